"""Train/test split by time and stratified folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import CV_FOLDS, TEST_FRACTION
from ticketlens.operators.scale import exact_quantiles, number_by_digest


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def split_point(df: DataFrame, at: str, test_fraction: float = TEST_FRACTION) -> float:
    """The linear quantile of time (in microseconds) at which the test part starts."""
    return exact_quantiles(df.select(micros(at).alias("t")), "t", [1 - test_fraction])[0]


def temporal_split(
    df: DataFrame, at: str = "created_at", test_fraction: float = TEST_FRACTION
) -> tuple[DataFrame, DataFrame]:
    """Train on the past, test on the most recent rows."""
    cut = F.lit(split_point(df, at, test_fraction))
    return df.filter(micros(at) < cut), df.filter(micros(at) >= cut)


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = CV_FOLDS,
                     seed: int = 42) -> DataFrame:
    """Adds ``fold``: within each label the rows are put in the order of a seeded digest of their
    key and dealt out in turn, so fold sizes differ by at most one row per label."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    numbered = number_by_digest(df.withColumn("_digest", digest), [label], "_digest", "_number")
    fold = F.pmod(F.col("_number") - 1, F.lit(folds)).cast("long")
    return numbered.withColumn("fold", fold).drop("_digest", "_number")
