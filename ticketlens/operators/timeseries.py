"""Daily volumes, weekday-adjusted robust z-scores and incident alerts.

The rows here are days: the ticket table has been counted per day and category before anything
in this module orders or windows it, so a window over all days is a window over a few thousand
rows whatever the size of the ticket table. The z-scores run in long form, one partition per
series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    BASELINE_DAYS,
    BASELINE_MIN_DAYS,
    MAD_TO_SIGMA,
    Z_THRESHOLD,
)


def series_columns(categories: list[str]) -> list[str]:
    """Column names ``c0, c1, …`` for the categories, which may hold any characters."""
    return [f"c{i}" for i in range(len(categories))]


def daily_matrix(counts: DataFrame, categories: list[str]) -> DataFrame:
    """One row per calendar day from the first to the last, one column per listed category, 0 for
    missing days and pairs, and their ``total``. Other categories are dropped."""
    columns = series_columns(categories)
    wide = counts.groupBy("day").agg(*[
        F.coalesce(F.sum(F.when(F.col("category") == name, F.col("n"))), F.lit(0)).alias(c)
        for name, c in zip(categories, columns)
    ])
    # The gap after each day is filled by that day's row; no second pass over the counts.
    following = F.lead("day").over(Window.orderBy("day"))
    last = F.coalesce(F.date_sub(following, 1), F.col("day"))
    filled = wide.withColumn("_last", last).select(
        "day",
        F.explode(F.sequence("day", "_last")).alias("_day"),
        *columns,
    )
    own = F.col("day") == F.col("_day")
    return filled.select(
        F.col("_day").alias("day"),
        *[F.when(own, F.col(c)).otherwise(0).alias(c) for c in columns],
    ).withColumn("total", reduce(Column.__add__, [F.col(c) for c in columns]))


def weekday_factor(matrix: DataFrame) -> DataFrame:
    """Mean total of the weekday over the whole history, divided by the mean total."""
    same_weekday = F.avg("total").over(Window.partitionBy(F.weekday("day")))
    return matrix.withColumn(
        "weekday_factor", same_weekday / F.avg("total").over(Window.partitionBy())
    )


def to_series(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (day, series, x, …): one row per day and column."""
    kept = [c for c in matrix.columns if c not in columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in columns
    ])
    return matrix.select(*kept, F.inline(pairs))


def robust_z(series: DataFrame) -> DataFrame:
    """Adds ``adj, med, mad, z`` to (day, series, x, weekday_factor). The baseline of a day is
    the median of the days before it; its spread is the median of the recent one-day-back
    deviations, each taken from the median of its own day."""
    ordered = Window.partitionBy("series").orderBy("day")
    before = ordered.rowsBetween(-BASELINE_DAYS, -1)
    recent = ordered.rowsBetween(-(BASELINE_DAYS - 1), 0)

    def median(name: str, frame) -> Column:
        enough = F.count(name).over(frame) >= BASELINE_MIN_DAYS
        return F.when(enough, F.percentile(name, 0.5).over(frame))

    return (
        series.withColumn("adj", F.try_divide(F.col("x"), F.col("weekday_factor")))
        .withColumn("med", median("adj", before))
        .withColumn("dev", F.abs(F.lag("adj").over(ordered) - F.col("med")))
        .withColumn("mad", median("dev", recent))
        .withColumn(
            "z",
            F.greatest(
                F.lit(0.0),
                F.coalesce(
                    (F.col("adj") - F.col("med")) / (MAD_TO_SIGMA * F.col("mad") + 1.0),
                    F.lit(0.0),
                ),
            ),
        )
        .drop("dev")
    )


def features(matrix: DataFrame, categories: list[str]) -> DataFrame:
    """Per day: ``z_c0 … z_total`` and the share of the largest category."""
    columns = series_columns(categories)
    names = [*columns, "total"]
    long = to_series(weekday_factor(matrix).select("day", "weekday_factor", *names), names)
    z = robust_z(long).groupBy("day").agg(
        *[F.max(F.when(F.col("series") == c, F.col("z"))).alias(f"z_{c}") for c in names],
        *[F.max(F.when(F.col("series") == c, F.col("x"))).alias(c) for c in names],
    )
    largest = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    share = largest / F.greatest(F.col("total"), F.lit(1.0))
    return z.select("day", *[f"z_{c}" for c in names], share.alias("share_max"))


def driver(feats: DataFrame, categories: list[str]) -> DataFrame:
    """Adds the category with the largest z (the first listed on ties) and that z."""
    columns = [f"z_{c}" for c in series_columns(categories)]
    top = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    name = F.when(F.lit(False), F.lit(""))
    for category, c in zip(categories, columns):
        name = name.when(F.col(c) == F.col("_top"), F.lit(category))
    return (
        feats.withColumn("_top", top)
        .withColumn("driver_category", name)
        .withColumn("driver_z", F.bround("_top", 2))
    )


def score_robust_z(
    feats: DataFrame, categories: list[str], threshold: float = Z_THRESHOLD
) -> DataFrame:
    return driver(feats, categories).select(
        "day",
        F.col("_top").alias("anomaly_score"),
        (F.col("_top") > threshold).alias("is_anomaly"),
        "driver_category",
        "driver_z",
    )


def detection_metrics(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Day-level tp, fp, fn, precision, recall and f1 against the days of ``truth``."""
    days = truth.select("day").distinct().withColumn("_true", F.lit(True))
    marked = scored.join(days, "day", "left").withColumn("_true", F.col("_true").isNotNull())
    hit, true = F.col("is_anomaly"), F.col("_true")
    counts = marked.agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
    )
    tp = F.col("tp")
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(tp, tp + F.col("fn")), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    return counts.select(
        "tp", "fp", "fn",
        F.bround(precision, 3).alias("precision"),
        F.bround(recall, 3).alias("recall"),
        F.bround(f1, 3).alias("f1"),
    )


def top_anomalies(scored: DataFrame, k: int = 10) -> DataFrame:
    return (
        scored.filter("is_anomaly")
        .orderBy(F.col("anomaly_score").desc(), "day")
        .limit(k)
        .select("day", F.bround("anomaly_score", 3).alias("score"), "driver_category", "driver_z")
    )


def incidents(
    counts: DataFrame, categories: list[str], days: int = 30, score=score_robust_z
) -> DataFrame:
    """Alerts among the last ``days`` days; baselines come from the full history."""
    scored = score(features(daily_matrix(counts, categories), categories), categories)
    recent = scored.orderBy(F.col("day").desc()).limit(days)
    scored_days = recent.agg(F.count("*").alias("days_scored"))
    return top_anomalies(recent, days).join(F.broadcast(scored_days), F.lit(True), "left")


def champion(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """The method with the best f1; the first listed wins ties."""
    rows = [
        metrics.select(F.lit(name).alias("method"), F.lit(i).alias("_order"), *metrics.columns)
        for i, (name, metrics) in enumerate(results)
    ]
    union = reduce(DataFrame.unionByName, rows)
    return union.orderBy(F.col("f1").desc(), "_order").limit(1).drop("_order")


def mean_by_weekday(daily_totals: DataFrame) -> DataFrame:
    """Mean rows per day name over all days from the first to the last, empty days included."""
    return (
        daily_totals.groupBy(F.date_format("day", "EEEE").alias("weekday"))
        .agg(F.round(F.avg("total"), 1).alias("avg_per_day"))
        .orderBy("weekday")
    )
