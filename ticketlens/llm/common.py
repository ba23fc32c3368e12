"""Small helpers of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after limiting what is sent to a Python worker at once, for the session: texts are
    long, and a task's memory holds a batch several times."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def sized_batches(df: DataFrame, rows: int = 10_000, size: int = 8 << 20) -> DataFrame:
    """As ``bounded_batches``, by bytes as well: a batch ends after ``size`` bytes or ``rows`` rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return bounded_batches(df, rows)
