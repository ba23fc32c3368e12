"""Text, JSON-lines and CSV sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "question string, source string, intent string, answer_contains string, " \
         "aliases array<string>"
INCIDENTS = "date date, category string, description string"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row (source, raw) per ``*.md`` file, in the order of the file names."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("raw")
    ).orderBy("source")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set in JSON lines; blank lines are skipped, ``aliases`` may be missing. A broken
    line fails the read instead of becoming a row of NULLs."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)


def write_incidents(incidents: DataFrame, path: str) -> None:
    incidents.select("date", "category", "description").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INCIDENTS).option("header", True).csv(path)
