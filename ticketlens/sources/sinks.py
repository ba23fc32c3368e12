"""Append log, report documents and row export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_records(df: DataFrame, event: str) -> DataFrame:
    """Records for the audit log: time, event name and a digest in place of the input text."""
    out = df.withColumn(
        "ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ).withColumn("event", F.lit(event))
    if "input" in df.columns:
        out = out.withColumn("input_sha256", F.substring(F.sha2("input", 256), 1, 16))
        out = out.drop("input")
    first = ["ts", "event"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def append_audit(df: DataFrame, event: str, path: str) -> None:
    audit_records(df, event).write.mode("append").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Tidy metric rows (section, metric, value) as JSON lines."""
    metrics.select("section", "metric", "value").write.mode("overwrite").json(path)


def record_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON record with ISO dates."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
                     .alias("record"))
