"""Streaming forms of the batch jobs: triage, daily counts, drift window, rate limit, audit log.

Every job names its checkpoint, writes through an idempotent sink and keeps a bounded state, so it
can be restarted after the loss of executors or of the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketlens.fixed_values import DRIFT_WINDOW, RATE_LIMIT, RATE_WINDOW_SECONDS
from ticketlens.operators.analytics import daily_counts
from ticketlens.operators.classify import classify_masked
from ticketlens.operators.monitoring import rate_decisions
from ticketlens.operators.scale import latest_rows
from ticketlens.sources.sinks import audit_records


COUNTED = "day date, category string, n long, batch long"
FOLDED = "day date, category string, n long, upto long, rows long"


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Files of one table as they arrive: ``folder/name*.parquet``, files or directories of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def triage_stream(
    rows: DataFrame, category_model: PipelineModel, priority_model: PipelineModel, path: str,
    once: bool = False,
) -> StreamingQuery:
    """Arriving texts, masked and classified: one folder per micro-batch of a parquet table, written
    anew if a micro-batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        done = classify_masked(batch, category_model, priority_model)
        done.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(rows.writeStream.foreachBatch(write), f"{path}-checkpoint", once)


def audit_stream(rows: DataFrame, event: str, path: str, once: bool = False) -> StreamingQuery:
    """The audit log as a JSON sink; input texts leave as digests only."""
    writer = audit_records(rows, event).writeStream.format("json").outputMode("append")
    return _start(writer.option("path", path), f"{path}-checkpoint", once)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*[
            c.split(" ")[0] for c in schema.split(", ")])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _folded_counts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest complete fold and the micro-batch up to which it counts. A fold says how many rows it
    has, so one that was interrupted is seen as such."""
    best, upto = spark.createDataFrame([], FOLDED), -1
    for side in (0, 1):
        rows = _written(spark, f"{path}/folded/side={side}", FOLDED)
        found = rows.agg(F.max("upto"), F.max("rows"), F.count("*")).first()
        if found[0] is not None and found[1] == found[2] and found[0] > upto:
            best, upto = rows, found[0]
    return best, upto


def _newer_counts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    folded, upto = _folded_counts(spark, path)
    newer = _written(spark, f"{path}/ring", COUNTED).filter(F.col("batch") > upto)
    both = folded.select("day", "category", "n").unionByName(newer.select("day", "category", "n"))
    return both.groupBy("day", "category").agg(F.sum("n").alias("n")), upto


def daily_counts_stream(tickets: DataFrame, path: str, once: bool = False,
                        ring: int = 64) -> StreamingQuery:
    """Counts per (day, category) of every micro-batch. Nothing is held between micro-batches, so a
    row counts however late it is.

    Micro-batches take turns in ``ring`` folders. The last of a round folds them into one table, on the
    side that the fold before it did not use; readers add only what is newer than the fold they use,
    so a micro-batch that is repeated, before or after its round was folded, changes nothing and
    the number of folders stays the same."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = daily_counts(batch).withColumn("batch", F.lit(batch_id).cast("long"))
        counts.write.mode("overwrite").parquet(f"{path}/ring/slot={batch_id % ring}")
        if (batch_id + 1) % ring == 0:
            rows, upto = _newer_counts(spark, path)
            if upto < batch_id:
                marks = {"upto": F.lit(batch_id).cast("long"), "rows": F.lit(rows.count()).cast("long")}
                side = batch_id // ring % 2
                rows.withColumns(marks).write.mode("overwrite").parquet(f"{path}/folded/side={side}")

    writer = tickets.writeStream.outputMode("append").foreachBatch(append)
    return _start(writer, f"{path}-checkpoint", once)


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every (day, category) over all micro-batches so far."""
    return _newer_counts(spark, path)[0]


def drift_stream(
    predictions: DataFrame, order: list[str], path: str, window: int = DRIFT_WINDOW,
    once: bool = False,
) -> StreamingQuery:
    """The most recent ``window`` predictions per field of (field, value, *order).

    A micro-batch is first cut to its own most recent rows, then merged with the window before it.
    Two slots take turns, so a repeated micro-batch finds the slot it started from unchanged."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            before = batch.sparkSession.read.schema(batch.schema)
            rows = rows.unionByName(before.parquet(f"{path}/slot={(batch_id - 1) % 2}"))
        kept = latest_rows(rows, ["field"], order, window)
        kept.write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")
        last = batch.sparkSession.createDataFrame([(batch_id,)], "batch_id long")
        last.write.mode("append").json(f"{path}-batches")

    writer = predictions.writeStream.outputMode("append").foreachBatch(merge)
    return _start(writer, f"{path}-checkpoint", once)


def read_drift_window(spark: SparkSession, path: str) -> DataFrame:
    done = spark.read.schema("batch_id long").json(f"{path}-batches")
    last = done.agg(F.max("batch_id")).first()[0]
    return spark.read.parquet(f"{path}/slot={last % 2}")


def rate_stream(
    requests: DataFrame, key: str, at: str, order: str, path: str,
    window: int = RATE_WINDOW_SECONDS, limit: int = RATE_LIMIT, once: bool = False,
    lateness: int = 0,
) -> StreamingQuery:
    """The sequential rate rule on arriving requests, decided micro-batch by micro-batch with the batch
    rule, which takes a busy key apart into stretches.

    What is kept between micro-batches is a table of accepted requests that can still matter: those
    not older than ``window`` + ``lateness`` seconds before the newest request of all. A key that has
    gone quiet leaves nothing behind, and no request is dropped: one that comes later than
    ``lateness`` is judged with what is known by then. Two slots take turns, so a repeated
    micro-batch finds the slot it started from unchanged."""
    columns = [key, at, order]

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, None
        if batch_id > 0:
            schema = batch.select(columns).schema
            before = spark.read.schema(schema).parquet(f"{path}-accepted/slot={(batch_id - 1) % 2}")
        decided = f"{path}/batch={batch_id}"
        rate_decisions(batch.select(columns), key, at, order, window, limit, before).write.mode(
            "overwrite").parquet(decided)
        known = spark.read.parquet(decided)
        accepted = known.filter("accepted").select(columns)
        newest = known.select(at)
        if before is not None:
            accepted, newest = accepted.unionByName(before), newest.unionByName(before.select(at))
        last = newest.agg(F.max(F.unix_micros(F.col(at).cast("timestamp")))).first()[0]
        oldest = (last or 0) - (window + lateness) * 1_000_000
        accepted.filter(F.unix_micros(F.col(at).cast("timestamp")) >= oldest).write.mode(
            "overwrite").parquet(f"{path}-accepted/slot={batch_id % 2}")

    writer = requests.writeStream.outputMode("append").foreachBatch(decide)
    return _start(writer, f"{path}-checkpoint", once)
