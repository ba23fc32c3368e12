"""Streaming jobs over the given tables, drained once; results equal those of the batch jobs (M),
and the sinks read back (S)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import mask_pii
from ticketlens.operators import monitoring as m
from ticketlens.operators import scores as sc
from ticketlens.plans.learning_plans import _models
from ticketlens.plans.learning_plans import ORACLE as LEARNING
from ticketlens.plans.series_plans import ORACLE as SERIES
from ticketlens.plans.text_plans import ORACLE as TEXT
from ticketlens.plans.views import Desk, with_views
from ticketlens.session import scratch_path
from ticketlens.sources import files, sinks
from ticketlens.sources.tables import TICKETS, read_table, write_table
from ticketlens.streaming import jobs


class LiveDesk(Desk):
    """The same views over arriving files."""

    def table(self, name: str) -> DataFrame:
        return jobs.read_stream(self.spark, self.folder, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")


def _daily(s, d):
    path = scratch_path(s, "daily")
    jobs.daily_counts_stream(LiveDesk(s, d).tickets, path, once=True).awaitTermination()
    return jobs.read_daily_counts(s, path)


def _drift(s, d):
    path = scratch_path(s, "drift")
    order = ["created_at", "ticket_id"]
    predictions = m.long_predictions(LiveDesk(s, d).tickets, ["category", "priority"], *order)
    jobs.drift_stream(predictions, order, path, once=True).awaitTermination()
    return m.current_distribution(jobs.read_drift_window(s, path))


def _triage(s, d):
    path = scratch_path(s, "triage")
    rows = LiveDesk(s, d).messages.select("message_id", "text")
    jobs.triage_stream(rows, *_models(s, d), path, once=True).awaitTermination()
    return s.read.parquet(path).select("message_id", "masked_text", "category", "priority")


def _rates(s, d):
    path = scratch_path(s, "rates")
    events = LiveDesk(s, d).table("events").select("event_id", "user_id", "ts")
    jobs.rate_stream(events, "user_id", "ts", "event_id", path, 86400, 3, once=True).awaitTermination()
    return s.read.parquet(path).select("event_id", "user_id", "ts", "accepted")


def _audit(s, d):
    path = scratch_path(s, "audit")
    rows = LiveDesk(s, d).messages.select("message_id", mask_pii(F.col("text")).alias("input"))
    jobs.audit_stream(rows, "agent_chat", path, once=True).awaitTermination()
    return s.read.schema("message_id long, event string, input_sha256 string").json(path)


def _audit_batch(s, d):
    path = scratch_path(s, "audit")
    rows = Desk(s, d).messages.select("message_id", mask_pii(F.col("text")).alias("input"))
    sinks.append_audit(rows, "agent_chat", path)
    return s.read.schema("message_id long, event string, input_sha256 string").json(path)


def _round_trip(s, d):
    """All tickets through the declared schema and back; a ticket without a text has an empty one."""
    path = scratch_path(s, "tables")
    rows = Desk(s, d).ticket_texts.withColumns({
        "order_id": F.lit(None).cast("long"), "subject": F.coalesce("source", F.lit("")),
        "body": F.coalesce("body", F.lit("")),
    })
    write_table(rows, f"{path}/tickets.parquet", TICKETS)
    return read_table(s, path, "tickets").select(
        "ticket_id", "customer_id", "created_at", "channel", "category", "priority", "status",
        "resolution_hours", F.col("csat").cast("long").alias("csat"), "body",
    )


def _incidents(s, d):
    path = scratch_path(s, "incidents")
    rows = Desk(s, d).daily.select(
        F.col("day").alias("date"), "category",
        F.concat(F.lit("volume "), F.col("n").cast("string")).alias("description"),
    )
    files.write_incidents(rows, path)
    return files.read_incidents(s, path)


def _golden(s, d):
    path = scratch_path(s, "golden")
    rows = Desk(s, d).table("benchmark").select(
        F.col("text").alias("question"), F.concat(F.lit("item"), "item_id").alias("source"),
        F.lit("knowledge").alias("intent"), F.substring("text", 1, 12).alias("answer_contains"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lower(F.substring("text", 1, 12))))
        .alias("aliases"),
    )
    rows.write.json(path)
    return files.read_golden(s, path).select(
        "question", "source", "intent", "answer_contains",
        F.array_join("aliases", "|").alias("aliases"),
    )


def _report(s, d):
    path = scratch_path(s, "report")
    predictions = Desk(s, d).predictions
    classes = sc.per_class(predictions)
    rows = classes.select(F.inline(F.array(*[
        F.struct(F.lit("priority").alias("section"),
                 F.concat("label", F.lit(f".{c}")).alias("metric"),
                 F.bround(F.col(c).cast("double"), 4).alias("value"))
        for c in ("precision", "recall", "f1", "support")
    ])))
    sinks.write_report(rows, path)
    return s.read.schema("section string, metric string, value double").json(path)


QUERIES = {
    "s2_write_table": _round_trip,
    "s5_read_golden": _golden,
    "s6_incidents_csv": _incidents,
    "s7_append_audit": _audit_batch,
    "s8_report_sink": _report,
    "m4_drift_stream": _drift,
    "m5_triage_stream": _triage,
    "m6_daily_counts_stream": _daily,
    "m7_rate_stream": _rates,
    "m10_audit_stream": _audit,
}

ORACLE = {
    "s2_write_table": with_views(
        """SELECT ticket_id, customer_id, created_at, channel, category, priority, status,
                  resolution_hours, csat::BIGINT AS csat, coalesce(body, '') AS body
           FROM ticket_texts_v""",
        "ticket_texts_v"),
    "s5_read_golden": """
        SELECT text AS question, 'item' || item_id AS source, 'knowledge' AS intent,
               substr(text, 1, 12) AS answer_contains,
               CASE WHEN item_id % 2 = 0 THEN lower(substr(text, 1, 12)) END AS aliases
        FROM benchmark""",
    "s6_incidents_csv": with_views(
        """SELECT day AS date, category, 'volume ' || n AS description FROM daily_v""",
        "daily_v"),
    "s7_append_audit": TEXT["s7_audit_digest"],
    "s8_report_sink": """
        SELECT 'priority' AS section, label || '.' || name AS metric, value FROM (
            SELECT label, unnest(['precision', 'recall', 'f1', 'support']) AS name,
                   unnest([precision, recall, f1, support::DOUBLE]) AS value
            FROM (""" + LEARNING["l11_per_class"] + "))",
    "m4_drift_stream": SERIES["m3_current_distribution"],
    "m6_daily_counts_stream": with_views(
        "SELECT CAST(created_at AS DATE) AS day, category, COUNT(*) AS n FROM tickets_v GROUP BY 1, 2",
        "tickets_v"),
    "m7_rate_stream": SERIES["m7_rate_decisions"],
    "m10_audit_stream": TEXT["s7_audit_digest"],
}
