"""Drift of predictions, request rates, latency histograms and labelled counters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    DRIFT_MIN_SAMPLES,
    DRIFT_WINDOW,
    LATENCY_BUCKETS,
    PSI_FLOOR,
    PSI_MODERATE,
    PSI_SIGNIFICANT,
    RATE_LIMIT,
    RATE_WINDOW_SECONDS,
)
from ticketlens.operators.scale import latest_rows


def distribution(rows: DataFrame) -> DataFrame:
    """Share of each value per field of (field, value, …)."""
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("field"))
    return counts.select("field", "value", (F.col("n") / whole).alias("share"), "n")


def long_predictions(rows: DataFrame, fields: list[str], *order: str) -> DataFrame:
    """(field, value, *order): one row per prediction and field."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])
    return rows.select(*order, F.inline(pairs))


def psi(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Population stability index per field over the union of values, shares floored."""
    e = expected.select("field", "value", F.col("share").alias("e"))
    a = actual.select("field", "value", F.col("share").alias("a"))
    both = e.join(a, ["field", "value"], "full_outer").select(
        "field",
        F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(PSI_FLOOR)).alias("e"),
        F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(PSI_FLOOR)).alias("a"),
    )
    term = (F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))
    return both.groupBy("field").agg(F.bround(F.sum(term), 4).alias("psi"))


def psi_status(value: Column) -> Column:
    return (
        F.when(value < PSI_MODERATE, "stable")
        .when(value < PSI_SIGNIFICANT, "moderate")
        .otherwise("significant")
    )


def drift_report(
    recent: DataFrame, reference: DataFrame, min_samples: int = DRIFT_MIN_SAMPLES
) -> DataFrame:
    """Status per field of ``reference`` for the windowed predictions ``recent`` (field, value).
    Fields without a reference are ignored; a thin window gives no index."""
    known = recent.join(F.broadcast(reference.select("field").distinct()), "field", "left_semi")
    actual = distribution(known)
    samples = known.groupBy("field").agg(F.count("*").alias("samples"))
    fields = reference.select("field").distinct().join(samples, "field", "left")
    enough = F.col("samples") >= min_samples
    return (
        fields.withColumn("samples", F.coalesce("samples", F.lit(0)))
        .join(psi(reference, actual), "field", "left")
        .select(
            "field",
            "samples",
            F.when(enough, F.col("psi")).alias("psi"),
            F.when(enough, psi_status(F.col("psi"))).otherwise("insufficient_data")
            .alias("status"),
        )
    )


def drift_window(predictions: DataFrame, order: list[str], window: int = DRIFT_WINDOW) -> DataFrame:
    """The most recent ``window`` predictions of each field."""
    return latest_rows(predictions, ["field"], order, window)


def current_distribution(recent: DataFrame) -> DataFrame:
    return distribution(recent).select("field", "value", F.bround("share", 3).alias("share"))


def range_counts(
    requests: DataFrame, key: str, at: str, window: int = RATE_WINDOW_SECONDS,
    span_windows: int = 60,
) -> DataFrame:
    """Adds ``in_window``: requests of the same key from ``window`` seconds before up to now.

    A busy key is cut into time spans; rows at the end of a span are repeated as context for the
    next one, so each span is counted on its own and no task gets all rows of a key."""
    span = window * span_windows
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1000000
    own = F.floor(seconds / span)
    touches_next = own + 1 == F.floor((seconds + window) / span)
    spans = F.when(touches_next, F.array(own, own + 1)).otherwise(F.array(own))
    rows = requests.withColumn("_own", own).withColumn("_span", F.explode(spans))
    frame = (
        Window.partitionBy(key, "_span")
        .orderBy(F.unix_micros(F.col(at).cast("timestamp")))
        .rangeBetween(-window * 1000000, Window.currentRow)
    )
    return (
        rows.withColumn("in_window", F.count("*").over(frame))
        .filter(F.col("_span") == F.col("_own"))
        .drop("_own", "_span")
    )


def rate_decisions(
    requests: DataFrame, key: str, at: str, order: str, window: int = RATE_WINDOW_SECONDS,
    limit: int = RATE_LIMIT, before: DataFrame | None = None,
) -> DataFrame:
    """Adds ``accepted`` by the sequential rule: a request is rejected when ``limit`` accepted
    requests of its key lie in the last ``window`` seconds; rejected ones do not count. ``before``
    has requests (same columns) that were accepted earlier; they count and are not returned.

    Where fewer than ``limit`` requests fall into two neighbouring windows nothing can be
    rejected, so only runs of busy windows are decided one request after the other, each run on
    its own with the window before it as context. The decision keeps at most ``limit`` times."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.withColumn("_given", F.lit(False))
    if before is not None:
        rows = rows.unionByName(before.select(requests.columns).withColumn("_given", F.lit(True)))
    rows = rows.withColumn("_t", micros).withColumn("_w", F.floor(F.col("_t") / (window * 1000000)))
    per_window = rows.groupBy(key, "_w").agg(F.count("*").alias("_n"))
    by_time = Window.partitionBy(key).orderBy("_w")
    before = F.when(F.lag("_w").over(by_time) == F.col("_w") - 1, F.lag("_n").over(by_time))
    busy = per_window.withColumn(
        "_busy", F.col("_n") + F.coalesce(before, F.lit(0)) > limit
    ).filter("_busy")
    new_run = F.coalesce(F.col("_w") - F.lag("_w").over(by_time) > 1, F.lit(True))
    runs = busy.withColumn("_start", F.when(new_run, F.col("_w"))).withColumn(
        "_run", F.last("_start", True).over(by_time)
    ).select(key, "_w", "_run")
    context = runs.filter(F.col("_w") == F.col("_run")).select(
        key, (F.col("_w") - 1).alias("_w"), F.col("_run")
    )
    involved = runs.withColumn("_context", F.lit(False)).unionByName(
        context.withColumn("_context", F.lit(True))
    )
    # A quiet window right before a run is accepted as it stands and serves as context as well.
    quiet = rows.join(runs, [key, "_w"], "left_anti").filter("NOT _given").withColumn(
        "accepted", F.lit(True))
    crowded = rows.join(involved, [key, "_w"])
    columns = requests.columns
    out_fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields]
    window_micros = window * 1000000

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, accepted = None, deque()
        for batch in batches:
            flags = []
            keys, starts = batch[key].tolist(), batch["_run"].tolist()
            for k, s, t, given in zip(keys, starts, batch["_t"].tolist(), batch["_given"].tolist()):
                if (k, s) != run:
                    run, accepted = (k, s), deque()
                while accepted and t - accepted[0] > window_micros:
                    accepted.popleft()
                ok = given or len(accepted) < limit
                if ok:
                    accepted.append(t)
                flags.append(ok)
            decided = batch.assign(accepted=flags)
            returned = ~decided["_context"].astype(bool) & ~decided["_given"].astype(bool)
            yield decided.loc[returned, [*columns, "accepted"]]

    ordered = (
        crowded.repartition(F.col(key), F.col("_run"))
        .sortWithinPartitions(key, "_run", "_t", order)
        .select(*columns, "_run", "_t", "_context", "_given")
    )
    decided = ordered.mapInPandas(decide, ", ".join([*out_fields, "accepted boolean"]))
    return quiet.select(*columns, "accepted").unionByName(decided)


def latency_histogram(requests: DataFrame, route: str, seconds: str) -> DataFrame:
    """Cumulative buckets, sum and count per route: (route, le, requests, total_seconds)."""
    names = [f"{b:g}" for b in LATENCY_BUCKETS] + ["+Inf"]
    counted = requests.groupBy(F.col(route).alias("route")).agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BUCKETS)],
        F.count("*").alias(f"b{len(LATENCY_BUCKETS)}"),
        F.sum(seconds).alias("sum"),
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("le"), F.col(f"b{i}").alias("requests"))
        for i, n in enumerate(names)
    ])
    return counted.select("route", F.round("sum", 6).alias("total_seconds"), F.inline(rows))


def labelled_counters(events: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Count per label combination of one counter; labels in alphabetical order."""
    text = F.concat_ws(",", *[
        F.concat(F.lit(f'{label}="'), F.col(label).cast("string"), F.lit('"'))
        for label in sorted(labels)
    ])
    return events.groupBy(*labels).agg(F.count("*").alias("value")).select(
        F.lit(name).alias("name"), text.alias("labels"), "value"
    )
