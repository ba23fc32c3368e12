"""Figures of the exploratory report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.operators.analytics import percent, sla_target
from ticketlens.operators.scale import running_share
from ticketlens.session import materialise


def ticket_frame(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """Tickets with the customer's tier; an unresolved ticket counts as not breached."""
    late = F.col("resolution_hours") > sla_target(F.col("priority"))
    return tickets.join(customers.select("customer_id", "tier"), "customer_id").withColumn(
        "sla_breached", F.coalesce(late, F.lit(False))
    )


def null_percentage(df: DataFrame) -> DataFrame:
    shares = df.agg(*[
        percent(F.count_if(F.col(c).isNull()), F.count("*")).alias(c) for c in df.columns
    ])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_pct")) for c in df.columns
    ])
    return shares.select(F.inline(pairs)).filter(F.col("null_pct") > 0)


def share_percent(df: DataFrame, field: str) -> DataFrame:
    return (
        df.groupBy(F.col(field).alias("value"))
        .agg(F.count("*").alias("n"))
        .select("value", percent(F.col("n"), F.sum("n").over(Window.partitionBy()))
                .alias("share_pct"))
        .orderBy(F.col("share_pct").desc(), "value")
    )


def crosstab_percent(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` x ``column`` as percentages of each column; ``values`` fixes the columns."""
    total = F.sum("n").over(Window.partitionBy(column))
    return (
        df.groupBy(row, column)
        .agg(F.count("*").alias("n"))
        .withColumn("pct", percent(F.col("n"), total))
        .groupBy(row)
        .pivot(column, values)
        .agg(F.first("pct"))
        .na.fill(0.0)
    )


def csat_by_breach(frame: DataFrame) -> DataFrame:
    return frame.groupBy("sla_breached").agg(F.round(F.avg("csat"), 2).alias("avg_csat"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks on ties. The rows shrink to distinct (x, y) pairs with
    counts first; ranks come from the histogram of each column, and the Pearson sums are taken
    over the pairs. No row-level global sort."""
    pairs = (
        df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .dropna()
        .groupBy("x", "y")
        .agg(F.count("*").alias("n"))
    )
    pairs = materialise(pairs, "rank-pairs")
    for c in ("x", "y"):
        hist = materialise(pairs.groupBy(c).agg(F.sum("n").alias("w")), "rank-histogram")
        ranks = running_share(hist, c, "w", "before").select(
            c, (F.col("before") + (F.col("w") + 1) / 2).alias(f"rank_{c}")
        )
        pairs = pairs.join(ranks, c)
    # Deviations from the known mean rank (n + 1) / 2 keep the sums exact enough at any size.
    total = pairs.agg(F.sum("n").alias("_total"))
    dx = F.col("rank_x") - (F.col("_total") + 1) / 2
    dy = F.col("rank_y") - (F.col("_total") + 1) / 2
    sums = pairs.join(F.broadcast(total), F.lit(True)).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * dx * dy).alias("xy"),
        F.sum(F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("n") * dy * dy).alias("yy"),
    )
    bottom = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select("n", F.round(F.try_divide(F.col("xy"), bottom), 6).alias("spearman"))


def late_by_carrier(orders: DataFrame) -> DataFrame:
    late = F.count_if(F.col("delivered_at") > F.col("estimated_delivery"))
    return (
        orders.filter(F.col("delivered_at").isNotNull())
        .groupBy("carrier")
        .agg(percent(late, F.count("*")).alias("late_pct"))
        .orderBy(F.col("late_pct").desc(), "carrier")
    )


def length_quantiles(df: DataFrame, text: str) -> DataFrame:
    """Median and 95th percentile of text length. The rows are first counted per length, so the
    percentile sees at most one row per distinct length."""
    hist = df.groupBy(F.length(text).alias("chars")).agg(F.count("*").alias("n"))
    return hist.agg(
        F.round(F.percentile("chars", 0.5, F.col("n")), 6).alias("median_chars"),
        F.round(F.percentile("chars", 0.95, F.col("n")), 6).alias("p95_chars"),
    )
