"""The named support analytics and the lookups around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    ALLOWED_RELATIONS,
    DISPLAY_LIMIT,
    LOW_CSAT,
    MAX_LIMIT,
    SLA_HOURS,
    TOP_CONTACTS,
)
from ticketlens.functions.sql_audit import (
    EXPRESSIONS,
    PLAN_NODES,
    UnsafeStatement,
    check_statement,
)


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / whole, 1)


def sla_target(priority: Column) -> Column:
    """Target hours; any priority without its own target gets the one for ``low``."""
    target = F.when(priority == "urgent", SLA_HOURS["urgent"])
    for name in ("high", "medium"):
        target = target.when(priority == name, SLA_HOURS[name])
    return target.otherwise(SLA_HOURS["low"])


def tickets_by_category(tickets: DataFrame) -> DataFrame:
    # The window runs over the few category rows, after the aggregation.
    everything = F.sum("tickets").over(Window.partitionBy())
    return (
        tickets.groupBy("category")
        .agg(
            F.count("*").alias("tickets"),
            F.round(F.avg("resolution_hours"), 1).alias("avg_resolution_h"),
            F.round(F.avg("csat"), 2).alias("avg_csat"),
        )
        .withColumn("share_pct", percent(F.col("tickets"), everything))
        .select("category", "tickets", "share_pct", "avg_resolution_h", "avg_csat")
        .orderBy(F.col("tickets").desc(), "category")
    )


def sla_breaches_by_priority(tickets: DataFrame) -> DataFrame:
    late = F.col("resolution_hours") > sla_target(F.col("priority"))
    return (
        tickets.filter(F.col("resolution_hours").isNotNull())
        .groupBy("priority")
        .agg(F.count("*").alias("resolved"), F.count_if(late).alias("breaches"))
        .withColumn("breach_rate_pct", percent(F.col("breaches"), F.col("resolved")))
        .orderBy(F.col("breach_rate_pct").desc(), "priority")
    )


def carrier_delay_ranking(orders: DataFrame) -> DataFrame:
    late = F.when(F.col("delivered_at") > F.col("estimated_delivery"), 1.0).otherwise(0.0)
    return (
        orders.filter(F.col("status") == "delivered")
        .groupBy("carrier")
        .agg(F.count("*").alias("deliveries"), F.avg(late).alias("late"))
        .select(
            "carrier",
            "deliveries",
            F.round(F.col("late") * 100.0, 1).alias("late_pct"),
            F.rank().over(Window.orderBy(F.col("late").desc())).cast("long").alias("delay_rank"),
        )
        .orderBy("delay_rank", "carrier")
    )


def monthly_volume(rows: DataFrame, at: str = "created_at") -> DataFrame:
    previous = F.lag("tickets").over(Window.orderBy("month"))
    growth = percent(F.col("tickets") - previous, previous)
    return (
        rows.groupBy(F.date_format(at, "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("tickets"))
        .withColumn("mom_growth_pct", growth)
        .orderBy("month")
    )


def csat_by_channel(tickets: DataFrame) -> DataFrame:
    low = F.count_if(F.col("csat") <= LOW_CSAT)
    return (
        tickets.filter(F.col("csat").isNotNull())
        .groupBy("channel")
        .agg(
            F.count("*").alias("tickets"),
            F.round(F.avg("csat"), 2).alias("avg_csat"),
            percent(low, F.count("*")).alias("detractors_pct"),
        )
        .orderBy(F.col("avg_csat").desc(), "channel")
    )


def top_contacting_customers(tickets: DataFrame, safe_customers: DataFrame) -> DataFrame:
    """Counts per (customer, category) first: a customer with very many tickets shrinks to one row
    per category before any shuffle, and the join sees one row per customer."""
    per_category = tickets.groupBy("customer_id", "category").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last")
    )
    per_customer = per_category.groupBy("customer_id").agg(
        F.sum("n").alias("tickets"),
        F.count("category").alias("distinct_categories"),
        F.max("last").alias("last_contact"),
    )
    return (
        per_customer.join(safe_customers.select("customer_id", "tier", "state"), "customer_id")
        .select("customer_id", "tier", "state", "tickets", "distinct_categories", "last_contact")
        .orderBy(F.col("tickets").desc(), "customer_id")
        .limit(TOP_CONTACTS)
    )


NAMED: dict[str, tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = {
    "tickets_by_category": (
        "How many tickets each category has, with resolution time and satisfaction",
        lambda t: tickets_by_category(t["tickets"]),
    ),
    "sla_breaches_by_priority": (
        "How often each priority misses its resolution target",
        lambda t: sla_breaches_by_priority(t["tickets"]),
    ),
    "carrier_delay_ranking": (
        "Carriers by their share of late deliveries",
        lambda t: carrier_delay_ranking(t["orders"]),
    ),
    "monthly_volume": (
        "Tickets per month and the change to the month before",
        lambda t: monthly_volume(t["tickets"]),
    ),
    "csat_by_channel": (
        "Satisfaction and rated tickets of each channel",
        lambda t: csat_by_channel(t["tickets"]),
    ),
    "top_contacting_customers": (
        "Who writes most often, without personal data",
        lambda t: top_contacting_customers(t["tickets"], t["v_customer_safe"]),
    ),
}


def run_named(name: str, relations: dict[str, DataFrame]) -> DataFrame:
    """One of the named analytics over ``tickets``, ``orders`` and ``v_customer_safe``."""
    if name not in NAMED:
        raise KeyError(f"Unknown analytics query '{name}'. Available: {sorted(NAMED)}")
    return NAMED[name][1](relations)


def named_answers(relations: dict[str, DataFrame], names: Sequence[str] = tuple(NAMED)) -> DataFrame:
    """(name, rows): the rows of each named query as one JSON array, in its order, at most
    ``DISPLAY_LIMIT`` of them. Every query runs once, however many questions ask for it."""
    parts = []
    for name in names:
        shown = display_rows(run_named(name, relations))
        rows = shown.select(F.monotonically_increasing_id().alias("at"),
                            F.to_json(F.struct(*shown.columns)).alias("row"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda r: r["row"])
        parts.append(rows.agg(F.lit(name).alias("name"), F.concat(
            F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("rows")))
    return reduce(DataFrame.unionByName, parts)


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(name, description) for name, (description, _) in NAMED.items()]
    return spark.createDataFrame(rows, "name string, description string")


def daily_counts(tickets: DataFrame, at: str = "created_at") -> DataFrame:
    return (
        tickets.groupBy(F.to_date(at).alias("day"), "category")
        .agg(F.count("*").alias("n"))
        .orderBy("day", "category")
    )


def order_lookup_batch(requests: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Each request with its order, or ``found = false`` when the order is absent or belongs to
    someone else. A request without ``customer_id`` is not bound to an owner."""
    o = orders.select(
        F.col("order_id").alias("_order_id"),
        F.col("customer_id").alias("_owner"),
        "status", "created_at", "estimated_delivery", "delivered_at", "carrier",
        "payment_method", "total_value",
    ).join(
        customers.select(F.col("customer_id").alias("_owner"), "tier"), "_owner"
    )
    mine = F.col("customer_id").isNull() | (F.col("customer_id") == F.col("_owner"))
    return requests.join(o, (F.col("order_id") == F.col("_order_id")) & mine, "left").select(
        "request_id",
        "order_id",
        F.col("_order_id").isNotNull().alias("found"),
        "status", "created_at", "estimated_delivery", "delivered_at", "carrier",
        "payment_method", "total_value", "tier",
        F.date_diff("delivered_at", "estimated_delivery").cast("long").alias("days_late"),
    )


def data_range(tickets: DataFrame) -> DataFrame:
    day = "yyyy-MM-dd"
    return tickets.agg(
        F.date_format(F.min("created_at"), day).alias("min_date"),
        F.date_format(F.max("created_at"), day).alias("max_date"),
    )


def _check_plan(session: SparkSession, plan: JavaObject) -> None:
    """Every node and expression of an analysed plan, in subqueries too, must be of a listed class, and
    every table an allowed view that was opened for the statement, whatever its text calls it. A CTE
    must not have the name of a table that exists."""

    def each(items: JavaObject) -> Iterator[JavaObject]:
        return (items.apply(i) for i in range(items.size()))

    def check_expression(expression: JavaObject) -> None:
        kind = expression.getClass().getSimpleName()
        if kind not in EXPRESSIONS:
            raise UnsafeStatement(f"function not allowed: {expression.prettyName()} ({kind})")
        for child in each(expression.children()):
            check_expression(child)

    kind = plan.getClass().getSimpleName()
    if kind == "View":
        name = plan.desc().identifier()
        if (not plan.isTempView() or name.database().isDefined()
                or name.table().lower() not in ALLOWED_RELATIONS):
            raise UnsafeStatement(f"relation not allowed: {name.unquotedString()}")
        return
    if kind not in PLAN_NODES:
        raise UnsafeStatement(f"relation or clause not allowed: {kind}")
    if kind == "CTERelationDef":
        own = plan.child().identifier().name()
        if own.lower() not in ALLOWED_RELATIONS and session.catalog.tableExists(own):
            raise UnsafeStatement(f"name of a table: {own}")
    for expression in each(plan.expressions()):
        check_expression(expression)
    for part in (*each(plan.subqueries()), *each(plan.children())):
        _check_plan(session, part)


def guarded_select(
    spark: SparkSession, sql: str, relations: Callable[[SparkSession], dict[str, DataFrame]]
) -> DataFrame:
    """Run one read-only SELECT over the allowed relations only, at most ``MAX_LIMIT`` rows.

    The statement must pass the text rules first, because ``spark.sql`` runs commands at once. It
    is then analysed, not run, in a session of its own, in which ``relations`` opens the allowed
    tables. A session still sees the catalog, so the analysed plan has to consist of listed nodes and
    functions over these tables alone."""
    safe = check_statement(spark, sql)
    isolated = spark.newSession()
    isolated.conf.set("spark.sql.runSQLOnFiles", "false")
    isolated.conf.set("spark.sql.session.timeZone", "UTC")
    for name, df in relations(isolated).items():
        if name in ALLOWED_RELATIONS:
            df.createOrReplaceTempView(name)
    try:
        found = isolated.sql(safe)
    except AnalysisException as error:
        if error.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        raise UnsafeStatement("relation not allowed or not there") from error
    _check_plan(isolated, found._jdf.queryExecution().analyzed())
    return found.limit(MAX_LIMIT)


def display_rows(result: DataFrame) -> DataFrame:
    """The rows shown with an answer."""
    return result.limit(DISPLAY_LIMIT)
