"""Sources, named analytics, data quality and report figures (S, A, Q, X)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import clean_text
from ticketlens.operators import analytics as a
from ticketlens.operators import quality as q
from ticketlens.operators import report as x
from ticketlens.plans.oracle_text import CLEAN
from ticketlens.plans.views import Desk, with_views
from ticketlens.sources.tables import safe_customer_view

GUARDED = (
    "WITH t AS (SELECT * FROM tickets) SELECT priority, channel, COUNT(*) AS n, "
    "MAX(resolution_hours) AS longest_h FROM t GROUP BY priority, channel LIMIT 1000"
)


def _guarded(spark, folder):
    return a.guarded_select(spark, GUARDED, lambda session: _relations(session, folder))


#: a key and a figure of each named query
NAMED_FIGURES = {
    "tickets_by_category": ("category", "tickets"),
    "sla_breaches_by_priority": ("priority", "breaches"),
    "carrier_delay_ranking": ("carrier", "delay_rank"),
    "monthly_volume": ("month", "tickets"),
    "csat_by_channel": ("channel", "avg_csat"),
    "top_contacting_customers": ("customer_id", "tickets"),
}


def _relations(spark, folder):
    desk = Desk(spark, folder)
    return {"tickets": desk.tickets, "orders": desk.orders,
            "v_customer_safe": safe_customer_view(desk.customers)}


def _named(spark, folder):
    """The catalogue with the rows of every query in it."""
    relations = _relations(spark, folder)
    rows = [a.run_named(name, relations).select(
        F.lit(name).alias("name"), F.col(key).cast("string").alias("key"),
        F.col(figure).cast("double").alias("figure"))
        for name, (key, figure) in NAMED_FIGURES.items()]
    return a.catalogue(spark).join(reduce(DataFrame.unionByName, rows), "name")


def _texts(spark, folder):
    desk = Desk(spark, folder)
    safe = safe_customer_view(desk.customers)
    return (
        desk.ticket_texts.join(safe.select("customer_id", "tier"), "customer_id")
        .select("ticket_id", "created_at", "channel", "category", "priority", "tier",
                clean_text(F.col("body")).alias("text"))
        .orderBy("created_at", "ticket_id")
    )


SLA_CASE = (
    "CASE priority WHEN 'urgent' THEN 8 WHEN 'high' THEN 24 WHEN 'medium' THEN 48 ELSE 120 END"
)
CATEGORY_LIST = ["click", "error", "login", "purchase", "view"]

QUERIES = {
    "s1_read_table": lambda s, d: Desk(s, d).table("supplier"),
    "s3_safe_customer_view": lambda s, d: safe_customer_view(Desk(s, d).customers),
    "a1_tickets_by_category": lambda s, d: a.tickets_by_category(Desk(s, d).tickets),
    "a2_sla_breaches_by_priority": lambda s, d: a.sla_breaches_by_priority(Desk(s, d).tickets),
    "a3_carrier_delay_ranking": lambda s, d: a.carrier_delay_ranking(Desk(s, d).orders),
    "a4_monthly_volume": lambda s, d: a.monthly_volume(Desk(s, d).orders),
    "a5_csat_by_channel": lambda s, d: a.csat_by_channel(Desk(s, d).tickets),
    "a6_top_contacting_customers": lambda s, d: a.top_contacting_customers(
        Desk(s, d).tickets, safe_customer_view(Desk(s, d).customers)
    ),
    "a7_run_named": _named,
    "a8_daily_counts": lambda s, d: a.daily_counts(Desk(s, d).tickets),
    "a9_order_lookup_batch": lambda s, d: a.order_lookup_batch(
        Desk(s, d).requests, Desk(s, d).order_heads, Desk(s, d).customers
    ),
    "a10_data_range": lambda s, d: a.data_range(Desk(s, d).tickets),
    "a11_training_frame": _texts,
    "a12_guarded_select": _guarded,
    "p28_guarded_union": lambda s, d: a.guarded_select(
        s,
        "SELECT status, COUNT(*) AS n FROM tickets GROUP BY status "
        "UNION SELECT status, COUNT(*) AS n FROM orders GROUP BY status",
        lambda session: {"tickets": Desk(session, d).tickets, "orders": Desk(session, d).orders},
    ),
    "q1_quality_issues": lambda s, d: q.quality_issues(
        Desk(s, d).ticket_marks, ["click", "error", "view"], ["low", "medium", "high", "urgent"]
    ),
    "q3_declared_constraints": lambda s, d: q.constraint_violations(
        Desk(s, d).customers, "customer_id", ["customer_id", "name", "state", "tier"],
        {"tier": ["standard", "silver"]},
    ),
    "q4_referential_integrity": lambda s, d: q.orphan_rows([
        ("orders.customer_id", Desk(s, d).orders, "customer_id", Desk(s, d).customers,
         "customer_id"),
        ("tickets.customer_id", Desk(s, d).tickets, "customer_id", Desk(s, d).customers,
         "customer_id"),
        ("requests.order_id", Desk(s, d).requests, "order_id", Desk(s, d).order_heads,
         "order_id"),
    ]),
    "q5_profile": lambda s, d: q.profile(Desk(s, d).ticket_marks, F.col("body_chars")),
    "q6_fingerprint": lambda s, d: q.fingerprint(Desk(s, d).tickets, ["ticket_id", "category"]),
    "x1_ticket_tier_frame": lambda s, d: x.ticket_frame(
        Desk(s, d).tickets, Desk(s, d).customers
    ).select("ticket_id", "customer_id", "priority", "tier", "resolution_hours", "sla_breached"),
    "x2_null_percentage": lambda s, d: x.null_percentage(Desk(s, d).tickets),
    "x3_category_share": lambda s, d: x.share_percent(Desk(s, d).tickets, "category"),
    "x3_priority_by_tier": lambda s, d: x.crosstab_percent(
        x.ticket_frame(Desk(s, d).tickets, Desk(s, d).customers),
        "priority", "tier", ["gold", "silver", "standard"],
    ),
    "x4_csat_by_breach": lambda s, d: x.csat_by_breach(
        x.ticket_frame(Desk(s, d).tickets, Desk(s, d).customers)
    ),
    "x5_spearman": lambda s, d: x.spearman(Desk(s, d).tickets, "resolution_hours", "csat"),
    "x6_late_by_carrier": lambda s, d: x.late_by_carrier(Desk(s, d).orders),
    "x7_body_length": lambda s, d: x.length_quantiles(Desk(s, d).documents, "text"),
}

_DAY = "CAST(created_at AS DATE)"


def _monthly_sql(view: str) -> str:
    return with_views(
        """SELECT month, n AS tickets, ROUND((n - previous) * 100::DOUBLE / previous, 1)
                  AS mom_growth_pct FROM chained""", view,
        extra=f"""months AS (SELECT substr(CAST(created_at AS VARCHAR), 1, 7) AS month,
                                    COUNT(*) AS n FROM {view} GROUP BY 1),
                 chained AS (SELECT *, LAG(n) OVER (ORDER BY month) AS previous FROM months)""")


ORACLE = {
    "s1_read_table": "SELECT * FROM supplier",
    "s3_safe_customer_view": with_views("SELECT * FROM customer_safe_v", "customer_safe_v"),
    "a1_tickets_by_category": with_views(
        """SELECT category, n AS tickets, ROUND(n * 100::DOUBLE / everything, 1) AS share_pct,
                  ROUND(hours, 1) AS avg_resolution_h, ROUND(score, 2) AS avg_csat
           FROM counted, total""", "tickets_v",
        extra="""counted AS (SELECT category, COUNT(*) AS n, AVG(resolution_hours) AS hours,
                                    AVG(csat) AS score FROM tickets_v GROUP BY category),
                 total AS (SELECT SUM(n) AS everything FROM counted)"""),
    "a2_sla_breaches_by_priority": with_views(
        f"""SELECT priority, COUNT(*) AS resolved,
                  COUNT(*) FILTER (WHERE resolution_hours > {SLA_CASE}) AS breaches,
                  ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE resolution_hours > {SLA_CASE})
                        / COUNT(*), 1) AS breach_rate_pct
           FROM tickets_v WHERE resolution_hours IS NOT NULL GROUP BY priority""", "tickets_v"),
    "a3_carrier_delay_ranking": with_views(
        """SELECT carrier, n AS deliveries, ROUND(late * 100::DOUBLE / n, 1) AS late_pct,
                  1 + (SELECT COUNT(*) FROM carried w WHERE w.late * c.n > c.late * w.n) AS delay_rank
           FROM carried c""", "orders_v",
        extra="""carried AS (SELECT carrier, COUNT(*) AS n,
                                    COUNT(*) FILTER (WHERE delivered_at > estimated_delivery) AS late
                             FROM orders_v WHERE status = 'delivered' GROUP BY carrier)"""),
    "a4_monthly_volume": _monthly_sql("orders_v"),
    "a5_csat_by_channel": with_views(
        """SELECT channel, rated AS tickets, ROUND(points::DOUBLE / rated, 2) AS avg_csat,
                  ROUND(low * 100::DOUBLE / rated, 1) AS detractors_pct FROM channels""", "tickets_v",
        extra="""scores AS (SELECT channel, csat, COUNT(*) AS n FROM tickets_v
                            WHERE csat IS NOT NULL GROUP BY channel, csat),
                 channels AS (SELECT channel, SUM(n)::BIGINT AS rated, SUM(n * csat) AS points,
                                     SUM(CASE WHEN csat <= 2 THEN n ELSE 0 END) AS low
                              FROM scores GROUP BY channel)"""),
    "a6_top_contacting_customers": with_views(
        """SELECT customer_id, tier, state, tickets, distinct_categories, last_contact
           FROM ranked WHERE place <= 10""", "tickets_v", "customer_safe_v",
        extra="""per_category AS (SELECT customer_id, category, COUNT(*) AS n,
                                         MAX(created_at) AS latest FROM tickets_v GROUP BY 1, 2),
                 per_customer AS (SELECT customer_id, SUM(n)::BIGINT AS tickets,
                                         COUNT(category) AS distinct_categories,
                                         MAX(latest) AS last_contact
                                  FROM per_category GROUP BY customer_id),
                 ranked AS (SELECT *, row_number() OVER (ORDER BY tickets DESC, customer_id)
                            AS place FROM per_customer JOIN customer_safe_v USING (customer_id))"""),
    "a8_daily_counts": with_views(
        f"SELECT {_DAY} AS day, category, COUNT(*) AS n FROM tickets_v GROUP BY 1, 2",
        "tickets_v"),
    "a9_order_lookup_batch": with_views(
        """SELECT r.request_id, r.order_id, o.order_id IS NOT NULL AS found, o.status,
                  o.created_at, o.estimated_delivery, o.delivered_at, o.carrier,
                  o.payment_method, o.total_value, o.tier,
                  date_diff('day', o.estimated_delivery, o.delivered_at) AS days_late
           FROM requests_v r LEFT JOIN (
               SELECT h.*, c.tier FROM order_heads_v h JOIN customer_safe_v c USING (customer_id)
           ) o ON r.order_id = o.order_id
              AND (r.customer_id IS NULL OR r.customer_id = o.customer_id)""",
        "requests_v", "order_heads_v", "customer_safe_v"),
    "a10_data_range": with_views(
        """SELECT substr(CAST(MIN(created_at) AS VARCHAR), 1, 10) AS min_date,
                  substr(CAST(MAX(created_at) AS VARCHAR), 1, 10) AS max_date
           FROM tickets_v""", "tickets_v"),
    "a11_training_frame": with_views(
        f"""SELECT t.ticket_id, t.created_at, t.channel, t.category, t.priority, c.tier,
                  {CLEAN('t.body')} AS text
           FROM ticket_texts_v t JOIN customer_safe_v c ON c.customer_id = t.customer_id""",
        "ticket_texts_v", "customer_safe_v"),
    "a12_guarded_select": with_views(
        """SELECT priority, channel, COUNT(*) AS n, MAX(resolution_hours) AS longest_h
           FROM tickets_v GROUP BY priority, channel""", "tickets_v"),
    "p28_guarded_union": with_views(
        """SELECT status, COUNT(*) AS n FROM tickets_v GROUP BY status
           UNION SELECT status, COUNT(*) AS n FROM orders_v GROUP BY status""",
        "tickets_v", "orders_v"),
    "q1_quality_issues": with_views(
        """SELECT COUNT(*) FILTER (WHERE body IS NULL) AS null_body,
                  COUNT(*) FILTER (WHERE trim(body) = '') AS empty_body,
                  COUNT(*) FILTER (WHERE category IS NULL
                      OR category NOT IN ('click', 'error', 'view')) AS unknown_category,
                  COUNT(*) FILTER (WHERE priority IS NULL
                      OR priority NOT IN ('low', 'medium', 'high', 'urgent')) AS unknown_priority,
                  COUNT(*) - COUNT(DISTINCT ticket_id) AS duplicate_ids
           FROM ticket_texts_v""", "ticket_texts_v"),
    "q3_declared_constraints": with_views(
        """SELECT 'unique customer_id' AS check_name,
                  COUNT(*) - COUNT(DISTINCT customer_id) AS violations FROM customers_v
           UNION ALL SELECT 'not null customer_id', COUNT(*) - COUNT(customer_id) FROM customers_v
           UNION ALL SELECT 'not null name', COUNT(*) - COUNT(name) FROM customers_v
           UNION ALL SELECT 'not null state', COUNT(*) - COUNT(state) FROM customers_v
           UNION ALL SELECT 'not null tier', COUNT(*) - COUNT(tier) FROM customers_v
           UNION ALL SELECT 'values tier',
               COUNT(*) FILTER (WHERE tier NOT IN ('standard', 'silver')) FROM customers_v""",
        "customers_v"),
    "q4_referential_integrity": with_views(
        """SELECT 'orders.customer_id' AS foreign_key, COUNT(*) AS orphans FROM orders_v t
           WHERE customer_id IS NOT NULL AND NOT EXISTS
               (SELECT 1 FROM customers_v c WHERE c.customer_id = t.customer_id)
           UNION ALL SELECT 'tickets.customer_id', COUNT(*) FROM tickets_v t
           WHERE customer_id IS NOT NULL AND NOT EXISTS
               (SELECT 1 FROM customers_v c WHERE c.customer_id = t.customer_id)
           UNION ALL SELECT 'requests.order_id', COUNT(*) FROM requests_v t
           WHERE order_id IS NOT NULL AND NOT EXISTS
               (SELECT 1 FROM order_heads_v o WHERE o.order_id = t.order_id)""",
        "orders_v", "customers_v", "tickets_v", "requests_v", "order_heads_v"),
    "q5_profile": with_views(
        """SELECT 'category' AS field, category AS value,
                  ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 3)::DOUBLE AS figure
           FROM ticket_texts_v GROUP BY category
           UNION ALL SELECT 'priority', priority,
                  ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 3)::DOUBLE
           FROM ticket_texts_v GROUP BY priority
           UNION ALL SELECT 'rows', NULL, COUNT(*)::DOUBLE FROM ticket_texts_v
           UNION ALL SELECT 'avg_body_chars', NULL, ROUND(AVG(length(body)), 1)
           FROM ticket_texts_v""", "ticket_texts_v"),
    "x1_ticket_tier_frame": with_views(
        f"""SELECT ticket_id, customer_id, priority, tier, resolution_hours,
                  COALESCE(resolution_hours > {SLA_CASE}, false) AS sla_breached
           FROM tickets_v JOIN customers_v USING (customer_id)""", "tickets_v", "customers_v"),
    "x2_null_percentage": with_views(
        """SELECT * FROM (
               SELECT 'resolution_hours' AS column_name,
                      ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE resolution_hours IS NULL)
                            / COUNT(*), 1) AS null_pct FROM tickets_v
               UNION ALL SELECT 'csat', ROUND(100.0::DOUBLE
                      * COUNT(*) FILTER (WHERE csat IS NULL) / COUNT(*), 1) FROM tickets_v
               UNION ALL SELECT 'channel', ROUND(100.0::DOUBLE
                      * COUNT(*) FILTER (WHERE channel IS NULL) / COUNT(*), 1) FROM tickets_v)
           WHERE null_pct > 0""", "tickets_v"),
    "x3_category_share": with_views(
        """SELECT category AS value, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 1)::DOUBLE
                  AS share_pct FROM tickets_v GROUP BY category""", "tickets_v"),
    "x3_priority_by_tier": with_views(
        """SELECT priority,
               ROUND(100.0 * COUNT(*) FILTER (WHERE tier = 'gold')
                   / SUM(COUNT(*) FILTER (WHERE tier = 'gold')) OVER (), 1)::DOUBLE AS gold,
               ROUND(100.0 * COUNT(*) FILTER (WHERE tier = 'silver')
                   / SUM(COUNT(*) FILTER (WHERE tier = 'silver')) OVER (), 1)::DOUBLE AS silver,
               ROUND(100.0 * COUNT(*) FILTER (WHERE tier = 'standard')
                   / SUM(COUNT(*) FILTER (WHERE tier = 'standard')) OVER (), 1)::DOUBLE AS standard
           FROM tickets_v JOIN customers_v USING (customer_id) GROUP BY priority""",
        "tickets_v", "customers_v"),
    "x4_csat_by_breach": with_views(
        f"""SELECT COALESCE(resolution_hours > {SLA_CASE}, false) AS sla_breached,
                  ROUND(AVG(csat), 2) AS avg_csat
           FROM tickets_v JOIN customers_v USING (customer_id) GROUP BY 1""",
        "tickets_v", "customers_v"),
    "x5_spearman": with_views(
        """SELECT COUNT(*) AS n, ROUND(corr(rx, ry), 6) AS spearman FROM (
               SELECT rank() OVER (ORDER BY resolution_hours)
                      + (COUNT(*) OVER (PARTITION BY resolution_hours) - 1) / 2.0::DOUBLE AS rx,
                      rank() OVER (ORDER BY csat)
                      + (COUNT(*) OVER (PARTITION BY csat) - 1) / 2.0::DOUBLE AS ry
               FROM tickets_v WHERE resolution_hours IS NOT NULL AND csat IS NOT NULL)""",
        "tickets_v"),
    "x6_late_by_carrier": with_views(
        """SELECT carrier, ROUND(100.0::DOUBLE
                  * AVG(CASE WHEN delivered_at > estimated_delivery THEN 1 ELSE 0 END), 1) AS late_pct
           FROM orders_v WHERE delivered_at IS NOT NULL GROUP BY carrier""", "orders_v"),
    "x7_body_length": """SELECT ROUND(quantile_cont(length(text), 0.5), 6) AS median_chars,
               ROUND(quantile_cont(length(text), 0.95), 6) AS p95_chars FROM documents""",
}
ORACLE["a7_run_named"] = " UNION ALL ".join(
    f"SELECT '{name}' AS name, '{a.NAMED[name][0]}' AS description, CAST({key} AS VARCHAR) AS key, "
    f"{figure}::DOUBLE AS figure FROM ("
    + (_monthly_sql("tickets_v") if name == "monthly_volume"
       else ORACLE[next(k for k in ORACLE if k.endswith(f"_{name}"))]) + ")"
    for name, (key, figure) in NAMED_FIGURES.items())
_SLICES = ", ".join(
    f"CAST(SUM(('0x' || substr(row, {4 * i + 1}, 4))::BIGINT) AS VARCHAR)" for i in range(8))
ORACLE["q6_fingerprint"] = with_views(
    f"""SELECT substr(sha256(concat_ws(':', CAST(COUNT(*) AS VARCHAR), {_SLICES})), 1, 12) AS fingerprint
        FROM (SELECT md5(coalesce(strlen(CAST(ticket_id AS VARCHAR)) || ':' || ticket_id, '-')
                         || coalesce(strlen(category) || ':' || category, '-')) AS row FROM tickets_v)""",
    "tickets_v")
