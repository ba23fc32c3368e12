"""Time series, incident detection and monitoring (W, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import LATENCY_BUCKETS
from ticketlens.operators import forest, monitoring as m, timeseries as w
from ticketlens.operators.splits import temporal_split
from ticketlens.session import materialise
from ticketlens.plans.views import Desk, with_views

DAILY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
COLUMNS = w.series_columns(DAILY)


def _matrix(s, d):
    return w.daily_matrix(Desk(s, d).daily, DAILY)


def _features(s, d):
    return w.features(_matrix(s, d), DAILY)


def _scored(s, d):
    return w.score_robust_z(_features(s, d), DAILY)


def _truth(s, d):
    mean = F.avg("total").over(Window.partitionBy())  # over the days
    return _matrix(s, d).withColumn("_mean", mean).filter("total > 1.8D * _mean").select("day")


def _forest_scored(s, d):
    feats = materialise(_features(s, d), "daily-features")  # read by fitting and by scoring
    names = feats.columns[1:]
    nodes = forest.fit_forest(feats, "day", names)
    return forest.score_forest(feats, nodes, names, 256)


def _z(s, d):
    names = [*COLUMNS, "total"]
    long = w.to_series(
        w.weekday_factor(_matrix(s, d)).select("day", "weekday_factor", *names), names
    )
    return w.robust_z(long).select(
        "day", "series", *[F.round(c, 6).alias(c) for c in ("adj", "med", "mad", "z")]
    )


def _share(s, d):
    return _features(s, d).select("day", F.round("share_max", 6).alias("share_max"))


def _weekday(s, d):
    counts = Desk(s, d).table("events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n")
    ).withColumn("category", F.lit("all"))
    return w.mean_by_weekday(w.daily_matrix(counts, ["all"]))


def _champion(s, d):
    truth = _truth(s, d)
    return w.champion([
        ("robust_z", w.detection_metrics(_scored(s, d), truth)),
        ("isolation_forest", w.detection_metrics(_forest_scored(s, d), truth)),
    ])


def _predictions(s, d):
    return m.long_predictions(
        Desk(s, d).tickets, ["category", "priority"], "created_at", "ticket_id"
    )


def _channel_psi(s, d):
    tickets = Desk(s, d).tickets
    part = {
        c: m.distribution(m.long_predictions(
            tickets.filter(F.col("channel") == c), ["category", "priority"], "ticket_id"))
        for c in ("email", "chat")
    }
    return m.psi(part["email"], part["chat"]).withColumn("status", m.psi_status(F.col("psi")))


def _drift(s, d):
    train, _ = temporal_split(Desk(s, d).tickets)
    reference = m.distribution(m.long_predictions(train, ["category", "priority"], "ticket_id"))
    recent = m.drift_window(_predictions(s, d), ["created_at", "ticket_id"])
    return m.drift_report(recent, reference)


def _drift_shares(s, d):
    recent = m.drift_window(_predictions(s, d), ["created_at", "ticket_id"])
    return m.current_distribution(recent)


def _rates(s, d):
    events = Desk(s, d).table("events").select("event_id", "user_id", "ts")
    return m.range_counts(events, "user_id", "ts", 86400).select("event_id", "in_window")


def _decisions(s, d):
    events = Desk(s, d).table("events").select("event_id", "user_id", "ts")
    return m.rate_decisions(events, "user_id", "ts", "event_id", 86400, 3)


def _latency(s, d):
    rows = Desk(s, d).table("events").withColumn("seconds", F.col("value") / 50)
    return m.latency_histogram(rows, "event_type", "seconds")


QUERIES = {
    "w1_w2_daily_matrix": _matrix,
    "w3_weekday_factor": lambda s, d: w.weekday_factor(_matrix(s, d)).select(
        "day", F.round("weekday_factor", 6).alias("weekday_factor")
    ),
    "w4_w5_w6_robust_z": _z,
    "w7_share_max": _share,
    "w8_score_robust_z": lambda s, d: _scored(s, d).withColumn(
        "anomaly_score", F.round("anomaly_score", 6)
    ),
    "w9_detection_metrics": lambda s, d: w.detection_metrics(_scored(s, d), _truth(s, d)),
    "w10_top_anomalies": lambda s, d: w.top_anomalies(_scored(s, d)),
    "w11_incidents": lambda s, d: w.incidents(Desk(s, d).daily, DAILY, 1500),
    "w12_isolation_forest": lambda s, d: w.driver(_forest_scored(s, d), DAILY).select(
        "day", "anomaly_score", "is_anomaly", "driver_category", "driver_z"
    ),
    "w13_champion": _champion,
    "w14_mean_by_weekday": _weekday,
    "m1_m2_psi": _channel_psi,
    "m3_drift_report": _drift,
    "m3_current_distribution": _drift_shares,
    "m7_range_counts": _rates,
    "m7_rate_decisions": _decisions,
    "m8_latency_histogram": _latency,
    "m9_labelled_counters": lambda s, d: m.labelled_counters(
        Desk(s, d).tickets, "predictions_total", ["status", "category"]
    ),
}

_CELLS = ", ".join(
    f"COALESCE(SUM(n) FILTER (WHERE category = '{name}'), 0)::BIGINT AS {c}"
    for name, c in zip(DAILY, COLUMNS)
)
_SPINE = f"""
    days AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day
             FROM daily_v),
    cells AS (SELECT d.day, {_CELLS} FROM days d LEFT JOIN daily_v v ON v.day = d.day
              GROUP BY d.day),
    matrix AS (SELECT *, {' + '.join(COLUMNS)} AS total FROM cells),
    weighted AS (SELECT *, AVG(total) OVER (PARTITION BY isodow(day)) / AVG(total) OVER () AS wf
                 FROM matrix)"""
_LONG = " UNION ALL ".join(
    f"SELECT day, '{c}' AS series, {c}::DOUBLE AS x, {c} / wf AS adj FROM weighted"
    for c in [*COLUMNS, "total"]
)
_Z = f"""{_SPINE},
    long AS ({_LONG}),
    centred AS (SELECT *, CASE WHEN COUNT(adj) OVER f >= 7 THEN median(adj) OVER f END AS med,
                       LAG(adj) OVER (PARTITION BY series ORDER BY day) AS yesterday
                FROM long WINDOW f AS (PARTITION BY series ORDER BY day
                                       ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
    spread AS (SELECT *, abs(yesterday - med) AS dev FROM centred),
    scaled AS (SELECT *, CASE WHEN COUNT(dev) OVER g >= 7 THEN median(dev) OVER g END AS mad
               FROM spread WINDOW g AS (PARTITION BY series ORDER BY day
                                        ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
    z AS (SELECT *, greatest(0.0::DOUBLE, COALESCE((adj - med) / (1.4826::DOUBLE * mad + 1), 0))
                 AS z FROM scaled)"""
_BEST = " ".join(
    f"WHEN max(z) FILTER (WHERE series = '{c}') = max(z) FILTER (WHERE series <> 'total') "
    f"THEN '{name}'" for name, c in zip(DAILY, COLUMNS)
)
_SCORED = f"""{_Z},
    scored AS (SELECT day, max(z) FILTER (WHERE series <> 'total') AS anomaly_score,
                      max(z) FILTER (WHERE series <> 'total') > 3.5 AS is_anomaly,
                      CASE {_BEST} END AS driver_category,
                      round_even(max(z) FILTER (WHERE series <> 'total'), 2) AS driver_z
               FROM z GROUP BY day)"""
_TRUTH = f"""{_SCORED},
    truth AS (SELECT day FROM matrix WHERE total > 1.8::DOUBLE * (SELECT AVG(total) FROM matrix)),
    counted AS (SELECT COUNT(*) FILTER (WHERE is_anomaly AND t.day IS NOT NULL) AS tp,
                       COUNT(*) FILTER (WHERE is_anomaly AND t.day IS NULL) AS fp,
                       COUNT(*) FILTER (WHERE NOT is_anomaly AND t.day IS NOT NULL) AS fn
                FROM scored s LEFT JOIN truth t ON t.day = s.day),
    rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p,
                     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r
              FROM counted)"""
_SHARES = """
    long AS (SELECT 'category' AS field, category AS value, channel, created_at, ticket_id
             FROM tickets_v
             UNION ALL SELECT 'priority', priority, channel, created_at, ticket_id FROM tickets_v)"""


def _share_sql(name: str, source: str) -> str:
    return (
        f"{name} AS (SELECT field, value, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER "
        f"(PARTITION BY field) AS share FROM {source} GROUP BY field, value)"
    )


_PSI = """round_even(SUM((greatest(COALESCE(a.share, 0), 0.0001::DOUBLE)
               - greatest(COALESCE(e.share, 0), 0.0001::DOUBLE))
               * ln(greatest(COALESCE(a.share, 0), 0.0001::DOUBLE)
                    / greatest(COALESCE(e.share, 0), 0.0001::DOUBLE))), 4)"""
_STATUS = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"
_RECENT = """recent AS (SELECT field, value FROM (SELECT *, row_number() OVER (
        PARTITION BY field ORDER BY created_at DESC, ticket_id DESC) AS r FROM long)
        WHERE r <= 1000)"""

ORACLE = {
    "w1_w2_daily_matrix": with_views("SELECT * FROM matrix", "daily_v", extra=_SPINE),
    "w3_weekday_factor": with_views(
        "SELECT day, ROUND(wf, 6) AS weekday_factor FROM weighted", "daily_v", extra=_SPINE),
    "w4_w5_w6_robust_z": with_views(
        """SELECT day, series, ROUND(adj, 6) AS adj, ROUND(med, 6) AS med, ROUND(mad, 6) AS mad,
                  ROUND(z, 6) AS z FROM z""", "daily_v", extra=_Z),
    "w7_share_max": with_views(
        f"""SELECT day, ROUND(greatest({', '.join(COLUMNS)}) / greatest(total, 1)::DOUBLE, 6)
                  AS share_max FROM matrix""", "daily_v", extra=_SPINE),
    "w8_score_robust_z": with_views(
        """SELECT day, ROUND(anomaly_score, 6) AS anomaly_score, is_anomaly, driver_category,
                  driver_z FROM scored""", "daily_v", extra=_SCORED),
    "w9_detection_metrics": with_views(
        """SELECT tp, fp, fn, round_even(p, 3) AS precision, round_even(r, 3) AS recall,
                  round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1
           FROM rates""", "daily_v", extra=_TRUTH),
    "w10_top_anomalies": with_views(
        """SELECT day, round_even(anomaly_score, 3) AS score, driver_category, driver_z
           FROM scored WHERE is_anomaly ORDER BY anomaly_score DESC, day LIMIT 10""",
        "daily_v", extra=_SCORED),
    "w11_incidents": with_views(
        """SELECT day, round_even(anomaly_score, 3) AS score, driver_category, driver_z,
                  (SELECT COUNT(*) FROM (SELECT * FROM scored ORDER BY day DESC LIMIT 1500))
                  AS days_scored
           FROM (SELECT * FROM scored ORDER BY day DESC LIMIT 1500) WHERE is_anomaly""",
        "daily_v", extra=_SCORED),
    "w14_mean_by_weekday": """
        SELECT dayname(day) AS weekday, ROUND(AVG(n), 1) AS avg_per_day FROM (
            SELECT day, COUNT(event_id) AS n FROM (
                SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE
                       AS day FROM events) LEFT JOIN events ON ts::DATE = day
            GROUP BY day) GROUP BY 1""",
    "m1_m2_psi": with_views(
        f"""SELECT field, psi, {_STATUS} AS status FROM (
            SELECT COALESCE(e.field, a.field) AS field, {_PSI} AS psi
            FROM e FULL JOIN a ON a.field = e.field AND a.value = e.value GROUP BY 1)""",
        "tickets_v",
        extra=f"{_SHARES}, {_share_sql('e', '(FROM long WHERE channel = ' + chr(39) + 'email' + chr(39) + ')')}, "
              f"{_share_sql('a', '(FROM long WHERE channel = ' + chr(39) + 'chat' + chr(39) + ')')}"),
    "m3_drift_report": with_views(
        f"""SELECT field, (SELECT COUNT(*) FROM recent r WHERE r.field = p.field) AS samples, psi,
                  {_STATUS} AS status FROM (
            SELECT COALESCE(e.field, a.field) AS field, {_PSI} AS psi
            FROM e FULL JOIN a ON a.field = e.field AND a.value = e.value GROUP BY 1) p""",
        "tickets_v",
        extra=f"""{_SHARES}, cut AS (SELECT quantile_cont(epoch_us(created_at)::DOUBLE, 0.8) AS c
                  FROM tickets_v), past AS (SELECT * FROM long, cut
                  WHERE epoch_us(created_at) < c), {_RECENT},
                  {_share_sql('e', 'past')}, {_share_sql('a', 'recent')}"""),
    "m3_current_distribution": with_views(
        "SELECT field, value, round_even(share, 3) AS share FROM a", "tickets_v",
        extra=f"{_SHARES}, {_RECENT}, {_share_sql('a', 'recent')}"),
    "m7_range_counts": """
        SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts
               RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS in_window FROM events""",
    "m8_latency_histogram": "SELECT route, le, requests, total_seconds FROM (" + " UNION ALL ".join(
        f"SELECT event_type AS route, '{le}' AS le, COUNT(*) FILTER (WHERE {test}) AS requests, "
        "ROUND(SUM(value / 50), 6) AS total_seconds FROM events GROUP BY event_type"
        for le, test in [*[(f"{b:g}", f"value / 50 <= {b}") for b in LATENCY_BUCKETS],
                         ("+Inf", "true")]
    ) + ")",
    "m9_labelled_counters": with_views(
        """SELECT 'predictions_total' AS name,
                  'category="' || category || '",status="' || status || '"' AS labels,
                  COUNT(*) AS value FROM tickets_v GROUP BY category, status""", "tickets_v"),
}

# The rate rule one request after the other, per key, with the times accepted in the last day.
ORACLE["m7_rate_decisions"] = """
    WITH RECURSIVE numbered AS MATERIALIZED (
        SELECT event_id, user_id, ts,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    walk AS (
        SELECT event_id, user_id, ts, r, true AS accepted, [ts] AS recent FROM numbered WHERE r = 1
        UNION ALL
        SELECT event_id, user_id, ts, r, len(kept) < 3,
               CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END
        FROM (SELECT n.event_id, n.user_id, n.r, n.ts,
                     list_filter(w.recent, lambda t: n.ts - t <= INTERVAL 24 HOURS) AS kept
              FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.r = w.r + 1))
    SELECT event_id, user_id, accepted, ts FROM walk"""
