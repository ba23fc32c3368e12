import datetime as dt
from collections import Counter, defaultdict, deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import forest, monitoring as m, quality, timeseries as w
from ticketlens.streaming import jobs

CATEGORIES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(11)
    days = pd.date_range("2024-01-01", periods=120, freq="D")
    rows = []
    for i, day in enumerate(days):
        if i in (40, 41):
            continue  # missing days
        for c in CATEGORIES:
            n = int(rng.poisson(8 + 4 * (day.dayofweek < 2)))
            if i == 90 and c == "b":
                n += 90
            if n:
                rows.append((day.date(), c, n))
    rows.append((days[3].date(), "other", 50))
    return rows


def features_in_pandas(rows):
    df = pd.DataFrame(rows, columns=["day", "category", "n"])
    wide = df.pivot_table(index="day", columns="category", values="n", aggfunc="sum", fill_value=0)
    wide.index = pd.to_datetime(wide.index)
    wide = wide.reindex(columns=CATEGORIES, fill_value=0).asfreq("D", fill_value=0)
    wide["total"] = wide.sum(axis=1)
    factor = wide["total"].groupby(wide.index.dayofweek).transform("mean") / wide["total"].mean()
    out = {}
    for c in [*CATEGORIES, "total"]:
        adj = wide[c] / factor
        med = adj.shift(1).rolling(28, min_periods=7).median()
        mad = (adj.shift(1) - med).abs().rolling(28, min_periods=7).median()
        out[c] = ((adj - med) / (1.4826 * mad + 1)).fillna(0).clip(lower=0)
    return wide, pd.DataFrame(out)


def test_robust_z_matches_pandas(spark, counts):
    df = spark.createDataFrame(counts, "day date, category string, n long")
    matrix = w.daily_matrix(df, CATEGORIES)
    feats = w.features(matrix, CATEGORIES).orderBy("day").toPandas()
    wide, z = features_in_pandas(counts)
    assert len(feats) == 120
    got = matrix.orderBy("day").toPandas()
    assert (got[["c0", "c1", "c2", "total"]].to_numpy() == wide.to_numpy()).all()
    assert np.allclose(feats[["z_c0", "z_c1", "z_c2", "z_total"]].to_numpy(), z.to_numpy(), atol=1e-9)
    scored = w.score_robust_z(w.features(matrix, CATEGORIES), CATEGORIES)
    top = w.top_anomalies(scored, 1).first()
    assert top["day"] == dt.date(2024, 3, 31) and top["driver_category"] == "b"
    truth = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),)], "day date")
    row = w.detection_metrics(scored, truth).first()
    assert row["tp"] == 1 and row["fn"] == 1 and row["recall"] == 0.5


def test_champion_prefers_the_first_on_ties(spark):
    row = spark.createDataFrame([(1, 0.5)], "tp long, f1 double")
    better = spark.createDataFrame([(1, 0.6)], "tp long, f1 double")
    assert w.champion([("x", row), ("y", row)]).first()["method"] == "x"
    assert w.champion([("x", row), ("y", better)]).first()["method"] == "y"


def test_isolation_forest_finds_the_planted_outlier(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    x[123] = [9.0, -9.0, 9.0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               "k long, p double, q double, r double")
    names = ["p", "q", "r"]
    nodes = forest.fit_forest(df, "k", names, trees=60)
    scored = forest.score_forest(df, nodes, names, 256).toPandas()
    assert scored.loc[scored["anomaly_score"].idxmax(), "k"] == 123
    assert 0.02 <= scored["is_anomaly"].mean() <= 0.04
    assert scored["anomaly_score"].between(0, 1).all()


def test_psi(spark):
    def dist(**shares):
        return spark.createDataFrame([("f", k, v) for k, v in shares.items()],
                                     "field string, value string, share double")
    same = m.psi(dist(a=0.5, b=0.5), dist(a=0.5, b=0.5)).first()["psi"]
    moved = m.psi(dist(a=0.5, b=0.5), dist(a=0.9, b=0.1))
    assert same == 0
    assert moved.select(m.psi_status(F.col("psi"))).first()[0] == "significant"
    assert m.psi(dist(a=1.0), dist(b=1.0)).first()["psi"] > 10


def test_drift_report_needs_samples_and_keeps_the_window(spark):
    reference = spark.createDataFrame([("category", "x", 0.5), ("category", "y", 0.5)],
                                      "field string, value string, share double")
    rows = spark.range(30).select(F.lit("category").alias("field"), F.lit("x").alias("value"),
                                  F.col("id").alias("seq"))
    thin = m.drift_report(m.drift_window(rows.limit(9), ["seq"]), reference, 10).first()
    assert (thin["samples"], thin["status"], thin["psi"]) == (9, "insufficient_data", None)
    full = m.drift_report(m.drift_window(rows, ["seq"], 20), reference, 10).first()
    assert (full["samples"], full["status"]) == (20, "significant")


def requests(spark):
    rng = np.random.default_rng(9)
    start = dt.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(600):
        t += float(rng.exponential(4 if i % 200 < 80 else 40))
        rows.append((i, "hot" if i % 3 else f"k{i % 4}", start + dt.timedelta(seconds=round(t))))
    return rows, spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")


def decide(rows, window, limit):
    recent, out = defaultdict(deque), {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        times = recent[key]
        while times and (ts - times[0]).total_seconds() > window:
            times.popleft()
        out[i] = len(times) < limit
        if out[i]:
            times.append(ts)
    return out


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_rate_decisions_match_brute_force(spark, limit):
    rows, df = requests(spark)
    got = {r["id"]: r["accepted"] for r in
           m.rate_decisions(df, "key", "ts", "id", 60, limit).collect()}
    expected = decide(rows, 60, limit)
    assert got == expected and not all(expected.values())


def test_range_counts_match_brute_force(spark):
    rows, df = requests(spark)
    got = {r["id"]: r["in_window"] for r in
           m.range_counts(df, "key", "ts", 60, span_windows=2).collect()}
    for i, key, ts in rows:
        near = [r for r in rows if r[1] == key and 0 <= (ts - r[2]).total_seconds() <= 60]
        assert got[i] == len(near)


def test_streams_equal_batch_over_several_micro_batches(spark, tmp_path):
    rows, df = requests(spark)
    table = tmp_path / "in" / "requests.parquet"
    df.orderBy("ts", "id").repartitionByRange(3, "ts").write.parquet(str(table))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(table))
    jobs.rate_stream(live, "key", "ts", "id", str(tmp_path / "rates"), 60, 3, True
                     ).awaitTermination()
    got = {r["id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "rates")).collect()}
    assert set(got) == {r[0] for r in rows}  # files come in any order

    long = live.select(F.lit("key").alias("field"), F.col("key").alias("value"), "ts", "id")
    jobs.drift_stream(long, ["ts", "id"], str(tmp_path / "drift"), 50, True).awaitTermination()
    kept = {r["id"] for r in jobs.read_drift_window(spark, str(tmp_path / "drift")).collect()}
    assert kept == {r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))[-50:]}

    tickets = live.select(F.col("ts").alias("created_at"), F.col("key").alias("category"))
    jobs.daily_counts_stream(tickets, str(tmp_path / "daily"), once=True).awaitTermination()
    daily = jobs.read_daily_counts(spark, str(tmp_path / "daily"))
    expected = df.groupBy(F.to_date("ts").alias("day"), F.col("key").alias("category")).count()
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, expected.collect()))


def test_rate_stream_with_one_busy_key(spark, tmp_path):
    """One key in many micro-batches, in order; then a request a day later, which frees its state."""
    start, path, table = dt.datetime(2024, 5, 1), str(tmp_path / "rates"), str(tmp_path / "in")
    schema = "id long, key string, ts timestamp_ntz"
    rows = [(i, "busy", start + dt.timedelta(seconds=i * 2 // 3)) for i in range(400)]
    rows += [(400, "later", start + dt.timedelta(days=1)), (401, "busy", start)]
    for first, last in ((0, 100), (100, 101), (101, 250), (250, 400), (400, 401), (401, 402)):
        spark.createDataFrame(rows[first:last], schema).coalesce(1).write.mode("append").parquet(table)
        live = spark.readStream.schema(schema).parquet(table)
        jobs.rate_stream(live, "key", "ts", "id", path, 60, 7, once=True).awaitTermination()
    got = {r["id"]: r["accepted"] for r in spark.read.parquet(path).collect()}
    assert {i: got[i] for i in range(401)} == decide(rows[:401], 60, 7)
    assert got[401]  # late, counted, and judged with what is left
    left = spark.read.parquet(f"{path}-accepted/slot=1").collect()
    assert [r["id"] for r in left] == [400]


def test_daily_counts_stream_counts_late_rows(spark, tmp_path):
    table, path = str(tmp_path / "tickets"), str(tmp_path / "daily")
    for day in ("2024-03-20", "2024-03-21", "2024-03-01", "2024-03-20"):
        rows = spark.createDataFrame([(f"{day} 10:00:00", "a"), (None, "a")], "at string, category string")
        rows = rows.select(F.col("at").cast("timestamp").alias("created_at"), "category")
        rows.coalesce(1).write.mode("append").parquet(table)
        live = spark.readStream.schema(rows.schema).parquet(table)
        jobs.daily_counts_stream(live, path, once=True).awaitTermination()
    got = {(str(r["day"]), r["n"]) for r in jobs.read_daily_counts(spark, path).collect()}
    assert got == {("None", 4), ("2024-03-01", 1), ("2024-03-20", 2), ("2024-03-21", 1)}


def test_daily_counts_fold_their_folders(spark, tmp_path):
    table, path = str(tmp_path / "tickets"), str(tmp_path / "daily")
    days = ["2024-03-20", "2024-03-21", "2024-03-01", "2024-03-20", "2024-03-22", "2024-03-20", "2024-03-01"]
    for at, day in enumerate(days):
        rows = spark.createDataFrame([(f"{day} 10:00:00", "a")] * (at + 1), "at string, category string")
        rows = rows.select(F.col("at").cast("timestamp").alias("created_at"), "category")
        rows.coalesce(1).write.mode("append").parquet(table)
        live = spark.readStream.schema(rows.schema).parquet(table)
        jobs.daily_counts_stream(live, path, ring=2, once=True).awaitTermination()
        expected = Counter()
        for k, d in enumerate(days[:at + 1]):
            expected[d] += k + 1
        got = {str(r["day"]): r["n"] for r in jobs.read_daily_counts(spark, path).collect()}
        assert got == expected
    folders = {str(p.relative_to(path)) for p in (tmp_path / "daily").rglob("*=*")}
    assert folders == {"ring/slot=0", "ring/slot=1", "folded/side=0", "folded/side=1"}
    # a fold that was interrupted has fewer rows than it says and is not used
    folded, upto = jobs._folded_counts(spark, path)
    assert upto == 5
    folded.withColumns({"rows": F.lit(99).cast("long"), "upto": F.lit(7).cast("long")}).write.mode(
        "overwrite").parquet(f"{path}/folded/side=1")
    assert jobs._folded_counts(spark, path)[1] == 5


def test_audit_log_never_stores_the_text(spark, tmp_path):
    from ticketlens.sources.sinks import append_audit

    rows = spark.createDataFrame([("texto sensível", "knowledge")], "input string, intent string")
    append_audit(rows, "event", str(tmp_path / "audit"))
    append_audit(rows, "event", str(tmp_path / "audit"))
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "audit")).collect())
    assert "sensível" not in text and text.count("input_sha256") == 2


def test_quality_rejects_bad_rows(spark):
    good = spark.createDataFrame(
        [(1, "x", "billing", "low"), (2, "y", "account", "high")],
        "ticket_id long, body string, category string, priority string")
    quality.assert_quality(good)
    bad = spark.createDataFrame(
        [(1, " \t", "spam", None), (1, None, "billing", "low")], good.schema)
    row = quality.quality_issues(bad).first()
    assert tuple(row) == (1, 1, 1, 1, 1)
    with pytest.raises(ValueError, match="unknown_category"):
        quality.assert_quality(bad)


def test_fingerprint_depends_on_content_only(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("c"))
    columns = ["id", "c"]
    base = quality.fingerprint(df, columns).first()[0]
    assert len(base) == 12
    assert quality.fingerprint(df.repartition(5).orderBy("c"), columns).first()[0] == base
    changed = df.withColumn("c", F.when(F.col("id") == 500, "z").otherwise(F.col("c")))
    assert quality.fingerprint(changed, columns).first()[0] != base
