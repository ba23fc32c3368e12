import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ticketlens.operators import scale
from ticketlens.operators.report import spearman
from ticketlens.operators.splits import stratified_folds, temporal_split


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 1500), np.full(700, 5.0), [1e9, -1e6]])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    probabilities = [0.0, 0.05, 0.3, 0.5, 0.8, 0.999, 1.0]
    got = scale.exact_quantiles(df, "x", probabilities, bins=16)
    assert np.allclose(got, np.quantile(values, probabilities), rtol=0, atol=0)
    assert scale.exact_quantiles(df.filter("x is null"), "x", [0.5]) == [None]


def test_top_k_with_a_hot_group(spark):
    rows = [(0 if i % 3 else 1, (i * 7919) % 1009, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(7)
    got = scale.top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("i")], 20).collect()
    expected = pd.DataFrame(rows, columns=["g", "v", "i"]).sort_values(
        ["g", "v", "i"], ascending=[True, False, True]).groupby("g").head(20)
    assert sorted((r["g"], r["v"], r["i"]) for r in got) == sorted(
        map(tuple, expected.to_numpy().tolist()))
    assert sorted(r["rank"] for r in got if r["g"] == 0) == list(range(1, 21))


def test_hot_keys_join_once(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)],
                                "term string, i int")
    small = big.groupBy("term").agg(F.count("*").alias("df"))
    joined = scale.join_counted(big, small, "term", "df", "i", hot_rows=50)
    assert joined.count() == 600 and joined.select("i").distinct().count() == 600


def test_folds_are_balanced_and_equal_a_global_numbering(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(997)],
                               "ticket_id long, label string")
    rows = stratified_folds(df, "label", "ticket_id").toPandas()
    assert len(rows) == 997
    sizes = rows.groupby(["label", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    again = stratified_folds(df.repartition(5), "label", "ticket_id").toPandas()
    assert dict(zip(rows.ticket_id, rows.fold)) == dict(zip(again.ticket_id, again.fold))


def test_running_share(spark):
    values = random.Random(3).sample(range(10000), 500)
    hist = spark.createDataFrame([(float(v), v % 5 + 1) for v in values], "x double, w int")
    got = {r["x"]: r["b"] for r in scale.running_share(hist, "x", "w", "b", 60).collect()}
    total = 0
    for v in sorted(values):
        assert got[float(v)] == total
        total += v % 5 + 1


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.integers(0, 50, 800).astype(float)})
    pdf["y"] = np.round(-pdf["x"] / 20 + rng.normal(0, 1, 800))
    pdf.loc[::17, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None)))
    row = spearman(df, "x", "y").first()
    both = pdf.dropna()
    expected = both["x"].rank().corr(both["y"].rank())
    assert row["n"] == len(both) and abs(row["spearman"] - expected) < 1e-6


def test_split_is_out_of_time(spark):
    df = spark.range(101).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")
        .alias("created_at"))
    train, test = temporal_split(df)
    assert train.count() == 80 and test.count() == 21
    assert train.agg(F.max("created_at")).first()[0] < test.agg(F.min("created_at")).first()[0]
