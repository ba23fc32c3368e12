"""Isolation forest (Liu, Ting and Zhou, 2008) over a feature table.

Trees are independent: each draws its own rows, is grown in its own group, and the finished trees,
whose size depends only on the number of trees and the sample size, are broadcast for scoring."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.fixed_values import FOREST_CONTAMINATION, FOREST_SAMPLE, FOREST_TREES
from ticketlens.operators.scale import top_k_per_group

NODES = "tree int, node int, feature int, threshold double, child int, depth_value double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Node rows of one tree. ``child`` is the left child (the right one follows it); a leaf has
    child -1 and carries its depth plus the expected rest of the path."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    rows, pending = [], [(0, np.arange(len(x)), 0)]
    used = 1
    while pending:
        node, index, depth = pending.pop()
        low, high = x[index].min(axis=0), x[index].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(index) <= 1 or not len(open_features):
            rows.append((tree, node, -1, 0.0, -1, depth + average_path(len(index))))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[index, f] <= cut
        rows.append((tree, node, f, cut, used, 0.0))
        pending += [(used, index[left], depth + 1), (used + 1, index[~left], depth + 1)]
        used += 2
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "child",
                                       "depth_value"])


def fit_forest(
    rows: DataFrame, key: str, columns: list[str], trees: int = FOREST_TREES,
    sample: int = FOREST_SAMPLE, seed: int = 42,
) -> DataFrame:
    """Node table of the forest. Each tree takes the ``sample`` rows with the smallest hashes."""
    drawn = rows.select(
        key,
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
    )
    draw = F.xxhash64(F.lit(seed), "tree", key)
    picked = top_k_per_group(drawn, ["tree"], [draw, F.col(key)], sample)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        return grow_tree(int(group["tree"].iloc[0]), np.stack(group["x"].to_numpy()), seed)

    return picked.select("tree", "rank", "x").groupBy("tree").applyInPandas(grow, NODES)


def path_depth(nodes: DataFrame, x: Column) -> Column:
    """Mean path length of the vectors ``x`` over all trees."""
    table = nodes.orderBy("tree", "node").toPandas()  # trees x (2 * sample - 1) rows at most
    starts = np.flatnonzero(table["node"].to_numpy() == 0)
    base = np.repeat(starts, np.diff([*starts, len(table)]))
    child = table["child"].to_numpy()
    parts = nodes.sparkSession.sparkContext.broadcast((
        starts,
        table["feature"].to_numpy(),
        table["threshold"].to_numpy(),
        np.where(child >= 0, child + base, -1),
        table["depth_value"].to_numpy(),
    ))

    @F.pandas_udf(T.DoubleType())
    def depth(vectors: pd.Series) -> pd.Series:
        roots, feature, threshold, first_child, value = parts.value
        if not len(vectors):
            return pd.Series([], dtype="float64")
        rows = np.stack(vectors.to_numpy())
        at = np.tile(roots, (len(rows), 1))
        inner = first_child[at] >= 0
        while inner.any():
            r, c = np.nonzero(inner)
            n = at[r, c]
            right = rows[r, feature[n]] > threshold[n]
            at[r, c] = first_child[n] + right
            inner[r, c] = first_child[at[r, c]] >= 0
        return pd.Series(value[at].mean(axis=1))

    return depth(x)


def score_forest(
    rows: DataFrame, nodes: DataFrame, columns: list[str], sampled: int,
    contamination: float = FOREST_CONTAMINATION,
) -> DataFrame:
    """Adds ``anomaly_score`` (2 ** -depth / expected depth) and ``is_anomaly`` (above the
    quantile that leaves the share ``contamination``)."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    score = F.pow(F.lit(2.0), -path_depth(nodes, x) / F.lit(average_path(sampled)))
    scored = rows.withColumn("anomaly_score", score)
    cut = scored.agg(F.percentile("anomaly_score", 1.0 - contamination).alias("_cut"))
    return (
        scored.join(F.broadcast(cut), F.lit(True))
        .withColumn("is_anomaly", F.col("anomaly_score") > F.col("_cut"))
        .drop("_cut")
    )
