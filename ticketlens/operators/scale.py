"""Building blocks that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import materialise

SALTS = 32
HOT_ROWS = 500_000


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. The first round ranks within
    (group, salt) so that a hot group is spread over ``SALTS`` tasks; the second round ranks the
    survivors. The salt is constant per task; up to 1,000 rows (Spark's window group limit) a task
    passes on only ``k`` per group. Without keys it is a plain ordered limit, which cuts in each task
    for any ``k``."""
    if not keys:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_part", F.row_number().over(first))
        .filter(F.col("_part") <= k)
        .drop("_part", "_salt")
        .withColumn(rank, F.row_number().over(last))
        .filter(F.col(rank) <= k)
    )


def first_of_value(df: DataFrame, keys: Sequence[str], value: str, order: str, k: int) -> DataFrame:
    """Per group the ``k`` rows of the largest ``value``, equal values by ``order`` (unique), without a
    merge of every task's best: a histogram of the values gives the one at which a group is cut, rows
    above it stay, and only the rows at the cut are numbered, over the parts of a range sort. ``df``
    is read several times, so it should be a written table."""
    names = [f"_of_{c}" for c in keys]
    hist = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    cuts = hist.withColumn("_to", F.sum("_n").over(down)).filter(F.col("_to") >= k)
    cuts = cuts.groupBy(*[F.col(c).alias(n) for c, n in zip(keys, names)]).agg(
        F.max(F.struct(F.col(value).alias("at"), (F.lit(k) - F.col("_to") + F.col("_n")).alias("left"))
              ).alias("_cut"))
    same = F.lit(True)
    for c, name in zip(keys, names):
        same = same & F.col(c).eqNullSafe(F.col(name))
    rows = df.join(cuts, same, "left")
    above = rows.filter(F.col("_cut").isNull() | (F.col(value) > F.col("_cut.at")))
    tied = rows.filter(F.col(value) == F.col("_cut.at")).repartitionByRange(
        *[F.col(c) for c in (*keys, order)]).sortWithinPartitions(*keys, order)
    tied = materialise(tied.withColumn("_id", F.monotonically_increasing_id()), "tied")
    tied = tied.withColumn("_part", F.shiftright("_id", 33))
    parts = tied.groupBy(*names, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("_part").alias("_in"),
                         (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_add"))
    same = F.col("_part") == F.col("_in")
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    first = tied.join(parts, same).filter(F.col("_id") + F.col("_add") < F.col("_cut.left"))
    return above.select(*df.columns).unionByName(first.select(*df.columns))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most recent rows of each group."""
    return top_k_per_group(df, keys, [F.col(c).desc() for c in order], k, "_recent").drop("_recent")


def join_counted(
    big: DataFrame, small: DataFrame, key: str, count: str, salt_from: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of ``big`` with one row per key, where ``small`` knows in ``count`` how many rows
    of ``big`` carry the key. Keys with more than ``hot_rows`` rows are spread over ``SALTS``
    tasks. There can be at most rows / ``hot_rows`` of them, which bounds the broadcast list."""
    hot = small.filter(F.col(count) > hot_rows).select(key, F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64(salt_from), F.lit(SALTS)).cast("int")
    spread = F.when(F.col(count) > hot_rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    return (
        big.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0))
        .join(small.withColumn("_salt", F.explode(spread)), [key, "_salt"])
        .drop("_salt", "_hot")
    )


def number_by_digest(df: DataFrame, keys: Sequence[str], digest: str, out: str) -> DataFrame:
    """``row_number()`` of each group in the order of the hex string ``digest``, without sorting a
    group in one task: rows are numbered within (group, first three hex digits), and the sizes of
    the earlier buckets (4096 small rows per group) are added."""
    bucket = F.substring(digest, 1, 3)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_bucket").alias("_offset_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col("_bucket") == F.col("_offset_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(digest)
    return (
        rows.withColumn("_within", F.row_number().over(within))
        .join(F.broadcast(offsets), same)
        .withColumn(out, (F.col("_within") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_within", "_offset", "_offset_bucket", *[f"_key_{k}" for k in keys])
    )


def running_share(
    hist: DataFrame, value: str, weight: str, out: str, rows_per_part: int = 100_000
) -> DataFrame:
    """Adds to a histogram (one row per distinct ``value``) the total ``weight`` of all smaller values,
    as a prefix sum over the parts of a range sort: a part needs only the totals of the parts before
    it, one row each."""
    parts = 1 + hist.count() // rows_per_part
    ordered = hist.repartitionByRange(parts, F.col(value)).withColumn("_part", F.spark_partition_id())
    rows = materialise(ordered, "ranges")
    sums = rows.groupBy("_part").agg(F.sum(weight).alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_before", F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .join(offsets, "_part")
        .withColumn(out, F.col("_before") + F.col("_offset"))
        .drop("_part", "_before", "_offset")
    )


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float],
                    bins: int = 2048) -> list[float | None]:
    """Exact quantiles with linear interpolation, in two scans whatever the data. ``percentile`` keeps
    every distinct value in one buffer; here a mergeable sketch brackets every wanted rank, which
    leaves about 4 in ``bins`` of the rows, and one histogram counts the values inside the brackets
    and everything between them."""
    values = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    margin = 2.0 / bins  # twice the sketch's error
    around = [(max(0.0, p - margin), min(1.0, p + margin)) for p in probabilities]
    bounds = sorted({b for pair in around for b in pair})
    sketch = values.agg(
        F.percentile_approx("x", bounds, bins).alias("at"), F.min("x").alias("low"),
        F.max("x").alias("high"), F.count("*").alias("n")).first()
    n = sketch["n"]
    if not n:
        return [None for _ in probabilities]
    at = dict(zip(bounds, sketch["at"]))
    brackets = sorted({(sketch["low"] if a == 0.0 else at[a], sketch["high"] if b == 1.0 else at[b])
                       for a, b in around})
    inside = F.lit(False)
    floor = F.lit(sketch["low"])
    for low, high in brackets:
        inside = inside | F.col("x").between(low, high)
        floor = F.when(F.col("x") > high, F.greatest(floor, F.lit(high))).otherwise(floor)
    # What lies between brackets is counted at the end of the bracket below, where no wanted rank is.
    hist = values.groupBy(F.when(inside, F.col("x")).otherwise(floor).alias("x")).agg(
        F.count("*").alias("w"))
    ranked = running_share(materialise(hist, "brackets"), "x", "w", "before")
    positions = [(n - 1) * p for p in probabilities]
    ranks = sorted({int(math.floor(h)) for h in positions} | {int(math.ceil(h)) for h in positions})
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | ((F.col("before") <= r) & (F.lit(r) < F.col("before") + F.col("w")))
    rows = ranked.filter(wanted).collect()  # at most two values per quantile
    found = {r: next(row["x"] for row in rows if row["before"] <= r < row["before"] + row["w"])
             for r in ranks}
    out = []
    for h in positions:
        a, b = found[int(math.floor(h))], found[int(math.ceil(h))]
        out.append(a + (b - a) * (h - math.floor(h)))
    return out
