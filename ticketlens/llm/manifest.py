"""A Merkle manifest of a table, and the climb that proves every row against its root.

Rows become leaves, one binary tree per group, and the trees' roots the leaves of a top tree. Nodes
are built in blocks of ``2 ** BLOCK_LEVELS`` neighbours, tier by tier, and written as rows linked to
an ancestor: a node row holds the siblings on the way to the node ``LIFT`` levels higher (or to the
end of its tree) and that node's name. Only every ``LIFT``-th level needs rows.

A recursive query starts at every leaf and follows the links: it appends the siblings and folds the
leaf that was given, tampered or not. Few nodes stand above many leaves. Those above a ``HEAVY``-th of
all leaves or more are at most ``HEAVY`` per level, whatever the data; they are broadcast to a second
recursive query, and no key of the first query's join has more rows than that share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.session import materialise

LIFT = 4
BLOCK_LEVELS = 12
HEAVY = 16_384
TOP = "top"

LEAF, NODE, BLOCK_TOP, TREE_TOP = range(4)


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: ``-`` for null, else byte count, ``:``, value, one column after the other."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"),
                                 c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def _numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``rows``, written, with ``_index``: their place in the order. Parts of a range sort are numbered
    from the sizes of the parts before them, one row per part."""
    ordered = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    table = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    table = table.withColumn("_part", F.shiftright("_at", 33))
    sizes = table.groupBy("_part").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    return table.join(F.broadcast(offsets), "_part").select(  # one row per part of the sort
        *rows.columns, "_part",
        (F.col("_offset") + F.col("_at") - F.shiftleft(F.col("_part"), 33)).alias("_index"))


def _leaves(docs: DataFrame, key: str, group: str, columns: Sequence[str],
            changed: dict[str, Column]) -> DataFrame:
    """Leaves with their tree (named after its first row's place), place in it and the tree's size."""
    plain, other = ([values.get(c, F.col(c)) for c in columns] for values in ({}, changed))
    touched = F.lit(False)
    for c, value in changed.items():
        touched = touched | ~value.eqNullSafe(F.col(c))
    given = F.when(touched, F.unhex(row_digest(other)))
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("group"),
                         F.unhex(row_digest(plain)).alias("hash"), given.alias("given"))
    table = _numbered(leaves, ["group", "key", "hash"], "leaves")
    runs = table.groupBy("group", "_part").agg(F.min("_index").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("group")
    runs = runs.select(F.col("group").alias("_group"), F.col("_part").alias("_run"),
                       F.min("first").over(whole).alias("start"), F.sum("rows").over(whole).alias("n"))
    same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_run"))
    return table.join(runs, same).select(
        F.col("start").cast("string").alias("tree"), (F.col("_index") - F.col("start")).alias("pos"),
        "n", "hash", F.lit(1).cast("long").alias("weight"), F.lit(None).cast("string").alias("node"),
        "key", "given")


def _row_schema(key_type: T.DataType) -> T.StructType:
    link = T.StructType([T.StructField("sibling", T.BinaryType()), T.StructField("left", T.BooleanType())])
    kinds = {"kind": T.IntegerType(), "tree": T.StringType(), "pos": T.LongType(), "n": T.LongType(),
             "hash": T.BinaryType(), "weight": T.LongType(), "node": T.StringType(), "key": key_type,
             "given": T.BinaryType(), "parent": T.StringType(), "parent_weight": T.LongType(),
             "links": T.ArrayType(link), "subroot": T.BinaryType(), "root": T.BinaryType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _levels(leaves: list[str], weights: list[int], count: int) -> tuple[list[list[str]], list[list[int]]]:
    hashes, sums = [leaves], [weights]
    for _ in range(count):
        below, w = hashes[-1], sums[-1]
        hashes.append([hashlib.sha256("".join(below[i:i + 2]).encode()).hexdigest()
                       for i in range(0, len(below), 2)])
        sums.append([sum(w[i:i + 2]) for i in range(0, len(w), 2)])
    return hashes, sums


def _block_builder(base: int, arrow: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Builds one block of one tree from its nodes of level ``base``."""

    def build(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: r["pos"])
        tree, n, first = rows[0]["tree"], rows[0]["n"], rows[0]["pos"]
        height = (n - 1).bit_length()
        top = min(base + BLOCK_LEVELS, height)
        hashes, weights = _levels([r["hash"].hex() for r in rows], [r["weight"] for r in rows], top - base)
        raw = [[bytes.fromhex(h) for h in level] for level in hashes]
        out = []

        def name(level: int, at: int) -> str:
            return f"{tree}/{level}/{(first >> (level - base)) + at}"

        for level in range(base, max(top, base + (top == height == base)), LIFT):
            end = min(level + LIFT, top)
            for at, own in enumerate(raw[level - base]):
                links = []
                for step in range(level, end):
                    place = (at >> (step - level)) ^ 1
                    there = raw[step - base]
                    links.append({"sibling": there[place] if place < len(there) else None,
                                  "left": place % 2 == 0})
                over = at >> (end - level)
                row = {"kind": NODE, "tree": tree, "node": name(level, at), "hash": own, "links": links,
                       "weight": weights[level - base][at], "parent": name(end, over),
                       "parent_weight": weights[end - base][over]}
                if end == height:
                    ends = {"root": raw[-1][0], "parent": None} if tree == TOP else {"subroot": raw[-1][0]}
                    row |= ends
                if level == base:
                    given = rows[at]
                    row |= {"key": given["key"], "given": given["given"], "node": given["node"] or row["node"],
                            "kind": LEAF if base == 0 and tree != TOP else NODE}
                out.append(row)
        out.append({"kind": TREE_TOP if top == height else BLOCK_TOP, "tree": tree, "pos": first >> (top - base),
                    "n": n, "hash": raw[-1][0], "weight": weights[-1][0], "node": name(top, 0)})
        return pa.Table.from_pylist(out, schema=arrow)

    return build


def _build(level_rows: DataFrame, label: str) -> list[DataFrame]:
    """Written node rows of all tiers above ``level_rows``."""
    schema = _row_schema(level_rows.schema["key"].dataType)
    arrow = to_arrow_schema(schema)
    largest = level_rows.agg(F.max("n")).first()[0] or 0
    tiers, base = [], 0
    while True:
        blocks = level_rows.withColumn("block", F.shiftright("pos", BLOCK_LEVELS)).groupBy("tree", "block")
        tiers.append(materialise(blocks.applyInArrow(_block_builder(base, arrow), schema), f"{label}-{base}"))
        base += BLOCK_LEVELS
        if largest <= 1 << base:
            return tiers
        level_rows = tiers[-1].filter(F.col("kind") == BLOCK_TOP).select(*level_rows.columns)


_FOLD = """aggregate({links}, {start}, (h, s) -> unhex(sha2(concat(
    if(s.left, coalesce(lower(hex(s.sibling)), ''), ''), lower(hex(h)),
    if(s.left, '', coalesce(lower(hex(s.sibling)), ''))), 256)))"""
_SIBLINGS = "filter(transform({links}, s -> s.sibling), s -> s IS NOT NULL)"

_CLIMB = f"""
WITH RECURSIVE climb(key, leaf, parent, heavy, folded, proof, subroot, root) AS (
  SELECT key, leaf, parent, heavy, folded, proof, subroot, root FROM {{start}}
  UNION ALL
  SELECT %(hint)s c.key, c.leaf, n.parent, n.parent_heavy,
    {_FOLD.format(links="n.links", start="c.folded")},
    concat(c.proof, {_SIBLINGS.format(links="n.links")}),
    coalesce(c.subroot, n.subroot), n.root
  FROM climb c JOIN {{nodes}} n ON c.parent = n.node
)
SELECT * FROM climb WHERE %(ended)s LIMIT ALL
"""


@dataclass(frozen=True)
class Manifest:
    """``leaves`` and ``nodes`` are written tables of linked rows; ``rows`` counts the leaves."""

    leaves: DataFrame
    nodes: DataFrame
    rows: int


def build_manifest(docs: DataFrame, columns: Sequence[str], key: str = "doc_id", group: str = "lang",
                   changed: dict[str, Column] | None = None) -> Manifest:
    """The trees over all rows of ``docs``. ``columns`` make a leaf; ``changed`` has expressions that
    stand for some of them in the row that a climb is later to start from.

    Trees are ordered by ``group`` (null first, by bytes), leaves by ``key`` (null first), equal keys
    by digest; repeated rows are leaves of the same digest side by side. Pairs of neighbours become
    one node, a last one without a neighbour is hashed alone, a single leaf is its tree's root. Null
    and empty values have different digests. Columns that are not named are not read.
    """
    tiers = _build(_leaves(docs, key, group, columns, changed or {}), "tree")
    tops = [tier.filter(F.col("kind") == TREE_TOP) for tier in tiers]
    tops = reduce(DataFrame.unionByName, tops).select(
        F.col("tree").cast("long").alias("tree"), "hash", "weight", "node")
    tops = _numbered(tops, ["tree"], "tops")
    trees, rows = tops.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    top_leaves = tops.select(
        F.lit(TOP).alias("tree"), F.col("_index").alias("pos"), F.lit(trees).cast("long").alias("n"),
        "hash", "weight", "node", F.lit(None).cast(docs.schema[key].dataType).alias("key"),
        F.lit(None).cast("binary").alias("given"))
    tiers += _build(top_leaves, "top")
    nodes = [tier.filter(F.col("kind") == NODE) for tier in tiers]
    return Manifest(tiers[0].filter(F.col("kind") == LEAF), reduce(DataFrame.unionByName, nodes), rows)


def climb(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``key``, hex digests ``leaf``, ``subroot`` (of its tree), ``root``, ``proof``
    (siblings from the leaf to the root; a level without a sibling adds none), ``folded_root`` (from
    the changed row, else the leaf, and the siblings) and ``verified``. No leaves, no rows."""
    spark = manifest.leaves.sparkSession
    share = manifest.rows / HEAVY
    nodes = manifest.nodes.select("node", "parent", "links", "subroot", "root", "weight",
                                  (F.col("parent_weight") >= share).alias("parent_heavy"))
    heavy = F.col("weight") >= share
    light = materialise(nodes.filter(~heavy).drop("weight"), "light")
    start = manifest.leaves.select(
        "key", F.col("hash").alias("leaf"), "parent", (F.col("parent_weight") >= share).alias("heavy"),
        F.expr(_FOLD.format(links="links", start="coalesce(given, hash)")).alias("folded"),
        F.expr(_SIBLINGS.format(links="links")).alias("proof"), "subroot", "root")
    low = spark.sql(_CLIMB % {"hint": "", "ended": "heavy"}, start=start, nodes=light)
    high = spark.sql(_CLIMB % {"hint": "/*+ BROADCAST(n) */", "ended": "parent IS NULL"},
                     start=materialise(low, "low"), nodes=nodes.filter(heavy).drop("weight"))
    digest = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded")}
    return high.select(
        "key", digest["leaf"].alias("leaf"), digest["subroot"].alias("subroot"),
        digest["root"].alias("root"), F.transform("proof", lambda s: F.lower(F.hex(s))).alias("proof"),
        digest["folded"].alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
