"""Exact duplicates by deterministic block naming.

A text is cut into blocks of ``block_bytes`` bytes. All distinct blocks are sorted and numbered;
then neighbouring pairs of numbers are sorted and numbered again, and so on, until one number is
left per document. Two texts of the same number of blocks are equal exactly if their last numbers
are equal: every numbering compares contents, never digests alone.

Two 64-bit fingerprints stand for a block between the numbering and the documents, so that texts
are shuffled once. The numbering sees the contents; if it finds two blocks with the same pair of
fingerprints, the work starts again with another seed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import free_name
from ticketlens.session import materialise

BLOCK_BYTES = 4096


def seeded_prints(block: Column, seed: int) -> Column:
    """Two fingerprints of a block."""
    return F.struct(
        F.xxhash64(F.lit(2 * seed), block).alias("a"),
        F.xxhash64(F.lit(2 * seed + 1), block).alias("b"),
    )


def _blocks(text: Column, size: int) -> Column:
    raw = F.coalesce(text, F.lit("")).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(raw) / size).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, size))


def _number(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Distinct keys with an integer name each: sorted within the parts of one exchange, numbered
    by part and place, and written so that the numbers never change."""
    distinct = rows.dropDuplicates(list({*keys, *order}))
    numbered = distinct.sortWithinPartitions(*order)
    return materialise(
        numbered.select(*keys, (F.monotonically_increasing_id() + 1).alias("name")), label
    )


def _named_blocks(docs: DataFrame, text: str, carry: Sequence[str], size: int,
                  prints: Callable[[Column, int], Column]) -> tuple[DataFrame, DataFrame]:
    """Documents as arrays of fingerprints, and the names of all distinct blocks."""
    seed = 0
    while True:
        blocks = docs.select(F.explode(_blocks(F.col(text), size)).alias("block"))
        found = blocks.select(prints(F.col("block"), seed).alias("p"), "block")
        found = found.select("p.a", "p.b", "block")
        names = _number(found, ["a", "b"], ["block"], "blocks")
        clash = names.groupBy("a", "b").count().filter("count > 1").limit(1).count()
        if not clash:
            break
        seed += 1
    table = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("_doc"),
            *carry,
            F.transform(_blocks(F.col(text), size), lambda b: prints(b, seed)).alias("_prints"),
        ).withColumn("_n", F.size("_prints")),
        "prints",
    )
    return table, names


def name_texts(docs: DataFrame, text: str = "text", carry: Sequence[str] = (),
               block_bytes: int = BLOCK_BYTES,
               prints: Callable[[Column, int], Column] = seeded_prints) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, ``n_blocks`` and ``name``. Rows agree in
    both exactly if their texts are the same bytes. A null text counts as empty."""
    table, names = _named_blocks(docs, text, carry, block_bytes, prints)
    first = table.filter("_n = 1").select(
        *carry, F.col("_n").alias("n_blocks"), F.col("_prints")[0]["a"].alias("a"),
        F.col("_prints")[0]["b"].alias("b"),
    )
    single = first.join(names, ["a", "b"]).select(*carry, "n_blocks", "name")
    longest = table.agg(F.max("_n")).first()[0] or 0
    if longest <= 1:
        return single
    rows = table.filter("_n > 1").select("_doc", "_n", F.posexplode("_prints").alias("pos", "p"))
    rows = rows.select("_doc", "_n", "pos", "p.a", "p.b").join(names, ["a", "b"])
    rows = rows.select("_doc", "_n", "pos", "name")
    done = None
    left = longest
    step = 0
    while left > 1:
        step, left = step + 1, (left + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = rows.groupBy("_doc", "_n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"),
        )
        pairs = materialise(pairs, "pairs")
        numbers = _number(pairs.select("a", "b"), ["a", "b"], ["a", "b"], "names")
        named = pairs.join(numbers, ["a", "b"]).select("_doc", "_n", "pos", "name")
        size_now = F.ceil(F.col("_n") / float(2**step))
        ready = named.filter(size_now == 1).select("_doc", "name")
        done = ready if done is None else done.unionByName(ready)
        rows = named.filter(size_now > 1)
    several = table.filter("_n > 1").select("_doc", *carry, F.col("_n").alias("n_blocks"))
    return single.unionByName(several.join(done, "_doc").select(*carry, "n_blocks", "name"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     block_bytes: int = BLOCK_BYTES,
                     prints: Callable[[Column, int], Column] = seeded_prints) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id`` (largest key among equal texts),
    ``group_size``, ``kept``, ``text_sha256``.

    Nulls: a null text is an empty text; a null key loses against any other key and stays only in a
    group without other keys. Repeated rows (same key, same text) count in ``group_size`` and agree
    in ``kept``. Other columns are not read. An empty table gives an empty result.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    plain = docs.select(F.col(key).alias("_key"), F.unhex(digest).alias("_sha"),
                        F.col(text).alias("_text"))
    named = materialise(name_texts(plain, "_text", ["_key", "_sha"], block_bytes, prints), "named")
    groups = named.groupBy("n_blocks", "name").agg(
        F.max("_key").alias("keep_id"), F.count("*").alias("group_size")
    )
    return named.join(groups, ["n_blocks", "name"]).select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_one_per_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest key, once."""
    k, sha = free_name(docs, "_stay_key"), free_name(docs, "_stay_sha")
    as_text = F.coalesce(F.col(key).cast("string"), F.lit("")).alias(k)
    stay = exact_duplicates(docs, key, text).filter("kept").select(
        as_text, F.col("text_sha256").alias(sha)).distinct()
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias(sha)
    marked = docs.select("*", as_text, digest)
    return marked.join(stay, [k, sha], "left_semi").dropDuplicates([k, sha]).select(*docs.columns)
