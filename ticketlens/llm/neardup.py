"""Near-duplicate classes from bottom-k sketches of one hash function.

1. A document's shingles are hashed once; the ``k`` smallest hashes are its sketch. Documents with
   the same shingle set form one class, and only classes go on.
2. Inverted lists of retained values. Two sets with the wanted similarity share at least ``c`` of
   their retained values, so a list only needs a value where it is among the ``m - c + 1`` rarest of
   a sketch of ``m`` values. Values that one class alone has fill most of these places, so a unique
   document leaves no entry. The classes with entries get their full sets, and the same lists over
   full sets (``c`` is then exact) leave out documents that only share a passage with others.
3. Star rounds: every list offers its members to a few central members, which is linear in the list
   and joins groups of copies. Rounds end when one leaves more than half of the open pairs. What lists
   still hold of different components is offered pair by pair at the end, block by block; nothing is
   capped.
4. The union of two sketches estimates their similarity; pairs far below are dropped.
5. The rest is decided on full sets, and links are closed to components by alternating star steps.

On sketches, ``c`` is exact for sets whose sketches are complete. Otherwise it is k / 2, which two
sets of similarity 0.8 miss with a probability below 1e-7 for k = 64 (binomial tail; it does not
depend on the size of the corpus).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_batches, free_name
from ticketlens.session import materialise

K = 64
PERCENT = 80
#: the estimate may be this much below the wanted similarity (six standard deviations at k = 64)
MARGIN = 30
#: members of one block of a list, and values of their sets, at most on average
BLOCK, BLOCK_VALUES = 1024, 1 << 18
#: distinct values of a block that are compared at once
COLUMNS = 4096
#: heads that a star round draws from every list, and the most rounds before all pairs are offered
HEADS = 3
STAR_ROUNDS = 5
CACHED_WORDS = 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) < 64:
            self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _MIX_A
    h = (h ^ (h >> _S33)) * _MIX_B
    return h ^ (h >> _S33)


def shingle_sets(texts: list[str | None], width: int, words: _WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text. Words are runs of anything
    but ASCII white space, A-Z in lower case; a text of fewer words is one shingle."""
    split = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter((words[w] for s in split for w in s), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    out = []
    hashes = _mix(flat + np.uint64(width))
    for j in range(1, width):
        hashes = _mix((hashes[:-1] if j < len(flat) else hashes[:0]) * _MIX_A + flat[j:])
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        start = end - size
        if size >= width:
            own = hashes[start:end - width + 1]
        elif size:
            own = _mix(flat[start:start + 1] + np.uint64(size))
            for j in range(1, size):
                own = _mix(own * _MIX_A + flat[start + j:start + j + 1])
        else:
            own = flat[:0]
        out.append(np.unique(own.view(np.int64)))
    return out


def _batched(texts: pd.Series, width: int, words: _WordHashes) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), 500):
        yield from shingle_sets(list(texts.iloc[at:at + 500]), width, words)


def sketch(docs: DataFrame, key: str, text: str, width: int, k: int) -> DataFrame:
    """key, n (set size), digest (of the set, null if empty), sketch (k smallest hashes)."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for texts in batches:
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None,
                     s[:k]) for s in _batched(texts, width, words)]
            yield pd.DataFrame(rows, columns=["n", "digest", "sketch"])

    udf = F.pandas_udf(read, "n long, digest binary, sketch array<long>")
    return docs.select(F.col(key).alias("key"), udf(F.col(text)).alias("s")).select("key", "s.*")


def _least_overlap(n: Column, k: int, percent: int) -> Column:
    """Retained values that a set of size ``n`` shares with any set similar enough."""
    whole = F.floor((n * percent + 99) / 100)
    return F.when(n * 100 <= percent * k, whole).otherwise(F.lit(k // 2))


def _rarest(sets: DataFrame, values: str, k: int, percent: int) -> DataFrame:
    """cid, n, shared, rarest: the rarest values of every class that can matter, and how many of its
    values other classes have too. One row per class that has such values."""
    long = sets.select("cid", "n", F.size(values).alias("m"), F.explode(values).alias("value"))
    # The values are the bulk of what is moved here; counting where they meet moves them once.
    counted = long.withColumn("df", F.count("*").over(Window.partitionBy("value"))).filter("df > 1")
    common = counted.groupBy("cid", "n", "m").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    places = F.col("m") - _least_overlap(F.col("n"), k, percent) + 1
    take = F.greatest(places - (F.col("m") - F.size("common")), F.lit(0)).cast("int")
    shared = F.size("common").cast("long")
    kept = common.select("cid", "n", shared.alias("shared"), F.slice("common", 1, take).alias("c"))
    return kept.filter(F.size("c") > 0).select("cid", "n", "shared", F.col("c.value").alias("rarest"))


def postings(sets: DataFrame, values: str, k: int, percent: int) -> DataFrame:
    """value, cid, n, shared: ``_rarest`` as inverted lists."""
    return _rarest(sets, values, k, percent).select("cid", "n", "shared", F.explode("rarest").alias("value"))


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether two classes can be similar enough, by their sizes and by how many of their values any
    other class has: no more than that can be common."""
    most = F.least(a["shared"], b["shared"])
    return (most * (100 + percent) >= (a["n"] + b["n"]) * percent) & (
        a["n"] * 100 >= b["n"] * percent) & (b["n"] * 100 >= a["n"] * percent)


def _with_components(entries: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return entries.withColumn("comp", F.col("cid"))
    return entries.join(components, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _star_pairs(named: DataFrame, percent: int, seed: int) -> DataFrame:
    """Every member of a list with the list's heads, unless they are one component already. Heads
    are members that share most with others, drawn by hash."""
    member = F.struct("cid", "n", "shared", "comp")
    tenth = F.floor(F.col("shared") * 10 / F.col("n"))
    heads = named.groupBy("value").agg(*[
        F.min(F.struct((-tenth).alias("tenth"), F.xxhash64("cid", F.lit(seed * HEADS + r)).alias("draw"),
                       member.alias("member"))).alias(f"h{r}") for r in range(HEADS)])
    heads = materialise(heads.select("value", F.array_distinct(
        F.array(*[F.col(f"h{r}.member") for r in range(HEADS)])).alias("heads")), "heads")
    own = F.struct("cid", "n", "shared", "comp")
    met = named.join(heads, "value").select(own.alias("own"), F.filter(
        "heads", lambda h: (h["comp"] != F.col("comp")) & _may_link(h, own, percent)).alias("fit"))
    pairs = met.select("own.cid", F.explode("fit.cid").alias("head"))
    return pairs.select(F.least("cid", "head").alias("a"),
                        F.greatest("cid", "head").alias("b")).distinct()


def _open_pairs(named: DataFrame) -> int:
    """How many pairs of different components the lists hold."""
    sizes = named.groupBy("value", "comp").agg(F.count("*").alias("c"))
    lists = sizes.groupBy("value").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return lists.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0


def _meetings(named: DataFrame, percent: int) -> DataFrame:
    """value, i, j, cid, comp: the members that meet where blocks i and j of a list do. Blocks are as
    large as a task's memory allows, because a member is a row once per block of its list."""
    mixed = materialise(named.groupBy("value").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_VALUES)).alias("blocks")
    ).filter("low < high").select("value", "blocks"), "mixed")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    blocks = named.join(mixed, "value").groupBy("value", block.alias("block")).agg(
        F.collect_list(F.struct("cid", "n", "shared", "comp")).alias("members"))
    blocks = materialise(blocks, "blocks")
    left = blocks.select("value", F.col("block").alias("i"), F.col("members").alias("x"))
    right = blocks.select("value", F.col("block").alias("j"), F.col("members").alias("y"))

    def with_partner(these: str, those: str) -> Column:
        return F.filter(these, lambda x: F.exists(those, lambda y: (
            (x["comp"] != y["comp"]) & _may_link(x, y, percent))))

    met = left.join(right, "value").filter("i <= j").select(
        "value", "i", "j", F.array_union(with_partner("x", "y"), with_partner("y", "x")).alias("m"))
    return met.select("value", "i", "j", F.explode("m").alias("m")).select(
        "value", "i", "j", "m.cid", "m.comp")


def _cross_links(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among all pairs of a list's members in different components. A list is cut into blocks;
    a pair of blocks is one piece of work, to which the sets come once per member, so no pair is ever
    a row unless it is a link."""
    rows = _meetings(named, percent).join(sets.select("cid", "set"), "cid")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        cids, comps = group["cid"].to_numpy(), group["comp"].to_numpy()
        sizes = np.array([len(v) for v in group["set"]])
        member = np.repeat(np.arange(len(cids)), sizes)
        _, place, many = np.unique(np.concatenate(list(group["set"])), return_inverse=True,
                                   return_counts=True)
        common = np.zeros((len(cids), len(cids)), dtype=np.float32)
        met = many > 1  # a value that one member alone has is common to no two
        member, place = member[met[place]], (np.cumsum(met) - 1)[place[met[place]]]
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(0, int(met.sum()) + COLUMNS, COLUMNS))
        for k, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            some = order[start:end]
            cells = np.zeros((len(cids), COLUMNS), dtype=np.float32)
            cells[member[some], place[some] - k * COLUMNS] = 1.0
            common += cells @ cells.T
        common = common.astype(np.int64)
        every = sizes[:, None] + sizes[None, :] - common
        a, b = np.nonzero((common * 100 >= every * percent) & (comps[:, None] != comps[None, :])
                          & (cids[:, None] < cids[None, :]))
        return pd.DataFrame({"a": cids[a], "b": cids[b]})

    return rows.groupBy("value", "i", "j").applyInPandas(links, "a long, b long").distinct()


def _promising(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union sketch does not speak against them: of the k smallest hashes of both
    sketches together, the share that both have."""
    slim = classes.select("cid", "sketch")
    met = pairs.join(slim.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a").join(
        slim.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.array_intersect(union, F.array_intersect("sa", "sb"))
    return met.filter(F.size(both) * 100 >= F.size(union) * (percent - MARGIN)).select("a", "b")


def _similar(percent: int):
    def decide(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both * 100 >= percent * (len(a) + len(b) - both))
        return pd.Series(out)

    return F.pandas_udf(decide, "boolean")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are similar enough on their full sets."""
    met = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b").join(
        sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a")
    return met.filter(_similar(percent)("sa", "sb")).select("a", "b")


def _full_sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """cid, n, set of the ``wanted`` classes (cid, rep, digest), read again from one document each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for batch in batches:
            rows = []
            for cid, digest, s in zip(batch["cid"], batch["digest"],
                                      _batched(batch["text"], width, words), strict=True):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(digest):
                    rows.append((cid, len(s), s))
            yield pd.DataFrame(rows, columns=["cid", "n", "set"])

    as_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = docs.select(as_text.alias("k"), F.col(text).alias("text")).join(
        wanted.select(F.coalesce(F.col("rep").cast("string"), F.lit("")).alias("k"), "cid", "digest"),
        "k").select("cid", "digest", "text")
    return found.mapInPandas(read, "cid long, n long, set array<long>").dropDuplicates(["cid"])


def _is_forest(edges: DataFrame) -> bool:
    """Whether every u hangs on one v that hangs on nothing: a star step would change nothing."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """cid, comp (smallest member) of all members of ``links`` (a, b), by alternating steps: large
    star hangs larger neighbours on the smallest one, small star the smaller ones. ``links`` is read
    several times, so it should be a written table."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        # One row per edge, so repeated ones need not be dropped before the small star.
        large = materialise(both.join(least, "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")), "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(smallest, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(
            smallest.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "small")
        if _is_forest(edges):
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp"))


def _joined(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after ``links`` are added: a component goes in as its members' links to its
    smallest one."""
    if components is None:
        return connected(links)
    return connected(links.unionByName(
        components.select(F.col("cid").alias("a"), F.col("comp").alias("b"))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = PERCENT, k: int = K) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id (smallest key in the component),
    kept (key = component_id).

    Documents are linked if 100 * common >= ``percent`` * all of their distinct shingles; links are
    closed transitively. A null or empty text, or one of white space, has no shingles and is linked
    with nothing. Rows with one key are one member each; a null key is the component's id only if no
    member has another. Repeated rows agree in every column. Other columns are not read. An empty
    table gives no rows.
    """
    rows = materialise(sketch(bounded_batches(docs), key, text, width, k), "sketches")
    found = rows.filter("n > 0")
    classes = materialise(found.groupBy("digest").agg(
        F.min("key").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    ).select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    near = _rarest(classes, "sketch", k, percent).select("cid")
    wanted = classes.select("cid", "rep", "digest").join(near, "cid", "left_semi")
    sets = materialise(_full_sets(docs, key, text, width, wanted), "sets")
    everything = (classes.agg(F.max("n")).first()[0] or 0) * 100 + 100
    entries = materialise(postings(sets, "set", everything, percent), "postings")
    size = entries.count()

    def linked_now(pairs: DataFrame) -> DataFrame:
        good = materialise(_promising(pairs, classes, k, percent), "pairs")
        return materialise(_links(good, sets, percent), "links")

    components, before = None, None
    for seed in range(STAR_ROUNDS):
        named = materialise(_with_components(entries, components), "named")
        now = _open_pairs(named)
        if now <= size or (before is not None and now * 2 > before):
            break
        before = now
        found_now = linked_now(_star_pairs(named, percent, seed))
        if found_now.isEmpty():
            break
        components = _joined(components, found_now)
    else:
        named = materialise(_with_components(entries, components), "named")
    rest = materialise(_cross_links(named, sets, percent), "links")
    if not rest.isEmpty():
        components = _joined(components, rest)
    if components is None:
        components = classes.select("cid", F.col("cid").alias("comp")).limit(0)
    named = classes.select("cid", "digest", "rep").join(components, "cid", "left").select(
        "digest", "rep", F.coalesce("comp", "cid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_digest = materialise(named.join(least, "comp").select("digest", "component_id"), "components")
    linked = found.join(by_digest, "digest").select("key", "n", "component_id")
    alone = rows.filter("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text",
                           width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest key of every component. Rows that repeat that key
    stay with it (exact copies are another operator's work)."""
    k = free_name(docs, "_stay_key")
    as_text = F.coalesce(F.col(key).cast("string"), F.lit("")).alias(k)
    stay = near_duplicates(docs, key, text, width, percent).filter("kept").select(as_text).distinct()
    return docs.select("*", as_text).join(stay, k, "left_semi").select(*docs.columns)
