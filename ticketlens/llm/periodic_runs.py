"""Periodic runs of words, found by the branching-tandem test on an enhanced suffix array.

Texts are independent of each other, so a task builds one suffix array over as many of its texts as
make ``CHUNK_WORDS`` words (or over one longer text); the text number leads every sort key and each
text ends in a word of its own, so that no interval reaches from one text into another.

Per chunk: suffixes are sorted by doubling, only tied ones again in each round; the ranks of every
round are kept and give LCP values and left extensions by halving steps. An LCP interval of depth d
is found by the nearest smaller LCP values on both sides. Of all children of an interval but the
largest, every suffix i looks up ISA[i + d] and ISA[i - d]: if that suffix lies in the interval, in
another child, the words at i and i + d begin a square that cannot be shifted to the right.
Rotating it to the left as far as the words allow gives the whole run; squares of squares end in the
same stretch and are merged into the one of the smallest period.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import bounded_batches, free_name

CHUNK_WORDS = 400_000
WHITE = r"[\x20\x09-\x0D]+"

RUN_TYPE = T.ArrayType(T.StructType([
    T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")]), False)


def _sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array, ranks after each doubling round (by the first 2^j words), and for every place
    of the array the last round in which its suffix was tied with the one before it (-1: never)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    place = np.arange(n)
    tied = np.zeros(n, dtype=bool)
    tied[1:] = words[order[1:]] == words[order[:-1]]
    heads = np.maximum.accumulate(np.where(tied, 0, place))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = heads
    rounds, last_tie = [rank], np.where(tied, 0, -1)
    open_places = np.flatnonzero(tied | np.append(tied[1:], False))
    width = 1
    while len(open_places):
        suffixes = order[open_places]
        key = rank[suffixes] * n + rank[suffixes + width]
        by_key = np.argsort(key, kind="stable")
        key, suffixes = key[by_key], suffixes[by_key]
        order[open_places] = suffixes
        tied = np.zeros(len(key), dtype=bool)
        tied[1:] = key[1:] == key[:-1]
        heads = np.maximum.accumulate(np.where(tied, 0, np.arange(len(key))))
        rank = rank.copy()
        rank[suffixes] = open_places[heads]
        rounds.append(rank)
        last_tie[open_places[tied]] = len(rounds) - 1
        open_places = open_places[tied | np.append(tied[1:], False)]
        width *= 2
    return order, rounds, last_tie


def _common_prefixes(order: np.ndarray, rounds: list[np.ndarray], last_tie: np.ndarray) -> np.ndarray:
    """LCP[k] of the suffixes at places k - 1 and k; one more zero closes the array."""
    lcp = np.zeros(len(order) + 1, dtype=np.int64)
    places = np.empty(0, dtype=np.int64)
    for j in range(len(rounds) - 1, -1, -1):
        places = np.concatenate([places, np.flatnonzero(last_tie == j)])
        done = lcp[places]
        same = rounds[j][order[places - 1] + done] == rounds[j][order[places] + done]
        lcp[places] += same.astype(np.int64) << j
    return lcp


def _nearest(lcp: np.ndarray, places: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For every place the nearest one in direction ``step`` whose value is smaller (or equal).
    All places jump at once; a place may use the pointer another has reached so far, because
    everything between a place and its pointer is known to be too large."""
    to = np.arange(len(lcp)) + step
    to[0], to[-1] = 0, len(lcp) - 1
    left = places
    while len(left):
        value, there = lcp[left], lcp[to[left]]
        left = left[there > value if equal else there >= value]
        to[left] = to[to[left]]
    return to


def _branching_squares(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares that cannot be shifted to the right."""
    n = len(order)
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    inner = np.flatnonzero(lcp)
    if not len(inner):
        return inner, inner
    low = _nearest(lcp, inner, -1, False)[inner]
    high = _nearest(lcp, inner, 1, False)[inner] - 1
    before = _nearest(lcp, inner, -1, True)
    after = _nearest(lcp, inner, 1, True)[inner]
    depth = lcp[inner]

    first = np.arange(n + 1)  # the first inner place of the interval that a place belongs to
    linked = lcp[before[inner]] == depth
    first[inner[linked]] = before[inner[linked]]
    while True:
        further = first[first[inner]]
        if np.array_equal(further, first[inner]):
            break
        first[inner] = further
    interval = first[inner]

    opens = ~linked
    start = np.concatenate([inner, low[opens]])
    end = np.concatenate([after, inner[opens]])  # exclusive
    owner = np.concatenate([interval, interval[opens]])
    lo, hi, d = (np.concatenate([x, x[opens]]) for x in (low, high, depth))
    score = (end - start) * len(start) + np.arange(len(start))
    largest = np.zeros(n + 1, dtype=np.int64)
    np.maximum.at(largest, owner, score)
    small = np.flatnonzero(largest[owner] != score)

    size = (end - start)[small]
    child = np.repeat(small, size)
    place = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + start[child]
    suffix, period = order[place], d[child]
    found = []
    for other, begin in ((suffix + period, suffix), (suffix - period, suffix - period)):
        there = inverse[np.maximum(other, 0)]
        meets = (other >= 0) & (there >= lo[child]) & (there <= hi[child])
        meets &= (there < start[child]) | (there >= end[child])
        found.append((begin[meets], period[meets]))
    squares = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
    return squares[:, 0], squares[:, 1]


def runs_of_words(words: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Runs of a sequence of word numbers as rows (start, length, period), by start, then period.
    Words that must not match anything have numbers of their own."""
    order, rounds, last_tie = _sorted_suffixes(words)
    start, period = _branching_squares(order, _common_prefixes(order, rounds, last_tie))
    turned = np.zeros(len(start), dtype=np.int64)  # rotations to the left
    for j in range(len(rounds) - 1, -1, -1):
        a = start - turned - (1 << j)
        same = a >= 0
        same &= rounds[j][np.maximum(a, 0)] == rounds[j][np.maximum(a, 0) + period]
        turned += same.astype(np.int64) << j
    length = 2 * period + turned
    wanted = (length >= least_length) & (length >= least_exponent * period)
    rows = np.stack([start - turned, length, period], axis=1)[wanted]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    merged = np.ones(len(rows), dtype=bool)
    merged[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[merged]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _chunks(texts: Iterable[bytes | None]) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for text in texts:
        words = (text or b"").split()
        if chunk and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words) + 1
    if chunk:
        yield chunk


def _chunk_runs(chunk: list[list[bytes]], least_length: int,
                least_exponent: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Every text's words with its runs."""
    names: dict[bytes, int] = {}
    sizes = np.array([len(words) + 1 for words in chunk])
    starts = np.cumsum(sizes) - sizes
    numbers = np.empty(int(sizes.sum()), dtype=np.int64)
    for words, at in zip(chunk, starts):
        numbers[at:at + len(words)] = [names.setdefault(w, len(names)) for w in words]
        numbers[at + len(words)] = -1
    numbers += 1 + np.repeat(np.arange(len(chunk)), sizes) * (len(names) + 1)
    runs = runs_of_words(numbers, least_length, least_exponent)
    cut = np.searchsorted(runs[:, 0], np.append(starts, len(numbers)))
    for k, words in enumerate(chunk):
        own = runs[cut[k]:cut[k + 1]]
        yield words, own - np.array([starts[k], 0, 0])


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    drop = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        drop[start + period:start + length] = True
    return b" ".join([w for w, gone in zip(words, drop) if not gone])


def find_runs(docs: DataFrame, text: str = "text", least_length: int = 6,
              least_exponent: int = 4) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``runs`` (array of start, length, period in words, by start,
    then period) and ``collapsed`` (the words joined by one space, without those that repeat the
    first period of a run). A run is a maximal stretch of smallest period q that is at least
    ``least_length`` and ``least_exponent`` * q words long; the exponent is 2 or more.

    Words are what stands between white space (space, tab to carriage return). A null or empty text
    has no words, no runs and an empty ``collapsed``. Rows are independent: null or repeated keys and
    repeated rows each keep their own result. New columns get a trailing ``_`` where ``docs`` has one
    of that name. A task holds one Arrow batch and the suffix array of ``CHUNK_WORDS`` words, or of
    one longer text.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    names = [free_name(docs, name) for name in ("n_words", "runs", "collapsed")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()),
                           T.StructField(names[1], RUN_TYPE), T.StructField(names[2], T.StringType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            counts, found, left = [], [], []
            for chunk in _chunks(v.as_py() for v in texts):
                for words, runs in _chunk_runs(chunk, least_length, least_exponent):
                    counts.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()])
                    left.append(_collapse(words, runs))
            kind = pa.list_(pa.field("element", pa.struct([
                pa.field(name, pa.int64(), False) for name in ("start", "length", "period")]), False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind),
                 pa.array(left, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names, *names])

    return bounded_batches(docs, 500).mapInArrow(label, schema)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text; where 10 divides h = crc32(key as decimal text), every word from a = g % n on
    (g = h div 10, n words) is replaced by the one at a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    Null keys and texts without words stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(F.col(key), F.col(text), F.when(h % 10 == 0, F.floor(h / 10)).alias("_g"),
                       F.when(h % 10 == 0, _words(F.col(text))).alias("_words"))
    n = F.size("_words").cast("long")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    rows = rows.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    moved = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return rows.select(key, F.when(F.col("_a").isNotNull(), F.concat_ws(" ", moved))
                       .otherwise(F.col(text)).alias(text))


def run_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of ``find_runs``: ``key``, ``n_runs``, the run of the greatest exponent (ties:
    smallest start, then period; nulls without a run) and digests of all runs and of what is left."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]),
        F.struct(*[r[c].alias(c) for c in ("start", "length", "period")])).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    rows = found.select(key, "runs", "collapsed", best.alias("top"), listed.alias("listed"))
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.col("listed"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
