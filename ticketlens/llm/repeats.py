"""Repeated passages over all documents, by common-prefix intervals of a sampled suffix array.

Every window of ``WINDOW`` bytes names one of its suffix starts, its anchor: the place whose
``ANCHOR`` bytes hash lowest. Equal windows name the same place, so a passage that stands twice meets
itself at an anchor; the windows that name one anchor are neighbours and make up its context. Three
steps, all over whole texts:

1. Anchors (not texts) are range-sorted by the hash of their suffix's first bytes, then by their
   context's digest, which splits a hot key over as many parts as it needs. An anchor's neighbours in
   this order tell all there is to know: a neighbour with the same context repeats every window of
   it; one that shares only the anchor may repeat some. The rows at the edges of a part are completed
   from the edges of the next part.
2. Texts meet their anchors once. Documents whose anchors are all decided are done. For others, one
   context of each kind under an ambiguous anchor is cut out.
3. Contexts of one anchor form a bucket of the suffix array. Suffixes are sorted, a stack scan over
   their LCP values gives every common-prefix interval, and within an interval a second scan over the
   reversed text to the left tells where left extensions differ: these are the maximal repeats with all
   their occurrences. A bucket of more than ``HOT`` contexts is split by where the window may begin,
   again and again, down to single windows, which are equal if their digests are.

Two contexts count as equal if 128 bits of two different hashes agree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.llm.common import sized_batches
from ticketlens.session import materialise

WINDOW = 200
ANCHOR = 64
HOT = 2_000
SLICE = 1 << 20

DONE, PENDING, CONTEXT = range(3)

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xFFFFFF)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, dtype=np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    return np.cumprod(base), np.cumprod(back)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _suffix_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from every place on."""
    n = len(data)
    powers, back = _powers(SLICE + WINDOW)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
    h = (total[ANCHOR:] - total[:-ANCHOR]) * back[:n - ANCHOR + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def _pieces(texts: Iterable[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in slices of at most ``SLICE`` window starts: (number, offset, bytes)."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(len(text) - WINDOW + 1, 0), SLICE):
            piece = text[offset:offset + SLICE + WINDOW - 1]
            if held and size + len(piece) > SLICE:
                yield held
                held, size = [], 0
            held.append((number, offset, piece))
            size += len(piece)
    if held:
        yield held


def _slice_anchors(pieces: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Number, anchor place, bytes of its context before it and windows beyond the first, hash of the
    suffix, digest of the context."""
    joined = b"".join(piece for _, _, piece in pieces)
    data = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(piece) for _, _, piece in pieces])
    ends = np.cumsum(sizes)
    hashes = _suffix_hashes(data)
    key = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    anchor = (_PLACE - (_sliding_least(key, WINDOW - ANCHOR + 1) & _PLACE)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[:len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= ends[piece])
    anchor, piece = anchor[start], piece[start]
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start)) - 1
    at, owner = anchor[first], piece[first]
    named = hashes[at].view(np.int64).tolist()
    begins = (ends - sizes)[owner].tolist()
    for h, a, k, s0, s1, begin in zip(named, at.tolist(), owner.tolist(), start[first].tolist(),
                                      start[last].tolist(), begins):
        digest = _signed(xxhash.xxh3_64_intdigest(joined[s0:s1 + WINDOW], a - s0))
        number, offset, _ = pieces[k]
        yield number, offset + a - begin, a - s0, s1 - s0, h, digest


def _pack(place: int, before: int, more: int) -> int:
    return place << 16 | before << 8 | more


def _unpack(packed: int) -> tuple[int, int, int]:
    """Anchor place, first byte of the context, end of the context."""
    place, before, more = packed >> 16, packed >> 8 & 255, packed & 255
    return place, place - before, place - before + more + WINDOW


def _texts(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("suffix", T.LongType()), T.StructField("context", T.LongType()),
        T.StructField("key", docs.schema[key].dataType), T.StructField("print", T.LongType()),
        T.StructField("place", T.LongType())])
    arrow = to_arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            prints = [zlib.crc32(t) for t in texts]
            for pieces in _pieces(texts):
                rows = list(_slice_anchors(pieces))
                if rows:
                    number, place, before, more, suffix, digest = zip(*rows)
                    packed = [_pack(p, b, m) for p, b, m in zip(place, before, more)]
                    keys = batch.column(0).take(pa.array(number, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(suffix, pa.int64()), pa.array(digest, pa.int64()),
                         keys.cast(arrow.field("key").type),
                         pa.array([prints[i] for i in number], pa.int64()),
                         pa.array(packed, pa.int64())], schema=arrow)

    return sized_batches(docs.select(key, text)).mapInArrow(find, schema)


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted anchors that share their suffix hash with a neighbour, and the first and last row.
    ``full``: a neighbour has the same context. ``mixed``: one has another context."""

    def judge(table: pa.Table, before: tuple | None, after: tuple | None) -> pa.Table:
        suffix = table.column("suffix").to_numpy()
        context = table.column("context").to_numpy()
        n = len(suffix)
        same = np.zeros((2, n), dtype=bool)  # suffix as in the row before / after
        alike = np.zeros((2, n), dtype=bool)  # context too
        same[0, 1:] = same[1, :-1] = suffix[1:] == suffix[:-1]
        alike[0, 1:] = alike[1, :-1] = same[0, 1:] & (context[1:] == context[:-1])
        for side, at, other in ((0, 0, before), (1, n - 1, after)):
            if other is not None:
                same[side, at] = suffix[at] == other[0]
                alike[side, at] = same[side, at] and context[at] == other[1]
        edge = np.zeros(n, dtype=np.int32)
        edge[0] |= before is None
        edge[-1] |= 2 * (after is None)
        full, mixed = alike.any(axis=0), (same & ~alike).any(axis=0)
        table = table.append_column("full", pa.array(full)).append_column("mixed", pa.array(mixed))
        table = table.append_column("edge", pa.array(edge))
        return table.filter(pa.array(full | mixed | (edge > 0)))

    def ends(table: pa.Table, at: int) -> tuple:
        return table.column("suffix")[at].as_py(), table.column("context")[at].as_py()

    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            yield from judge(held, before, ends(table, 0)).to_batches()
            before = ends(held, -1)
        held = table
    if held is not None:
        yield from judge(held, before, None).to_batches()


def _shared_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors whose suffix hash occurs again: with ``full`` and ``mixed`` as in the sorted order."""
    order = ["suffix", "context", "key", "print", "place"]
    schema = T.StructType([*anchors.schema.fields, T.StructField("full", T.BooleanType()),
                           T.StructField("mixed", T.BooleanType()), T.StructField("edge", T.IntegerType())])
    ordered = anchors.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    table = ordered.mapInArrow(_compare_neighbours, schema).withColumn("part", F.spark_partition_id())
    table = materialise(table, "anchors")
    beside = Window.orderBy("part", "edge")  # two rows at most of every part of the sort
    edges = table.filter("edge > 0")
    for side, other, bit in (("before", F.lag, 1), ("after", F.lead, 2)):
        there = F.col("edge").bitwiseAND(bit) > 0
        same = F.coalesce(other("suffix").over(beside) == F.col("suffix"), F.lit(False)) & there
        alike = same & (other("context").over(beside) == F.col("context"))
        edges = edges.withColumn(f"alike_{side}", alike).withColumn(f"other_{side}", same & ~alike)
    edges = edges.select(*order, (F.col("full") | F.col("alike_before") | F.col("alike_after")).alias("full"),
                         (F.col("mixed") | F.col("other_before") | F.col("other_after")).alias("mixed"))
    return table.filter("edge = 0").select(edges.columns).unionByName(edges.filter("full OR mixed"))


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _result_fields(key_type: T.DataType) -> list[T.StructField]:
    return [T.StructField("key", key_type), T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()), T.StructField("spans", _SPANS),
            T.StructField("kept", T.BinaryType())]


def _result(key: object, text: bytes, spans: list[tuple[int, int]], digest: bool) -> dict:
    kept = _cut(text, spans)
    return {"key": key, "n_bytes": len(text), "n_removed": len(text) - len(kept),
            "spans": [{"start": a, "end": b} for a, b in spans],
            "kept": hashlib.sha256(kept).hexdigest().encode() if digest else kept}


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _read_texts(docs: DataFrame, key: str, text: str, shared: DataFrame, digest: bool) -> DataFrame:
    """Results of documents without open anchors; texts and decided spans of the others; contexts."""
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), *_result_fields(key_type),
        T.StructField("print", T.LongType()), T.StructField("text", T.BinaryType()),
        T.StructField("bucket", T.LongType()), T.StructField("context", T.LongType()),
        T.StructField("open", T.BooleanType()), T.StructField("place", T.LongType()),
        T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    decided = F.when(F.col("mixed"), F.col("suffix")), F.when(F.col("mixed"), F.col("context"))
    found = shared.select("key", "print", F.struct("place", "full", decided[0].alias("suffix"),
                                                   decided[1].alias("context")).alias("anchor"))
    found = found.groupBy(F.col("key").alias("_key"), F.col("print").alias("_print")).agg(
        F.collect_list("anchor").alias("anchors"))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.col(key).alias("key"), raw.alias("text")).withColumn("print", F.crc32("text"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("print") == F.col("_print"))
    joined = texts.join(found, same, "left").select("key", "print", "text", "anchors")

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in batch.to_pylist():
            text, spans, open_anchors = row["text"], [], False
            for a in row["anchors"] or ():
                place, start, end = _unpack(a["place"])
                if a["full"]:
                    spans.append((start, end))
                open_anchors |= not a["full"]
                if a["suffix"] is not None:
                    yield {"kind": CONTEXT, "key": row["key"], "print": row["print"], "place": place,
                           "bucket": a["suffix"], "context": a["context"], "open": not a["full"],
                           "left": text[start:place][::-1], "right": text[place:end]}
            spans = _merged(spans)
            if open_anchors:
                yield {"kind": PENDING, "key": row["key"], "print": row["print"], "text": text,
                       "spans": [{"start": a, "end": b} for a, b in spans]}
            else:
                yield {"kind": DONE} | _result(row["key"], text, spans, digest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(rows(batch), arrow)

    return sized_batches(joined).mapInArrow(read, schema)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """All common-prefix intervals (depth, first, last) of a sorted list, where ``lcp[k]`` belongs to
    the places k - 1 and k: a stack scan, inner intervals before outer ones."""
    stack = [(-1, 0)]
    for k in range(1, len(lcp) + 1):
        depth = lcp[k] if k < len(lcp) else -1
        first = k - 1
        while stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, k - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes],
                    wanted: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through the anchor of a bucket: bytes to the left, bytes to the right and all
    occurrences, for those of ``wanted`` bytes or more. ``lefts`` are read backwards."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0, *(_common(rights[a], rights[b]) for a, b in zip(order, order[1:]))]
    for depth, first, last in intervals(lcp):
        inside = sorted(order[first:last + 1], key=lefts.__getitem__)
        beside = [0, *(_common(lefts[a], lefts[b]) for a, b in zip(inside, inside[1:]))]
        if max(beside) + depth < wanted:
            continue
        for extension, low, high in intervals(beside):
            if extension + depth >= wanted:
                yield extension, depth, inside[low:high + 1]


def _bucket_spans(rows: list[dict]) -> Iterator[tuple[dict, int, int]]:
    """Covered spans of the open contexts of a bucket; contexts of one digest count once."""
    kinds = list({(r["context"], r["left"], r["right"]): r for r in rows}.values())
    reach: dict[int, tuple[int, int]] = {}
    for before, after, members in maximal_repeats([r["left"] for r in kinds], [r["right"] for r in kinds],
                                                  WINDOW):
        for m in members:
            b, a = reach.get(m, (0, 0))
            reach[m] = max(b, before), max(a, after)
    for m, (before, after) in reach.items():
        if kinds[m]["open"]:
            yield kinds[m], kinds[m]["place"] - before, kinds[m]["place"] + after


def _span_rows(contexts: DataFrame) -> DataFrame:
    schema = T.StructType([contexts.schema["key"], contexts.schema["print"],
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = to_arrow_schema(schema)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bucket: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if bucket and row["bucket"] != bucket[0]["bucket"]:
                    yield from found(bucket)
                    bucket = []
                bucket.append(row)
        if bucket:
            yield from found(bucket)

    def found(bucket: list[dict]) -> Iterator[dict]:
        for row, start, end in _bucket_spans(bucket):
            yield {"key": row["key"], "print": row["print"], "start": start, "end": end}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(spans(batches), arrow, 5_000)

    ordered = contexts.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(scan, schema)


def _split(contexts: DataFrame) -> DataFrame:
    """Every context once for each of four ranges of window starts, with what these can reach; the
    bucket is a hash of the bytes that all windows of the range have in common."""
    schema = contexts.schema
    arrow = to_arrow_schema(schema)

    def parts(row: dict) -> Iterator[dict]:
        low, high = row["low"], row["high"]
        step = (high - low) // 4 + 1
        for near in range(low, high + 1, step):
            far = min(near + step - 1, high)
            left, right = row["left"][:far], row["right"][:WINDOW - near]
            if len(left) < near or WINDOW - len(right) > far:
                continue
            core = left[:near][::-1] + right[:WINDOW - far]
            yield row | {"low": near, "high": far, "left": left, "right": right,
                         "bucket": _signed(xxhash.xxh3_64_intdigest(core, near * 256 + far))}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches((part for row in batch.to_pylist() for part in parts(row)), arrow)

    return contexts.mapInArrow(split, schema)


def _open_spans(contexts: DataFrame) -> DataFrame:
    """Spans of open contexts, from buckets of at most ``HOT`` contexts."""
    rows = contexts.withColumn("low", F.lit(0)).withColumn("high", F.lit(WINDOW - ANCHOR))
    found = []
    while True:
        hot = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("high").alias("top"),
                                         F.max("low").alias("bottom")).filter(F.col("n") > HOT)
        hot = materialise(hot, "hot")
        found.append(_span_rows(rows.join(hot, "bucket", "left_anti")))
        left = hot.agg(F.max(F.col("top") - F.col("bottom"))).first()[0]
        if left is None:
            break
        rows = rows.join(hot, "bucket", "left_semi")
        if left == 0:  # single windows, known by two hashes of theirs
            rows = rows.withColumn("window", F.sha2(F.concat(F.hex("left"), F.lit("|"), F.hex("right")), 256))
            twice = rows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1")
            rows = rows.join(twice, "window", "left_semi").filter("open")
            found.append(rows.select("key", "print", (F.col("place") - F.col("low")).alias("start"),
                                     (F.col("place") - F.col("low") + WINDOW).alias("end")))
            break
        rows = materialise(_split(rows), "split")
    return reduce(DataFrame.unionByName, found)


def _finish(pending: DataFrame, spans: DataFrame, digest: bool) -> DataFrame:
    key_type = pending.schema["key"].dataType
    schema = T.StructType(_result_fields(key_type))
    arrow = to_arrow_schema(schema)
    more = spans.groupBy(F.col("key").alias("_key"), F.col("print").alias("_print")).agg(
        F.collect_list(F.struct("start", "end")).alias("more"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("print") == F.col("_print"))
    joined = pending.join(more, same, "left").select("key", "text", "spans", "more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (_result(r["key"], r["text"], _merged((s["start"], s["end"]) for s in
                                                         r["spans"] + (r["more"] or [])), digest)
                    for r in batch.to_pylist())
            yield from _batches(rows, arrow)

    return sized_batches(joined).mapInArrow(finish, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes``, ``n_removed``, ``spans`` (removed runs of
    UTF-8 bytes, end exclusive) and ``kept`` (the bytes that are left, or the hex SHA-256 of them with
    ``digest``, which saves writing texts). Removed is every byte inside a string of ``WINDOW`` bytes
    that starts anywhere else too, in the same text or another, judged on the texts as given.

    Null texts are empty; texts shorter than the window keep all bytes. A row is known by its key and
    a checksum of its text, so null and repeated keys are fine; repeated rows are occurrences of each
    other. Other columns are not read. An empty table gives an empty result. Text that repeats a
    period shorter than ``ANCHOR`` bytes has an anchor per period, or per byte at worst.
    """
    names = ["key", "n_bytes", "n_removed", "spans", "kept"]
    shared = _shared_anchors(_anchor_rows(docs, key, text))
    read = materialise(_read_texts(docs, key, text, shared, digest), "read")
    contexts = read.filter(F.col("kind") == CONTEXT).select(
        "bucket", "context", "key", "print", "place", "open", "left", "right")
    pending = read.filter(F.col("kind") == PENDING).select("key", "print", "text", "spans")
    done = read.filter(F.col("kind") == DONE).select(names)
    return done.unionByName(_finish(pending, _open_spans(contexts), digest)).withColumnRenamed("key", key)
