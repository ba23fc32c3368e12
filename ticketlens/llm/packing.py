"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` tokens. Packing is bulk-synchronous: one superstep
places all pieces of one length, the longest first. Pieces of one length are alike, and so are
sequences with one gap, so a superstep is a successor sweep over ranges: the pieces, numbered by
rank, take the sequences with the smallest sufficient gap, range by range; a range that is only
partly used is split, and the gaps that are left take part in the next superstep. This is best-fit
decreasing. What is swept are counts per length (at most ``capacity`` numbers, whatever the size of
the corpus). The pieces themselves stay distributed: they are numbered within their length by a
salted sort, and each then finds its range, hence its sequence and offset, by its rank.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_batches
from ticketlens.session import materialise

CAPACITY = 2048
END_ID = 0
SALTS = 64
#: words whose ids one task keeps
CACHED_WORDS = 250_000
SPECIAL = "<|endoftext|>"
#: a space inside or at the end of a longer stretch of white space: such texts are encoded whole
_ODD_SPACE = re.compile(r"\s (?:\s|\Z)")


class _Encoder(dict):
    """Ids of a text as little-endian 32-bit numbers. A byte-level vocabulary never joins across a
    single space, so words are encoded one by one and remembered. ``ranks`` holds the vocabulary of
    the tokenizer file in the form of a second, faster library."""

    def __init__(self, tokenizer: str, ranks: str | None):
        super().__init__()
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(tokenizer)
        self._fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                           mergeable_ranks=table, special_tokens={})

    def _encode(self, text: str) -> bytes:
        if self._fast is not None:
            ids = self._fast.encode_ordinary(text)
        else:
            ids = self._whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(" " + word)
        if len(self) < CACHED_WORDS and len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            ids = self._whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if _ODD_SPACE.search(text):
            return self._encode(text)
        first, *words = text.split(" ")
        return self._encode(first) + b"".join(map(self.__getitem__, words))


_encoders: dict[tuple[str, str | None], _Encoder] = {}


def encoder(tokenizer: str, ranks: str | None) -> _Encoder:
    """One per Python worker."""
    if (tokenizer, ranks) not in _encoders:
        _encoders[tokenizer, ranks] = _Encoder(tokenizer, ranks)
    return _encoders[tokenizer, ranks]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces: one, or pieces of full length after a shorter first one."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    edges = ([0] if first else []) + list(range(first, length + 1, capacity))
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def tokenise(docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id",
             text: str = "text", capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece (from 0), start, length, and ids (little-endian unsigned
    32-bit numbers) or, with ``digest``, their checksum ids_crc32 instead. A document is its ids and
    the end id; a null text is empty. ``tokenizer`` and ``ranks`` are files every machine has."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks)
        end = struct.pack("<I", END_ID)
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                ids = encode.ids(t or "") + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((k, n, start, length, zlib.crc32(part) if digest else part))
            yield pd.DataFrame(rows, columns=[key, "piece", "start", "length", last])

    last = "ids_crc32" if digest else "ids"
    kind = docs.schema[key].dataType.simpleString()
    return bounded_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(
        pieces, f"`{key}` {kind}, piece int, start long, length long, "
        f"{last} {'long' if digest else 'binary'}")


def best_fit_ranges(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go, by length and rank: (length, first rank, first sequence, pieces per
    sequence, offset of the first piece in its sequence) for ranges of consecutive ranks."""
    ranges = []
    free: dict[int, list[tuple[int, int]]] = {}  # gap: ranges of sequences (first, how many)
    gaps: list[int] = []
    opened = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in free:
                insort(gaps, gap)
            free.setdefault(gap, []).append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = free[gap].pop()
                if not free[gap]:
                    del free[gap], gaps[at]
            else:
                gap, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            fit = gap // length
            full = min(many, left // fit)
            if full:
                ranges.append((length, rank, first, fit, capacity - gap))
                leave(gap - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if left and full < many:  # fewer pieces than one sequence takes
                ranges.append((length, rank, first + full, left, capacity - gap))
                leave(gap - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            leave(gap, first + full, many - full)
    return ranges


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY,
         salts: int = SALTS) -> DataFrame:
    """``pieces`` (``tokenise``) with sequence_id (from 0, without gaps) and offset (gapless from 0
    within a sequence). Pieces of one length are ranked by salt, key, piece and start; rows equal in
    all of them are interchangeable. Rows with a length outside 1 to ``capacity`` are an error."""
    table = materialise(pieces, "pieces")
    salt = F.pmod(F.xxhash64(F.col(key), "piece", "start"), F.lit(salts)).alias("_salt")
    sizes = table.groupBy("length", salt).count()
    counted = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n"))
               .collect()}
    if counted and not 1 <= min(counted) <= max(counted) <= capacity:
        raise ValueError("a piece does not fit into a sequence")
    ranges = sorted(best_fit_ranges(counted, capacity))
    found = np.array(ranges, dtype=np.int64).reshape(-1, 5)
    sent = table.sparkSession.sparkContext.broadcast(found)

    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        known = sent.value
        keys = (known[:, 0] << 44) + known[:, 1]
        r = known[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
        behind = rank - r[:, 1]
        return pd.DataFrame({"sequence_id": r[:, 2] + behind // r[:, 3],
                             "offset": r[:, 4] + behind % r[:, 3] * length})

    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, -1)
    before = sizes.select("length", "_salt",
                          F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(F.col(key), "piece", "start")
    numbered = table.withColumn("_salt", salt).join(before, ["length", "_salt"]).withColumn(
        "_rank", F.row_number().over(within) - 1 + F.col("_before"))
    placed = F.pandas_udf(place, "sequence_id long, offset long")
    return numbered.withColumn("_at", placed("length", "_rank")).select(
        *pieces.columns, F.col("_at.sequence_id").alias("sequence_id"),
        F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id",
                   text: str = "text", capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence, offset and ids (or checksum).

    Null texts and null keys are documents like others; a repeated row is packed again; other
    columns are not read; an empty table gives no rows."""
    return pack(tokenise(docs, tokenizer, ranks, key, text, capacity, digest), key, capacity)
