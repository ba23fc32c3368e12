import struct
import zlib

import public_tokenizers as files
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ticketlens.llm import packing

JSON, RANKS = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")
WHOLE = Tokenizer.from_file(JSON)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="ab é1.'s \n\t 　", max_size=30), st.text(max_size=20),
                 st.just("x <|endoftext|> y"), st.just("a \n b   c \n")))
def test_word_wise_ids_equal_the_tokenizer(text):
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    assert packing.encoder(JSON, RANKS).ids(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert packing.encoder(JSON, None).ids(text) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 15)))
def test_ranges_are_best_fit_decreasing(counts):
    bins, gaps = [], []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                i = gaps.index(min(fit))
            else:
                i = len(gaps)
                gaps.append(20)
                bins.append([])
            bins[i].append(length)
            gaps[i] -= length
    ranges = packing.best_fit_ranges(counts, 20)
    placed = {}
    for length in counts:
        own = sorted(r for r in ranges if r[0] == length)
        for rank in range(counts[length]):
            _, start, first, fit, offset = [r for r in own if r[1] <= rank][-1]
            seq, slot = first + (rank - start) // fit, (rank - start) % fit
            placed.setdefault(seq, []).append((offset + slot * length, length))
    assert sorted(placed) == list(range(len(bins)))
    for items in placed.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 20
    # equal gaps are interchangeable, so what stays the same is how full the sequences are
    assert sorted(sum(n for _, n in v) for v in placed.values()) == sorted(map(sum, bins))


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_documents_come_back(spark):
    long = "word " * 700
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, long), (4, long),
            (5, "x  y   z \n")]
    docs = spark.createDataFrame([(k, t, "s", 0) for k, t in rows],
                                 "doc_id long, text string, piece string, length int")
    got = packing.pack_documents(docs, JSON, RANKS, capacity=64).collect()
    sums = packing.pack_documents(docs, JSON, RANKS, capacity=64, digest=True).collect()
    assert sorted(zlib.crc32(bytes(r["ids"])) for r in got) == sorted(r["ids_crc32"] for r in sums)
    by_doc = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["piece"])):
        assert len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    want = struct.pack("<I", 0)
    for key in (None, 4):
        ids = WHOLE.encode(long, add_special_tokens=False).ids
        assert b"".join(by_doc[key]) == struct.pack(f"<{len(ids)}I", *ids) + want
    assert by_doc[2] == by_doc[3] == [want]
    assert len(by_doc[1]) == 2 and by_doc[1][0] == by_doc[1][1]
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64
    assert packing.pack_documents(docs.limit(0), JSON, RANKS).count() == 0
