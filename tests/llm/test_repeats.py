import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import repeats
from ticketlens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, spans string"


def _brute(texts, window=repeats.WINDOW):
    """(bytes, removed, runs, kept) of every text, by counting all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i + 1:i + window + 1] = True
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), len(b) - len(kept), runs, kept))
    return out


def _corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["zwölf", "ein", "the", "of", "a", "ñandú", "xylophone", "日本", "&", "repeat"]

    def prose(size):
        return " ".join(words[i] for i in rng.integers(0, len(words), size))

    shared = [prose(60) for _ in range(4)] + ["ab" * 150, "x" * 260, prose(30)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 1000, "z" * 400]
    for i in range(n):
        text = prose(rng.integers(1, 80))
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(0, len(shared))]
            cut = sorted(rng.integers(0, len(s), 2))
            text += s[cut[0]:] if rng.random() < 0.5 else s[:cut[1]]
            text += prose(rng.integers(0, 20))
        texts.append(text)
    base = prose(300)
    for _ in range(8):  # near copies
        edit = base.split(" ")
        for _ in range(4):
            edit[rng.integers(0, len(edit))] = "edit"
        texts.append(" ".join(edit))
    return [*texts, texts[-1], base, base, base[1:], "p" + base[:-3]]


def _check(spark, texts, shuffle=True):
    rows = [(None if i % 11 == 4 else i // 2, t, "other") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = repeats.remove_repeats(docs.repartition(5) if shuffle else docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"]))
                    for r in got.collect())
    assert found == Counter((row[0], *want) for row, want in zip(rows, _brute(texts)))
    return found


@pytest.mark.parametrize("seed,hot", [(1, 2_000), (2, 3), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    found = _check(spark, _corpus(seed))
    assert sum(r[2] > 0 for r in found) > 20


@pytest.mark.parametrize("size", [1 << 20, 1000, 300])
def test_every_window_names_one_place(monkeypatch, size):
    monkeypatch.setattr(repeats, "SLICE", size)
    texts = [(t or "").encode() for t in _corpus(6)]
    named, met = {}, set()
    for pieces in repeats._pieces(texts):
        for number, place, before, more, suffix, _ in repeats._slice_anchors(pieces):
            packed = repeats._pack(place, before, more)
            assert repeats._unpack(packed) == (place, place - before, place - before + more + repeats.WINDOW)
            for start in range(place - before, place - before + more + 1):
                assert (number, start) not in met
                met.add((number, start))
                window = texts[number][start:start + repeats.WINDOW]
                assert len(window) == repeats.WINDOW
                assert named.setdefault(window, (place - start, suffix)) == (place - start, suffix)
    assert len(met) == sum(max(len(t) - repeats.WINDOW + 1, 0) for t in texts)


def test_passage_between_different_texts(spark, monkeypatch):
    """One passage in many texts that differ on both sides of it, of 199, 200 and 230 bytes."""
    monkeypatch.setattr(repeats, "HOT", 5)
    rng = np.random.default_rng(9)
    for size in (199, 200, 230):
        passage = "".join(chr(97 + c) for c in rng.integers(0, 26, size))
        noise = ["".join(chr(97 + c) for c in rng.integers(0, 26, 700)) for _ in range(40)]
        texts = [t[:300] + passage + t[300:] for t in noise]
        found = _check(spark, texts)
        assert all(r[2] >= size for r in found) or size < 200


def test_sorted_neighbours_cross_parts(spark):
    rows = [(1, c // 4, c % 5, 7, c) for c in range(40)] + [(2, 1, 1, 7, 0), (3, 5, 1, 7, 1), (3, 5, 2, 7, 1)]
    anchors = spark.createDataFrame(rows, "suffix long, context long, key long, print long, place long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r["suffix"], r["context"], r["place"]): (r["full"], r["mixed"])
           for r in repeats._shared_anchors(anchors).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows)
    for k, row in enumerate(order):
        near = [o for o in (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None) if o]
        full = any(o[:2] == row[:2] for o in near)
        mixed = any(o[0] == row[0] and o[1] != row[1] for o in near)
        assert got.get((row[0], row[1], row[4]), (False, False)) == (full, mixed)


def test_interval_tree():
    texts = [b"banana", b"bandana", b"ban", b"xx", b"bandit"]
    order = sorted(texts)
    lcp = [0, *(repeats._common(a, b) for a, b in zip(order, order[1:]))]
    found = set(repeats.intervals(lcp))
    assert found == {(3, 0, 3), (4, 2, 3), (0, 0, 4)}
    groups = list(repeats.maximal_repeats([b"aq", b"ap", b"aq"], [b"bcd", b"bcd", b"bc"], 4))
    assert sorted((a, b, sorted(m)) for a, b, m in groups) == [(1, 3, [0, 1]), (2, 2, [0, 2])]


def test_query(spark, tmp_path):
    texts = _corpus(5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_repeated_passages"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(_brute(texts))]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert repeats.remove_repeats(docs.filter(F.lit(False))).count() == 0
