import hashlib
import zlib

import numpy as np
import pytest

from ticketlens.llm import periodic_runs
from ticketlens.llm.queries import QUERIES

WHITE = " \t\n\v\f\r"


def _words(text):
    return (text or "").encode().split()


def _brute_runs(words, least_length=6, least_exponent=4):
    """Every stretch that a period covers and no neighbour extends, of which it is the smallest."""
    n, found = len(words), {}
    for q in range(1, n // least_exponent + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - at >= max(least_length, least_exponent * q):
                found.setdefault((at, end - at), q)
            at = end - q + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def _brute_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def _sequences():
    rng = np.random.default_rng(5)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 300, [1, 2] * 40, [1, 2, 1] * 33 + [1, 2], list(range(50))]
    for _ in range(150):
        letters, base = rng.integers(1, 4), []
        for _ in range(rng.integers(1, 6)):
            root = rng.integers(0, letters, rng.integers(1, 7)).tolist()
            base += root * int(rng.integers(1, 9)) + root[:rng.integers(0, len(root))]
        out.append(base)
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    return [*out, b]


@pytest.mark.parametrize("least_length,least_exponent", [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least_length, least_exponent):
    chunk = [[str(w).encode() for w in seq] for seq in _sequences()]
    got = periodic_runs._chunk_runs(chunk, least_length, least_exponent)
    for words, (same, runs) in zip(chunk, got):
        assert words == same
        assert [tuple(r) for r in runs.tolist()] == _brute_runs(words, least_length, least_exponent)


def test_suffix_array_and_lcp():
    rng = np.random.default_rng(1)
    for size in (1, 2, 30, 200):
        words = np.append(rng.integers(1, 3, size), 0)
        order, rounds, ties = periodic_runs._sorted_suffixes(words)
        suffixes = sorted(range(len(words)), key=lambda i: words[i:].tolist())
        assert order.tolist() == suffixes
        lcp = periodic_runs._common_prefixes(order, rounds, ties)
        for k in range(1, len(words)):
            a, b = words[order[k - 1]:], words[order[k]:]
            same = min(len(a), len(b))
            assert lcp[k] == next((i for i in range(same) if a[i] != b[i]), same)


def test_texts_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 50)
    texts = [None, "", " \t\r\n ", "one", "la la la la la la", "a b " * 9, "x y " * 2000 + "x",
             "la la la la la la", "             "]
    rows = [(i % 8 if i else None, t, i, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, collapsed string")
    found = periodic_runs.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed", "n_words", "runs_", "collapsed_"]
    got = {r["runs"]: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = _words(text)
        runs = _brute_runs(words)
        assert got[i]["n_words"] == len(words)
        assert [tuple(r) for r in got[i]["runs_"]] == runs
        assert got[i]["collapsed_"].encode() == _brute_collapse(words, runs)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, least_exponent=1)


def _expected(doc_id, text):
    words = _words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _brute_runs(words)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(_brute_collapse(words, runs)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for doc_id in range(400):
        size = int(rng.integers(0, 60))
        text = "".join(f"{'abc'[rng.integers(0, 3)]}{WHITE[rng.integers(0, 6)]}" for _ in range(size))
        rows.append((doc_id, None if doc_id % 97 == 5 else text, "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == [_expected(doc_id, text) for doc_id, text, _ in rows]
    assert sum(r[1] > 0 for r in got) > 30
