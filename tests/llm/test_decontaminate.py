import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlens.llm import decontaminate as dc

WORDS = st.lists(st.sampled_from(["a", "b", "c", "é", "x9"]), max_size=30)


def brute(docs, items, window):
    """Hit words and items of every document, by comparing every place with every window."""
    phrases = []
    for key, text in items:
        w = dc.words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.append((key, w[i:i + window]))
    out = []
    for text in docs:
        w, hit, found = dc.words_of(text), set(), set()
        for key, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(key)
        out.append((len(w), len(hit), sorted(found)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6), st.lists(WORDS, max_size=5), st.integers(1, 5))
def test_index_equals_brute_force(docs, items, window):
    texts = [" ".join(d) for d in docs]
    bench = [(str(i), ", ".join(w)) for i, w in enumerate(items)]
    phrases = dc.Phrases(bench, window)
    shard = [np.array([phrases.vocabulary.get(w, 0) for w in dc.words_of(t)], dtype=np.int64)
             for t in texts]
    got = [(len(ids), sum(e - s for s, e in spans), found)
           for ids, (spans, found) in zip(shard, dc._shard_hits(shard, phrases), strict=True)]
    assert got == brute(texts, bench, window)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60))
def test_suffix_array_and_ranks(values):
    symbols = np.array([*values, 0], dtype=np.int64)
    border = {p: k for k, p in enumerate(np.flatnonzero(symbols == 0))}

    def key(p):
        end = next(q for q in range(p, len(symbols)) if symbols[q] == 0)
        return [(1, int(v)) for v in symbols[p:end]] + [(0, border[end])]

    assert dc.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=key)
    tree = dc.WaveletTree(symbols, int(symbols.max()))
    assert tree.access(np.arange(len(symbols))).tolist() == symbols.tolist()
    for c in range(7):
        if c <= symbols.max():
            ends = np.arange(len(symbols) + 1)
            want = np.concatenate([[0], np.cumsum(symbols == c)])
            assert tree.rank(np.full(len(ends), c), ends).tolist() == want.tolist()


def test_rows_blocks_and_shards_agree(spark):
    long = "w1 w2 " * 5000 + "k1 k2 k3 k4"
    rows = [(1, "x a b c d y a b c d", 0), (1, "x a b c d y a b c d", 0), (2, None, 0), (3, "", 0),
            (None, long, 0), (4, "A-b.C d", 0), (5, "k1 k2 k3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contamination int")
    items = [(10, "a b c d"), (9, "k1 k2 k3 k4 k5"), (8, None), (7, "!!"), (6, "d y a"),
             (None, "w2 w1 w2 w1"), (10, "a b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([r[1] for r in rows], [("" if k is None else str(k), t) for k, t in items], 4)
    want = [(n, h, [i for i in found if i]) for n, h, found in want]
    for block_chars, shard_words in ((10**6, 10**6), (1, 2), (8, 10**6)):
        marked = dc.find_contamination(docs, bench, window=4, block_chars=block_chars,
                                       shard_words=shard_words)
        assert marked.columns == ["doc_id", "text", "contamination", "contamination_"]
        got = [(r["contamination_"]["n_words"],
                sum(s["end"] - s["start"] for s in r["contamination_"]["spans"]),
                r["contamination_"]["items"]) for r in marked.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    none = dc.find_contamination(docs, bench.limit(0), window=4)
    assert none.filter("size(contamination_.spans) > 0").count() == 0
    assert dc.drop_contaminated(docs.limit(0), bench).count() == 0
    kept = dc.drop_contaminated(docs, spark.createDataFrame([(1, "a b c d")], bench.schema))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5]
