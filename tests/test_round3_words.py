"""Word terms are counted in the tasks that hold the texts."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import classify as c
from ticketlens.operators import features as f
from ticketlens.operators import words as w

TEXTS = [(1, "b Log cc log cc dd é"), (2, "log cc ee"), (3, "dd ee log cc"), (4, None), (5, ""), (6, "zz")]


def _terms(text):
    names = [x for x in (text or "").lower().split() if len(x) > 1]
    return Counter(names + [f"{a} {b}" for a, b in zip(names, names[1:])])


def _expected(texts, min_df, sublinear):
    counts = {k: _terms(t) for k, t in texts}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for k, c in counts.items():
        raw = {t: (1 + math.log(n) if sublinear else n) * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
               for t, n in c.items() if df[t] >= min_df}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(k, t): v / length for t, v in raw.items()})
    return out


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("held", [1, 5, 1 << 20])
@pytest.mark.parametrize("min_df,sublinear", [(1, True), (2, False)])
def test_word_weights_of_pieces_equal_a_count_by_hand(spark, monkeypatch, held, min_df, sublinear):
    monkeypatch.setattr(w, "WORDS_HELD", held)
    docs = spark.createDataFrame(TEXTS, "k long, text string")
    weights = f.tfidf_words(docs, "k", "text", min_df, sublinear)
    assert "Generate" not in _plan(weights)  # no row per term of a text before it is weighed
    got = {(r["k"], r["term"]): r["weight"] for r in weights.collect()}
    assert got == pytest.approx(_expected(TEXTS, min_df, sublinear))


def test_texts_of_one_key_are_one_and_no_pair_reaches_from_one_to_the_next(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "cc dd"), (2, "aa bb"), (2, None)], "k long, text string")
    got = {(r["k"], r["term"]) for r in f.tfidf_words(docs, "k", "text", 1).collect()}
    assert got == {(1, t) for t in ("aa", "bb", "cc", "dd", "aa bb", "cc dd")} | {
        (2, t) for t in ("aa", "bb", "aa bb")}


def test_class_sums_are_made_before_terms_become_rows(spark, monkeypatch):
    monkeypatch.setattr(w, "WORDS_HELD", 4)
    labels = ["de", "en", "de", None, "en", "de"]
    docs = spark.createDataFrame([(k, t, v) for (k, t), v in zip(TEXTS, labels)], "k long, text string, lang string")
    sums = f.known_words(docs, "k", "text", 2, False, "lang").sums_by_group()
    assert "Generate" not in _plan(sums)
    got = {(r["term"], r["own"]): r["s"] for r in sums.groupBy("term", "own").agg(F.sum("sum").alias("s")).collect()}
    want = Counter()
    for (k, term), weight in _expected(TEXTS, 2, False).items():
        want[term, labels[k - 1]] += weight
    assert got == pytest.approx(dict(want))


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_bayes_in_pieces_equals_the_long_form(spark, monkeypatch, held):
    monkeypatch.setattr(w, "WORDS_HELD", held)
    labels, classes = ["de", "en", "de", None, "fr", "de"], ["de", "en"]
    more = TEXTS + [(7, "ee dd cc"), (8, "zz log")]
    docs = spark.createDataFrame([(k, t, v) for (k, t), v in zip(more, [*labels, None, "en"])],
                                 "k long, text string, lang string")
    weights = f.tfidf_words(docs, "k", "text")
    long = c.bayes_predict(docs, weights, c.bayes_fit(weights, docs, "k", "lang", classes), "k", classes)
    got = c.bayes_fitted_on(docs, "k", "text", "lang", classes)
    assert "Generate" not in _plan(got)
    want = {r["k"]: (r["prediction"], r["confidence"]) for r in long.collect()}
    assert len(want) == 8
    for row in got.collect():
        assert (row["prediction"], row["confidence"]) == (want[row["k"]][0], pytest.approx(want[row["k"]][1]))
    twice = docs.union(docs.filter("k = 1").withColumn("lang", F.lit("en")))
    assert c.bayes_fitted_on(twice, "k", "text", "lang", classes).count() == 9
