"""One small case for each finding of round 3 that was right."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ticketlens.operators import features as f
from ticketlens.operators import grams
from ticketlens.operators import retrieval as r
from ticketlens.operators.grams import char_texts, gram_stats, gram_weights, sent_terms
from ticketlens.plans.stream_plans import LiveDesk

SMALL = "/root/testdata/sf0.001"


def _folder(spark, tmp_path, **replaced):
    """A copy of the smallest data folder by links, with some tables ``replaced``."""
    for name in os.listdir(SMALL):
        table = name.removesuffix(".parquet")
        if table in replaced:
            replaced[table].write.parquet(f"{tmp_path}/{name}")
        else:
            os.symlink(f"{SMALL}/{name}", f"{tmp_path}/{name}")
    return str(tmp_path)


def test_orphans_are_counted_per_order_line(spark, tmp_path):
    """an order without a customer counts once per line, and one without lines is no parent."""
    day = datetime.datetime(1995, 1, 1)
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    first = orders.limit(1).collect()[0].asDict()
    kept = [first | {"o_orderkey": 1, "o_custkey": -5, "o_orderdate": day},
            first | {"o_orderkey": 2, "o_custkey": -5, "o_orderdate": day}]
    line = lines.limit(1).collect()[0].asDict()
    two = [line | {"l_orderkey": 1, "l_linenumber": n} for n in (1, 2)]
    folder = _folder(spark, tmp_path, orders=spark.createDataFrame(kept, orders.schema),
                     lineitem=spark.createDataFrame(two, lines.schema))
    found = {r["foreign_key"]: r["orphans"]
             for r in entry.queries()["q4_referential_integrity"](spark, folder).collect()}
    assert found["orders.customer_id"] == 2 and found["requests.order_id"] == 1


def test_stream_reads_a_table_that_is_a_directory(spark, tmp_path):
    """a table of several files is a directory, whose files have names of their own."""
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    folder = _folder(spark, tmp_path, conversations=rows.repartition(3))
    live = LiveDesk(spark, folder).table("conversations")
    query = live.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == rows.count() > 0


def _sent(spark, texts):
    terms = f.char_vocabulary(texts, 1)
    return terms, sent_terms(terms)


def test_grams_are_weighed_and_ranked_without_rows_of_grams(spark):
    """The same ranking as from rows of n-grams, which are not made. Texts of one key
    count as one; null and blank ones have none."""
    rows = [(1, "Ação rápida, ação"), (2, "rapid action now"), (2, "now or never"), (3, None),
            (4, "   "), (5, "x" * 90 + " now"), (6, "acao rapida")]
    documents = spark.createDataFrame(rows, "chunk_id long, text string")
    items = spark.createDataFrame([(10, "rapida acao now"), (11, "never xxxx"), (12, "%%%")],
                                  "query_id long, text string")
    counts = f.char_counts(documents, "chunk_id", "text", fold=True)
    old = f.vocabulary(counts, documents, 1)
    texts = char_texts(documents, "chunk_id", "text", True)
    new, sent = _sent(spark, texts)
    pair = lambda df: {r["term"]: r["df"] for r in df.collect()}
    assert pair(old) == pair(new)
    asked = gram_weights(char_texts(items, "query_id", "text", True), "query_id", sent)
    got = r.text_topk(asked, texts, sent, 100, 3)
    idf = f.weigh(counts, "chunk_id", new)
    want = r.keyword_topk(asked, idf, 3)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 3


def test_keyword_query_makes_no_rows_of_grams(spark, monkeypatch):
    """a vocabulary that can be sent needs no table of (document, n-gram)."""
    def none(*args, **kwargs):
        raise AssertionError("rows of n-grams")
    monkeypatch.setattr(f, "char_counts", none)
    assert entry.queries()["r3_keyword_topk"](spark, SMALL).count() > 0
    assert entry.queries()["l2_tfidf_chars"](spark, SMALL).count() > 0


@pytest.mark.parametrize("settings", [{"GRAMS_HELD": 5, "DOCUMENTS_HELD": 2}, {"BASE": 12}, {"BASE": 6}])
def test_grams_beyond_the_digits_and_the_held_counts(spark, monkeypatch, settings):
    """Counts are passed on early, digits run out between texts and within one: always the same."""
    rows = [(i, f"w{i} abc {'xyz' * (i % 3)}é{chr(20000 + i)}  ") for i in range(40)] + [(99, "")]
    texts = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    want = {r["term"]: (r["df"], r["total"]) for r in f.vocabulary(
        f.char_counts(texts, "k", "text"), texts, 1).join(
        f.char_counts(texts, "k", "text").groupBy("term").agg(F.sum("tf").alias("total")), "term").collect()}
    for name, value in settings.items():
        monkeypatch.setattr(grams, name, value)
    assert {r["term"]: (r["df"], r["total"]) for r in gram_stats(texts).collect()} == want
