"""Retrieval, answers and evaluation (R, E)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    CATEGORIES,
    CATEGORY_SOURCES,
    QUALITY_GATES,
    STATUS_LABELS,
    STOPWORDS,
)
from ticketlens.functions import text as t
from ticketlens.operators import answers as an
from ticketlens.operators import evaluation as ev
from ticketlens.operators import features as f
from ticketlens.operators import retrieval as r
from ticketlens.operators import scores as sc
from ticketlens.operators.analytics import named_answers, order_lookup_batch
from ticketlens.operators.classify import bayes_fit, bayes_predict, triage_batch
from ticketlens.operators.documents import chunk_markdown
from ticketlens.operators.grams import char_texts, gram_weights, sent_terms
from ticketlens.plans import oracle_terms as ot
from ticketlens.plans import oracle_text as o
from ticketlens.plans.analytics_plans import _relations
from ticketlens.plans.learning_plans import BAYES_MODEL, LANGUAGES, _models
from ticketlens.plans.learning_plans import ORACLE as LEARNING
from ticketlens.plans.series_plans import ORACLE as SERIES
from ticketlens.plans.series_plans import QUERIES as SERIES_QUERIES
from ticketlens.plans.text_plans import ORACLE as TEXT_ORACLE
from ticketlens.plans.views import Desk, with_views
from ticketlens.session import materialise, scratch_path
from ticketlens.sources import registry
from ticketlens.sources.index_store import build_index, open_index


def _centroids(s, d) -> DataFrame:
    """One query vector per label: the mean vector."""
    cells = Desk(s, d).table("embeddings").select(
        "label", F.posexplode("embedding").alias("pos", "x")
    )
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"])
        .alias("vector")  # one entry per dimension
    ).select(F.col("label").cast("long").alias("query_id"), "vector")


def _dense(s, d, n=10) -> DataFrame:
    corpus = Desk(s, d).table("embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")
    )
    return r.dense_topk(_centroids(s, d), corpus, n)


def _keyword(s, d, n=10) -> DataFrame:
    documents = Desk(s, d).documents.select(F.col("doc_id").alias("chunk_id"), "text")
    items = Desk(s, d).table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    texts = char_texts(documents, "chunk_id", "text", True)
    terms = materialise(f.char_vocabulary(texts, 1), "char-terms")
    size = terms.count()
    if size <= f.BROADCAST_TERMS:
        sent = sent_terms(terms)
        asked = gram_weights(char_texts(items, "query_id", "text", True), "query_id", sent)
        chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
        return r.text_topk(materialise(asked, "query-terms"), texts, sent, chars, n)
    counts = f.char_counts(documents, "chunk_id", "text", fold=True)
    asked = f.char_counts(items, "query_id", "text", fold=True)
    weights = materialise(f.weigh(asked, "query_id", terms, size=size), "query-terms")
    return r.keyword_topk(weights, f.weigh(counts, "chunk_id", terms, size=size), n)


def _item_dense(s, d) -> DataFrame:
    """Each benchmark item takes the vector ranking of the label its number ends in."""
    items = Desk(s, d).table("benchmark").select("item_id")
    ranked = _dense(s, d)
    return items.join(F.broadcast(ranked), F.col("item_id") % 10 == F.col("query_id")).select(
        F.col("item_id").alias("query_id"), "chunk_id", "score", "rank"
    )


def _sources(s, d) -> DataFrame:
    return Desk(s, d).table("documents").select(F.col("doc_id").alias("chunk_id"), "source")


def _boosts(s, d) -> DataFrame:
    return Desk(s, d).table("benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"),
    )


def _rounded(df, digits=6):
    return df.select("query_id", "chunk_id", F.round("score", digits).alias("score"),
                     F.col("rank").cast("long").alias("rank"))


def _hybrid(s, d):
    return _rounded(r.hybrid_topk(_item_dense(s, d), _keyword(s, d)))


def _boosted(s, d):
    return _rounded(r.hybrid_topk(
        _item_dense(s, d), _keyword(s, d), 4, _sources(s, d), _boosts(s, d)
    ))


def _prior(s, d):
    key = F.col("event_id")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    rows = Desk(s, d).table("events").select(
        key.alias("query_id"),
        F.element_at(names, (key % 5 + 1).cast("int")).alias("category"),
        (F.col("value") / 100).alias("confidence"),
    )
    return r.source_prior(rows, "query_id", F.col("category"), F.col("confidence"))


def _looked_up(s, d):
    desk = Desk(s, d)
    return order_lookup_batch(desk.requests, desk.order_heads, desk.customers)


def _enriched(s, d):
    question = F.concat(F.lit("pedido "), F.col("order_id").cast("string"))
    query = an.enriched_query(question, F.col("found"), F.col("status"), F.col("days_late"))
    return _looked_up(s, d).select("request_id", query.alias("query"))


def _order_sentences(s, d):
    sentence = an.order_sentence(F.col("order_id"), F.col("status"), F.col("carrier"),
                                 F.col("estimated_delivery"), F.col("days_late"))
    return _looked_up(s, d).filter("found").select("request_id", sentence.alias("sentence"))


def _hits(s, d, n) -> DataFrame:
    documents = Desk(s, d).table("documents").select(
        F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("section"), "text"
    )
    return _keyword(s, d, n).join(documents, "chunk_id")


def _questions(s, d) -> DataFrame:
    return Desk(s, d).table("benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def _sentence_scores(s, d):
    best = an.scored_sentences(_questions(s, d), _hits(s, d, 3))
    return best.select("query_id", "place", "rank", F.round("score", 6).alias("score"), "sentence")


def _answers(s, d):
    return an.extractive_answers(_questions(s, d), _hits(s, d, 3))


def _citations(s, d):
    orders = _questions(s, d).select("query_id", (F.col("query_id") + 10000).alias("order_id"))
    return an.citations(_hits(s, d, 4), orders).select(
        "query_id", F.array_join("citations", "; ").alias("citations")
    )


def _index_path(s, d, **settings) -> tuple[DataFrame, str]:
    path = scratch_path(s, "index")
    chunks = chunk_markdown(Desk(s, d).sections)
    size = build_index(chunks, path, **settings)
    return size, path


def _search(s, d):
    _, path = _index_path(s, d)
    hits = open_index(s, path).search(_questions(s, d), 4)
    return hits.select("query_id", "rank", "score", "source", "section")


def _answer_batch(s, d):
    _, path = _index_path(s, d)
    index = open_index(s, path)
    desk = Desk(s, d)

    def search(queries, boosts):
        return index.search(materialise(queries, "queries"), 4, boosts=boosts)

    models = _served_models(s, d)

    def triage(rows):
        return triage_batch(materialise(rows, "questions"), *models, text="question")

    analytics = materialise(named_answers(_relations(s, d)), "named-answers")
    questions = desk.messages.select(F.col("message_id").alias("query_id"), "customer_id", "text")
    return an.answer_batch(questions, desk.order_heads, desk.customers, search, triage, analytics)


def _served_models(s, d):
    """Both triage models as the registry serves them: fitted, registered, promoted and loaded."""
    root = scratch_path(s, "registry")
    for name, model in zip(("category", "priority"), _models(s, d)):
        registry.register(model, s, root, name, {}, {}, "none")
    return [registry.load(s, root, name) for name in ("category", "priority")]


def _golden(s, d) -> DataFrame:
    return Desk(s, d).qrels.select(F.col("item_id").alias("query_id"),
                                   F.col("doc_id").alias("source"))


def _as_source(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "rank", F.col("chunk_id").alias("source"))


#: documents favoured for questions in a language
LANGUAGE_SOURCES = {lang: [f"src{n}" for n in range(20) if n % len(LANGUAGES) == i]
                    for i, lang in enumerate(LANGUAGES)}


def _triaged(s, d) -> DataFrame:
    """(query_id, prediction, confidence): the language of every question by complement naive Bayes
    over the words of all documents."""
    documents = Desk(s, d).documents.select("doc_id", "text", "lang")
    counts = f.word_counts(documents, "doc_id", "text")
    terms = materialise(f.vocabulary(counts, documents, 2), "word-terms")
    size = terms.count()
    weights = f.weigh(counts, "doc_id", terms, size=size)
    model = materialise(bayes_fit(weights, documents, "doc_id", "lang", LANGUAGES), "bayes")
    items = _questions(s, d)
    asked = f.weigh(f.word_counts(items, "query_id", "question"), "query_id", terms, size=size)
    return bayes_predict(items, asked, model, "query_id", LANGUAGES)


def _modes(s, d) -> dict[str, DataFrame]:
    keyword = materialise(_keyword(s, d), "keyword")
    dense = materialise(_item_dense(s, d), "dense")
    boosts = r.source_prior(_triaged(s, d), "query_id", F.col("prediction"), F.col("confidence"),
                            LANGUAGE_SOURCES)
    return {
        "keyword": _as_source(keyword), "dense": _as_source(dense),
        "hybrid": _as_source(r.hybrid_topk(dense, keyword, 5)),
        "hybrid+triage": _as_source(r.hybrid_topk(
            dense, keyword, 5, _sources(s, d), materialise(boosts, "boosts"))),
    }


def _retrieval(s, d):
    return ev.retrieval_report(_modes(s, d), materialise(_golden(s, d), "golden"))


def _misses(s, d):
    return ev.misses_by_mode(_modes(s, d), materialise(_golden(s, d), "golden"))


def _routed(s, d):
    """Messages with the intent that their planted ending should lead to."""
    message = F.col("message_id")
    kind = (F.floor(message / 1000) + message % 1000) % 11
    expected = F.when(kind.isin(2, 4, 6, 9), "analytics").when(
        kind.isin(0, 1, 5, 7), "order_lookup").otherwise("knowledge")
    rows = Desk(s, d).messages.withColumn("order_id", t.extract_order_id(F.col("text")))
    folded = t.normalize_accents(F.col("text"))
    return rows.select(t.route_intent(folded, F.col("order_id")).alias("intent"),
                       expected.alias("expected"))


def _grounding(s, d):
    """Do the extractive answers hold words of the passage that was asked for? The fact is a run of
    four words, the alias another."""
    words = F.split("question", r"\s+")
    facts = _questions(s, d).select(
        "query_id", F.array_join(F.slice(words, 2, 4), " ").alias("answer_contains"),
        F.when(F.col("query_id") % 2 == 0, F.array(F.array_join(F.slice(words, 7, 4), " ")))
        .alias("aliases"))
    return ev.grounding(_answers(s, d).join(facts, "query_id"))


def _red_team(s, d):
    desk = Desk(s, d)
    message = F.col("message_id")
    kind = (F.floor(message / 1000) + message % 1000) % 11
    messages = desk.messages.withColumn("kind", kind)
    label = F.create_map(F.lit(1), F.lit("CPF"), F.lit(5), F.lit("PHONE"), F.lit(7), F.lit("CARD"))
    safe = F.pmod(F.col("statement_id"), F.lit(16)).isin(0, 1, 2, 7, 8, 14)
    return ev.red_team_summary(ev.red_team(
        messages.filter(F.col("kind").isin(3, 8)),
        desk.statements.withColumn("safe", safe),
        messages.filter(F.col("kind").isin(1, 5, 7)).withColumn(
            "label", label[F.col("kind").cast("int")]),
    ))


def _gates(s, d):
    """Gates over figures that the tables yield."""
    predictions = Desk(s, d).predictions
    figures = [
        ("category_macro_f1", sc.classification_metrics(predictions), "macro_f1"),
        ("urgent_recall", sc.class_recall(predictions), "urgent_recall"),
        ("agent_routing_accuracy", ev.routing_accuracy(_routed(s, d)), "routing_accuracy"),
        ("answer_grounding", _grounding(s, d), "answer_contains_rate"),
        ("security_pass_rate",
         _red_team(s, d).agg(F.bround(F.sum("passed") / F.sum("cases"), 3).alias("x")), "x"),
        ("incident_f1", SERIES_QUERIES["w9_detection_metrics"](s, d), "f1"),
        ("retrieval_hit@3", _retrieval(s, d).filter("mode = 'hybrid+triage'"), "hit_at_3"),
    ]
    rows = [df.select(F.lit(name).alias("metric"), F.col(c).alias("value"))
            for name, df, c in figures]
    return ev.quality_gates(reduce(DataFrame.unionByName, rows))


QUERIES = {
    "r1_s10_build_index": lambda s, d: _index_path(s, d)[0],
    "r1_search_index": _search,
    "r2_dense_topk": lambda s, d: _rounded(_dense(s, d)),
    "r3_keyword_topk": lambda s, d: _rounded(_keyword(s, d)),
    "r4_hybrid_topk": _hybrid,
    "r5_metadata_boost": _boosted,
    "r6_source_prior": _prior,
    "r7_enriched_query": _enriched,
    "r8_sentence_scores": _sentence_scores,
    "r8_extractive_answers": _answers,
    "r9_order_sentence": _order_sentences,
    "r10_citations": _citations,
    "r11_answer_batch": _answer_batch,
    "e1_e2_retrieval_scores": _retrieval,
    "e3_top1_misses": _misses,
    "e4_routing_accuracy": lambda s, d: ev.routing_accuracy(_routed(s, d)),
    "e5_grounding": _grounding,
    "e6_red_team": _red_team,
    "e7_quality_gates": _gates,
}

_RANKED = f"""{ot.keyword_ranking('keyword', 10)},
    {ot.dense_ranking('label_dense', 10)},
    dense AS (SELECT item_id AS query_id, chunk_id, rank FROM benchmark
              JOIN label_dense ON query_id = item_id % 10),
    fused AS (SELECT query_id, chunk_id, SUM(gain) AS score, MIN(dense_rank) AS dense_rank FROM (
              SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS gain, rank AS dense_rank FROM dense
              UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), NULL FROM keyword)
              GROUP BY 1, 2)"""


def _best_sql(source: str, k: int) -> str:
    return f"""SELECT query_id, chunk_id, rank, score FROM (
        SELECT query_id, chunk_id, round_even(score, 4) AS score, row_number() OVER (
            PARTITION BY query_id ORDER BY ROUND(score, 12) DESC, dense_rank ASC NULLS LAST, chunk_id)
            AS rank FROM {source}) WHERE rank <= {k}"""


_LOOKUP = """looked_up AS (
    SELECT r.request_id, r.order_id, o.order_id IS NOT NULL AS found, o.status, o.carrier,
           o.estimated_delivery, date_diff('day', o.estimated_delivery, o.delivered_at) AS days_late
    FROM requests_v r LEFT JOIN (
        SELECT h.* FROM order_heads_v h JOIN customer_safe_v c USING (customer_id)) o
      ON r.order_id = o.order_id AND (r.customer_id IS NULL OR r.customer_id = o.customer_id))"""
_STOP = "[" + ", ".join(o.quoted(w) for w in STOPWORDS) + "]"


def _tokens_sql(column: str) -> str:
    words = o.WORDS(o.FOLD(column))
    return f"list_filter(list_distinct({words}), lambda w: NOT list_contains({_STOP}, w))"


_SENTENCES = f"sentences AS ({TEXT_ORACLE['t12_sentences']})"
_SCORED = f"""{ot.keyword_ranking('keyword', 3)}, {_SENTENCES},
    lines AS (SELECT k.query_id, k.rank, s.pos, s.sentence,
                     {_tokens_sql("s.sentence || ' ' || d.lang")} AS said,
                     {_tokens_sql("b.text")} AS asked
              FROM keyword k JOIN sentences s ON s.doc_id = k.chunk_id
              JOIN documents d ON d.doc_id = k.chunk_id
              JOIN benchmark b ON b.item_id = k.query_id),
    places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos)
                      AS place FROM (
               SELECT query_id, rank, pos, sentence,
                      len(list_intersect(asked, said)) / (1 + 0.5::DOUBLE * (rank - 1)) AS score
               FROM lines) WHERE score > 0)"""
_KIND = "((message_id // 1000) + message_id % 1000) % 11"
_STATUS_SQL = "CASE status " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_LABELS.items()) + " ELSE status END"
_FAVOURED = f"""triaged AS (SELECT query_id, CASE {' '.join(
        f"WHEN s{i} = top THEN {i}" for i in range(len(LANGUAGES)))} END AS language FROM (
        SELECT *, greatest({', '.join(f's{i}' for i in range(len(LANGUAGES)))}) AS top FROM (
            SELECT item_id AS query_id, {', '.join(
                f'COALESCE(SUM(weight * w{i}), 0) AS s{i}' for i in range(len(LANGUAGES)))}
            FROM benchmark LEFT JOIN (asked_weights JOIN model USING (term)) ON k = item_id
            GROUP BY item_id))
        WHERE 1 / ({' + '.join(f'exp(s{i} - top)' for i in range(len(LANGUAGES)))}) >= 0.75),
    favoured AS (SELECT f.query_id, chunk_id, dense_rank, score + CASE
            WHEN CAST(substr(source, 4) AS INT) % {len(LANGUAGES)} = language
            THEN 1.0::DOUBLE / 61 ELSE 0 END AS score
        FROM fused f LEFT JOIN documents ON doc_id = chunk_id LEFT JOIN triaged USING (query_id))"""
_MODES = f"""{_RANKED}, {BAYES_MODEL},
    {ot.word_counts('asked_tf', 'benchmark', 'item_id', 'text')},
    {ot.weights('asked_weights', 'asked_tf', 'terms')}, {_FAVOURED},
    hits AS (
        SELECT 'keyword' AS mode, query_id, chunk_id, rank FROM keyword
        UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM dense
        UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM ({_best_sql('fused', 5)})
        UNION ALL SELECT 'hybrid+triage', query_id, chunk_id, rank FROM ({_best_sql('favoured', 5)}))"""
_HIT = """, ranks AS (SELECT mode, g.query_id, MIN(h.rank) AS rank
      FROM (SELECT DISTINCT item_id AS query_id FROM qrels_v) g CROSS JOIN
           (SELECT unnest(['keyword', 'dense', 'hybrid', 'hybrid+triage']) AS mode) m
      LEFT JOIN (SELECT h.*, item_id FROM hits h
                 JOIN qrels_v v ON v.item_id = h.query_id AND v.doc_id = h.chunk_id
                 WHERE h.rank <= 5) h USING (mode, query_id)
      GROUP BY 1, 2)"""
_ROUTED = TEXT_ORACLE["t7_t8_t9_routing"]
_ROUTE_SCORE = f"""SELECT round_even(AVG((intent = expected)::INT), 3) AS routing_accuracy,
               COUNT(*) AS n, COUNT(*) FILTER (WHERE intent <> expected) AS errors
           FROM (SELECT intent, CASE WHEN {_KIND} IN (2, 4, 6, 9) THEN 'analytics'
                                     WHEN {_KIND} IN (0, 1, 5, 7) THEN 'order_lookup'
                                     ELSE 'knowledge' END AS expected FROM ({_ROUTED}))"""


def _count_sql(label: str) -> str:
    return o.COUNTED("text", label)


ORACLE = {
    "r2_dense_topk": with_views(
        "SELECT query_id::BIGINT AS query_id, chunk_id, ROUND(score, 6) AS score, rank "
        "FROM label_dense", extra=ot.dense_ranking("label_dense", 10)),
    "r3_keyword_topk": with_views(
        "SELECT query_id, chunk_id, ROUND(score, 6) AS score, rank FROM keyword",
        extra=ot.keyword_ranking("keyword", 10)),
    "r4_hybrid_topk": with_views(_best_sql("fused", 4), extra=_RANKED),
    "r5_metadata_boost": with_views(
        _best_sql("boosted", 4), extra=f"""{_RANKED},
        boosted AS (SELECT query_id, chunk_id, score + CASE
            WHEN source = 'src' || CAST(query_id % 20 AS VARCHAR) THEN 1.0::DOUBLE / 61 ELSE 0 END
            AS score, dense_rank FROM fused LEFT JOIN documents ON doc_id = chunk_id)"""),
    "r6_source_prior": f"""SELECT event_id AS query_id, unnest(CASE event_id % 5 {' '.join(
        f"WHEN {i} THEN {CATEGORY_SOURCES[c]}" for i, c in enumerate(CATEGORIES))} END) AS source
        FROM events WHERE value / 100 >= 0.75""",
    "r7_enriched_query": with_views(
        """SELECT request_id, 'pedido ' || CAST(order_id AS VARCHAR) || CASE
               WHEN NOT found THEN '' WHEN COALESCE(days_late, 0) > 0 THEN ' atraso entrega'
               ELSE ' pedido ' || status END AS query FROM looked_up""",
        "requests_v", "order_heads_v", "customer_safe_v", extra=_LOOKUP),
    "r8_sentence_scores": with_views(
        """SELECT query_id, place, rank, ROUND(score, 6) AS score, sentence FROM places
           WHERE place <= 2""", extra=_SCORED),
    "r8_extractive_answers": with_views(
        """SELECT item_id AS query_id, COALESCE(string_agg(sentence || ' [' || rank || ']', ' '
               ORDER BY place), 'Não encontrei essa informação na base de conhecimento. '
               || 'Vou encaminhar para um atendente humano.') AS answer
           FROM benchmark LEFT JOIN (SELECT * FROM places WHERE place <= 2) ON query_id = item_id
           GROUP BY item_id""", extra=_SCORED),
    "r9_order_sentence": with_views(
        f"""SELECT request_id, 'O pedido ' || order_id || ' está **' || {_STATUS_SQL}
               || '** (transportadora ' || carrier || ', previsão '
               || CAST(estimated_delivery AS VARCHAR) || ')' || CASE
               WHEN COALESCE(days_late, 0) <> 0
               THEN ', entregue com ' || days_late || ' dia(s) de atraso' ELSE '' END || '.'
               AS sentence FROM looked_up WHERE found""",
        "requests_v", "order_heads_v", "customer_safe_v", extra=_LOOKUP),
    "r10_citations": with_views(
        """SELECT item_id AS query_id, 'orders#' || (item_id + 10000)
               || COALESCE('; ' || string_agg(source || ' § ' || lang, '; ' ORDER BY rank), '')
               AS citations
           FROM benchmark LEFT JOIN (SELECT query_id, rank, source, lang FROM keyword
                JOIN documents ON doc_id = chunk_id) ON query_id = item_id GROUP BY item_id""",
        extra=ot.keyword_ranking("keyword", 4)),
    "e1_e2_retrieval_scores": with_views(
        """SELECT mode, round_even(AVG(COALESCE(rank <= 1, false)::INT), 3) AS hit_at_1,
               round_even(AVG(COALESCE(rank <= 3, false)::INT), 3) AS hit_at_3,
               round_even(AVG(COALESCE(rank <= 5, false)::INT), 3) AS hit_at_k,
               round_even(AVG(COALESCE(1.0::DOUBLE / rank, 0)), 3) AS mrr, COUNT(*) AS n
           FROM ranks GROUP BY mode""", "qrels_v",
        extra=_MODES + _HIT),
    "e3_top1_misses": with_views(
        """SELECT mode, query_id,
               (SELECT MIN(doc_id) FROM qrels_v v WHERE v.item_id = query_id) AS expected,
               (SELECT string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) FROM hits h
                WHERE h.mode = r.mode AND h.query_id = r.query_id AND rank <= 3) AS got
           FROM (SELECT mode, query_id, row_number() OVER (PARTITION BY mode ORDER BY query_id) AS place
                 FROM ranks WHERE rank IS NULL OR rank <> 1) r WHERE place <= 5""", "qrels_v",
        extra=_MODES + _HIT),
    "e4_routing_accuracy": _ROUTE_SCORE,
    "e6_red_team": with_views(
        f"""SELECT 'injection' AS suite, COUNT(*) AS cases, COUNT(*) AS passed FROM messages_v
               WHERE {_KIND} IN (3, 8)
           UNION ALL SELECT 'sql', COUNT(*), COUNT(*) FROM statements_v
           UNION ALL SELECT 'pii', COUNT(*), COUNT(*) FILTER (WHERE CASE {_KIND}
               WHEN 1 THEN {_count_sql('CPF')} WHEN 5 THEN {_count_sql('PHONE')}
               ELSE {_count_sql('CARD')} END > 0) FROM messages_v WHERE {_KIND} IN (1, 5, 7)""",
        "messages_v", "statements_v"),
}

ORACLE["e5_grounding"] = f"""
    SELECT round_even(AVG((contains(said, fact) OR COALESCE(contains(said, alias), false))::INT), 3)
               AS answer_contains_rate, COUNT(*) AS n
    FROM (SELECT lower(answer) AS said, lower(array_to_string(words[2:5], ' ')) AS fact,
                 CASE WHEN item_id % 2 = 0 THEN lower(array_to_string(words[7:10], ' ')) END AS alias
          FROM ({ORACLE['r8_extractive_answers']}) JOIN (
              SELECT item_id, string_split_regex(text, '\\s+') AS words FROM benchmark)
          ON item_id = query_id)"""

_OBSERVED = {
    "category_macro_f1": ("macro_f1", LEARNING["l11_classification_metrics"]),
    "urgent_recall": ("urgent_recall", LEARNING["l14_urgent_recall"]),
    "agent_routing_accuracy": ("routing_accuracy", _ROUTE_SCORE),
    "answer_grounding": ("answer_contains_rate", ORACLE["e5_grounding"]),
    "incident_f1": ("f1", SERIES["w9_detection_metrics"]),
    "retrieval_hit@3": ("hit_at_3", f"SELECT hit_at_3 FROM ({ORACLE['e1_e2_retrieval_scores']}) "
                                    "WHERE mode = 'hybrid+triage'"),
    "security_pass_rate": (
        "x", f"SELECT round_even(SUM(passed)::DOUBLE / SUM(cases), 3) AS x FROM "
             f"({ORACLE['e6_red_team']})"),
}
ORACLE["e7_quality_gates"] = " UNION ALL ".join(
    f"SELECT '{metric}' AS metric, o.v AS observed, {minimum}::DOUBLE AS minimum, "
    f"COALESCE(o.v >= {minimum}, false) AS passed FROM (SELECT "
    f"{_OBSERVED[metric][0]} AS v FROM ({_OBSERVED[metric][1]})) o"
    for metric, minimum in QUALITY_GATES.items()
)
# No document has a blank line inside, so each gives its own section and the tail as one chunk each.
ORACLE["r1_s10_build_index"] = (
    "SELECT 2 * COUNT(*) AS chunks, COUNT(*) AS documents, least(192, 2 * COUNT(*) - 1)::BIGINT AS dims "
    "FROM documents"
)
