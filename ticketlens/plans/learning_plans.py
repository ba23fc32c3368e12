"""Text features, classification and its scores (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions.numbers import l2_norm, normalise
from ticketlens.functions.text import clean_text
from ticketlens.operators import classify as c
from ticketlens.operators import features as f
from ticketlens.operators import scores as sc
from ticketlens.operators.scale import join_counted
from ticketlens.operators.splits import stratified_folds, temporal_split
from ticketlens.plans import oracle_terms as ot
from ticketlens.plans.oracle_text import FOLD, WORDS
from ticketlens.plans.views import Desk, with_views
from ticketlens.session import materialise, scratch_path
from ticketlens.sources import registry

LANGUAGES = ["de", "en", "es", "fr"]
QUALITIES = ["0", "1"]
PRIORITIES = ["high", "low", "medium", "urgent"]


def _documents(s, d):
    return Desk(s, d).documents.select("doc_id", "text", "lang")


def _words(s, d):
    return f.tfidf_words(_documents(s, d), "doc_id", "text").select(
        "doc_id", "term", F.round("weight", 6).alias("weight")
    )


def _chars(s, d):
    weights = f.tfidf_chars(_documents(s, d), "doc_id", "text")
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.sum(F.col("weight") * F.length("term")), 6).alias("total_by_length"),
        F.round(F.max("weight"), 6).alias("largest"),
    )


def _split(s, d):
    train, test = temporal_split(Desk(s, d).tickets)
    sides = [df.select(F.lit(n).alias("side"), "*") for n, df in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(
        F.count("*").alias("n"), F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
    )


def _baseline(s, d):
    labelled = _documents(s, d).join(Desk(s, d).table("labels"), "doc_id")
    value = c.most_frequent(labelled, "quality")
    return labelled.groupBy("quality").agg(F.count("*").alias("support")).filter(
        F.col("quality") == value
    ).select(F.col("quality").alias("prediction"), F.lit(1.0).alias("confidence"), "support")


def _bayes(s, d):
    found = c.bayes_fitted_on(_documents(s, d), "doc_id", "text", "lang", LANGUAGES)
    return found.withColumn("confidence", F.round("confidence", 6))


def _frame(s, d):
    """Ticket texts with tier; the language of the text is what the category model learns, so a
    ticket without a text or a language is no labelled row."""
    desk = Desk(s, d)
    labelled = desk.ticket_texts.filter("body IS NOT NULL AND lang IS NOT NULL")
    rows = labelled.join(desk.customers.select("customer_id", "tier"), "customer_id")
    return rows.select(
        "ticket_id", "created_at", "channel", "priority", "tier",
        F.col("lang").alias("category"), clean_text(F.col("body")).alias("text"),
    )


def _prepared(s, d):
    frame = materialise(_frame(s, d), "training-frame", heavy=True)
    return frame, *temporal_split(frame)


def _logistic(s, d):
    _, train, test = _prepared(s, d)
    fitted = c.fit_classifier(train, "category", "logistic")
    return fitted.transform(test).select(
        "ticket_id", F.col("category").alias("label"), "prediction", "confidence"
    )


def _priority(s, d):
    _, train, test = _prepared(s, d)
    fitted = c.fit_priority(train)
    return fitted.transform(test).select(
        "ticket_id", F.col("priority").alias("label"), "predicted_priority", "priority_confidence"
    )


def _fold_scores(s, d):
    """Baseline and Bayes on the quality of the labelled documents, fold by fold."""
    labels = Desk(s, d).table("labels").filter("quality IS NOT NULL")
    labelled = _documents(s, d).join(labels, "doc_id").withColumn("quality", F.col("quality").cast("string"))
    return c.cross_validate(labelled, "quality", "doc_id", ["dummy", "bayes"]).withColumn(
        "macro_f1", F.round("macro_f1", 6))


def _validation(s, d):
    _, train, _ = _prepared(s, d)
    return c.cv_summary(c.cross_validate(train, "category", "ticket_id"))


def _selection(s, d):
    _, train, test = _prepared(s, d)
    _, best, metrics = c.train_category(train, test, "category", "ticket_id")
    return metrics.select(F.lit(best).alias("model"), "*")


def _models(s, d):
    _, train, _ = _prepared(s, d)
    return (
        c.fit_classifier(train, "category", "bayes"),
        c.fit_priority(train),
    )


def _triage(s, d):
    rows = Desk(s, d).messages.select("message_id", "text")
    return c.triage_batch(rows, *_models(s, d)).select(
        "message_id", "category", "category_confidence", "priority", "priority_confidence",
        "auto_routed",
    )


def _masked(s, d):
    rows = Desk(s, d).messages.select("message_id", "text")
    return c.classify_masked(rows, *_models(s, d)).select(
        "message_id", "masked_text", "category", "priority", "n_email", "n_cnpj", "n_cpf",
        "n_card", "n_phone",
    )


def _registry(s, d):
    """Two versions of one model, the first promoted again; rows say what production serves."""
    _, train, _ = _prepared(s, d)
    root = scratch_path(s, "registry")
    for name in ("dummy", "bayes"):
        model = c.fit_classifier(train, "category", name)
        registry.register(model, s, root, "category", {"rows": float(train.count())},
                          {"model": name}, "none")
    registry.promote(s, root, "category", 1)
    served = registry.load(s, root, "category").transform(train)
    return served.groupBy("prediction").agg(F.count("*").alias("n")).join(
        registry.production(s, root), F.lit(True)
    )


def _lsa(s, d):
    """Width and length of every document's vector, and how far its weights reach along the first
    component, which has the largest singular value."""
    documents = _documents(s, d)
    components = f.fit_lsa(documents, "doc_id", "text")
    first = components.select("term", "df", F.col("vec")[0].alias("x"))
    weights = f.tfidf_words(documents, "doc_id", "text", 1)
    reach = join_counted(weights, first, "term", "df", "doc_id").groupBy("doc_id").agg(
        F.abs(F.sum(F.col("weight") * F.col("x"))).alias("lead"))
    vectors = f.embed_lsa(documents, "doc_id", "text", components)
    return vectors.join(reach, "doc_id", "left").select(
        "doc_id", F.size("vector").alias("dims"), F.round(l2_norm(F.col("vector")), 6).alias("norm"),
        F.round(F.coalesce("lead", F.lit(0.0)), 5).alias("lead"),
    )


def _unit_vectors(s, d):
    rows = Desk(s, d).table("embeddings")
    return rows.select(
        "vec_id", F.round(l2_norm(F.col("embedding")), 6).alias("norm"),
        F.posexplode(normalise(F.col("embedding"))).alias("pos", "x"),
    ).select("vec_id", "norm", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _discriminative(s, d):
    rows = f.discriminative_terms(_documents(s, d), "doc_id", "text", "lang")
    return rows.select("lang", "term", F.round("difference", 6).alias("difference"), "rank")


def _pred(run):
    return lambda s, d: run(Desk(s, d).predictions)


QUERIES = {
    "l1_tfidf_words": _words,
    "l2_tfidf_chars": _chars,
    "l3_temporal_split": _split,
    "l4_dummy_baseline": _baseline,
    "l5_complement_bayes": _bayes,
    "l6_logistic_regression": _logistic,
    "l7_priority_model": _priority,
    "l9_stratified_folds": lambda s, d: stratified_folds(
        Desk(s, d).tickets, "priority", "ticket_id"
    ).select("ticket_id", "priority", "fold"),
    "l9_fold_scores": _fold_scores,
    "l9_cross_validation": _validation,
    "l10_model_selection": _selection,
    "l11_classification_metrics": _pred(sc.classification_metrics),
    "l11_per_class": _pred(lambda p: sc.per_class(p).select(
        "label", "support", *[F.bround(x, 4).alias(x) for x in ("precision", "recall", "f1")])),
    "l12_confusion_matrix": _pred(lambda p: sc.confusion_matrix(p, PRIORITIES)),
    "l13_auto_routing": _pred(sc.auto_routing),
    "l14_urgent_recall": _pred(sc.class_recall),
    "l8_l15_triage_batch": _triage,
    "l16_classify_masked": _masked,
    "l17_reference_shares": lambda s, d: sc.label_shares(
        temporal_split(Desk(s, d).tickets)[0], ["category", "priority"]
    ).withColumn("share", F.round("share", 6)),
    "l18_lsa_embedding": _lsa,
    "l19_unit_vectors": _unit_vectors,
    "l20_discriminative_terms": _discriminative,
    "s9_model_registry": _registry,
}

_WORD_WEIGHTS = ",\n".join([
    ot.word_counts("tf", "documents", "doc_id", "text"),
    ot.vocabulary("terms", "tf", "documents", 2),
    ot.weights("weights", "tf", "terms"),
])
_CUT = "cut AS (SELECT quantile_cont(epoch_us(created_at)::DOUBLE, 0.8) AS c FROM tickets_v)"
_CLASSES = """sides AS (
        SELECT label, 1 AS support, 0 AS predicted, (label = prediction)::INT AS hits
        FROM predictions_v UNION ALL SELECT prediction, 0, 1, 0 FROM predictions_v),
    sums AS (SELECT label, SUM(support)::BIGINT AS support, SUM(predicted) AS predicted,
                    SUM(hits) AS hits FROM sides GROUP BY label),
    ratios AS (SELECT *, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS p,
                      CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS r FROM sums),
    classes AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1
                FROM ratios)"""
_BAYES_IN = ", ".join(
    f"SUM(CASE WHEN lang = '{c}' THEN weight ELSE 0 END) AS in{i}" for i, c in enumerate(LANGUAGES)
)
_N = range(len(LANGUAGES))
BAYES_MODEL = f"""{_WORD_WEIGHTS},
    sums AS (SELECT term, SUM(weight) AS everywhere, {_BAYES_IN}
             FROM weights JOIN documents ON doc_id = k GROUP BY term),
    totals AS (SELECT {', '.join(f'SUM(everywhere + 0.3::DOUBLE - in{i}) AS t{i}' for i in _N)} FROM sums),
    model AS (SELECT term, {', '.join(f'-ln((everywhere + 0.3::DOUBLE - in{i}) / t{i}) AS w{i}' for i in _N)}
              FROM sums, totals)"""
_QUALITY_IN = ", ".join(
    f"SUM(CASE WHEN quality = '{c}' THEN weight ELSE 0 END) AS in{i}" for i, c in enumerate(QUALITIES)
)
_Q = range(len(QUALITIES))

ORACLE = {
    "l1_tfidf_words": with_views(
        "SELECT k AS doc_id, term, ROUND(weight, 6) AS weight FROM weights", extra=_WORD_WEIGHTS),
    "l2_tfidf_chars": with_views(
        """SELECT k AS doc_id, COUNT(*) AS terms, ROUND(SUM(weight), 6) AS total,
                  ROUND(SUM(weight * length(term)), 6) AS total_by_length,
                  ROUND(MAX(weight), 6) AS largest FROM weights GROUP BY k""",
        extra=",\n".join([
            ot.char_counts("tf", "documents", "doc_id", "text", False),
            ot.vocabulary("terms", "tf", "documents", 3, 40000),
            ot.weights("weights", "tf", "terms"),
        ])),
    "l3_temporal_split": with_views(
        """SELECT CASE WHEN epoch_us(created_at) < c THEN 'train' ELSE 'test' END AS side,
                  COUNT(*) AS n, MIN(created_at) AS first, MAX(created_at) AS last
           FROM tickets_v, cut GROUP BY 1""", "tickets_v", extra=_CUT),
    "l4_dummy_baseline": """
        SELECT quality AS prediction, 1.0::DOUBLE AS confidence, COUNT(*) AS support
        FROM documents JOIN labels USING (doc_id) GROUP BY quality
        ORDER BY support DESC, quality LIMIT 1""",
    "l5_complement_bayes": with_views(
        f"""SELECT k AS doc_id,
               CASE {' '.join(f"WHEN s{i} = top THEN '{c}'" for i, c in enumerate(LANGUAGES))} END
                   AS prediction,
               ROUND(1 / ({' + '.join(f'exp(s{i} - top)' for i in _N)}), 6) AS confidence
           FROM (SELECT *, greatest({', '.join(f's{i}' for i in _N)}) AS top FROM (
               SELECT doc_id AS k, {', '.join(f'COALESCE(SUM(weight * w{i}), 0) AS s{i}' for i in _N)}
               FROM documents LEFT JOIN (weights JOIN model USING (term)) ON k = doc_id
               GROUP BY doc_id))""",
        extra=BAYES_MODEL),
    "l9_stratified_folds": with_views(
        """SELECT ticket_id, priority, (row_number() OVER (PARTITION BY priority ORDER BY
               md5('42:' || CAST(ticket_id AS VARCHAR))) - 1) % 5 AS fold FROM tickets_v""",
        "tickets_v"),
    "l11_classification_metrics": with_views(
        """SELECT round_even(SUM(hits) / SUM(support), 4) AS accuracy,
                  round_even(AVG(f1), 4) AS macro_f1,
                  round_even(SUM(f1 * support) / SUM(support), 4) AS weighted_f1 FROM classes""",
        "predictions_v", extra=_CLASSES),
    "l11_per_class": with_views(
        """SELECT label, support, round_even(p, 4) AS precision, round_even(r, 4) AS recall,
                  round_even(f1, 4) AS f1 FROM classes""", "predictions_v", extra=_CLASSES),
    "l12_confusion_matrix": with_views(
        "SELECT label, " + ", ".join(
            f"COUNT(*) FILTER (WHERE prediction = '{p}') AS pred_{p}" for p in PRIORITIES
        ) + " FROM predictions_v GROUP BY label", "predictions_v"),
    "l13_auto_routing": with_views(
        """SELECT round_even(AVG((confidence >= 0.6)::INT), 4) AS auto_route_rate,
                  round_even(AVG((label = prediction)::INT) FILTER (WHERE confidence >= 0.6), 4)
                  AS auto_route_accuracy FROM predictions_v""", "predictions_v"),
    "l14_urgent_recall": with_views(
        """SELECT round_even(AVG((prediction = 'urgent')::INT), 4) AS urgent_recall
           FROM predictions_v WHERE label = 'urgent'""", "predictions_v"),
    "l17_reference_shares": with_views(
        """SELECT field, value, ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY field), 6)
                  AS share FROM (
               SELECT 'category' AS field, category AS value, created_at FROM tickets_v
               UNION ALL SELECT 'priority', priority, created_at FROM tickets_v), cut
           WHERE epoch_us(created_at) < c GROUP BY field, value""", "tickets_v", extra=_CUT),
    "l19_unit_vectors": """
        SELECT vec_id, ROUND(norm, 6) AS norm, pos - 1 AS pos, ROUND(v / norm, 6) AS x FROM (
            SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)))
                   AS norm, unnest(embedding)::DOUBLE AS v,
                   generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
    "l20_discriminative_terms": with_views(
        """SELECT lang, term, ROUND(difference, 6) AS difference, rank FROM (
               SELECT *, row_number() OVER (PARTITION BY lang ORDER BY difference DESC, term) AS rank
               FROM (SELECT lang, term, ROUND(inside / size
                     - (SUM(inside) OVER (PARTITION BY term) - inside) / (n - size), 9) AS difference
                     FROM (SELECT lang, term, SUM(weight) AS inside
                           FROM weights JOIN documents ON doc_id = k GROUP BY 1, 2)
                     JOIN (SELECT lang, COUNT(*) AS size, SUM(COUNT(*)) OVER () AS n
                           FROM documents GROUP BY lang) USING (lang))) WHERE rank <= 8""",
        extra=",\n".join([
            ot.word_counts("tf", "documents", "doc_id", "text"),
            ot.vocabulary("terms", "tf", "documents", 5),
            ot.weights("weights", "tf", "terms", False),
        ])),
}

# A document has a vector of length one if it has a word and zero if not. The first component comes
# from power iteration with the documents' inner products, which are all positive.
ORACLE["l18_lsa_embedding"] = with_views(
    f"""SELECT doc_id, (SELECT least(192, COUNT(*) - 1, (SELECT COUNT(*) - 1 FROM terms)) FROM documents)
               AS dims, CASE WHEN len({WORDS(FOLD('text'))}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm,
               ROUND(COALESCE(y * sqrt(size), 0), 5) AS lead
        FROM documents LEFT JOIN (SELECT * FROM steps WHERE i = 60) ON k = doc_id""",
    extra=",\n".join([
        ot.word_counts("tf", "documents", "doc_id", "text"),
        ot.vocabulary("terms", "tf", "documents", 1),
        ot.weights("weights", "tf", "terms"),
        """shared AS (SELECT * FROM weights WHERE df > 1),
        own AS (SELECT k, SUM(weight * weight) AS own FROM weights WHERE df = 1 GROUP BY k),
        steps(i, k, y, size) AS (
            SELECT 0, k, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT k FROM weights)
            UNION ALL
            SELECT i, k, z / sqrt(SUM(z * z) OVER ()), sqrt(SUM(z * z) OVER ()) FROM (
                SELECT i + 1 AS i, k, SUM(part) AS z FROM (
                    SELECT s.i, w.k, w.weight * t.x AS part
                    FROM (SELECT s.i, w.term, SUM(w.weight * s.y) AS x
                          FROM steps s JOIN shared w ON w.k = s.k GROUP BY s.i, w.term) t
                    JOIN shared w ON w.term = t.term JOIN steps s ON s.k = w.k
                    UNION ALL
                    SELECT s.i, s.k, s.y * COALESCE(o.own, 0) FROM steps s LEFT JOIN own o ON o.k = s.k)
                WHERE i < 60 GROUP BY i, k))""",
    ]), recursive=True)

_SEEN = "JOIN folds USING (k) JOIN others ON others.f <> folds.fold"


def _fold_weights(kind: str, counts: str, min_df: int, limit: int | None) -> str:
    cap = "" if limit is None else (
        f" QUALIFY row_number() OVER (PARTITION BY f ORDER BY SUM(tf) DESC, term) <= {limit}")
    return f"""{kind}_terms AS (SELECT f, term, COUNT(*) AS df FROM {counts} {_SEEN}
                        GROUP BY f, term HAVING COUNT(*) >= {min_df}{cap}),
    {kind}_weights AS (SELECT f, k, '{kind}:' || term AS term,
               w / sqrt(SUM(w * w) OVER (PARTITION BY f, k)) AS weight FROM (
            SELECT f, k, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w
            FROM {counts} JOIN {kind}_terms USING (term) JOIN fold_sizes USING (f)))"""


ORACLE["l9_fold_scores"] = with_views(
    f"""SELECT model, f AS fold, ROUND(AVG(2.0::DOUBLE * hits / (support + predicted)), 6) AS macro_f1 FROM (
            SELECT model, f, class, SUM(support) AS support, SUM(predicted) AS predicted, SUM(hits) AS hits
            FROM (SELECT model, f, quality AS class, 1 AS support, 0 AS predicted,
                         (quality = prediction)::INT AS hits FROM predicted
                  UNION ALL SELECT model, f, prediction, 0, 1, 0 FROM predicted) GROUP BY ALL)
        GROUP BY model, f""",
    extra=",\n".join([
        """labelled AS (SELECT doc_id, text, CAST(quality AS VARCHAR) AS quality
                     FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)""",
        """folds AS (SELECT doc_id AS k, quality, (row_number() OVER (PARTITION BY quality
                  ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) - 1) % 5 AS fold FROM labelled)""",
        "others AS (SELECT unnest(range(5)) AS f)",
        "fold_sizes AS (SELECT f, COUNT(*) AS n FROM folds JOIN others ON f <> fold GROUP BY f)",
        ot.word_counts("word_tf", "labelled", "doc_id", "text"),
        ot.char_counts("char_tf", "labelled", "doc_id", "text", False),
        _fold_weights("w", "word_tf", 2, None),
        _fold_weights("c", "char_tf", 3, 40000),
        f"""weights AS (SELECT * FROM w_weights UNION ALL SELECT * FROM c_weights),
        sums AS (SELECT f, term, SUM(weight) AS everywhere, {_QUALITY_IN}
                 FROM weights JOIN folds USING (k) WHERE fold <> f GROUP BY f, term),
        totals AS (SELECT f, {', '.join(f'SUM(everywhere + 0.3::DOUBLE - in{i}) AS t{i}' for i in _Q)}
                   FROM sums GROUP BY f),
        model AS (SELECT f, term, {', '.join(
            f'-ln((everywhere + 0.3::DOUBLE - in{i}) / t{i}) AS w{i}' for i in _Q)}
                  FROM sums JOIN totals USING (f)),
        scored AS (SELECT fold AS f, k, quality, {', '.join(
            f'COALESCE(SUM(weight * w{i}), 0) AS s{i}' for i in _Q)}
                   FROM folds LEFT JOIN (weights JOIN model USING (f, term)) USING (k)
                   WHERE f IS NULL OR f = fold GROUP BY fold, k, quality),
        dummy AS (SELECT f, quality AS prediction FROM folds JOIN others ON f <> fold GROUP BY f, quality
                  QUALIFY row_number() OVER (PARTITION BY f ORDER BY COUNT(*) DESC, quality) = 1),
        predicted AS (
            SELECT 'bayes' AS model, f, quality, CASE {' '.join(
                f"WHEN s{i} >= greatest({', '.join(f's{j}' for j in _Q)}) THEN '{c}'"
                for i, c in enumerate(QUALITIES))} END AS prediction FROM scored
            UNION ALL
            SELECT 'dummy', f, folds.quality, prediction FROM folds JOIN dummy ON f = fold)""",
    ]))
ORACLE["s9_model_registry"] = with_views(
    """SELECT (SELECT lang FROM train GROUP BY lang ORDER BY COUNT(*) DESC, lang LIMIT 1)
              AS prediction, COUNT(*) AS n, 'category' AS name, 1 AS version FROM train""",
    "ticket_texts_v", "customers_v",
    extra="""frame AS (SELECT lang, epoch_us(created_at) AS t
                       FROM ticket_texts_v JOIN customers_v USING (customer_id)
                       WHERE body IS NOT NULL AND lang IS NOT NULL),
             cut AS (SELECT quantile_cont(t::DOUBLE, 0.8) AS c FROM frame),
             train AS (SELECT lang FROM frame, cut WHERE t < c)""")
