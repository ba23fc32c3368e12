"""Term weights in long form (document, term, weight) and latent semantic vectors.

One long table serves classification, keyword search and the report. Terms are keys that are
aggregated and joined; only a vocabulary of character n-grams passes the driver, on its way to the
tasks, if it has at most ``BROADCAST_TERMS`` terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import CHAR_FEATURES, LSA_DIMS
from ticketlens.functions.text import WORD, normalize_accents
from ticketlens.operators.blocks import (
    COLS,
    ROWS,
    Strips,
    bound_batches,
    numbered,
    packed_rows,
    sparse,
    triangle,
    unpacked_rows,
    whitening,
)
from ticketlens.operators.grams import char_texts, gram_stats, gram_weights, sent_terms
from ticketlens.operators.scale import first_of_value, join_counted, top_k_per_group
from ticketlens.operators.words import Words, counted_words
from ticketlens.session import materialise

BROADCAST_TERMS = 1_000_000


def word_terms(folded: Column, bigrams: bool = True) -> Column:
    """Words of two or more characters of a folded text and, after them, neighbouring pairs."""
    words = F.regexp_extract_all(folded, F.lit(f"[{WORD}]{{2,}}"), 0)
    if not bigrams:
        return words
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    first, second = F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs)
    return F.concat(words, F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b)))


def char_terms(lowered: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams that do not cross word bounds; each word is padded with one blank."""
    words = F.filter(F.split(lowered, r"(?U)\s+"), lambda w: w != "")

    def of_size(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - n + 1)
        found = F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, found).otherwise(F.array().cast("array<string>"))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[of_size(padded, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))


def _folded(documents: DataFrame, key: str, text: str, fold: bool) -> DataFrame:
    """(key, _text), one shuffle of the texts by document. Everything that follows per document
    (counts, norms, gathering) finds its rows together, so none of the far more numerous term rows
    are shuffled for it."""
    # Folding comes before the shuffle: a Python step after it would hide the partitioning.
    folded = normalize_accents(F.col(text)) if fold else F.lower(text)
    return documents.select(key, folded.alias("_text")).repartition(key)


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def word_counts(documents: DataFrame, key: str, text: str, fold: bool = True) -> DataFrame:
    """(key, term, tf) of words and neighbouring pairs, partitioned by document."""
    rows = _folded(documents, key, text, fold)
    return _counted(rows.select(key, F.explode(word_terms(F.col("_text"))).alias("term")), key)


def char_counts(documents: DataFrame, key: str, text: str, fold: bool = False, low: int = 3,
                high: int = 5) -> DataFrame:
    """(key, term, tf) of ``char_terms``, one row per word and start so that all of it is
    generated code; partitioned by document."""
    rows = _folded(documents, key, text, fold)
    word = F.concat(F.lit(" "), F.col("_word"), F.lit(" "))
    words = rows.select(key, F.explode(F.split("_text", r"(?U)\s+")).alias("_word"))
    starts = words.filter("_word <> ''").select(key, word.alias("_word")).select(
        key, "_word", F.explode(F.sequence(F.lit(1), F.length("_word") - low + 1)).alias("_at")
    )
    grams = F.array(*[
        F.when(F.col("_at") + n - 1 <= F.length("_word"), F.substr("_word", "_at", F.lit(n)))
        for n in range(low, high + 1)
    ])
    return _counted(
        starts.select(key, F.explode(grams).alias("term")).filter("term IS NOT NULL"), key
    )


def vocabulary(
    counts: DataFrame, documents: DataFrame, min_df: int, max_features: int | None = None
) -> DataFrame:
    """(term, df, idf) of the terms in at least ``min_df`` documents; ``max_features`` keeps the
    most frequent ones (ties by term). idf = ln((1 + N) / (1 + df)) + 1."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return _with_idf(terms, documents, min_df, max_features)


def char_vocabulary(texts: DataFrame, min_df: int, max_features: int | None = None) -> DataFrame:
    """``vocabulary`` of the character n-grams of ``char_texts``."""
    return _with_idf(gram_stats(texts), texts, min_df, max_features)


def _with_idf(terms: DataFrame, documents: DataFrame, min_df: int, max_features: int | None) -> DataFrame:
    terms = terms.filter(F.col("df") >= min_df)
    if max_features:
        terms = first_of_value(materialise(terms, "terms"), [], "total", "term", max_features)
    size = documents.agg(F.count("*").alias("_n"))
    return terms.join(F.broadcast(size), F.lit(True)).select(
        "term", "df", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def join_terms(rows: DataFrame, terms: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """Term rows with their vocabulary entry. A vocabulary of a counted ``size`` up to
    ``BROADCAST_TERMS`` is broadcast, which leaves the rows where they are; a larger or unknown
    one is joined by a shuffle that splits frequent terms."""
    if size is not None and size <= BROADCAST_TERMS:
        return rows.join(F.broadcast(terms), "term")
    return join_counted(rows, terms, "term", "df", key)


def weigh(counts: DataFrame, key: str, terms: DataFrame, sublinear: bool = True,
          size: int | None = None) -> DataFrame:
    """(key, term, weight), unit length per document, over the terms of the vocabulary."""
    tf = 1 + F.ln("tf") if sublinear else F.col("tf")
    raw = join_terms(counts, terms, key, size).select(
        key, "term", (tf * F.col("idf")).alias("_w")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / length).alias("weight"))


def tfidf_words(documents: DataFrame, key: str, text: str, min_df: int = 2,
                sublinear: bool = True) -> DataFrame:
    """Word and word-pair weights, accents removed."""
    return known_words(documents, key, text, min_df, sublinear).weights(key)


def known_words(documents: DataFrame, key: str, text: str, min_df: int = 2, sublinear: bool = True,
                label: str | None = None) -> Words:
    """Words and word pairs, accents removed, ready to be weighed or summed up by ``label``."""
    words = word_terms(normalize_accents(F.col(text)), False)
    return counted_words(documents, key, words, min_df, sublinear, None if label is None else F.col(label))


def tfidf_chars(documents: DataFrame, key: str, text: str, min_df: int = 3,
                max_features: int | None = CHAR_FEATURES, fold: bool = False) -> DataFrame:
    """Character n-gram weights; accents are kept unless ``fold``."""
    texts = char_texts(documents, key, text, fold)
    terms = materialise(char_vocabulary(texts, min_df, max_features), "char-terms")
    size = terms.count()
    if size <= BROADCAST_TERMS:
        return gram_weights(texts, key, sent_terms(terms))
    return weigh(char_counts(documents, key, text, fold), key, terms, size=size)


def discriminative_terms(documents: DataFrame, key: str, text: str, label: str, min_df: int = 5,
                         k: int = 8) -> DataFrame:
    """The ``k`` terms per class whose mean weight in the class exceeds the mean outside most.
    Documents without the term count as zero."""
    known = known_words(documents, key, text, min_df, False, label)
    if documents.groupBy(key).count().filter("count > 1").isEmpty():
        sums = known.sums_by_group()
    else:  # texts of one key are one, but may have several labels
        sums = known.weights(key).join(documents.select(key, F.col(label).alias("own")), key)
        sums = sums.withColumnRenamed("weight", "sum")
    sizes = documents.groupBy(label).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_all", F.sum("_size").over(Window.partitionBy()))
    kind = documents.schema[label].dataType
    per_class = sums.groupBy("term", F.col("own").cast(kind).alias(label)).agg(F.sum("sum").alias("_in"))
    per_class = materialise(per_class, "class-sums")
    total = per_class.groupBy("term").agg(F.sum("_in").alias("_sum"))
    # Terms that never occur in a class have no row there and cannot lead it.
    difference = F.col("_in") / F.col("_size") - F.coalesce(
        F.try_divide(F.col("_sum") - F.col("_in"), F.col("_all") - F.col("_size")), F.lit(0.0)
    )
    scored = per_class.join(total, "term").join(F.broadcast(sizes), label).select(
        label, "term", F.round(difference, 9).alias("difference")
    )
    return top_k_per_group(scored, [label], [F.col("difference").desc(), F.col("term")], k)


# --- latent semantic vectors ------------------------------------------------------------------


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def _scaled(rows: Strips, factor: Strips, power: float) -> DataFrame:
    """Every row of ``rows`` times a power of the one number that ``factor`` has for it."""
    joined = rows.frame.join(factor.frame.withColumnRenamed("data", "factor"), "block")
    height, width = rows.height, rows.width

    def run(batches):
        for batch in batches:
            for block, data, factors in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                by = np.frombuffer(factors.as_buffer()) ** power
                dense = np.frombuffer(data.as_buffer()).reshape(height, width)
                out = [(dense * by[:, None]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()),
                                                  pa.array(out, pa.binary())], ["block", "data"])

    return joined.mapInArrow(run, "block long, data binary")


def fit_lsa(documents: DataFrame, key: str, text: str, dims: int = LSA_DIMS, iterations: int = 5,
            oversample: int = 10) -> DataFrame:
    """Components of a truncated SVD of the word weights: (term, df, idf, block, at, vec), where block
    and at number the terms.

    Randomised subspace iteration (Halko, Martinsson and Tropp, 2011) with products of blocks; columns
    are made orthonormal by a tree QR. A term of a single document adds only to that document's own
    row of the matrix times its transpose, so such terms, the most of all, stay out of the products:
    one number per document stands for them, and their components are made from its final row."""
    bound_batches(documents.sparkSession)
    counts = word_counts(documents, key, text)
    terms = materialise(vocabulary(counts, documents, 1), "lsa-terms")
    n_terms = terms.count()
    a = materialise(weigh(counts, key, terms, size=n_terms), "lsa-weights")
    docs = materialise(numbered(documents.select(key).distinct(), key, ROWS), "lsa-documents")
    shared = materialise(numbered(terms.filter("df > 1"), "term", COLS), "lsa-shared")
    dims = max(2, min(dims, docs.count() - 1, n_terms - 1))
    size = dims + oversample

    places = shared.select("term", "df", F.col("block").alias("cb"), F.col("at").alias("ca"))
    rows = docs.select(key, F.col("block").alias("rb"), F.col("at").alias("ra"))
    entries = join_counted(a, places, "term", "df", key).join(rows, key)
    matrix = sparse(entries.withColumnRenamed("weight", "value"), "lsa-matrix")
    single = materialise(a.join(terms.filter("df = 1"), "term"), "lsa-single")
    squares = single.groupBy(key).agg(F.array(F.sum(F.col("weight") ** 2)).alias("vec"))
    own = packed_rows(docs.join(squares, key), ROWS, 1).written("lsa-own")

    sign = F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda j: F.when(F.xxhash64(key, j) % 2 == 0, 1.0).otherwise(-1.0))
    left = packed_rows(docs.withColumn("vec", sign), ROWS, size)
    for _ in range(iterations + 1):
        right = matrix.transposed_times(left).written("lsa-right")
        left = matrix.times(right, [_scaled(left, own, 1.0)]).written("lsa-left")
        left = left.times(whitening(triangle(left))[1])
    right = matrix.transposed_times(left).written("lsa-right")
    beside = Strips(_scaled(left, own, 0.5), ROWS, size)
    _, turn = whitening(np.linalg.qr(np.vstack([triangle(right), triangle(beside)]), mode="r"))
    turn = turn[:, :dims]

    found = unpacked_rows(right.times(turn), shared, "term string, df long, idf double")
    kind = documents.schema[key].dataType.simpleString()
    rows = unpacked_rows(left.times(turn), docs, f"{key} {kind}")
    alone = single.join(rows, key).select(
        "term", "df", "idf", F.transform("vec", lambda x: x * F.col("weight")).alias("vec"))
    names = numbered(terms.select("term"), "term", COLS)
    return materialise(found.unionByName(alone).join(names, "term").select(
        "term", "df", "idf", "block", "at", "vec"), "lsa-components")


def embed_lsa(documents: DataFrame, key: str, text: str, components: DataFrame) -> DataFrame:
    """(key, vector): unit vectors of the documents in the fitted space. A document that shares no
    term with it has the zero vector."""
    bound_batches(documents.sparkSession)
    terms = components.select("term", "df", "idf", "block", "at")
    counts = word_counts(documents, key, text)
    weights = weigh(counts, key, terms.select("term", "df", "idf"), size=components.count())
    docs = materialise(numbered(documents.select(key).distinct(), key, ROWS), "lsa-documents")
    places = terms.select("term", "df", F.col("block").alias("cb"), F.col("at").alias("ca"))
    rows = docs.select(key, F.col("block").alias("rb"), F.col("at").alias("ra"))
    entries = join_counted(weights, places, "term", "df", key).join(rows, key)
    matrix = sparse(entries.withColumnRenamed("weight", "value"), "lsa-matrix")
    size = components.select(F.size("vec")).first()[0]
    product = matrix.times(packed_rows(components, COLS, size))
    kind = documents.schema[key].dataType.simpleString()
    return unpacked_rows(product, docs, f"{key} {kind}", _unit).withColumnRenamed("vec", "vector")
