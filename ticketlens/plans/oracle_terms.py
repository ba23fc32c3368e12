"""SQL text for term weights and rankings on the check engine's side."""

from __future__ import annotations

from ticketlens.plans.oracle_text import FOLD, WORDS


def word_counts(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (k, term, tf) of words and word pairs."""
    return f"""{name} AS (SELECT k, term, COUNT(*) AS tf FROM (
        SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)),
               lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM (SELECT {key} AS k, {WORDS(FOLD(text))} AS w FROM {source})) GROUP BY 1, 2)"""


def char_counts(name: str, source: str, key: str, text: str, fold: bool) -> str:
    """CTE ``name`` (k, term, tf) of padded character 3- to 5-grams."""
    lowered = FOLD(text) if fold else f"lower({text})"
    sizes = ", ".join(
        f"list_transform(range(1, greatest(length(w) - {n} + 2, 1)), lambda i: substr(w, i, {n}))"
        for n in (3, 4, 5)
    )
    return f"""{name} AS (SELECT k, term, COUNT(*) AS tf FROM (
        SELECT k, unnest(flatten([{sizes}])) AS term FROM (
            SELECT k, ' ' || w || ' ' AS w FROM (
                SELECT {key} AS k, unnest(regexp_split_to_array({lowered}, '\\s+')) AS w
                FROM {source}) WHERE w <> '')) GROUP BY 1, 2)"""


def vocabulary(name: str, counts: str, source: str, min_df: int, limit: int | None = None) -> str:
    cap = f" ORDER BY SUM(tf) DESC, term LIMIT {limit}" if limit else ""
    return f"""{name} AS (SELECT term, COUNT(*) AS df,
        ln((1 + (SELECT COUNT(*) FROM {source}))::DOUBLE / (1 + COUNT(*))) + 1 AS idf
        FROM {counts} GROUP BY term HAVING COUNT(*) >= {min_df}{cap})"""


def weights(name: str, counts: str, terms: str, sublinear: bool = True) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""{name} AS (SELECT k, term, df, w / sqrt(SUM(w * w) OVER (PARTITION BY k)) AS weight
        FROM (SELECT k, term, df, {tf} * idf AS w FROM {counts} JOIN {terms} USING (term)))"""


def keyword_ranking(name: str, n: int) -> str:
    """CTE of the best ``n`` documents per benchmark item by character n-gram weights."""
    return ",\n".join([
        char_counts("doc_grams", "documents", "doc_id", "text", True),
        vocabulary("grams", "doc_grams", "documents", 1),
        weights("doc_weights", "doc_grams", "grams"),
        char_counts("item_grams", "benchmark", "item_id", "text", True),
        weights("item_weights", "item_grams", "grams"),
        f"""{name} AS (SELECT * FROM (
            SELECT query_id, chunk_id, score, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
            FROM (SELECT q.k AS query_id, d.k AS chunk_id,
                         ROUND(SUM(q.weight * d.weight), 9) AS score
                  FROM item_weights q JOIN doc_weights d USING (term) GROUP BY 1, 2)
            WHERE score > 0) WHERE rank <= {n})""",
    ])


def dense_ranking(name: str, n: int) -> str:
    """CTE of the best ``n`` vectors per label centroid."""
    return f"""
        cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
                         generate_subscripts(embedding, 1) AS i FROM embeddings),
        centroids AS (SELECT label, i, AVG(x) AS x FROM cells GROUP BY 1, 2),
        lengths AS (SELECT vec_id, sqrt(SUM(x * x)) AS l FROM cells GROUP BY 1),
        centroid_lengths AS (SELECT label, sqrt(SUM(x * x)) AS l FROM centroids GROUP BY 1),
        {name} AS (SELECT * FROM (
            SELECT query_id, chunk_id, score, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
            FROM (SELECT c.label AS query_id, v.vec_id AS chunk_id,
                         ROUND(SUM(c.x / cl.l * (v.x / l.l)), 9) AS score
                  FROM centroids c JOIN centroid_lengths cl USING (label)
                  JOIN cells v ON v.i = c.i JOIN lengths l ON l.vec_id = v.vec_id
                  GROUP BY 1, 2)) WHERE rank <= {n})"""
