"""Text operators, SQL audit, audit log digest (T, S7, S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    ALLOWED_RELATIONS,
    ANALYTICS_HINTS,
    ANALYTICS_KEYWORDS,
    FORBIDDEN_SQL,
    INJECTION_PATTERNS,
    ORDER_ID,
    PII_PATTERNS,
    STOPWORDS,
)
from ticketlens.functions import sql_audit
from ticketlens.functions import text as t
from ticketlens.operators.documents import chunk_markdown
from ticketlens.plans import oracle_text as o
from ticketlens.plans.views import Desk, with_views
from ticketlens.sources.sinks import audit_records, record_rows


def _documents(spark, folder):
    return Desk(spark, folder).documents.select("doc_id", "text")


def _per_document(**columns):
    def run(spark, folder):
        return _documents(spark, folder).select(
            "doc_id", *[make(F.col("text")).alias(name) for name, make in columns.items()]
        )
    return run


def _pii_columns(spark, folder):
    counts = t.pii_counts(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", *[n.alias(f"n_{label.lower()}") for label, n in counts.items()]
    )


def _prevalence(spark, folder):
    share = F.avg(F.when(t.has_pii(F.col("text")), 100.0).otherwise(0.0))
    return _documents(spark, folder).agg(F.round(share, 6).alias("pii_pct"))


def _guard(spark, folder):
    desk = Desk(spark, folder)
    masked = desk.messages.select("message_id", t.mask_pii(F.col("text")).alias("text"))
    reason = t.guard_reason(F.col("text"))
    return masked.select("message_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def _guard_documents(spark, folder):
    reason = t.guard_reason(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", reason.isNull().alias("allowed"), reason.alias("reason")
    )


def _routing(spark, folder):
    folded = t.normalize_accents(F.col("text"))
    rows = Desk(spark, folder).messages.select(
        "message_id", folded.alias("folded"), t.extract_order_id(F.col("text")).alias("order_id")
    )
    return rows.select(
        "message_id",
        "order_id",
        t.analytics_match(F.col("folded")).alias("query"),
        t.route_intent(F.col("folded"), F.col("order_id")).alias("intent"),
    )


def _sentences(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "sentence")
    )


def _chunks(spark, folder):
    return chunk_markdown(Desk(spark, folder).sections, limit=1_000_000).select(
        "doc_id", "chunk_id", "source", "title", "section",
        t.embedding_text(F.col("title"), F.col("section"), F.col("text")).alias("embedding_text"),
    )


def _split(spark, folder):
    """Every line of a document as a paragraph, so that the packing has something to pack."""
    body = F.regexp_replace("text", r"\n+", "\n\n")
    return _documents(spark, folder).select(
        "doc_id", F.posexplode(t.split_long(body)).alias("part", "text")
    )


def _json(spark, folder):
    events = Desk(spark, folder).table("events")
    found = t.embedded_json(F.concat(F.lit("{ k:"), F.col("event_type"), F.col("props")))
    plain = t.embedded_json(F.concat(F.lit("answer: "), F.col("props"), F.lit(" end")))
    return events.select(
        "event_id", found.alias("from_first_brace"),
        F.get_json_object(plain, "$.k").cast("long").alias("k"),
    )


def _audit_digest(spark, folder):
    rows = Desk(spark, folder).messages.select(
        "message_id", t.mask_pii(F.col("text")).alias("input")
    )
    return audit_records(rows, "agent_chat").select("message_id", "event", "input_sha256")


def _export(spark, folder):
    from ticketlens.operators.analytics import daily_counts

    return record_rows(daily_counts(Desk(spark, folder).tickets))


QUERIES = {
    "t1_mask_pii": _per_document(masked=t.mask_pii),
    "t2_pii_counts": _pii_columns,
    "t3_clean_text": _per_document(cleaned=t.clean_text),
    "t4_check_input": _guard,
    "t4_check_input_documents": _guard_documents,
    "t5_normalize_accents": _per_document(folded=t.normalize_accents),
    "t6_tokens": _per_document(words=lambda c: F.array_join(F.array_sort(t.tokens(c)), " ")),
    "t7_t8_t9_routing": _routing,
    "t10_fold_typography": _per_document(folded=t.fold_typography),
    "t11_sql_verdict": lambda s, d: sql_audit.audit(Desk(s, d).statements).select(
        "statement_id", "ok", "reason", "safe_sql"
    ),
    "t12_sentences": _sentences,
    "t13_t15_chunk_markdown": _chunks,
    "t14_split_long": _split,
    "t16_embedded_json": _json,
    "t17_pii_prevalence": _prevalence,
    "s7_audit_digest": _audit_digest,
    "s11_record_rows": _export,
}


def _guard_reason_sql(column: str) -> str:
    regex = "(?i)(" + "|".join(INJECTION_PATTERNS) + ")"
    found = o.unwrapped(f"regexp_extract({o.wrapped(column)}, {o.quoted(_wrapped_regex(regex))}, 0)")
    return (
        f"CASE WHEN {column} IS NULL OR trim({column}, chr(32) || chr(9) || chr(10) || chr(13)) = '' "
        f"THEN 'empty input' WHEN length({column}) > 4000 THEN 'input exceeds 4000 characters' "
        f"WHEN {found} <> '' THEN 'possible prompt injection: ''' || {found} || '''' END"
    )


def _wrapped_regex(regex: str) -> str:
    """The accented alternatives as they look between marks."""
    m = o.MARK
    for plain, accented in (("c", "ç"), ("o", "õ"), ("e", "é"), ("e", "ê")):
        for written in (f"[{plain}{accented}]", f"[{accented}{plain}]"):
            if written in regex:
                regex = regex.replace(written, f"(?:{plain}|{m}{accented}{m})")
    return regex


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {o.quoted(w)})" for w in words) + ")"


_MATCH = "CASE " + " ".join(
    f"WHEN {_any('folded', words)} THEN '{name}'" for words, name in ANALYTICS_KEYWORDS
) + " END"
_STOP = "[" + ", ".join(o.quoted(w) for w in STOPWORDS) + "]"
_CLEAN_SQL = (
    "regexp_replace(regexp_replace(stmt, '--[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g')"
)
_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
_RELATION_SQL = r"'(?i)\b(?:from|join)\s+([a-zA-Z_][\w.]*)'"
_CTE_SQL = r"'(?i)(?:\bwith|,)\s*([a-zA-Z_]\w*)\s+as\s*\('"
_FORBIDDEN_SQL = "'(?i)\\b(" + "|".join(FORBIDDEN_SQL) + ")\\b'"
_LIMIT_SQL = r"'(?i)\blimit\s+(\d+)\s*$'"
_ALLOWED_SQL = "[" + ", ".join(o.quoted(r) for r in ALLOWED_RELATIONS) + "]"

ORACLE = {
    "t1_mask_pii": f"SELECT doc_id, {o.MASK('text')} AS masked FROM documents",
    "t2_pii_counts": "SELECT doc_id, " + ", ".join(
        f"{o.COUNTED('text', label)} AS n_{label.lower()}" for label in PII_PATTERNS
    ) + " FROM documents",
    "t3_clean_text": f"SELECT doc_id, {o.CLEAN('text')} AS cleaned FROM documents",
    "t4_check_input": with_views(
        f"""SELECT message_id, reason IS NULL AS allowed, reason FROM (
            SELECT message_id, {_guard_reason_sql('masked')} AS reason FROM (
                SELECT message_id, {o.MASK('text')} AS masked FROM messages_v))""", "messages_v"),
    "t4_check_input_documents": f"""SELECT doc_id, reason IS NULL AS allowed, reason FROM (
            SELECT doc_id, {_guard_reason_sql('text')} AS reason FROM documents)""",
    "t5_normalize_accents": f"SELECT doc_id, {o.FOLD('text')} AS folded FROM documents",
    "t6_tokens": f"""SELECT doc_id, array_to_string(list_sort(list_filter(
            list_distinct({o.WORDS(o.FOLD('text'))}), lambda w: NOT list_contains({_STOP}, w))), ' ')
            AS words FROM documents""",
    "t7_t8_t9_routing": with_views(
        f"""SELECT message_id, order_id, query,
                  CASE WHEN {_any('folded', ANALYTICS_HINTS)} AND query IS NOT NULL
                       THEN 'analytics' WHEN order_id IS NOT NULL THEN 'order_lookup'
                       ELSE 'knowledge' END AS intent
           FROM (SELECT *, {_MATCH} AS query FROM (
               SELECT message_id, {o.FOLD('text')} AS folded,
                      TRY_CAST(nullif(regexp_extract({o.wrapped('text')}, {o.quoted(ORDER_ID)}, 1),
                               '') AS BIGINT) AS order_id
               FROM messages_v))""", "messages_v"),
    "t11_sql_verdict": with_views(
        f"""SELECT statement_id, reason IS NULL AS ok, reason,
               CASE WHEN reason IS NULL THEN
                   CASE WHEN cap = '' THEN q || ' LIMIT 100'
                        WHEN coalesce(TRY_CAST(cap AS DECIMAL(38, 0)) > 100, true)
                        THEN regexp_replace(q, {_LIMIT_SQL}, 'LIMIT 100') ELSE q END
               END AS safe_sql
           FROM (SELECT *, regexp_extract(q, {_LIMIT_SQL}, 1) AS cap,
               CASE WHEN q = '' THEN 'empty query'
                    WHEN contains(q, ';') THEN 'multiple statements are not allowed'
                    WHEN NOT regexp_matches(q, '^(?i)(select|with)\\b')
                         THEN 'only SELECT queries are allowed'
                    WHEN regexp_extract(q, {_FORBIDDEN_SQL}, 1) <> ''
                         THEN 'forbidden keyword: ' || upper(regexp_extract(q, {_FORBIDDEN_SQL}, 1))
                    WHEN len(bad) > 0 THEN 'relation not allowed: ' || bad[1] END AS reason
           FROM (SELECT *, list_filter(regexp_extract_all(q, {_RELATION_SQL}, 1),
                     lambda r: NOT list_contains({_ALLOWED_SQL}, lower(r))
                          AND NOT list_contains(list_transform(
                              regexp_extract_all(q, {_CTE_SQL}, 1), lambda c: lower(c)), lower(r))) AS bad
           FROM (SELECT statement_id, trim(rtrim(trim({_CLEAN_SQL}, {_SPACE}), ';'), {_SPACE}) AS q
                 FROM statements_v)))""", "statements_v"),
    "t12_sentences": """
        SELECT doc_id, pos - 1 AS pos, sentence FROM (
            SELECT doc_id, unnest(kept) AS sentence, generate_subscripts(kept, 1) AS pos FROM (
                SELECT doc_id, list_filter(list_transform(
                    regexp_split_to_array(
                        regexp_replace(
                            regexp_replace(replace(text, '**', ''), '\\b(art|ex)\\.', '\\1' || chr(1),
                                           'g'),
                            '([.!?])\\s+', '\\1' || chr(2), 'g'),
                        chr(2) || '|\\n+'),
                    lambda p: replace(trim(regexp_replace(p, '^\\s*(\\d+\\.|[-*|#])\\s*', ''),
                              ' ' || chr(9) || chr(10) || chr(13)), chr(1), '.')),
                    lambda p: length(p) > 15 AND NOT ends_with(p, ':')) AS kept
                FROM documents))""",
    "t13_t15_chunk_markdown": with_views(
        """SELECT doc_id, substr(md5(source || ':' || heading || ':0'), 1, 12) AS chunk_id, source,
               title, heading AS section,
               title || ' — ' || heading || chr(10) || body AS embedding_text
           FROM (
               SELECT s.doc_id, s.source, d.source AS title, d.lang AS heading,
                      regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') AS body
               FROM sections_v s JOIN documents d USING (doc_id)
               UNION ALL
               SELECT s.doc_id, s.source, d.source, 'tail', 'n=' || CAST(d.n_chars AS VARCHAR)
               FROM sections_v s JOIN documents d USING (doc_id))""", "sections_v"),
    "t16_embedded_json": """
        SELECT event_id, regexp_extract('{ k:' || event_type || props, '(?s)\\{.*\\}', 0)
               AS from_first_brace, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "t17_pii_prevalence": f"""
        SELECT ROUND(AVG(CASE WHEN {' OR '.join(f"{o.COUNTED('text', l)} > 0" for l in PII_PATTERNS)}
               THEN 100.0::DOUBLE ELSE 0 END), 6) AS pii_pct FROM documents""",
    "s7_audit_digest": with_views(
        f"""SELECT message_id, 'agent_chat' AS event,
               substr(sha256({o.MASK('text')}), 1, 16) AS input_sha256 FROM messages_v""",
        "messages_v"),
    "s11_record_rows": with_views(
        """SELECT '{"day":"' || CAST(CAST(created_at AS DATE) AS VARCHAR) || '","category":"'
               || category || '","n":' || CAST(COUNT(*) AS VARCHAR) || '}' AS record
           FROM tickets_v GROUP BY CAST(created_at AS DATE), category""", "tickets_v"),
}

# The packing one paragraph after the other.
ORACLE["t14_split_long"] = """
    WITH RECURSIVE bodies AS (
        SELECT doc_id, regexp_replace(text, '\\n+', chr(10) || chr(10), 'g') AS body FROM documents),
    pieces AS MATERIALIZED (
        SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
            SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
                SELECT doc_id, regexp_split_to_array(body, '\\n\\s*\\n') AS ps
                FROM bodies WHERE length(body) > 1200))
        WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> ''),
    walk AS (
        SELECT doc_id, r, chr(10) || chr(10) || p AS buf, CAST(NULL AS VARCHAR) AS done
        FROM pieces WHERE r = 1
        UNION ALL
        SELECT p.doc_id, p.r,
               CASE WHEN length(w.buf) + length(p.p) > 1200 THEN right(w.buf, 150) ELSE w.buf END
                   || chr(10) || chr(10) || p.p,
               CASE WHEN length(w.buf) + length(p.p) > 1200 THEN w.buf END
        FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.r = w.r + 1),
    parts AS (
        SELECT doc_id, r, done AS part FROM walk WHERE done IS NOT NULL
        UNION ALL SELECT doc_id, r + 1, buf FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) AS last FROM walk)
        WHERE last = 1)
    SELECT doc_id, 0 AS part, body AS text FROM bodies WHERE length(body) <= 1200
    UNION ALL
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1,
           regexp_replace(part, '^\\s+|\\s+$', '', 'g') FROM parts"""
# The documents hold no compatibility characters, for which the check engine has no function.
ORACLE["t10_fold_typography"] = (
    "SELECT doc_id, translate(nfc_normalize(text), '‑‐【】', '--[]') AS folded FROM documents"
)
