"""Text operators as native column expressions.

Patterns are stated in ``fixed_values`` in the common regex notation. Java differs in what counts
as a word character, so ``java_regex`` spells that class out and switches on Unicode rules."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.fixed_values import (
    ANALYTICS_HINTS,
    ANALYTICS_KEYWORDS,
    CHUNK_CHARS,
    CHUNK_OVERLAP,
    INJECTION_PATTERNS,
    MAX_INPUT_CHARS,
    ORDER_ID,
    ORDER_NUMBER,
    ORDER_NUMBER_TOKEN,
    PII_PATTERNS,
    STOPWORDS,
    TYPOGRAPHY,
)

WORD = r"\p{L}\p{N}_"


#: a word bound; Java's own takes a combining mark for a part of the word
BOUND = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
#: a bound right after a digit or letter needs only look ahead
AFTER_WORD = re.compile(r"(\\d(?:\{\d+\})?\)?|[a-z])\\b")


def java_regex(pattern: str, flags: str = "U") -> str:
    if pattern.startswith(r"\b"):  # all such patterns go on with a digit
        pattern = f"(?<![{WORD}])" + pattern[2:]
    pattern = AFTER_WORD.sub(lambda m: f"{m[1]}(?![{WORD}])", pattern).replace(r"\b", BOUND)
    inside_class = pattern.replace(r"[\w", f"[{WORD}")
    return f"(?{flags})" + inside_class.replace(r"\w", f"[{WORD}]")


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` only removes blanks)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def like_any(text: Column, words: list[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


# --- personal data ------------------------------------------------------------------------


def _mask(text: Column, label: str) -> Column:
    masked = F.regexp_replace(text, java_regex(PII_PATTERNS[label]), f"[{label}]")
    if label == "EMAIL":  # most texts hold no address; skip the scan of every word in them
        return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)
    return masked


def mask_pii(text: Column) -> Column:
    for label in PII_PATTERNS:
        text = _mask(text, label)
    return text


def pii_counts(text: Column) -> dict[str, Column]:
    """Replacements per label; each label is counted on the text the earlier ones left."""
    counts = {}
    for label, pattern in PII_PATTERNS.items():
        n = F.regexp_count(text, F.lit(java_regex(pattern)))
        if label == "EMAIL":
            n = F.when(F.contains(text, F.lit("@")), n).otherwise(0)
        counts[label] = n.cast("long")
        text = _mask(text, label)
    return counts


def pii_map(text: Column) -> Column:
    """label -> count, without the labels that do not occur."""
    pairs = [c for label, n in pii_counts(text).items() for c in (F.lit(label), n)]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def has_pii(text: Column) -> Column:
    """Masking changes a text exactly when it holds some personal data."""
    found = F.rlike(text, F.lit(java_regex(PII_PATTERNS["EMAIL"])))
    found = F.contains(text, F.lit("@")) & found
    for label in list(PII_PATTERNS)[1:]:
        found = found | F.rlike(text, F.lit(java_regex(PII_PATTERNS[label])))
    return found


def clean_text(text: Column) -> Column:
    """Mask, lower-case, then hide stand-alone five-digit order numbers."""
    return F.regexp_replace(F.lower(mask_pii(text)), java_regex(ORDER_NUMBER), ORDER_NUMBER_TOKEN)


# --- input guard ----------------------------------------------------------------------------


def guard_reason(text: Column) -> Column:
    """Why a text is refused; NULL when it is allowed."""
    injection = java_regex("(" + "|".join(INJECTION_PATTERNS) + ")", "iuU")
    match = F.regexp_extract(text, injection, 0)
    return (
        F.when(text.isNull() | (strip_space(text) == ""), "empty input")
        .when(F.length(text) > MAX_INPUT_CHARS, f"input exceeds {MAX_INPUT_CHARS} characters")
        .when(match != "", F.concat(F.lit("possible prompt injection: '"), match, F.lit("'")))
    )


# --- folding and tokens -------------------------------------------------------------------------


def _fold(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def _single_character_folds() -> tuple[str, str, str]:
    """For the Latin blocks: characters that fold to another one, what they fold to, and the
    regex class of every character for which this table and lower-casing is the whole rule."""
    blocks = [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028)]
    single = [code for code in blocks if len(_fold(chr(code))) == 1]
    moved = [code for code in single if _fold(chr(code)) != chr(code)]
    ranges = [[0, 0x7F]]
    for code in single:
        if code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    plain = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)
    return "".join(map(chr, moved)), "".join(_fold(chr(code)) for code in moved), plain


FOLD_FROM, FOLD_TO, FOLD_CLASS = _single_character_folds()


@F.pandas_udf(T.StringType())
def _fold_any(texts: pd.Series) -> pd.Series:
    return texts.map(_fold, na_action="ignore")


def normalize_accents(text: Column) -> Column:
    """Lower-case, compatibility-decompose, drop combining marks. Latin text is folded by a
    character table inside the JVM; only texts with other characters are sent to Python."""
    other = F.rlike(text, F.lit(rf"[[^\x00-\x7f]&&[^{FOLD_CLASS}]]"))
    in_jvm = F.lower(F.translate(text, FOLD_FROM, FOLD_TO))
    return F.coalesce(_fold_any(F.when(other, text)), in_jvm)


def latin_fold(text: Column) -> Column:
    """The table part alone, for texts known to be Latin."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


@F.pandas_udf(T.StringType())
def _compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold_typography(text: Column) -> Column:
    other = F.rlike(text, F.lit(r"[^\x00-\x7f]"))
    folded = F.coalesce(_compatibility_form(F.when(other, text)), text)
    return F.translate(folded, "".join(TYPOGRAPHY), "".join(TYPOGRAPHY.values()))


def words_of(folded: Column) -> Column:
    """Distinct words of an already folded text, longer than one character, no stop words."""
    found = F.regexp_extract_all(folded, F.lit(f"[{WORD}]{{2,}}"), 0)
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def tokens(text: Column) -> Column:
    return words_of(normalize_accents(text))


# --- routing ------------------------------------------------------------------------------------


#: decimal digits of other scripts, and what they stand for
_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def extract_order_id(text: Column) -> Column:
    digits = F.regexp_extract(text, java_regex(ORDER_ID), 1)
    return F.nullif(F.translate(digits, "".join(_DIGITS), _VALUES), F.lit("")).try_cast("long")


def analytics_match(folded: Column) -> Column:
    """Name of the first keyword group with a keyword inside the folded text, else NULL."""
    name = F.when(F.lit(False), F.lit(""))
    for words, query in ANALYTICS_KEYWORDS:
        name = name.when(like_any(folded, words), query)
    return name


def route_intent(folded: Column, order_id: Column) -> Column:
    analytic = like_any(folded, ANALYTICS_HINTS) & analytics_match(folded).isNotNull()
    return (
        F.when(analytic, "analytics")
        .when(order_id.isNotNull(), "order_lookup")
        .otherwise("knowledge")
    )


# --- documents ------------------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Sentences of a passage without list markers, headings and fragments."""
    ends = r"(?U)(?<!\bart\.)(?<!\bex\.)(?<=[.!?])\s+|\n+"
    parts = F.split(F.replace(text, F.lit("**"), F.lit("")), ends)
    marker = r"(?U)^\s*(\d+\.|[-*|#])\s*"
    cleaned = F.transform(parts, lambda p: strip_space(F.regexp_replace(p, marker, "")))
    return F.filter(cleaned, lambda p: (F.length(p) > 15) & ~F.endswith(p, F.lit(":")))


def split_long(body: Column, limit: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pack paragraphs into parts of at most ``limit`` characters where possible. A new part opens
    with the tail of the part before it; a single paragraph is never cut."""
    paragraphs = F.filter(F.split(body, r"(?U)\n\s*\n"), lambda p: strip_space(p) != "")
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"))

    def add(state: Column, paragraph: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(paragraph) > limit)
        tail = F.substring(state["open"], -overlap, overlap)
        kept = F.when(F.length(state["open"]) <= overlap, state["open"]).otherwise(tail)
        return F.struct(
            F.when(full, F.array_append(state["parts"], strip_space(state["open"])))
            .otherwise(state["parts"]).alias("parts"),
            F.concat(F.when(full, kept).otherwise(state["open"]), F.lit("\n\n"), paragraph)
            .alias("open"),
        )

    def close(state: Column) -> Column:
        last = strip_space(state["open"])
        return F.when(last != "", F.array_append(state["parts"], last)).otherwise(state["parts"])

    packed = F.aggregate(paragraphs, empty, add, close)
    return F.when(F.length(body) <= limit, F.array(body)).otherwise(packed)


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat(title, F.lit(" — "), section, F.lit("\n"), text)


def embedded_json(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, or an empty object."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found == "", "{}").otherwise(found)
