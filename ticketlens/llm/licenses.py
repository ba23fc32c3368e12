"""Licence scan with ordered signature rules, in built-in expressions only.

A text becomes words; every word stands between two spaces of its own, so a rule is a plain regular
expression over whole words and two matches never share a character. A rule is tried only if the
text contains the rule's keyword, and keywords are looked up only if a gate stem occurs at all. Hits
are intervals of words. An interval inside another one of higher priority, or inside a longer one
of equal priority, is suppressed. The state of that sweep is one number per priority, so it is
linear in the number of hits; nothing is shuffled.

Rule syntax: words; ``x?`` is an optional word, ``x|y`` a choice of words, ``*`` any one word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import free_name, lower_ascii

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: every rule contains one of these stems
GATES = ("licen", "commons", "cc0", "domain", "rights", "copyleft", "redistribution", "obtaining")
PRIORITIES = (1, 2, 3)

#: label: keyword, name specs
NAMES = {
    "mit": ("mit", ["mit"]),
    "mit-0": ("attribution", ["mit no attribution"]),
    "apache": ("apache", ["apache software?"]),
    "apache-1.1": ("apache", ["apache software? version? 1 1"]),
    "apache-2.0": ("apache", ["apache software? version? 2 0", "apache software? v2 0?"]),
    "bsd": ("bsd", ["bsd", "bsd style"]),
    "bsd-2-clause": ("bsd", ["bsd 2 clause", "simplified bsd"]),
    "freebsd": ("freebsd", ["freebsd"]),
    "bsd-3-clause": ("bsd", ["bsd 3 clause", "new bsd", "modified bsd"]),
    "bsd-4-clause": ("bsd", ["bsd 4 clause", "original bsd"]),
    "isc": ("isc", ["isc"]),
    "gpl": ("general", ["gnu? general public"]),
    "gpl-2.0": ("general", ["gnu? general public license|licence version? 2"]),
    "gpl-3.0": ("general", ["gnu? general public license|licence version? 3"]),
    "lgpl": ("lesser", ["gnu? lesser general public", "gnu? library lesser general public"]),
    "lgpl-2.1": ("lesser", ["gnu? lesser general public license|licence version? 2 1"]),
    "agpl": ("affero", ["gnu? affero general public"]),
    "agpl-3.0": ("affero", ["gnu? affero general public license|licence version? 3"]),
    "mpl": ("mozilla", ["mozilla public"]),
    "mpl-1.1": ("mozilla", ["mozilla public license|licence version? 1 1"]),
    "mpl-2.0": ("mozilla", ["mozilla public license|licence version? 2 0"]),
    "epl": ("eclipse", ["eclipse public"]),
    "epl-2.0": ("eclipse", ["eclipse public license|licence version? 2 0"]),
    "cddl": ("distribution", ["common development and distribution"]),
    "cpl": ("common", ["common public"]),
    "cpal": ("attribution", ["common public attribution"]),
    "eupl": ("european", ["european union public"]),
    "osl": ("open", ["open software"]),
    "afl": ("academic", ["academic free"]),
    "artistic": ("artistic", ["artistic", "perl artistic", "clarified artistic"]),
    "artistic-2.0": ("artistic", ["artistic license|licence version? 2 0"]),
    "zlib": ("zlib", ["zlib", "zlib libpng"]),
    "libpng": ("libpng", ["libpng"]),
    "bsl-1.0": ("boost", ["boost software"]),
    "unlicense": ("unlicense", ["unlicense"]),
    "wtfpl": ("wtfpl", ["wtfpl"]),
    "ms-pl": ("microsoft", ["microsoft public", "ms pl microsoft public"]),
    "ms-rl": ("microsoft", ["microsoft reciprocal"]),
    "python": ("python", ["python software foundation", "python"]),
    "php": ("php", ["php"]),
    "ruby": ("ruby", ["ruby"]),
    "openssl": ("openssl", ["openssl"]),
    "ofl": ("font", ["sil? open font"]),
    "odbl": ("database", ["open database", "open data commons open database"]),
    "pddl": ("dedication", ["public domain dedication and"]),
    "gfdl": ("documentation", ["gnu? free documentation"]),
    "lppl": ("latex", ["latex project public"]),
    "ncsa": ("ncsa", ["ncsa open? source?", "university of illinois ncsa open source"]),
    "postgresql": ("postgresql", ["postgresql"]),
    "sleepycat": ("sleepycat", ["sleepycat"]),
    "vim": ("vim", ["vim"]),
    "w3c": ("w3c", ["w3c software? notice? and?", "w3c"]),
    "x11": ("x11", ["x11"]),
    "busl": ("business", ["business source"]),
    "sspl": ("server", ["server side public"]),
    "elastic": ("elastic", ["elastic"]),
    "cecill": ("cecill", ["cecill", "cecill b|c"]),
    "mulan": ("mulan", ["mulan permissive software"]),
    "hpnd": ("historical", ["historical permission notice and disclaimer"]),
    "upl": ("universal", ["universal permissive"]),
    "blueoak": ("oak", ["blue oak model"]),
    "ecl": ("educational", ["educational community"]),
}
#: label, keyword, name spec: names without the keyword of their label
MORE_NAMES = [("isc", "consortium", "internet systems consortium isc?")]
#: spec with the name in it, priority, confidence
FORMS = [
    ("{name} license|licence", 1, 0.6),
    ("licensed|licenced|released|distributed|available under the? terms? of? the? {name} license|licence", 2, 0.9),
    ("subject to the terms of the? {name} license|licence", 2, 0.9),
    ("spdx license identifier {name}", 3, 1.0),
]
#: label, keyword, spec, priority, confidence
SINGLE = [
    ("apache-2.0", "apache", "apache license|licence version? 2 0", 2, 0.9),
    ("apache-2.0", "apache", "apache org licenses license 2 0", 3, 1.0),
    ("gpl-2.0+", "published", "general public license|licence as published by the free software foundation either version 2", 3, 1.0),
    ("gpl-3.0+", "published", "general public license|licence as published by the free software foundation either version 3", 3, 1.0),
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files?", 3, 1.0),
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy of this software * * * licens|license|licence|deal|documentation", 3, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.8),
    ("cc", "creative", "creative commons", 1, 0.5),
    ("cc-by", "creative", "creative commons attribution", 2, 0.8),
    ("cc-by-sa", "creative", "creative commons attribution share alike", 3, 0.9),
    ("cc-by-sa", "creative", "creative commons attribution sharealike", 3, 0.9),
    ("cc-by-nc", "creative", "creative commons attribution non commercial", 3, 0.9),
    ("cc-by-nc", "creative", "creative commons attribution noncommercial", 3, 0.9),
    ("cc-by-nd", "creative", "creative commons attribution no derivatives|derivs", 3, 0.9),
    ("cc-by-nd", "creative", "creative commons attribution noderivatives|noderivs", 3, 0.9),
    ("cc0", "cc0", "creative? commons? cc0", 3, 0.9),
    ("cc0", "creative", "creative commons zero", 3, 0.9),
    ("public-domain", "domain", "public domain", 1, 0.4),
    ("public-domain", "domain", "released|dedicated|placed to|into|in the public domain", 2, 0.8),
    ("proprietary", "rights", "all rights reserved", 1, 0.3),
    ("proprietary", "proprietary", "proprietary and confidential license|licence", 2, 0.6),
    ("copyleft", "copyleft", "copyleft", 1, 0.3),
]
#: phrases that always count (fixed values)
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    spec: str
    priority: int
    confidence: float


def signature_rules() -> list[Rule]:
    """All names in all forms, then the single rules."""
    names = [(label, keyword, name) for label, (keyword, some) in NAMES.items() for name in some]
    rules = [
        Rule(label, keyword, form.format(name=name), priority, confidence)
        for label, keyword, name in names + MORE_NAMES
        for form, priority, confidence in FORMS
    ]
    return rules + [Rule(*row) for row in SINGLE]


def pattern(spec: str) -> str:
    """The regular expression of a rule over spaced words."""
    out = []
    for word in spec.split():
        if word == "*":
            out.append(" [^ ]+ ")
        elif word.endswith("?"):
            out.append(f"(?: {word[:-1]} )?")
        elif "|" in word:
            out.append(f" (?:{word}) ")
        else:
            out.append(f" {word} ")
    return "".join(out)


def spaced_words(text: Column) -> Column:
    """`` w1  w2  w3 ``: A-Z lower-cased words, each with a space on either side; else empty."""
    gaps = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP, "  ")
    return F.regexp_replace(F.trim(gaps), "^(.+)$", " $1 ")


def _hits(norm: Column, rule_pattern: Column) -> Column:
    """Intervals of words [start, end) of all matches: the matches are marked, and a marker's place
    among the words, less the markers before it, is a word position."""
    marked = F.regexp_replace(norm, rule_pattern, F.lit(" \x01 $0 \x02 "))
    words = F.split(F.trim(marked), " +")

    def places(sign: str) -> Column:
        at = F.transform(words, lambda w, i: F.when(w == sign, i))
        return F.filter(at, lambda i: i.isNotNull())

    starts = F.transform(places("\x01"), lambda p, k: p - 2 * k)
    ends = F.transform(places("\x02"), lambda p, k: p - 2 * k - 1)
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def _all_hits(norm: Column, rules: list[Rule]) -> Column:
    by_keyword: dict[str, list[Rule]] = {}
    for rule in rules:
        by_keyword.setdefault(rule.keyword, []).append(rule)
    table = F.array(*[
        F.struct(
            F.lit(f" {keyword} ").alias("keyword"),
            F.array(*[F.struct(
                F.lit(r.label).alias("label"), F.lit(pattern(r.spec)).alias("pattern"),
                F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"),
            ) for r in some]).alias("rules"),
        ) for keyword, some in by_keyword.items()
    ])
    gated = F.flatten(F.transform(
        F.filter(table, lambda k: F.contains(norm, k["keyword"])), lambda k: k["rules"]))
    found = F.filter(gated, lambda r: F.regexp_like(norm, r["pattern"]))
    return F.flatten(F.transform(found, lambda r: F.transform(
        _hits(norm, r["pattern"]), lambda h: F.struct(
            h["start"].alias("start"), (-h["end"]).alias("back"), (-r["priority"]).alias("rank"),
            r["label"].alias("label"), r["confidence"].alias("confidence")))))


def _survivors(hits: Column) -> Column:
    """Labels and confidence of the hits that no other hit suppresses. In the order (start, longest,
    highest priority), whatever contains a hit comes before it; per priority the furthest end so far
    tells whether there is one. Equal intervals: the higher priority, then the smaller label."""
    ordered = F.sort_array(hits)
    start = F.struct(
        *[F.lit(-1).alias(f"p{p}") for p in PRIORITIES],
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(state: Column, hit: Column) -> Column:
        end, priority = -hit["back"], -hit["rank"]
        covered = F.lit(False)
        for p in PRIORITIES:
            covered = covered | ((priority <= p) & (state[f"p{p}"] >= end))
        return F.struct(
            *[F.when(priority == p, F.greatest(state[f"p{p}"], end))
               .otherwise(state[f"p{p}"]).alias(f"p{p}") for p in PRIORITIES],
            F.when(covered, state["labels"]).otherwise(
                F.array_union(state["labels"], F.array(hit["label"]))).alias("labels"),
            F.when(covered, state["score"]).otherwise(
                F.greatest(state["score"], hit["confidence"])).alias("score"),
        )

    return F.aggregate(ordered, start, step)


def scan_licenses(docs: DataFrame, text: str = "text",
                  rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with a column ``license`` (struct): n_words, base (array of label, start, end),
    hits (array of start, back = -end, rank = -priority, label, confidence), found (labels of the
    hits that are not suppressed, score).

    A null or empty text, or one without words, has no words and no hits. Rows are independent:
    repeated rows, other columns and an empty table need no rule. If ``docs`` already has a column
    ``license``, the new one is called ``license_``.
    """
    rules = signature_rules() if rules is None else rules
    norm, gate = F.col("_norm"), F.col("_gate")
    stems = F.regexp_like(text, F.lit("(?i)" + "|".join(GATES)))
    none = F.array().cast("array<struct<start:int,back:int,rank:int,label:string,confidence:double>>")
    no_base = F.array().cast("array<struct<label:string,start:int,end:int>>")

    def base_hits(label: str, spec: str) -> Column:
        found = F.transform(_hits(norm, F.lit(pattern(spec))), lambda h: F.struct(
            F.lit(label).alias("label"), h["start"].alias("start"), h["end"].alias("end")))
        return F.when(F.contains(norm, F.lit(pattern(spec))), found).otherwise(no_base)

    base = F.concat(*[base_hits(label, spec) for label, spec in BASE])
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ANY_CASE_GAP, " "))
    spaces = F.octet_length("_words") - F.octet_length(F.replace("_words", F.lit(" "), F.lit("")))
    count = (F.col("_words") != "").cast("long") + spaces
    out = free_name(docs, "license")
    rest = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    read = docs.select(
        F.struct(*docs.columns).alias("_row"), words.alias("_words"),
        F.coalesce(stems, F.lit(False)).alias("_gate"), F.col(text).alias("_text"))
    read = read.select("_row", count.alias("_n"), "_gate", F.when(gate, F.col("_text")).alias("_text"))
    read = read.select("_row", "_n", "_gate", spaced_words(F.col("_text")).alias("_norm"))
    scanned = read.select(
        "_row",
        F.col("_n").alias("n_words"),
        F.when(gate, base).otherwise(no_base).alias("base"),
        F.when(gate, _all_hits(norm, rules)).otherwise(none).alias("hits"),
    )
    return scanned.select(*rest, F.struct(
        "n_words", "base", "hits", _survivors(F.col("hits")).alias("found")).alias(out))


def license_summary(scanned: DataFrame, key: str = "doc_id", column: str = "license") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    base, found = F.col(f"{column}.base"), F.col(f"{column}.found")
    return scanned.select(
        F.col(key),
        F.col(f"{column}.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).cast("long").alias("first_word"),
        F.array_max(base["start"]).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base["label"], found["labels"])), ",").alias(
            "labels"),
        found["score"].alias("score"),
    )
