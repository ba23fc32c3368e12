"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is kept under one of its literal tokens, the one that the fewest URLs contain (counted
over all URLs, for the rules' tokens only). The tokens of a URL fetch the candidate rules; only those
run their regular expression. Rules are a parameter and are sent to every task, so their number is
bounded by ``MAX_RULES``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import free_name

MAX_RULES = 1_000_000
TOKEN = re.compile("[a-z0-9]+")
VERDICT = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for URLs that fit ``spec``. ``site``: ``host/path``, fits the host, its
    subdomains and all paths that begin so. Otherwise a piece of a URL in lower case, where ``*``
    stands for anything and ``^`` for one sign that is no letter or digit, or for the end."""

    verdict: str
    spec: str
    site: bool = False

    def regex(self) -> str:
        if self.site:
            return r"^(?:[^/]*\.)?" + re.escape(self.spec)
        signs = {"*": ".*", "^": "(?:[^a-z0-9]|$)"}
        return "".join(signs.get(c, re.escape(c)) for c in self.spec)

    def tokens(self) -> list[str]:
        """Words that stand whole in every URL that the rule fits. A word at an open end of the
        pattern, or beside ``*``, may be part of a longer one and does not count."""
        spec = self.spec.lower()
        whole = []
        for m in TOKEN.finditer(spec):
            before = spec[m.start() - 1] if m.start() else ("." if self.site else "*")
            after = spec[m.end()] if m.end() < len(spec) else "*"
            if before != "*" and after != "*":
                whole.append(m.group())
        return whole


#: the site rules are fixed values
SITE_RULES = [
    UrlRule("block", "net/", True),
    UrlRule("allow", "example.net/en/", True),
    UrlRule("block", "example.com/de/", True),
    UrlRule("allow", "org/fr/", True),
]
METHOD_RULES = [
    UrlRule("block", spec)
    for spec in (
        "/ads/", "/ad/", "/adserver/", "/banner/", "/banners/", "/popup/", "/track/", "/tracker/",
        "/pixel.gif^", "/beacon/", "/click?", "/redirect?", "/sponsored/", "/affiliate/",
        "^doubleclick^", "^adservice^", "^utm_source=ad^", "^casino^", "^poker^", "^betting^",
        "^porn^", "^xxx^", "^adult^", "^escort^", "^torrent^", "^warez^", "^keygen^", "^crack^",
        "/login^", "/signin^", "/signup^", "/cart^", "/checkout^", "/wp-admin/", "/wp-login.php^",
        "/cgi-bin/", "/search?", "/tag/*/page/", "^sessionid=", "^phpsessid=", "/print/",
        ".exe^", ".zip^", ".jpg^", ".png^", ".gif^", ".css^", ".js^", ".mp4^",
    )
] + [UrlRule("allow", "/robots.txt^"), UrlRule("allow", "/ads/policy^")]


def rarest_tokens(urls: DataFrame, url: str, rules: Sequence[UrlRule]) -> dict[str, int]:
    """How many URLs contain each token of the rules: at most one row per rule token."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    tokens = F.split(F.lower(F.col(url)), "[^a-z0-9]+")
    known = F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]))
    counted = urls.select(F.explode(known).alias("token")).groupBy("token").count()
    return {**dict.fromkeys(wanted, 0), **{r["token"]: r["count"] for r in counted.collect()}}


def judge_urls(pages: DataFrame, url: str = "url",
               sites: Sequence[UrlRule] = tuple(SITE_RULES),
               patterns: Sequence[UrlRule] = tuple(METHOD_RULES),
               default: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule, verdict (or the name with ``_`` behind, where
    ``pages`` has it).

    The longest fitting site rule decides and is named in ``rule``; else ``rule`` is null and the
    longest fitting pattern decides (equal length: the first in the list); else ``default``. A null
    URL, or one without ``://``, has an empty host and path and is matched by patterns alone. Rows
    are independent, so ties, repeated rows and an empty table need no rule.
    """
    rules = [*sites, *patterns]
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rarity = rarest_tokens(pages, url, rules)
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        tokens = rule.tokens()
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (rarity[t], t)), []).append(i)
        else:
            always.append(i)
    sent = pages.sparkSession.sparkContext.broadcast((rules, index, always))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules, index, always = sent.value
        compiled: dict[int, re.Pattern] = {}

        def decide(raw: str | None) -> tuple[str, str, str | None, str]:
            raw = raw or ""
            _, mark, rest = raw.partition("://")
            place = re.match(r"([^/?#]*)([^?#]*)", rest, re.S) if mark else None
            host, path = place.groups() if place else ("", "")
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            low = raw.lower()
            fetched = {i for t in set(TOKEN.findall(low)) for i in index.get(t, ())}
            best: dict[bool, int] = {}
            for i in sorted(fetched.union(always)):
                rule = rules[i]
                found = compiled.get(i) or compiled.setdefault(i, re.compile(rule.regex(), re.S))
                if found.search(host + path if rule.site else low):
                    held = best.get(rule.site)
                    if held is None or len(rule.spec) > len(rules[held].spec):
                        best[rule.site] = i
            if True in best:
                return host, path, rules[best[True]].spec, rules[best[True]].verdict
            if False in best:
                return host, path, None, rules[best[False]].verdict
            return host, path, None, default

        for urls in batches:
            yield pd.DataFrame([decide(None if u is None else u) for u in urls],
                               columns=["host", "path", "rule", "verdict"])

    judged = F.pandas_udf(judge, VERDICT)
    struct = free_name(pages, "_url_verdict")
    out = pages.withColumn(struct, judged(F.col(url)))
    names = ["host", "path", "rule", "verdict"]
    return out.select(*pages.columns, *[
        F.col(f"{struct}.{n}").alias(free_name(pages, n)) for n in names])
