import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers as files
import pytest

from ticketlens.llm import (
    chat,
    exactdup,
    html_text,
    langid,
    licenses,
    neardup,
    url_rules,
)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_windows_are_read_back(spark):
    said = "</s>[INST] ok [/INST] <\\s> <|im_end|> <<SYS>>"
    long = [(7, t, "user" if t % 2 else "assistant", f"turn {t} " * 30) for t in range(1, 40)]
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, None, None, None),
            (None, 1, "a\nb%", "x"), (7, 0, "system", "be kind"), (3, 0, "system", "alone"),
            (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), *long]
    turns = spark.createDataFrame([(*r, "z") for r in rows],
                                  "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_chat(turns, budget=300, history=60)
    got = {r["conv_id"]: r for r in chat.chat_digest(windows).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[key]["n_turns"] == len(own)
        assert got[key]["turns_sha256"] == _sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(loss), _sha(loss))
    assert got[7]["n_windows"] > 5
    for w in windows.collect():
        assert w["n_tokens"] <= 300 and (w["conv_id"] != 7 or "be kind" in w["text"])
        assert w["conv_id"] != 1 or "</s>" not in w["text"]
    assert chat.chat_digest(chat.format_chat(turns.limit(0))).count() == 0


def test_exact_duplicates_with_short_blocks_and_weak_prints(spark):
    texts = ["", None, "a", "ab" * 40, "ab" * 40, "ab" * 40 + "c", "ba" * 40, "é" * 30, "a", "a"]
    rows = [(i if i != 8 else None, t, 0) for i, t in enumerate(texts)] + [(9, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name int")

    def weak(block, seed):  # collides until the third seed
        return exactdup.seeded_prints(block if seed > 1 else block.substr(0, 0), seed)

    groups = {}
    for key, text, _ in rows:
        groups.setdefault(text or "", []).append(key)
    want = sorted((str(k), max(x for x in groups[t or ""] if x is not None), len(groups[t or ""]),
                   _sha(t or "")) for k, t, _ in rows)
    for size, prints in ((4, exactdup.seeded_prints), (16, weak), (4096, exactdup.seeded_prints)):
        got = exactdup.exact_duplicates(docs, block_bytes=size, prints=prints).collect()
        assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"])
                      for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    kept = exactdup.keep_one_per_text(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exactdup.exact_duplicates(docs.limit(0)).count() == 0


def _components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c)) for c in comp}
    return [(rows[i][0], len(sets[i]), least[comp[i]]) for i in range(len(rows))]


@pytest.mark.parametrize("rounds", [0, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rounds):
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    passage = [f"p{i}" for i in range(30)]
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (1004, " \t ")]
    for d in range(60):  # copies with changes that are partly shared
        words = list(base)
        for at in draw.choice(80, int(draw.integers(0, 5)), replace=False):
            words[at] = f"x{draw.integers(0, 3)}"
        rows.append((d, " ".join(words)))
    for d in range(100, 140):  # one passage in unlike documents
        rows.append((d, " ".join([*passage, *(f"u{d}_{i}" for i in range(int(draw.integers(1, 12))))])))
    monkeypatch.setattr(neardup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(neardup, "_open_pairs", lambda named: 10**9)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n int")
    got = neardup.near_duplicates(docs, width=4)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(
        _components(rows, 4, 80))
    if rounds:
        assert neardup.near_duplicates(docs.limit(0)).count() == 0
        kept = neardup.keep_one_per_component(docs)
        assert kept.columns == docs.columns


def test_urls(spark):
    rows = [(1, "https://A.Example.net/en/x?q"), (2, "http://b.net/"), (3, None), (4, "no url"),
            (5, "http://x.org/fr/"), (6, "http://x.org/ads/y"), (7, "http://example.com/de/1"),
            (8, "http://notnet/"), (8, "http://notnet/"), (9, "http://b.net")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    out = url_rules.judge_urls(pages)
    assert out.columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host_"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("b.net", "/", "net/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2:] == (None, "block")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9] == ("b.net", "", None, "allow")
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "Under the MIT License. mit   license; Apache-License v2"), (2, None), (3, "..."),
            (4, "licensed under the Apache License, Version 2.0"), (5, "GNU General Public License"),
            (6, "x " * 30_000 + "mit license " * 3000), (7, "permit license")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")
    scanned = licenses.scan_licenses(docs)
    got = {r["doc_id"]: r for r in licenses.license_summary(scanned, column="license_").collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (9, 3, 2, 6)
    assert got[1]["base_labels"] == "apache,mit"
    assert (got[2]["n_words"], got[2]["labels"], got[2]["score"]) == (0, "", 0.0)
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None
    assert "apache-2.0" in got[4]["labels"].split(",") and got[4]["score"] == 0.9
    assert got[5]["base_labels"] == "gpl" and got[7]["n_base"] == 0
    assert (got[6]["n_base"], got[6]["last_word"]) == (3000, 30_000 + 5998)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_rules_pass_their_gate_and_keyword():
    for rule in licenses.signature_rules():
        words = [("any" if w == "*" else w).split("|") for w in rule.spec.split() if not w.endswith("?")]
        for some in itertools.product(*words):
            text = "".join(f" {w} " for w in some)
            assert any(stem in text for stem in licenses.GATES), rule
            assert f" {rule.keyword} " in text and re.search(licenses.pattern(rule.spec), text), rule


def test_licenses_in_their_own_words(spark):
    texts = {
        "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this '
               'software and associated documentation files (the "Software"), to deal in the Software',
        "cc0": "CC0 1.0 Universal",
        "isc": "Published under the Internet Systems Consortium License",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are "
               "permitted provided that the following conditions are met",
        "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "gpl-2.0+": "the terms of the GNU General Public License as published by the Free Software "
                    "Foundation; either version 2 of the License",
        "cc-by-sa": "Creative Commons Attribution-ShareAlike 4.0 International",
        "cc-by-nc": "Creative Commons Attribution-NonCommercial 4.0 International",
        "cc-by-nd": "Creative Commons Attribution-NoDerivatives 4.0 International",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    found = licenses.license_summary(licenses.scan_licenses(docs)).collect()
    assert [r["doc_id"] for r in found if r["doc_id"] not in r["labels"].split(",")] == []


def _segmentations(run, p, unknown):
    """Sum over all cuts of a run into pieces, by recursion."""
    if not run:
        return 1.0
    total = 0.0
    for n in range(1, len(run) + 1):
        if run[:n] in p:
            total += p[run[:n]] * _segmentations(run[n:], p, unknown)
        elif n == 1:
            total += unknown * _segmentations(run[1:], p, unknown)
    return total


def test_forward_pass_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a"]
    table = np.array([[.1], [.2], [.3], [.05], [.15], [.2], [langid.UNKNOWN]])
    p = {piece: table[i, 0] for i, piece in enumerate(pieces)}
    runs = ["▁ab", "▁abba", "▁c", "▁acab", "▁b"]
    got = langid.run_scores(runs, langid.PieceTable(pieces), table)[:, 0]
    assert np.allclose(np.exp(got), [_segmentations(r, p, langid.UNKNOWN) for r in runs])
    assert sum(len(r) for r in langid.runs_of(("x" * 100).encode())) == 100 + 3
    model = langid.fit_probabilities({"l": Counter({"▁ab": 5, "▁ba": 1})}, pieces)
    assert np.isclose(model.probability[:-1].sum(), 1.0)


def test_language_rows(spark):
    en, de = "the cat and the dog with this that", "der hund und die katze nicht ist ein"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", 0) for i in range(40)]
    rows += [(50, None, None, 0), (51, "123 !", "en", 0), (None, en, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    model = langid.fit_language_model(docs, files.path("piece_bpe_32k.model"))
    named = langid.identify(docs, model)
    got = {r["doc_id"]: r["language_"] for r in named.collect()}
    assert got[1]["lang_pred"] == got[None]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    assert got[50]["lang_pred"] == got[51]["lang_pred"] == "und" and got[51]["score"] == 0.0
    assert langid.keep_identified(docs, model).count() == 41
    none = langid.fit_language_model(docs.limit(0), files.path("piece_bpe_32k.model"))
    assert langid.identify(docs, none).filter("language_.lang_pred = 'und'").count() == 43


@pytest.mark.parametrize("end", ["</head>", "</HEAD >", "", "<!-- no end -->"])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_a_head_ends_with_or_without_its_tag(end, body):
    page = (f"<html><head><meta charset=x><title>T</title><style>p{{}}</style><noframes>f</noframes>"
            f"{end}{body}<header>top</header><article><h1>a</h1><p>one <b>two</b></p></article>")
    assert [t for _, t, _ in html_text.leaf_blocks(page)] == ["top", "a", "one two"]
    assert {e[0] for path, _, _ in html_text.leaf_blocks(page) for e in path} == {
        "html", "header", "article", "h1", "p"} | ({"body"} if body else set())


def test_an_end_tag_has_the_whole_name():
    assert [t for _, t, _ in html_text.leaf_blocks(
        "<script>a </scripts> b</script x>c<title>t</titles>u</title\n>d")] == ["cd"]


def test_pages(spark):
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>menu</a>"
            "</ul></nav><div class='ad'>buy</div><article><h1>Head</h1><p><b>One &amp; two<br>three"
            "<p>Four <script>var a='</p>';</script>five</article><footer>foot</footer>")
    pages = spark.createDataFrame([(i, page, "x") for i in range(30)] + [(90, None, ""), (91, "", "")],
                                  "page_id long, html string, main_text string")
    assert [t for _, t, _ in html_text.leaf_blocks(page)] == [
        "menu", "buy", "Head", "One & two three", "Four five", "foot"]
    model = html_text.fit_labeller(pages)
    got = {r["page_id"]: r["main_text_"] for r in html_text.extract_text(pages, model).collect()}
    assert got[3] == "Head\nOne & two three\nFour five" and got[90] == got[91] == ""
    empty = html_text.fit_labeller(pages.limit(0))
    assert html_text.extract_text(pages.limit(0), empty).count() == 0


def test_components_end_with_the_step_that_makes_stars(spark, monkeypatch):
    """Closing links writes two tables per step, and no step follows only to see that nothing changes."""
    written, write = [], neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, label: written.append(label) or write(df, label))
    star = write(spark.createDataFrame([(1, b) for b in range(2, 9)] + [(3, 9), (3, 9)], "a long, b long"), "star")
    found = {r["cid"]: r["comp"] for r in neardup.connected(star).collect()}
    assert found == {n: 1 for n in range(2, 10)}
    assert len(written) <= 4
    del written[:]
    plain = write(spark.createDataFrame([(1, b) for b in range(2, 9)], "a long, b long"), "star")
    components = neardup.connected(plain)
    assert written == ["large", "small"]
    more = write(spark.createDataFrame([(8, 20), (30, 31)], "a long, b long"), "links")
    joined = {r["cid"]: r["comp"] for r in neardup._joined(components, more).collect()}
    assert joined == {**{n: 1 for n in range(2, 9)}, 20: 1, 31: 30}
