import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlens.llm import pii

ALPHABET = st.text(alphabet="ab1294.@_%+- ()\n[]é＠４", max_size=60)


def _luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        s += v
    return s % 10 == 0


def plain(text):
    """The contract, read literally."""
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in pii.PATTERNS[kind].finditer(text):
            g = m.group()
            d = re.sub(r"[^0-9]", "", g)
            good = (kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in g.split(".")))
                    or (kind == "card" and 12 <= len(d) <= 19 and _luhn(d))
                    or (kind == "phone" and 9 <= len(d) <= 15))
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_base_findings_equal_the_literal_patterns(text):
    assert pii.find_plain(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.lists(st.tuples(st.integers(0, 50), st.integers(0, 4), st.text("xy", max_size=3))))
def test_rewritten_spans_map_back(text, raw):
    edits, at = [], 0
    for start, width, new in sorted(raw):
        start = max(start, at)
        if start + width <= len(text) and width:
            edits.append((start, start + width, new))
            at = start + width
    r = pii.Rewritten(text, edits)
    want = text
    for s, e, new in reversed(edits):
        want = want[:s] + new + want[e:]
    assert r.text == want
    inside = {p for s, e, _ in edits for p in range(s, e)}
    for i in range(len(r.text)):
        s, e = r.source(i, i + 1)
        assert 0 <= s < e <= len(text)
        if s not in inside:
            assert text[s:e] == r.text[i]


def test_disguises_are_found_and_plain_words_are_not():
    cases = {
        "mail john.doe [at] example [dot] com now": ["john.doe [at] example [dot] com"],
        "to bob at corp dot example dot org, please": ["bob at corp dot example dot org"],
        "ｊohn＠exаmple.com x": ["ｊohn＠exаmple.com"],
        "+one two three four five six seven eight nine zero": [
            "+one two three four five six seven eight nine zero"],
        "card four one one one 1 1 1 1 1 1 1 1 1 1 1 one": [
            "four one one one 1 1 1 1 1 1 1 1 1 1 1 one"],
        "meet at noon, dot the i, one two three": [],
        "": [],
    }
    for text, want in cases.items():
        found = pii.find_disguised(text, pii.find_plain(text))
        assert [text[s:e] for _, s, e in found] == want, text


def test_disguises_around_plain_signs_are_found_whole():
    whole = ["jоhn@example.com", "user@example.cоm", "user@exаmple.com", "аnna@example.org",
             "+1 five five five 867 5309", "+1 (five five five) 867-5309", "+1 555 867-five,three 0 nine",
             "4111 1111 1111 one one one one", "four 111 1111 1111 1111",
             "192.168.one.one", "+FIVE\tsix 7 eight 9 one two three four"]
    for span in whole:
        text = f"at noon, {span}; two more"
        found = pii.find_disguised(text, pii.find_plain(text))
        assert [text[s:e] for _, s, e in found] == [span], text


def test_a_part_or_a_repeat_of_a_base_finding_is_not_added():
    for text in ("at one 10.0.0.1, user@one.com or a.two@example.org (at) 5",
                 "４ times user@example.com and [at] home", "five: 4111 1111 1111 1111, one of many",
                 "ｘ +1 555 867 5309 [dot]", "six, seven; ſix fiᴠe 1 2 3"):
        assert pii.find_disguised(text, pii.find_plain(text)) == [], text
    text = "two ４111 1111 1111 1111"  # seventeen digits in a row are no card
    assert [text[s:e] for _, s, e in pii.find_disguised(text, [])] == ["４111 1111 1111 1111"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["one", "Five", "12", "3", " ", "-", ", ", ".", "+", "@", "at", "dot",
                                 "[at]", "(", "а", "４", "x"]), max_size=16).map("".join))
def test_every_edit_has_its_trigger(text):
    for trigger, edits_of in pii.TRANSDUCERS:
        assert trigger(text) or not edits_of(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000 + ".", " " * 300_000 + "[at]", "a.b " * 50_000 +
                 " at dot ", "+1" + " " * 300_000):
        assert pii.find_plain(text) == [] and pii.find_disguised(text, []) == []


def test_rows_nulls_and_clashing_names(spark):
    rows = [(1, None, "p"), (1, None, "p"), (None, "a@b.co 10.0.0.1", "q"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    found = pii.find_pii(docs)
    assert found.columns == ["doc_id", "text", "pii", "pii_"]
    got = {r["doc_id"]: r for r in pii.pii_summary(found, column="pii_").collect()}
    assert got[None]["n_email"] == got[None]["n_ip"] == 1
    assert got[None]["spans"] == "email:0:6,ip:7:15"
    assert got[None]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs.limit(0)).count() == 0
