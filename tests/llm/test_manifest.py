import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import manifest
from ticketlens.llm.oracles import ORACLE
from ticketlens.llm.queries import QUERIES


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([_sha("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def _siblings(levels, at):
    for level in levels[:-1]:
        other = at ^ 1
        yield (level[other] if other < len(level) else "", other < at)
        at //= 2


def _expected(rows):
    """rows of doc_id, source, lang, n_chars, text."""
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, _leaf(row), row))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {lang: _tree([x[2] for x in sorted(by_lang[lang])]) for lang in langs}
    top = _tree([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, (_, _, leaf, row) in enumerate(sorted(by_lang[lang])):
            way = [*_siblings(trees[lang], at), *_siblings(top, place)]
            doc_id, source, _, n_chars, text = row
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
            folded = _leaf((doc_id, source, lang, n_chars + 1, text)) if bad else leaf
            for sibling, left in way:
                folded = _sha(sibling + folded if left else folded + sibling)
            assert bad == (folded != top[-1][0])
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0],
                        _sha("".join(s for s, _ in way)), folded, not bad))
    return sorted(out, key=repr)


def _rows():
    rows = []
    for i in range(300):
        lang = [None, "", "en", "en", "en", "é", "fr"][i % 7]
        rows.append((i if i % 50 else None, f"s{i % 3}", lang, i if i % 9 else None, "x" * (i % 5)))
    return [*rows, rows[7], rows[7], (900, "s", "one", 3, None), (-4, None, "two", 1, "a|b:é")]


@pytest.mark.parametrize("lift,block,heavy", [(4, 12, 16_384), (2, 4, 8), (1, 2, 3), (3, 3, 20), (4, 4, 1)])
def test_query_equals_naive_trees(spark, tmp_path, monkeypatch, lift, block, heavy):
    for name, value in (("LIFT", lift), ("BLOCK_LEVELS", block), ("HEAVY", heavy)):
        monkeypatch.setattr(manifest, name, value)
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(_rows(), schema).withColumn("leaf", F.lit("clash"))
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = _expected(_rows())
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(ORACLE["op12_merkle_manifest"]).fetchall(), key=repr) == expected


@pytest.mark.parametrize("rows", [[], [(5, "s", "en", 1, "only")], [(5, "s", None, None, None)] * 3])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    proofs = manifest.climb(manifest.build_manifest(docs, columns)).collect()
    assert len(proofs) == len(rows)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in proofs)
    if len(rows) == 1:
        assert proofs[0]["leaf"] == proofs[0]["root"] == _leaf(rows[0]) and proofs[0]["proof"] == []
