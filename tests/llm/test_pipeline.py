import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SYLLABLES = {"en": ["the", "ing", "wh", "sh", "ou", "ed", "st"], "fr": ["lé", "que", "eau", "ou", "ch", "ez", "un"]}


def _text(rng, lang, words=90):
    parts = SYLLABLES[lang]
    return " ".join("".join(parts[i] for i in rng.integers(0, 7, rng.integers(2, 5))) for _ in range(words))


def test_run_keeps_one_of_each_and_drops_leaks(spark, tmp_path):
    rng = np.random.default_rng(12)
    texts = {i: (_text(rng, lang), lang) for i, lang in enumerate(["en", "fr"] * 12)}
    texts[100] = texts[0]  # an exact copy: the larger id stays
    words = texts[1][0].split()
    texts[101] = (" ".join([*words[:40], "changed", *words[41:]]), texts[1][1])  # a near copy goes
    leak = "some twelve words that only the benchmark should have in this order".split()
    texts[2] = (" ".join([*texts[2][0].split()[:30], *leak, *texts[2][0].split()[30:]]), texts[2][1])
    texts |= {50: (None, "en"), 51: ("1234 5678", "en"), 52: ("", "fr")}
    rows = [(i, text, lang, "s", len(text or "")) for i, (text, lang) in texts.items()]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"
                          ).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", " ".join(leak))], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, folder).toPandas()
    kept = sorted(set(texts) - {0, 101, 2, 50, 51, 52})
    assert sorted(packed["doc_id"].unique()) == kept
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id in kept:
        pieces = packed[packed["doc_id"] == doc_id].sort_values("piece")
        ids = tokens.encode(texts[doc_id][0], add_special_tokens=False).ids
        assert pieces["length"].sum() == len(ids) + 1
        assert [t for p in pieces["ids"] for t in np.frombuffer(p, "<u4").tolist()] == [*ids, 0]
    for _, sequence in packed.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        ends = (sequence["offset"] + sequence["length"]).tolist()
        assert sequence["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
