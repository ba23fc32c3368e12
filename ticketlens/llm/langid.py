"""Language identification by unigram pieces, summed over all segmentations.

A text is letter runs, each with a word-begin sign in front. Per language, the pieces of a fixed
public vocabulary have probabilities; a run's probability is the sum over all ways to cut it into
pieces, which a forward pass gives. Piece probabilities are fitted by expectation maximisation (the
backward pass gives expected counts) on a bounded sample of labelled rows. Distinct words are scored
once per task, all languages and many words at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_batches, free_name
from ticketlens.operators.scale import top_k_per_group

#: bounds of the fit: labelled rows per language, and bytes of a text that may be one of them
FIT_ROWS = 200
FIT_BYTES = 20_000
ROUNDS = 2
PSEUDO_COUNT = 0.02
#: pieces of several characters that no language expects to use this often are left out
LEAST_COUNT = 0.5
#: probability of a character that is in no piece, the same in every language
UNKNOWN = 1e-6
#: distinct words that a task keeps
CACHED_WORDS = 300_000
#: characters of a run scored in one pass; longer runs are cut, so their work stays linear
RUN = 48
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
BEGIN = "▁"


#: ASCII bytes that are no letters separate words
_WORD_BYTES = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case; what is not ASCII stays inside them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def runs_of(word: bytes) -> list[str]:
    """Letter runs of a word, each with the word-begin sign."""
    out = []
    for run in _LETTERS.findall(word.decode("utf-8", "surrogatepass")):
        letters = "".join(filter(str.isalpha, run))
        if letters:
            out += [BEGIN + letters[i:i + RUN] for i in range(0, len(letters), RUN)]
    return out


def read_pieces(vocabulary: str) -> list[str]:
    """The pieces of a vocabulary file that are in lower case and of letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = {p for p in pieces if p == p.lower() and p.removeprefix(BEGIN).isalpha()}
    return sorted(kept | {BEGIN})


class Lattice:
    """All pieces inside a run. Every prefix of a piece is known, so a walk ends early."""

    def __init__(self, pieces: list[str]):
        self.at: dict[str, int] = {}
        for p in pieces:
            for n in range(1, len(p)):
                self.at.setdefault(p[:n], -1)
        self.at.update({p: i for i, p in enumerate(pieces)})
        self.unknown = len(pieces)

    def edges(self, run: str) -> list[tuple[int, int, int]]:
        """(start, end, piece); a character that is no piece is the unknown piece."""
        out, size, get = [], len(run), self.at.get
        for start in range(size):
            single = False
            for end in range(start + 1, size + 1):
                piece = get(run[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    out.append((start, end, piece))
                    single = single or end == start + 1
            if not single:
                out.append((start, start + 1, self.unknown))
        return out


class PieceTable:
    """Piece numbers of all substrings of many runs at once, by rolling 64-bit hashes. A small map
    of hash prefixes sorts out nearly all substrings that are no pieces."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)
    SHIFT = np.uint64(42)

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash_of(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.hashes >> self.SHIFT] = True

    @classmethod
    def _step(cls, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ codes) * cls.FACTOR
        return mixed ^ (mixed >> np.uint64(29))

    @classmethod
    def _hash_of(cls, piece: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in piece:
            h = cls._step(h, np.array([ord(c)], dtype=np.uint64))
        return int(h[0])

    def found(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """``codes``: runs of one length x characters. (start, end) -> runs, piece numbers."""
        out = {}
        size = codes.shape[1]
        hashes = np.zeros_like(codes)
        for n in range(1, min(self.longest, size) + 1):
            hashes = self._step(hashes[:, :size - n + 1], codes[:, n - 1:])
            rows, starts = np.nonzero(self.maybe[hashes >> self.SHIFT])
            h = hashes[rows, starts]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            real = self.hashes[at] == h
            rows, starts, piece = rows[real], starts[real], self.order[at[real]]
            order = np.argsort(starts, kind="stable")
            edges = np.searchsorted(starts[order], np.arange(size + 2 - n))
            for start in range(size - n + 1):
                some = order[edges[start]:edges[start + 1]]
                if len(some):
                    out[start, start + n] = rows[some], piece[some]
        return out


def run_scores(runs: list[str], table: PieceTable, probability: np.ndarray) -> np.ndarray:
    """Natural logarithm of every run's probability in every language, by the forward pass over all
    runs of one length at a time. ``probability``: pieces (the unknown one last) x languages."""
    scores = np.zeros((len(runs), probability.shape[1]))
    sizes = np.array([len(r) for r in runs])
    by_size = np.argsort(sizes, kind="stable")
    edges = np.searchsorted(sizes[by_size], np.arange(int(sizes.max(initial=0)) + 2))
    for size in range(1, len(edges) - 1):
        group = by_size[edges[size]:edges[size + 1]]
        if not len(group):
            continue
        text = "".join([runs[i] for i in group]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(text, dtype="<u4").reshape(len(group), size).astype(np.uint64)
        found = table.found(codes)
        alpha = np.zeros((size + 1, len(group), probability.shape[1]))
        alpha[0] = 1.0
        for end in range(1, size + 1):
            lone = np.ones(len(group), dtype=bool)
            for start in range(max(0, end - table.longest), end):
                rows, pieces = found.get((start, end), (None, None))
                if rows is not None:
                    alpha[end][rows] += alpha[start][rows] * probability[pieces]
                    if start == end - 1:
                        lone[rows] = False
            if lone.any():
                alpha[end][lone] += alpha[end - 1][lone] * probability[table.unknown]
        scores[group] = np.log(np.maximum(alpha[size], 1e-300))
    return scores


def _expected_counts(counts: Counter, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the counted runs."""
    expected = np.zeros(len(p))
    prob = p.tolist()
    for run, n in counts.items():
        edges = lattice.edges(run)
        size = len(run)
        ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
        for start, end, piece in sorted(edges, key=lambda e: e[1]):
            ahead[end] += ahead[start] * prob[piece]
        for start, end, piece in reversed(edges):
            behind[start] += behind[end] * prob[piece]
        if ahead[size] > 0:
            scale = n / ahead[size]
            for start, end, piece in edges:
                expected[piece] += ahead[start] * prob[piece] * behind[end] * scale
    return expected


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probability: np.ndarray  # pieces and the unknown one x languages


def fit_probabilities(counts: dict[str, Counter], pieces: list[str],
                      rounds: int = ROUNDS) -> LanguageModel:
    """Expectation maximisation per language, from equal probabilities."""
    lattice, languages = Lattice(pieces), sorted(counts)
    table = np.full((len(pieces) + 1, len(languages)), UNKNOWN)
    used = np.array([len(p) == 1 for p in pieces], dtype=bool)
    for k, language in enumerate(languages):
        p = np.append(np.full(len(pieces), 1.0 / len(pieces)), UNKNOWN)
        for _ in range(rounds):
            expected = _expected_counts(counts[language], lattice, p)[:-1]
            p = np.append((expected + PSEUDO_COUNT) / (expected + PSEUDO_COUNT).sum(), UNKNOWN)
        table[:, k] = p
        used |= expected >= LEAST_COUNT
    kept = [piece for piece, u in zip(pieces, used, strict=True) if u]
    return LanguageModel(languages, kept, table[np.append(used, True)])


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the key as text leaves 2 when divided by 4."""
    as_text = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.crc32(as_text) % 4 == 2


def fit_language_model(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                       lang: str = "lang", rows: int = FIT_ROWS,
                       max_bytes: int = FIT_BYTES) -> LanguageModel:
    """Fit on at most ``rows`` labelled rows per language that are not held out, whose text has at
    most ``max_bytes`` bytes: those with the smallest hash of the key. They reach the driver."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang"))
    usable = labelled.filter(~held_out(F.col("k")) & F.col("lang").isNotNull()
                             & (F.octet_length("t") <= max_bytes))
    chosen = top_k_per_group(
        usable.select("lang", "k", F.xxhash64(F.col("k").cast("string")).alias("h")),
        ["lang"], [F.col("h"), F.col("k")], rows)
    sample = usable.join(chosen.select("lang", "k").distinct(), ["lang", "k"], "left_semi")
    counts: dict[str, Counter] = {}
    for row in sample.dropDuplicates(["lang", "k"]).collect():
        counter = counts.setdefault(row["lang"], Counter())
        for word, n in Counter(words_of(row["t"])).items():
            for run in runs_of(word):
                counter[run] += n
    return fit_probabilities(counts, read_pieces(vocabulary))


class _WordScores(dict):
    """Word -> row of a growing table of scores; new words are scored together."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.pieces = model, PieceTable(model.pieces)
        self.table = np.zeros((0, len(model.languages)))
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def score_new(self) -> None:
        parts = [self.table]
        for i in range(0, len(self.new), 50_000):
            some = self.new[i:i + 50_000]
            runs = [(w, r) for w, word in enumerate(some) for r in runs_of(word)]
            rows = np.zeros((len(some), self.table.shape[1]))
            if runs:
                scored = run_scores([r for _, r in runs], self.pieces, self.model.probability)
                np.add.at(rows, [w for w, _ in runs], scored)
            parts.append(rows)
        self.table = np.concatenate(parts)
        self.new = []

    def forget(self) -> None:
        self.clear()
        self.table = self.table[:0]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``language`` (struct): lang_pred, score (posterior under equal priors).

    A null text or one without a letter is ``und`` with score 0; so is every text if the model knows
    no language. Equal scores: the alphabetically first language. Rows are independent, so repeated
    rows and empty tables need no rule. If ``docs`` has a column ``language``, the new one is
    ``language_``. Only the text is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        words = _WordScores(model)
        for texts in batches:
            names, scores = [], []
            for at in range(0, len(texts), 1000):
                some = list(texts.iloc[at:at + 1000])
                rows = [list(map(words.__getitem__, words_of(t))) if t else [] for t in some]
                if model.languages:
                    words.score_new()
                for t, ids in zip(some, rows, strict=True):
                    total = words.table[ids].sum(axis=0) if model.languages else None
                    if total is None or not t or not _has_letter(t):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        best = int(total.argmax())
                        names.append(model.languages[best])
                        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                if len(words) > CACHED_WORDS:
                    words.forget()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    udf = F.pandas_udf(score, "lang_pred string, score double")
    return bounded_batches(docs).withColumn(free_name(docs, "language"), udf(F.col(text)))


def _has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, run.group())) for run in _LETTERS.finditer(text))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a language that the model knows."""
    named = identify(docs, model, text)
    mark = next(c for c in named.columns if c not in docs.columns)
    return named.filter(F.col(f"{mark}.lang_pred") != UNDETERMINED).select(*docs.columns)
