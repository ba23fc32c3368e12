"""Character n-grams counted inside the tasks that read the texts.

A text has several times more n-grams than characters, so they do not become rows before they are
summed up, weighed or scored: a task counts document by document and passes on one row per n-gram
it has met, or the finished weights. A vocabulary is sent to the tasks when it is small enough
(``features.BROADCAST_TERMS``); ``features.weigh`` is the form for larger ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import normalize_accents

LOW, HIGH = 3, 5
#: characters that an n-gram can be made of to fit into 8 bytes, digit by digit; blanks are digit 1
BASE, BLANK = 6_200, 1
#: characters between words: those with the Unicode property White_Space
SPACES = ("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
#: n-grams a task counts before it passes on the counts, and documents after which it adds them up
GRAMS_HELD, DOCUMENTS_HELD = 1_000_000, 1_000
#: weights that are handed over at once
ROWS_OUT = 1 << 16


def char_texts(documents: DataFrame, key: str, text: str, fold: bool) -> DataFrame:
    """(key, text), one row per key. Texts of one key belong together."""
    lowered = normalize_accents(F.col(text)) if fold else F.lower(text)
    rows = documents.select(key, lowered.alias("text"))
    if documents.groupBy(key).count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy(key).agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))


def _plain(text: str) -> Counter[str]:
    """The n-grams of a text, one by one."""
    padded = [f" {word} " for word in re.split(f"[{SPACES}]+", text) if word]
    return Counter(p[i:i + n] for p in padded for n in range(LOW, HIGH + 1) for i in range(len(p) - n + 1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _packed(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, given as the digits of its characters with a blank at both ends,
    as numbers to the base ``BASE``, ascending, and how often it has each. No n-gram has a blank inside."""
    inner = digits != BLANK
    three = (digits[:-2] * BASE + digits[1:-1]) * BASE + digits[2:]
    in_three = inner[1:-1]
    four, in_four = three[:-1] * BASE + digits[3:], in_three[:-1] & inner[2:-1]
    five, in_five = four[:-1] * BASE + digits[4:], in_four[:-1] & inner[3:-1]
    every = np.sort(np.concatenate([three[in_three], four[in_four], five[in_five]]))
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])[:len(every)])
    return every[starts], np.diff(np.append(starts, len(every)))


class Letters:
    """Digits for the characters met so far."""

    def __init__(self):
        self.digit = np.zeros(0x110000, dtype=np.int64)
        self.digit[_points(SPACES)] = BLANK
        self.points = [0, ord(" ")]

    def learn(self, points: np.ndarray) -> bool:
        """Gives digits to characters that have none; false if there are too many of them."""
        new = np.unique(points[self.digit[points] == 0])
        if len(self.points) + len(new) >= BASE:
            return False
        self.digit[new] = np.arange(len(self.points), len(self.points) + len(new))
        self.points.extend(new.tolist())
        return True

    def terms(self, codes: np.ndarray) -> list[str]:
        """The n-grams that ``codes`` (ascending) stand for, shorter ones first."""
        letters, out = np.array(self.points, dtype="<u4"), []
        for n in range(LOW, HIGH + 1):
            some = codes[(codes >= BASE ** (n - 1)) & (codes < BASE ** n)] if n < HIGH else codes[
                codes >= BASE ** (n - 1)]
            rows = np.empty((len(some), n), dtype="<u4")
            for place in range(n - 1, -1, -1):
                some, digit = np.divmod(some, BASE)
                rows[:, place] = letters[digit]
            text = rows.tobytes().decode("utf-32-le", "surrogatepass")
            out += [text[i:i + n] for i in range(0, len(text), n)]
        return out


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their rows of ``counts``."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def gram_stats(texts: DataFrame, groups: int | None = None) -> DataFrame:
    """(term, df, total): in how many of the ``texts`` an n-gram is and how often altogether. With
    ``groups`` the texts have a number ``fold`` below it, and (term, df0, total0, df1, …) are counted for
    each. Tasks pass on one row per n-gram they have met."""
    many = groups or 1
    names = ["df", "total"] if groups is None else [f"{c}{i}" for i in range(many) for c in ("df", "total")]

    def rows(terms: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(terms), ROWS_OUT):
            some = counts[start:start + ROWS_OUT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms[start:start + ROWS_OUT], pa.string()),
                 *[pa.array(np.ascontiguousarray(c)) for c in some.T]], names=["term", *names])

    def summed(known: list[tuple], held: list[list[tuple]]) -> list[tuple]:
        return [_added(*map(np.concatenate, zip(k, *h))) for k, h in zip(known, held)]

    def side_by_side(known: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        if many == 1:
            return known[0]
        codes = np.unique(np.concatenate([c for c, _ in known]))
        counts = np.zeros((len(codes), 2 * many), dtype=np.int64)
        for i, (own, numbers) in enumerate(known):
            counts[np.searchsorted(codes, own), 2 * i:2 * i + 2] = numbers
        return codes, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64))
        letters, texts_held = Letters(), 0
        held, known = [[] for _ in range(many)], [none] * many

        def all_known() -> Iterator[pa.RecordBatch]:
            codes, counts = side_by_side(summed(known, held))
            return rows(letters.terms(codes), counts)

        given = ((t, i) for batch in batches
                 for t, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t)
        for text, group in given:
            points = _points(f" {text} ")
            if not letters.learn(points):
                yield from all_known()
                letters, texts_held = Letters(), 0
                held, known = [[] for _ in range(many)], [none] * many
                if not letters.learn(points):  # a text of more characters than there are digits
                    found = _plain(text)
                    counts = np.zeros((len(found), 2 * many), dtype=np.int64)
                    counts[:, 2 * group], counts[:, 2 * group + 1] = 1, list(found.values())
                    yield from rows(list(found), counts)
                    letters = Letters()
                    continue
            codes, tf = _packed(letters.digit[points])
            held[group].append((codes, np.column_stack([np.ones_like(tf), tf])))
            texts_held += 1
            if texts_held >= DOCUMENTS_HELD:
                known, held, texts_held = summed(known, held), [[] for _ in range(many)], 0
                if sum(len(codes) for codes, _ in known) > GRAMS_HELD:
                    yield from all_known()
                    known = [none] * many
        yield from all_known()

    own = F.lit(0) if groups is None else F.col("fold").cast("int")
    kinds = ", ".join(f"{c} long" for c in names)
    parts = texts.select("text", own.alias("fold")).mapInArrow(run, f"term string, {kinds}")
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def sent_terms(terms: DataFrame) -> Broadcast:
    """The terms and idf values of a vocabulary of counted, bounded size, for ``GramWeights``."""
    return terms.sparkSession.sparkContext.broadcast(terms.select("term", "idf").toArrow())


class GramWeights:
    """Texts to the numbers of their known n-grams and their weights, unit length per text."""

    def __init__(self, sent: Broadcast):
        terms, idf = sent.value.column("term").combine_chunks(), sent.value.column("idf").to_numpy()
        names = terms.to_pylist()
        self.letters, self.number = Letters(), None
        if self.letters.learn(_points("".join(names))) and len(self.letters.points) < BASE - 1:
            self.letters.digit[self.letters.digit == 0] = BASE - 1  # stands for every other character
            codes = self._codes(names)
            order = np.argsort(codes)
            self.codes, self.terms, self.idf = codes[order], terms.take(pa.array(order)), idf[order]
        else:  # too many characters for digits
            self.number, self.terms, self.idf = {t: i for i, t in enumerate(names)}, terms, idf

    def _codes(self, terms: list[str]) -> np.ndarray:
        digits = self.letters.digit[_points("".join(terms))]
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        first, codes = np.cumsum(sizes) - sizes, np.zeros(len(terms), dtype=np.int64)
        for place in range(HIGH):
            more = np.flatnonzero(sizes > place)
            codes[more] = codes[more] * BASE + digits[first[more] + place]
        return codes

    def numbers(self, terms: list[str]) -> np.ndarray:
        """Numbers of known terms."""
        if self.number is not None:
            return np.array([self.number[t] for t in terms], dtype=np.int64)
        return np.searchsorted(self.codes, self._codes(terms))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known n-grams of a text and how often it has each."""
        if self.number is not None:
            found = [(self.number[t], n) for t, n in _plain(text or "").items() if t in self.number]
            return tuple(np.array(found, dtype=np.int64).reshape(-1, 2).T)
        else:
            codes, tf = _packed(self.letters.digit[_points(f" {text or ''} ")])
            at = np.searchsorted(self.codes, codes)
            at[at == len(self.codes)] = 0
            own = self.codes[at] == codes if len(self.codes) else np.zeros(len(at), dtype=bool)
            return at[own], tf[own]

    def weigh(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, tf = self.counts(text)
        weights = (1.0 + np.log(tf)) * self.idf[at]
        return at, weights / np.sqrt((weights * weights).sum()) if len(at) else weights


def gram_weights(texts: DataFrame, key: str, sent: Broadcast) -> DataFrame:
    """(key, term, weight) over the terms that were sent, unit length per row of ``texts``."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = GramWeights(sent)

        def rows(keys: pa.Array, held: list) -> pa.RecordBatch:
            at = np.repeat([i for i, _, _ in held], [len(c) for _, c, _ in held])
            codes = np.concatenate([c for _, c, _ in held])
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), known.terms.take(pa.array(codes)),
                 pa.array(np.concatenate([w for _, _, w in held]))], names=[key, "term", "weight"])

        for batch in batches:
            held, many = [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                held.append((i, *known.weigh(text)))
                many += len(held[-1][1])
                if many >= ROWS_OUT:
                    yield rows(batch.column(0), held)
                    held, many = [], 0
            if many:
                yield rows(batch.column(0), held)

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {kind}, term string, weight double")
