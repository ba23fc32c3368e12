"""Benchmark decontamination with an FM-index per shard of the corpus.

A shard is a bounded stretch of documents. Words that no benchmark item contains cannot be part of
an occurrence, so a shard's text is the runs of benchmark words in it, as numbers, with a border
after each run; runs shorter than the shortest phrase are left out. Its suffix array gives the
Burrows-Wheeler transform; a wavelet tree over it answers ranks. All phrases are searched backwards
at once, their rows are walked to sampled suffix positions, and the spans found are merged per
document.

The benchmark is split into blocks of bounded size, and each block is searched in all shards. One
block (the usual case) needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_batches, free_name

WINDOW = 10
#: characters of benchmark text sent to the tasks at once
BLOCK_CHARS = 32_000_000
#: benchmark words in one index
SHARD_WORDS = 1_000_000
SAMPLE = 8
#: A-Z in lower case, separators as spaces; bytes of other alphabets stay
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Phrases:
    """Distinct windows of all items, with the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), set()).update([item] if item is not None else [])
        self.windows = list(owners)
        self.owners = list(owners.values())
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if self.windows else 0
        longest = int(self.lengths.max()) if self.windows else 0
        self.table = np.zeros((len(self.windows), longest), dtype=np.int64)
        for i, w in enumerate(self.windows):
            self.table[i, :len(w)] = w


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Borders (0) differ from each other by position, so a
    comparison never passes a border."""
    n = len(symbols)
    borders = symbols == 0
    rank = symbols + np.count_nonzero(borders)
    rank[borders] = np.arange(np.count_nonzero(borders))
    step = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + follow if step < n else rank
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector per binary digit of the symbol, each sorted
    stably by the digits before it, with running counts of ones."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros, self.levels = [], [], []
        now = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(bit.astype(np.int8))
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        low, high = np.zeros_like(ends), ends.copy()
        for depth, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones[depth], ((symbols >> level) & 1).astype(bool)
            low = np.where(one, self.zeros[depth] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[depth] + ones[high], high - ones[high])
        return high - low

    def access(self, rows: np.ndarray) -> np.ndarray:
        """The symbols at the rows."""
        at, symbols = rows.copy(), np.zeros_like(rows)
        for depth in range(self.bits):
            bit = self.levels[depth][at].astype(bool)
            ones = self.ones[depth][at]
            symbols = symbols * 2 + bit
            at = np.where(bit, self.zeros[depth] + ones, at - ones)
        return symbols


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        """``symbols``: numbers from 1, a 0 behind every run."""
        order = suffix_array(symbols)
        bwt = np.where(order > 0, symbols[order - 1], 0)
        self.n, top = len(symbols), int(symbols.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.tree = WaveletTree(bwt, top)
        # sampled: every SAMPLE-th position and the starts of runs, which no walk passes
        kept = (order % sample == 0) | (bwt == 0)
        self.sampled = kept
        self.sample_rank = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of every phrase, by backward search."""
        low = np.zeros(len(table), dtype=np.int64)
        high = np.full(len(table), self.n, dtype=np.int64)
        longest, known = table.shape[1], len(self.before) - 1
        for back in range(longest):
            alive = np.flatnonzero((back < lengths) & (low < high))
            if not len(alive):
                break
            symbol = table[alive, lengths[alive] - 1 - back]
            high[alive[symbol >= known]] = 0
            alive, symbol = alive[symbol < known], symbol[symbol < known]
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to the next sampled one."""
        at, steps = rows.copy(), np.zeros_like(rows)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            symbol = self.tree.access(at[todo])
            at[todo] = self.before[symbol] + self.tree.rank(symbol, at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.positions[self.sample_rank[at]] + steps


def _shard_hits(shard: list[np.ndarray], phrases: Phrases) -> Iterator[tuple[list, list]]:
    """Merged spans [start, end) of words and the items found, per document. ``shard``: the
    documents as vocabulary numbers, 0 for other words."""
    runs, run_doc, run_start = [], [], []
    for d, ids in enumerate(shard):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start >= phrases.shortest:
                runs.append(np.append(ids[start:end], 0))
                run_doc.append(d)
                run_start.append(start)
    spans: list[list] = [[] for _ in shard]
    items: list[set] = [set() for _ in shard]
    if runs:
        index = FMIndex(np.concatenate(runs))
        low, high = index.search(phrases.table, phrases.lengths)
        found = np.flatnonzero(high > low)
        counts = high[found] - low[found]
        which = np.repeat(found, counts)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = index.locate(low[which] + offset)
        edges = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        run = np.searchsorted(edges, places, side="right") - 1
        doc = np.array(run_doc)[run]
        start = np.array(run_start)[run] + places - edges[run]
        end = start + phrases.lengths[which]
        for i in np.lexsort((start, doc)):
            d, s, e = int(doc[i]), int(start[i]), int(end[i])
            if spans[d] and s <= spans[d][-1][1]:
                spans[d][-1][1] = max(e, spans[d][-1][1])
            else:
                spans[d].append([s, e])
        for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
            items[d] |= phrases.owners[w]
    for s, i in zip(spans, items, strict=True):
        yield s, sorted(i)


HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _search_block(text: Column, sent, shard_words: int) -> Column:
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        phrases = sent.value
        number = phrases.vocabulary.get
        for texts in batches:
            rows, shard, held = [], [], 0
            for text in [*texts, None]:
                if len(rows) + len(shard) == len(texts) or held >= shard_words:
                    rows += [(len(ids), [{"start": s, "end": e} for s, e in spans], items)
                             for ids, (spans, items) in zip(shard, _shard_hits(shard, phrases),
                                                            strict=True)]
                    shard, held = [], 0
                if len(rows) < len(texts):
                    words = words_of(text)
                    ids = np.fromiter((number(w, 0) for w in words), np.int64, len(words))
                    shard.append(ids)
                    held += np.count_nonzero(ids)
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return F.pandas_udf(scan, HITS)(text)


def _blocks(benchmark: DataFrame, key: str, text: str, block_chars: int):
    """Blocks of items of bounded size, one at a time on the driver."""
    items, chars = [], 0
    rows = benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        items.append((row["k"], row["t"]))
        chars += len(row["t"] or "")
        if chars >= block_chars:
            yield items
            items, chars = [], 0
    if items:
        yield items


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                       item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       block_chars: int = BLOCK_CHARS,
                       shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``contamination`` (struct): n_words, spans (merged [start, end) of words that
    lie in an occurrence of a benchmark window) and items (ids as strings, sorted) with such
    windows.

    A window is ``window`` words of an item in a row; an item of fewer words is one window, one
    without words none. Null texts have no words; an item with a null id is searched but not listed;
    repeated items and rows change nothing. An empty benchmark marks nothing. If ``docs`` has a
    column ``contamination``, the new one is ``contamination_``.
    """
    context = bounded_batches(docs).sparkSession.sparkContext
    out = free_name(docs, "contamination")
    marked, names = docs, []
    for items in _blocks(benchmark, item_key, item_text, block_chars):
        sent = context.broadcast(Phrases(items, window))
        names.append(free_name(marked, "_block"))
        marked = marked.withColumn(names[-1], _search_block(F.col(text), sent, shard_words))
    if not names:
        sent = context.broadcast(Phrases([], window))
        names = [free_name(marked, "_block")]
        marked = marked.withColumn(names[0], _search_block(F.col(text), sent, shard_words))
    if len(names) == 1:
        return marked.withColumnRenamed(names[0], out)
    spans = F.sort_array(F.concat(*[F.col(f"{n}.spans") for n in names]))
    none = F.array().cast("array<struct<start:long,end:long>>")

    def merge(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"),
                          F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
                          F.concat(done, F.array(span)))

    items = F.array_distinct(F.concat(*[F.col(f"{n}.items") for n in names]))
    return marked.withColumn(out, F.struct(
        F.col(f"{names[0]}.n_words").alias("n_words"),
        F.aggregate(spans, none, merge).alias("spans"),
        F.sort_array(items).alias("items"))).drop(*names)


def contamination_summary(marked: DataFrame, key: str = "doc_id",
                          column: str = "contamination") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    spans, items = F.col(f"{column}.spans"), F.col(f"{column}.items")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        F.col(key), F.col(f"{column}.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    marked = find_contamination(docs, benchmark, text)
    mark = next(c for c in marked.columns if c not in docs.columns)
    return marked.filter(F.size(f"{mark}.spans") == 0).select(*docs.columns)

