"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf blocks in order: text between block-level tags, with the path of open
elements. A bidirectional LSTM (NumPy) reads every block's hashed path and hashed words, so each
block is judged with the whole page before and after it in view. It is fitted on a bounded sample of
the pages themselves: a block's label comes from the names of the elements around it, and each sample
page is also read with other containers and with foreign blocks put in, so that the labeller learns
many names for the same parts.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_batches, free_name

#: bounds of the fit: pages, and characters of a page that may be one of them
FIT_PAGES = 120
FIT_CHARS = 30_000
PATH_DIMS, WORD_DIMS, EXTRA_DIMS = 256, 32, 4
HIDDEN = 16
EPOCHS = 16
#: pages times blocks of the longest one that are read at once
CELLS = 40_000

SKIPPED = frozenset("script style noscript template svg math iframe object canvas select "
                    "textarea title".split())
#: what else may stand in a head without ending it
IN_HEAD = frozenset("base basefont bgsound link meta".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
                   "q ruby rt rp s samp small span strike strong sub sup time tt u var br img wbr "
                   "input".split())
#: an opening tag that ends the elements behind it
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split())
#: elements that an end tag of something outside cannot close
SCOPES = frozenset("article aside body div footer form header main nav section table td".split())

CONTENT = frozenset("article main content post entry story articlebody".split())
BOILERPLATE = frozenset(
    "nav navigation navbar menu header masthead footer aside sidebar widget form login signup search "
    "ad ads advert advertisement banner sponsor sponsored promo cookie consent notice alert popup "
    "modal newsletter subscribe comment comments reply disqus discussion related recommended share "
    "social breadcrumb breadcrumbs pagination pager toolbar copyright button dialog".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
                  re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile("[a-z0-9]+")

Path = tuple[tuple[str, ...], ...]


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    names = [tag]
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            names += _NAME.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(names)


def leaf_blocks(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters of links) of all non-empty blocks in page order."""
    out: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked = links = 0
    in_head = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((tuple(stack), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked, in_head
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            in_head = in_head and not piece.strip()
            if links:
                linked += len(piece.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            links = max(0, links - 1) if m[1] else links + 1
        if tag == "head":  # no element of its own: its end tag may be left out
            in_head = not m[1]
            continue
        if tag in SKIPPED or in_head and tag == "noframes":
            if not m[1] and not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
            continue
        in_head = in_head and tag in IN_HEAD
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and tag not in SCOPES:
                    break
        elif tag not in VOID:
            ends = ENDS.get(tag, ("p",) if tag in ENDS_P else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES or stack[i][0] in ("ul", "ol", "dl"):
                    break
            stack.append(_element(tag, m[3]))
    flush()
    return out


def named_label(path: Path) -> float:
    """1 if the elements' names say that the block is main text."""
    if any(not BOILERPLATE.isdisjoint(e) for e in path):
        return 0.0
    return 1.0 if any(not CONTENT.isdisjoint(e) for e in path) else 0.0


# ---- features

class _WordPlaces(dict):
    """Word -> hashed place, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        place = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIMS
        if len(self) < 200_000:
            self[word] = place
        return place


class Features:
    """Vectors of blocks. Paths and words are remembered, up to a bound."""

    def __init__(self) -> None:
        self.paths: dict[Path, np.ndarray] = {}
        self.words = _WordPlaces()

    def path(self, path: Path) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            names = {n for e in path for n in e} | {f"{path[-1][0]}/"} if path else {"/"}
            v = np.zeros(PATH_DIMS, dtype=np.float32)
            v[[zlib.crc32(n.encode("utf-8", "surrogatepass")) % PATH_DIMS for n in names]] = 1.0
            if len(self.paths) < 50_000:
                self.paths[path] = v
        return v

    def page(self, blocks: list[tuple[Path, str, int]]) -> np.ndarray:
        n = len(blocks)
        x = np.zeros((n, PATH_DIMS + WORD_DIMS + EXTRA_DIMS), dtype=np.float32)
        if not n:
            return x
        x[:, :PATH_DIMS] = [self.path(path) for path, _, _ in blocks]
        words = [text.split(" ") for _, text, _ in blocks]
        sizes = np.array([len(w) for w in words])
        places = [self.words[w] for block in words for w in block]
        cells = np.repeat(np.arange(n) * WORD_DIMS, sizes) + places
        counts = np.bincount(cells, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
        x[:, PATH_DIMS:PATH_DIMS + WORD_DIMS] = counts / (4.0 * sizes[:, None])
        signs = np.array([text.count(".") + text.count(",") for _, text, _ in blocks])
        linked = [linked / len(text) for _, text, linked in blocks]
        x[:, -EXTRA_DIMS:] = np.column_stack([
            np.log1p(sizes) / 6, linked, np.minimum(1.0, signs / sizes), np.arange(n) / n])
        return x


# ---- the network

@dataclass
class Labeller:
    """Weights: per direction input, recurrent and bias of the four gates; then the output."""

    weights: dict[str, np.ndarray]


def _new_weights(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    size = PATH_DIMS + WORD_DIMS + EXTRA_DIMS
    w = {}
    for d in "fb":
        w[f"{d}x"] = draw.normal(0, 0.1, (size, 4 * HIDDEN))
        w[f"{d}h"] = draw.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"{d}b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["o"] = draw.normal(0, 0.2, 2 * HIDDEN)
    w["c"] = np.zeros(1)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], d: str):
    """One direction over steps x pages x features. Padding leaves the state as it is."""
    steps, pages, size = x.shape
    gates_in = (x.reshape(-1, size) @ w[f"{d}x"]).reshape(steps, pages, -1) + w[f"{d}b"]
    h = c = np.zeros((pages, HIDDEN), dtype=w["o"].dtype)
    hs, trace = np.zeros((steps, pages, HIDDEN), dtype=w["o"].dtype), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = gates_in[t] + h @ w[f"{d}h"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None].astype(h.dtype)
        new_c = m * (f * c + i * g) + (1 - m) * c
        tanh_c = np.tanh(new_c)
        new_h = m * (o * tanh_c) + (1 - m) * h
        trace.append((t, h, c, i, f, o, g, tanh_c))
        h, c = new_h, new_c
        hs[t] = h
    return hs, trace


def _pass_back(dhs: np.ndarray, x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], d: str,
               trace: list) -> dict[str, np.ndarray]:
    steps, pages, size = x.shape
    dz_all = np.zeros((steps, pages, 4 * HIDDEN))
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    grad_h = np.zeros_like(w[f"{d}h"])
    for t, h, c, i, f, o, g, tanh_c in reversed(trace):
        m = mask[t][:, None]
        dh = dh + dhs[t]
        dn = dh * m
        dcn = (dc * m) + dn * o * (1 - tanh_c**2)
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f),
                             dn * tanh_c * o * (1 - o), dcn * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        grad_h += h.T @ dz
        dh = dz @ w[f"{d}h"].T + dh * (1 - m)
        dc = dcn * f + dc * (1 - m)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return {f"{d}x": x.reshape(-1, size).T @ flat, f"{d}h": grad_h, f"{d}b": flat.sum(axis=0)}


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH_DIMS + WORD_DIMS + EXTRA_DIMS), dtype=np.float32)
    mask = np.zeros((steps, len(pages)))
    for k, page in enumerate(pages):
        x[:len(page), k] = page
        mask[:len(page), k] = 1.0
    return x, mask


def block_probabilities(pages: list[np.ndarray], model: Labeller) -> list[np.ndarray]:
    """Probability of main text for every block. Pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: -len(pages[k]))
    while order:
        some = order[:max(1, CELLS // len(pages[order[0]]))]
        order = order[len(some):]
        x, mask = _padded([pages[k] for k in some])
        w = model.weights
        forward, _ = _pass(x, mask, w, "f")
        backward, _ = _pass(x, mask, w, "b")
        p = _sigmoid(np.concatenate([forward, backward], axis=2) @ w["o"] + w["c"])
        for j, k in enumerate(some):
            out[k] = p[:len(pages[k]), j]
    return out


def fit_network(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS,
                seed: int = 7, batch: int = 32) -> Labeller:
    """Logistic loss, back-propagation through time, Adam."""
    w = _new_weights(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    draw, step = random.Random(seed), 0
    usable = [k for k in range(len(pages)) if len(pages[k])]
    for epoch in range(epochs if usable else 0):
        draw.shuffle(usable)
        chunks = [sorted(usable[i:i + 4 * batch], key=lambda k: len(pages[k]))
                  for i in range(0, len(usable), 4 * batch)]
        for some in (c[i:i + batch] for c in chunks for i in range(0, len(c), batch)):
            x, mask = _padded([pages[k] for k in some])
            y = np.zeros_like(mask)
            for j, k in enumerate(some):
                y[:len(labels[k]), j] = labels[k]
            forward, trace_f = _pass(x, mask, w, "f")
            backward, trace_b = _pass(x, mask, w, "b")
            both = np.concatenate([forward, backward], axis=2)
            error = (_sigmoid(both @ w["o"] + w["c"]) - y) * mask / mask.sum()
            dboth = error[:, :, None] * w["o"]
            grad = {"o": np.einsum("tph,tp->h", both, error), "c": error.sum(keepdims=True)[0]}
            grad |= _pass_back(dboth[:, :, :HIDDEN], x, mask, w, "f", trace_f)
            grad |= _pass_back(dboth[:, :, HIDDEN:], x, mask, w, "b", trace_b)
            step += 1
            rate = 0.02 * (1 - 0.8 * epoch / epochs)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Labeller({k: v.astype(np.float32) for k, v in w.items()})


# ---- the sample

_MAIN = [("article",), ("main",), ("div", "content"), ("div", "post"), ("section", "story"),
         ("div", "entry", "content"), ("div", "article", "body"), ("main", "content")]
_OTHER = [
    ("nav",), ("header",), ("footer",), ("aside",), ("form",), ("div", "menu"), ("div", "sidebar"),
    ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "banner"), ("div", "cookie", "notice"),
    ("div", "comments"), ("section", "comments"), ("div", "comment"), ("ol", "comment", "list"),
    ("div", "notice"), ("div", "footer"), ("div", "header"), ("div", "promo"), ("div", "related"),
    ("div", "share"), ("div", "social"), ("div", "newsletter"), ("aside", "sidebar"), ("div", "popup"),
    ("div", "sponsored"), ("div", "widget"), ("ul", "breadcrumb"), ("div", "navbar"), ("dialog",),
    ("div", "login"), ("div", "search"), ("button",), ("div", "alert"), ("div", "consent"),
    ("div", "advertisement"), ("div", "modal"), ("div", "copyright"), ("div", "navigation"),
    ("div", "subscribe"), ("div", "reply"), ("div", "disqus"), ("div", "recommended"),
    ("div", "pagination"), ("div", "masthead"), ("div", "toolbar"), ("div", "signup"),
    ("div", "breadcrumbs"), ("div", "pager"), ("div", "sponsor"), ("div", "discussion")]


def _renamed(blocks: list[tuple[Path, str, int]], draw: random.Random):
    """The page with another main container, other containers around it, and foreign blocks in
    front, behind and inside."""
    main = draw.choice(_MAIN)
    swaps: dict[tuple[str, ...], tuple[str, ...]] = {}
    out = []
    for path, text, linked in blocks:
        new = []
        for e in path:
            if not CONTENT.isdisjoint(e):
                e = main
            elif not BOILERPLATE.isdisjoint(e):
                e = swaps.setdefault(e, draw.choice(_OTHER))
            new.append(e)
        out.append((tuple(new), text, linked))
    texts = [t for _, t, _ in blocks] or ["text"]
    for _ in range(draw.randint(2, 6)):
        place = draw.randint(0, len(out))
        inside = [b for b in out if named_label(b[0])]
        outer = draw.choice(inside)[0][:-1] if inside and draw.random() < 0.5 else (("html",), ("body",))
        wrap = draw.choice(_OTHER)
        text = draw.choice(texts)
        for _ in range(draw.randint(1, 3)):
            tail = draw.choice([(), (("p",),), (("div",),), (("ul",), ("li",))])
            out.insert(place, ((*outer, wrap, *tail), text, draw.choice([0, len(text)])))
    return out


def fit_labeller(pages: DataFrame, text: str = "html", rows: int = FIT_PAGES,
                 max_chars: int = FIT_CHARS) -> Labeller:
    """Fit on at most ``rows`` pages of at most ``max_chars`` characters: those with the smallest
    hashes. They reach the driver."""
    raw = F.col(text)
    chosen = (pages.filter(F.length(raw) <= max_chars).select(raw.alias("html"))
              .orderBy(F.xxhash64("html"), "html").limit(rows).collect())
    draw, seen = random.Random(11), []
    for row in chosen:
        blocks = leaf_blocks(row["html"])
        if blocks:
            seen += [blocks, *(_renamed(blocks, draw) for _ in range(3))]
    features = Features()
    labels = [np.array([named_label(p) for p, _, _ in b]) for b in seen]
    return fit_network([features.page(b) for b in seen], labels)


def extract_text(pages: DataFrame, model: Labeller, html_column: str = "html") -> DataFrame:
    """``pages`` with ``main_text``: the blocks labelled main text, in page order, one per line.

    Null or empty pages, and pages without such a block, give an empty text. Rows are independent,
    so repeated rows and an empty table need no rule. If ``pages`` has a column ``main_text``, the
    new one is ``main_text_``."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, features = sent.value, Features()
        for raw in batches:
            texts: list[str] = []
            for at in range(0, len(raw), 256):
                blocks = [leaf_blocks(page) if page else [] for page in raw.iloc[at:at + 256]]
                probabilities = block_probabilities([features.page(b) for b in blocks], model)
                texts += ["\n".join(t for (_, t, _), q in zip(b, p, strict=True) if q >= 0.5)
                          for b, p in zip(blocks, probabilities, strict=True)]
            yield pd.Series(texts, dtype=object)

    udf = F.pandas_udf(label, "string")
    return bounded_batches(pages).withColumn(free_name(pages, "main_text"), udf(F.col(html_column)))
