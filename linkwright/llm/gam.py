"""Quality classifier (operator 7): a generalised additive model with
pairwise interactions.

Features are counts and shares of the whole text, computed in Arrow batches.
Each feature is cut into quantile bins. Training is cyclic boosting: in every
round each feature in turn gets a tree of at most three leaves over its bins,
fitted to the current gradient, whose leaf values are added to the feature's
lookup table. The strongest pairs of features then get two-dimensional tables
the same way, from trees with one cut per feature. A score is the sum of one
lookup per table through the logistic function.

Labels are read for training only, from at most ``MAX_TRAIN`` labelled rows in
hash order (the documented bound); rows whose crc32(doc_id as text) mod 5 is 0
are never among them. doc_id, lang and source are not features.

Defined results: null and empty texts score as a text without words; without
training rows every score is 0.5, with one class only the smoothed share of
label 1; labels null are ignored; a doc_id with several labels takes the
smallest, with several texts the text of smallest hash; a null doc_id is not
held out and trains nothing; repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, claim, prepare, shingle_hashes, take_columns, utf8_buffers, word_hashes

MAX_TRAIN = 20_000
MAX_BINS = 32
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
PAIR_BINS = 8
RATE = 0.15
RIDGE = 1.0
FOLD = 5
THRESHOLD = 0.3

FEATURES = ("log_words", "bytes_per_word", "symbols_per_word", "exclamations_per_word",
            "bars_per_word", "upper_share", "digits_per_word", "distinct_words",
            "distinct_trigrams", "lines_per_word", "top_word_share", "stops_per_word",
            "same_as_before", "wide_bytes")


def _class(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_SYMBOL, _BANG, _BAR = _class(b"#*$%&<>"), _class(b"!"), _class(b"|")
_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_DIGIT, _LINE, _STOP = _class(b"0123456789"), _class(b"\n"), _class(b".?;:")
_WIDE, _SPACE = np.arange(256) >= 128, _class(b" \t\n\x0b\x0c\r")


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    claim("gam")
    raw, offs = utf8_buffers(col)
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    hashes, first = word_hashes(raw, offs)
    masks = (_SYMBOL, _BANG, _BAR, _UPPER, _LOWER, _DIGIT, _LINE, _STOP, _WIDE, _SPACE)
    for r in range(n):
        text = raw[offs[r]:offs[r + 1]]
        seen = np.bincount(text, minlength=256)
        sym, bang, bar, up, low, dig, line, stop, wide, space = (int(seen[m].sum()) for m in masks)
        w = hashes[first[r]:first[r + 1]]
        words = max(1, len(w))
        top = distinct = 0
        if len(w):
            _, c = np.unique(w, return_counts=True)
            distinct, top = len(c), int(c.max())
        tri = shingle_hashes(w, 3)
        out[r] = (np.log1p(len(w)), (len(text) - space) / words, sym / words, bang / words, bar / words,
                  up / max(1, up + low), dig / words, distinct / words,
                  len(np.unique(tri)) / max(1, len(tri)), line / words, top / words, stop / words,
                  float((w[1:] == w[:-1]).sum()) / words if len(w) > 1 else 0.0,
                  wide / max(1, len(text)))
    return out


@dataclass
class Gam:
    """Lookup tables: ``edges[j]`` cuts feature j into bins for ``tables[j]``;
    pairs hold (j, k, coarse edges j, coarse edges k, table)."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            s += t[np.searchsorted(e, x[:, j], side="right")]
        for j, k, ej, ek, t in self.pairs:
            s += t[np.searchsorted(ej, x[:, j], side="right"), np.searchsorted(ek, x[:, k], side="right")]
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    q = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher") if len(x) else np.zeros(0)
    return np.unique(q)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of the best tree with at most three leaves."""
    def cut(a: int, b: int):
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if b - a < 2:
            return 0.0, a
        gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
        at = int(np.argmax(gain))
        return float(gain[at]), a + at + 1

    n = len(g)
    gain, at = cut(0, n)
    if gain <= 1e-9:
        return np.full(n, -g.sum() / (h.sum() + RIDGE))
    bounds = [0, at, n]
    (gl, al), (gr, ar) = cut(0, at), cut(at, n)
    if max(gl, gr) > 1e-9:
        bounds = sorted({*bounds, al if gl >= gr else ar})
    out = np.empty(n)
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(G: np.ndarray, H: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree with one cut per axis over a grid of gradient sums."""
    cg, ch = G.cumsum(0).cumsum(1), H.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    if a.size == 0:
        return 0.0, np.zeros_like(G)
    row_g, row_h, col_g, col_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    gain = (_gain(a, b) + _gain(row_g - a, row_h - b) + _gain(col_g - a, col_h - b)
            + _gain(tg - row_g - col_g + a, th - row_h - col_h + b) - _gain(tg, th))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(G)
    for ri in (slice(0, i + 1), slice(i + 1, None)):
        for cj in (slice(0, j + 1), slice(j + 1, None)):
            out[ri, cj] = -G[ri, cj].sum() / (H[ri, cj].sum() + RIDGE)
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the logistic loss."""
    n, d = len(y), x.shape[1] if x.ndim == 2 else 0
    if n == 0:
        return Gam()
    prior = (float(y.sum()) + 0.5) / (n + 1.0)
    m = Gam(float(np.log(prior / (1 - prior))))
    if y.min() == y.max():
        return m
    m.edges = [_edges(x[:, j], MAX_BINS) for j in range(d)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    s = np.full(n, m.intercept)

    def grads():
        p = 1.0 / (1.0 + np.exp(-s))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = grads()
            k = len(m.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, k), np.bincount(bins[j], h, k))
            m.tables[j] += step
            s += step[bins[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    cbin = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(j: int, k: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[j]) + 1, len(coarse[k]) + 1
        return np.bincount(cbin[j] * b + cbin[k], v, a * b).reshape(a, b)

    g, h = grads()
    ranked = sorted(((_quadrants(grid(j, k, g), grid(j, k, h))[0], j, k)
                     for j in range(d) for k in range(j)), reverse=True)[:PAIRS]
    tables = {(j, k): np.zeros((len(coarse[j]) + 1, len(coarse[k]) + 1)) for _, j, k in ranked}
    for _ in range(PAIR_ROUNDS):
        for (j, k), t in tables.items():
            g, h = grads()
            step = RATE * _quadrants(grid(j, k, g), grid(j, k, h))[1]
            t += step
            s += step[cbin[j], cbin[k]]
    m.pairs = [(j, k, coarse[j], coarse[k], t) for (j, k), t in tables.items()]
    return m


def fold(doc_id):
    """crc32 of the id as text, mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLD


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Gam:
    """Train on at most ``max_train`` labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    sample = (take_columns(labels, ["doc_id", "quality"])
              .where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    # at most max_train rows of two numbers, so broadcasting is bounded
    joined = take_columns(docs, ["doc_id", "text"]).join(F.broadcast(sample), "doc_id")
    feats = add_column(joined, "x", T.ArrayType(T.DoubleType()), "text", lambda c: features(c).tolist())
    rows = (feats.select("doc_id", "quality", F.struct(F.xxhash64("text").alias("h"), "x").alias("v"))
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("v").alias("v"))
            .select("doc_id", "quality", F.col("v.x").alias("x")).collect())
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return train(x, np.array([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """Every row of ``docs`` with its score from 0 to 1."""
    prepare(docs.sparkSession)
    return add_column(docs, name, T.DoubleType(), "text", lambda c: model.score(features(c)))
