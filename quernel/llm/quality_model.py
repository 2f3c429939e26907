"""Quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature after the other with a small step, so that each feature ends up with a
lookup table over its bins; then the pairs of features with the largest gain get tables over two binned features the same
way. A document is scored by adding up one entry for each table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, labelled, map_rows

#: Features of a text, in order; none of them looks at labels, language or source fields or ids.
FEATURES = ["words", "word_length", "longest_word", "symbol_rate", "digit_rate", "upper_rate", "comma_rate", "stop_rate", "mark_rate", "bar_rate", "bang_rate", "repeated_lines", "line_words", "distinct_words", "non_ascii", "function_words"]
#: Fixed list: frequent function words of the four languages.
FUNCTION = frozenset("the of and to in a is that it for with as on be by this are was from an or at le la les de des du et un une en est que qui dans pour par sur pas au aux avec der die das und in zu den von mit ist ein eine nicht für auf im dem sich el los las y en que es un una por con para no se del".split())
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
_SYMBOLS, _MARKS = b"#*$%&|<>", b"\"'()[]{}/\\_=+~^@-"
_FUNCTION_BYTES = frozenset(w.encode("utf-8") for w in FUNCTION)
_KEEP_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_KEEP_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)


def features(text: str | None) -> list[float]:
    """Whole texts; an empty one has zeros."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    count = lambda drop: size - len(raw.translate(None, drop))
    lines = [x for x in (y.strip() for y in raw.split(b"\n")) if x]
    distinct = set(words)
    function = sum(w in _FUNCTION_BYTES for w in words)
    return [
        float(n),
        (size - raw.count(b" ") - raw.count(b"\n")) / n,
        float(max(map(len, words))),
        count(_SYMBOLS) / n,
        len(raw.translate(None, _KEEP_DIGIT)) / n,
        len(raw.translate(None, _KEEP_UPPER)) / n,
        raw.count(b",") / n,
        raw.count(b".") / n,
        count(_MARKS) / n,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        n / max(1, len(lines)),
        len(distinct) / n,
        (size - len(text or "")) / n,
        function / n,
    ]


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner borders of each feature's bins, at quantiles of the sample."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], axis=1) if len(x) else np.empty((0, len(cuts)), np.int64)


def tree(gradient: np.ndarray, weight: np.ndarray, penalty: float = 5.0) -> np.ndarray:
    """The best tree of at most three leaves over the ordered bins of a feature, as a value for each bin."""
    g, h = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])
    n = len(gradient)
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + penalty)
    i, j = np.triu_indices(n + 1)
    best = int(np.argmax(gain(0, i) + gain(i, j) + gain(j, n)))
    out = np.empty(n)
    for a, b in ((0, i[best]), (i[best], j[best]), (j[best], n)):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + penalty)
    return out


def quadrants(gradient: np.ndarray, weight: np.ndarray, penalty: float = 5.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best split of a two-dimensional table into four quadrants."""
    g, h = np.zeros((gradient.shape[0] + 1, gradient.shape[1] + 1)), np.zeros((gradient.shape[0] + 1, gradient.shape[1] + 1))
    g[1:, 1:], h[1:, 1:] = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    parts = lambda s: (s, s[:, -1:] - s, s[-1:, :] - s, s[-1, -1] - s[:, -1:] - s[-1:, :] + s)
    gains = sum(a * a / (b + penalty) for a, b in zip(parts(g), parts(h), strict=True))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = [a[i, j] / (b[i, j] + penalty) for a, b in zip(parts(g), parts(h), strict=True) for a, b in [(np.broadcast_to(a, g.shape), np.broadcast_to(b, h.shape))]]
    out = np.empty(gradient.shape)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return float(gains[i, j]), out


class Additive:
    """An intercept, a table for each feature, and tables for some pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15):
        self.cuts, self.pair_cuts = cuts_of(x, BINS), cuts_of(x, PAIR_BINS)
        self.tables, self.pairs, self.pair_tables = [np.zeros(len(c) + 1) for c in self.cuts], [], []
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            return
        b, p = binned(x, self.cuts), binned(x, self.pair_cuts)
        z = np.full(len(y), self.base)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-z))
            return y - q, q * (1 - q)

        for _ in range(rounds):
            for f, t in enumerate(self.tables):
                g, h = slope()
                step = rate * tree(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)))
                t += step
                z += step[b[:, f]]
        shape = lambda i, j: (len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)

        def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, h = slope()
            cell, (a, c) = p[:, i] * shape(i, j)[1] + p[:, j], shape(i, j)
            return np.bincount(cell, g, a * c).reshape(a, c), np.bincount(cell, h, a * c).reshape(a, c), cell

        ranked = sorted(itertools.combinations(range(len(self.cuts)), 2), key=lambda ij: -quadrants(*sums(*ij)[:2])[0])
        self.pairs = ranked[:PAIRS]
        self.pair_tables = [np.zeros(shape(*ij)) for ij in self.pairs]
        for _ in range(rounds // 2):
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                g, h, cell = sums(i, j)
                step = rate * quadrants(g, h)[1]
                t += step
                z += step.ravel()[cell]

    def score(self, x: np.ndarray) -> np.ndarray:
        b, p = binned(x, self.cuts), binned(x, self.pair_cuts)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[p[:, i], p[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text") -> Additive:
    scratch = Scratch(docs.sparkSession)
    rows = labelled(docs, labels, "quality", 4, 2, most, text, scratch)
    found = map_rows(rows, lambda b: {"id": b.column(0), "x": [features(t) for t in b.column(1).to_pylist()], "y": b.column(2)}, "id bigint, x array<double>, y int").collect()  # `most` rows at most
    scratch.free(rows)
    found.sort(key=lambda r: r["id"])
    return Additive(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found], float))


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null and empty texts have zeros as features and a score like any
    other; whole texts, however long; repeated rows give repeated results; without labels of both kinds the score is one
    constant; other columns are ignored; an empty table gives an empty result."""
    model = fit(docs, labels, most, text)

    def run(batch: pa.RecordBatch) -> dict:
        p = model.score(np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES)))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": p, "predicted": (p >= 0.7).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows.withColumn("h", held_out(F.col("doc_id"), 4, 2)), run, "doc_id bigint, held_out boolean, score double, predicted int")
