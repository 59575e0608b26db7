"""Quality classifier: a generalised additive model with pairwise interactions.

Each document is described by numbers taken from its whole text in one pass. Each number is cut into bins at quantiles of the
training rows. Cyclic boosting visits the features in turn, and each visit fits a shallow tree (two cuts at most) on one
feature to the current residuals and adds it to that feature's lookup table. Then the pairs of features whose best
two-by-two split of the residuals gains most are boosted in the same way, with trees of one cut in each of two features, into
two-dimensional tables. A score is the logistic of the intercept plus one table entry per feature and pair: vectorised
bin additions, whatever the number of trees.

Training uses at most ``most_rows`` labelled rows (TRAIN_ROWS by default), picked by a hash of their id; so the driver
holds a bounded table of numbers. Everything else covers all rows.

Cases: null and empty texts have the number 0 in every feature and are scored as any others. Without a labelled row the score
is 0.5; with one class only it is near that class. Rows are scored one by one. Columns of the input that have a result's
name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, text_batches
from .shingles import word_hashes

TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 60
PAIRS = 6
PAIR_ROUNDS = 20
RATE = 0.1
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "word_length", "upper", "digits", "spaces", "newlines", "exclaim", "bars", "symbols", "stops", "commas", "other_marks",
    "non_ascii", "distinct_words", "capital_words", "long_words", "repeated_lines", "line_length", "short_words", "marked_words",
)
_UPPER, _LOWER, _DIGIT, _SPACE, _NEWLINE, _EXCLAIM, _BAR, _SYMBOL, _STOP, _COMMA, _MARK = range(1, 12)
_classes: list[np.ndarray] = []


def _char_classes() -> np.ndarray:
    if not _classes:
        table = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x3000):
            c = chr(i)
            table[i] = (
                _NEWLINE if c == "\n" else _SPACE if c.isspace() else _DIGIT if c.isdigit() else _UPPER if c.isupper() else _LOWER if c.isalpha() else _EXCLAIM if c in "!?"
                else _BAR if c == "|" else _STOP if c in ".;:" else _COMMA if c in ",'\"-()" else _SYMBOL if c in "#$%&*@^~<>{}[]\\/_=+`" else _MARK
            )
        table[0x3000:] = _LOWER
        table[0xFF00:] = _MARK
        _classes.append(table)
    return _classes[0]


def features(texts: list[str | None]) -> np.ndarray:
    """(n x features)"""
    n = len(texts)
    points, ends = code_points([f"{t or ''} " for t in texts])  # the space ends the last word
    kinds = _char_classes()[points]
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    counts = np.bincount(owner * 16 + kinds, minlength=16 * n).reshape(n, 16).astype(float)
    counts[:, _SPACE] -= 1
    chars = np.diff(ends) - 1.0
    blank = (kinds == _SPACE) | (kinds == _NEWLINE)
    edge = np.diff((~blank).astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word_of = owner[start]
    words = np.bincount(word_of, minlength=n).astype(float)
    length = stop - start
    hashes, offsets = word_hashes(texts)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((hashes, text_of))
    h, t = hashes[order], text_of[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[fresh], minlength=n).astype(float)
    lines = counts[:, _NEWLINE] + 1
    repeated = np.zeros(n)
    for i in np.flatnonzero(counts[:, _NEWLINE] > 0).tolist():
        own = texts[i].split("\n")
        repeated[i] = 1 - len(set(own)) / len(own)
    safe, w = np.maximum(chars, 1), np.maximum(words, 1)
    last = kinds[np.maximum(stop - 1, 0)]
    share = lambda mask: np.bincount(word_of, weights=mask, minlength=n) / w
    letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1)
    columns = [
        np.log1p(chars), np.bincount(word_of, weights=length, minlength=n) / w, counts[:, _UPPER] / letters, counts[:, _DIGIT] / safe, counts[:, _SPACE] / safe, counts[:, _NEWLINE] / w,
        counts[:, _EXCLAIM] / w, counts[:, _BAR] / w, counts[:, _SYMBOL] / w, counts[:, _STOP] / w, counts[:, _COMMA] / w, counts[:, _MARK] / w,
        np.bincount(owner, weights=points > 127, minlength=n) / safe, distinct / w, share(kinds[start] == _UPPER), share(length > 12), repeated, np.log1p(chars / lines),
        share(length <= 3), share((last != _LOWER) & (last != _UPPER)),
    ]
    out = np.stack(columns, axis=1)
    out[chars <= 0] = 0.0
    return out


@dataclass
class Gam:
    """Lookup tables; their size is fixed by BINS, the features and PAIRS."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), dtype=int)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        for i, j, table in self.pairs:
            total += table[bins[:, i], bins[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logit(self.bins(x)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton leaf values of a shallow tree over ordered bins with gradient sums g and curvature sums h."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    parts = [(0, len(g))]
    for _ in range(depth):
        best = None
        for a, b in parts:
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if not len(cg):
                continue
            tg, th = g[a:b].sum(), h[a:b].sum()
            gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], a, b, a + k + 1)
        if best is None:
            break
        _, a, b, k = best
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
        for s, e in ((a, k), (k, b)):
            out[s:e] = g[s:e].sum() / (h[s:e].sum() + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, table) of the best tree with one cut in each of two features, over a grid of sums."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best_gain, best = 0.0, np.zeros_like(g)
    tg, th = cg[-1, -1], ch[-1, -1]
    a_g, a_h, b_g, b_h = cg[:-1, :-1], ch[:-1, :-1], cg[:-1, -1:], ch[:-1, -1:]
    c_g, c_h = cg[-1:, :-1], ch[-1:, :-1]
    q = [(a_g, a_h), (b_g - a_g, b_h - a_h), (c_g - a_g, c_h - a_h), (tg - b_g - c_g + a_g, th - b_h - c_h + a_h)]
    gain = sum(x**2 / (np.maximum(y, 0) + 1) for x, y in q) - tg**2 / (th + 1)
    if gain.size:
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] > 1e-9:
            best_gain = float(gain[i, j])
            leaf = [float(x[i, j] / (max(y[i, j], 0) + 1)) for x, y in q]
            best[: i + 1, : j + 1], best[: i + 1, j + 1 :], best[i + 1 :, : j + 1], best[i + 1 :, j + 1 :] = leaf
    return best_gain, best


def train(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Gam:
    """Fits to rows x features ``x`` and labels ``y`` (0 or 1)."""
    model = Gam()
    if not len(y):
        return model
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model.intercept = float(np.log(p / (1 - p)))
    for k in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])))
        model.tables.append(np.zeros(len(model.cuts[-1]) + 1))
    b = model.bins(x)
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            q = _logistic(z)
            step = rate * _tree(np.bincount(b[:, k], weights=y - q, minlength=len(table)), np.bincount(b[:, k], weights=q * (1 - q), minlength=len(table)))
            table += step
            z += step[b[:, k]]
    q = _logistic(z)
    grid = lambda i, j, w: np.bincount(b[:, i] * len(model.tables[j]) + b[:, j], weights=w, minlength=len(model.tables[i]) * len(model.tables[j])).reshape(len(model.tables[i]), -1)
    gains = [(_cross(grid(i, j, y - q), grid(i, j, q * (1 - q)))[0], i, j) for i in range(len(model.tables)) for j in range(i)]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            q = _logistic(z)
            step = rate * _cross(grid(i, j, y - q), grid(i, j, q * (1 - q)))[1]
            table += step
            z += step[b[:, i], b[:, j]]
    return model


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text and with array column ``__features``."""

    @F.pandas_udf("array<double>")
    def numbers(column: pd.Series) -> pd.Series:
        texts = column.tolist()
        return pd.Series([row for a, b in text_batches(texts) for row in features(texts[a:b])], dtype=object)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], numbers(F.col(text)).alias("__features"))


def fit(described: DataFrame, label: str, most_rows: int = TRAIN_ROWS) -> Gam:
    """Learn from at most ``most_rows`` described rows with a label of 0 or 1."""
    rows = described.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("y"), "__features")
    # a threshold on the hash picks about as many rows as are wanted in each task, so no task sends a whole sample of its own
    share = min(1.0, 0.98 * most_rows / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = rows.where(place < int(share * (1 << 30))).select(place.alias("h"), "doc_id", "y", "__features").collect()
    some = sorted(some, key=lambda r: (r["h"], r["doc_id"] or 0, r["y"]))[:most_rows]
    x = np.array([r["__features"] for r in some], dtype=float).reshape(len(some), len(FEATURES))
    return train(x, np.array([r["y"] for r in some], dtype=float))


def score(described: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """``described`` with score and predicted in place of the features."""

    @F.pandas_udf("double")
    def judge(column: pd.Series) -> pd.Series:
        x = np.stack(column.tolist()) if len(column) else np.zeros((0, len(FEATURES)))
        return pd.Series(model.score(x))

    kept = [F.col(f"`{c}`") for c in described.columns if c not in ("__features", "score", "predicted")]
    scored = described.select(*kept, judge(F.col("__features")).alias("score"))
    return scored.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
