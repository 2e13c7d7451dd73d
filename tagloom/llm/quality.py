"""Quality classifier: a generalised additive model with pairwise interactions.

Method: numeric features of the whole text are cut into bins. Boosted shallow
trees, one feature at a time in turn, add to that feature's lookup table; then the
pairs of features whose residuals interact most get two-way tables in the same
manner. A document is scored by adding up one table entry for each feature and
pair, over all documents of a batch at once.

The model is fitted on the driver to numeric features only, of at most ``max_rows``
labelled documents: those with the smallest hashes of their ids.

Defined cases: null text counts as empty, and an empty text has all features zero
and a score; labels other than 0 and 1 are left out; repeated rows are scored each
on their own; with no usable label every score is 0.5; extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

FEATURES = (
    "log_bytes", "log_words", "mean_word", "std_word", "long_words", "letters", "digits", "spaces", "punctuation", "symbols", "beyond_ascii", "upper",
    "log_lines", "mean_line", "repeated_lines", "distinct_words", "top_word", "repeated_pairs", "entropy", "sentence_marks", "word_symbols", "line_marks", "short_words", "compression",
)

_CLASSES = np.zeros((8, 256))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[0, _b] = _b < 128 and _c.isalpha()
    _CLASSES[1, _b] = 48 <= _b <= 57
    _CLASSES[2, _b] = _c in " \t\n\r\x0b\x0c"
    _CLASSES[3, _b] = _c in ".,;:!?'\"()-"
    _CLASSES[4, _b] = 32 < _b < 127 and not _c.isalnum() and _c not in ".,;:!?'\"()-"
    _CLASSES[5, _b] = _b >= 128
    _CLASSES[6, _b] = 65 <= _b <= 90
    _CLASSES[7, _b] = _c in ".!?"
_SYMBOLS = bytes(i for i in range(33, 127) if _CLASSES[4, i])


def features(text: bytes | None) -> list[float]:
    """The numbers named in FEATURES, from every byte of the text."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (_CLASSES @ counts) / n
    some = counts[counts > 0] / n
    words = text.split()
    lines = text.split(b"\n")
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(1 for w in tally if w.translate(None, _SYMBOLS) != w) / max(1, len(tally))
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes > 12).mean(), shares[0], shares[1], shares[2], shares[3], shares[4], shares[5], shares[6],
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(tally) / m, max(tally.values(), default=0) / m, 1 - pairs / max(1, len(words) - 1),
        float(-(some * np.log2(some)).sum()), shares[7], marked, sum(1 for x in lines if x[-1:] in (b".", b"!", b"?")) / len(lines), (sizes <= 3).mean(), len(zlib.compress(text, 1)) / n,
    ]


@dataclass
class Additive:
    """Tables of log odds: cuts[f] are bin edges of feature f; pair tables use coarser bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], side="right") for f in {f for pair in self.pairs for f in pair}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(slope: np.ndarray, weight: np.ndarray, splits: int, least: float) -> np.ndarray:
    """Step values of a shallow tree over ordered bins: Newton steps on the sides of the best splits."""
    parts = [(0, len(slope))]
    g, h = np.concatenate([[0], np.cumsum(slope)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            if len(cut):
                gain = np.where((h[cut] - h[a] >= least) & (h[b] - h[cut] >= least), worth(a, cut) + worth(cut, b) - worth(a, b), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (a, int(cut[i]), b))
        if best[1] is None:
            break
        a, c, b = best[1]
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(slope))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _quarters(slope: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps on the quarters of a two-way table, by the pair of cuts with the largest gain."""
    def corners(table):  # sums above and left of every pair of cuts, and of the other three quarters
        total = table.cumsum(0).cumsum(1)
        a = total[:-1, :-1]
        b, c = total[:-1, -1:] - a, total[-1:, :-1] - a
        return np.stack([a, b, c, total[-1, -1] - a - b - c])

    out = np.zeros_like(slope)
    if min(slope.shape) < 2:
        return out
    g, h = corners(slope), corners(weight)
    i, j = np.unravel_index(int((g**2 / (h + 4)).sum(axis=0).argmax()), g.shape[1:])
    values = g[:, i, j] / (h[:, i, j] + 4)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, pair_bins: int = 8, n_pairs: int = 12, rounds: int = 200, pair_rounds: int = 80, rate: float = 0.1, splits: int = 2, least: float = 2.0) -> Additive:
    """Boost the tables: all features in turn, each round; then the most promising pairs."""
    n_features = x.shape[1]
    y = y.astype(float)
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    cuts = [_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(n_features)]
    pair_cuts = [_edges(x[:, f], pair_bins) if len(x) else np.zeros(0) for f in range(n_features)]
    model = Additive(base, cuts, [np.zeros(len(c) + 1) for c in cuts], pair_cuts, [], [])
    if len(np.unique(y)) < 2:
        model.base = base if len(y) else 0.0
        return model
    placed = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(n_features)]
    coarse = [np.searchsorted(pair_cuts[f], x[:, f], side="right") for f in range(n_features)]
    odds = np.full(len(y), base)

    def gradient():
        p = 1 / (1 + np.exp(-odds))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(n_features):
            slope, weight = gradient()
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(placed[f], slope, n), np.bincount(placed[f], weight, n), splits, least)
            model.tables[f] += step
            odds += step[placed[f]]

    def cells(a, b, values):
        shape = (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    slope, weight = gradient()
    gains = []
    for a in range(n_features):
        for b in range(a + 1, n_features):
            g, h = cells(a, b, slope), cells(a, b, weight)
            gains.append((float((g**2 / (h + 4)).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, key=lambda t: (-t[0], t[1:]))[:n_pairs]]
    model.pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(model.pairs):
            slope, weight = gradient()
            g, h = cells(a, b, slope), cells(a, b, weight)
            step = _quarters(g, h)
            model.pair_tables[i] += rate * step
            odds += rate * step[coarse[a], coarse[b]]
    return model


_SCHEMA = ", ".join(f"{name} double" for name in FEATURES)


def feature_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of docs, and a double for each of FEATURES (columns of these names are replaced)."""
    others = [c for c in docs.columns if c != text_col and c not in FEATURES]

    def task(batches):
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(start, 512)
                x = np.array([features(t) for t in part.column("__text").cast(pa.binary()).to_pylist()], float).reshape(-1, len(FEATURES))
                kept = [part.column(c) for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x[:, f]) for f in range(len(FEATURES)))], [*(c for c in part.schema.names if c != "__text"), *FEATURES])

    rows = docs.select(*others, F.col(text_col).alias("__text"))
    schema = docs.select(*others).schema
    for name in FEATURES:
        schema = schema.add(name, "double")
    return map_arrow(rows, task, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> Additive:
    """Fit to labelled documents; pass only rows of labels that may be learned from."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(1)), "id", "label").limit(max_rows)  # the documented bound of the sample
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = feature_rows(texts.join(F.broadcast(chosen), "id")).toPandas()
    rows = rows.sort_values(["id", "label", *FEATURES])
    return fit(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(), **options)


def score(docs: DataFrame, model: Additive, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs but the text, with score and predicted (columns of these names are replaced)."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != text_col]

    def task(batches):
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(start, 512)
                x = np.array([features(t) for t in part.column("__text").cast(pa.binary()).to_pylist()], float).reshape(-1, len(FEATURES))
                scores = shared.value.scores(x)
                kept = [part.column(c) for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*(c for c in part.schema.names if c != "__text"), "score", "predicted"])

    schema = docs.select(*others).schema.add("score", "double").add("predicted", "integer")
    return map_arrow(docs.select(*others, F.col(text_col).alias("__text")), task, schema)
