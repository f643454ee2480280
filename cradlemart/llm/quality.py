"""Quality classifier: a generalised additive model with pairwise interactions.

The model is learned by boosting in cycles: feature after feature, a shallow tree over the feature's
bins is fitted to the current residuals and added to that feature's table; then the pairs of
features that explain most of what is left get tables of their own in the same way. A score is the
sum of the tables' entries, one per feature and pair, through the logistic function, so scoring is a
look-up and an addition per bin for whole batches at once.

Features are counted over the whole text in one pass over Spark's partitions. The model is fitted on
the driver, on at most ``sample_rows`` labelled rows chosen by a hash of their id; the sample is
the only thing that is bounded.

Rules for odd input: null and empty texts have features of their own (no words) and are scored like
all others; rows with a null label or a null id are not learned from; rows that repeat an id are
scored each by their own text; without labels of both kinds every text scores 1. Empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, stored
from .tokens import SPACED, text_buffers, words

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "bytes", "words", "word_length", "upper", "symbols", "marks", "pipes", "digits", "non_ascii", "distinct_words",
    "repeats_in_row", "top_word", "line_length", "repeated_lines", "marked_words", "sentences",
)


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_UPPER = _byte_set(bytes(range(65, 91)))
_LETTER = _UPPER | _byte_set(bytes(range(97, 123)))
_SYMBOL = _byte_set(b"#$%&*+<=>@^_~`\\{}[]/")
_MARK = _byte_set(b"!?")
_PIPE = _byte_set(b"|")
_DIGIT = _byte_set(b"0123456789")
_STOP = _byte_set(b".!?")
_ODD_END = _byte_set(b"#$%&*+<=>@^_~|!\\{}[]/")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for every text of a batch."""
    data, all_bounds = text_buffers(column)
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for w in words(column, SPACED):
        n_texts = len(w.bounds) - 1
        low = int(all_bounds[w.first])
        raw = data[low : low + len(w.data)]
        size = np.maximum(np.diff(w.bounds), 1).astype(float)
        n_words = np.diff(w.offsets).astype(float)
        some = np.maximum(n_words, 1)
        letters = np.maximum(_sums(_LETTER[raw], w.bounds), 1)
        odd_end = _ODD_END[raw[np.maximum(w.end - 1, 0)]] if len(w.end) else np.zeros(0, bool)
        same = np.zeros(len(w.hash), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        firsts = w.offsets[:-1]
        same[firsts[firsts < len(same)]] = False
        distinct, top, lines, repeated = np.zeros(n_texts), np.zeros(n_texts), np.ones(n_texts), np.zeros(n_texts)
        breaks = np.flatnonzero(raw == 10)
        cut = np.searchsorted(breaks, w.bounds)
        for i in range(n_texts):
            _, counts = np.unique(w.hash[w.offsets[i] : w.offsets[i + 1]], return_counts=True)
            distinct[i] = len(counts)
            top[i] = counts.max() if len(counts) else 0
            if cut[i + 1] > cut[i]:
                parts = raw[w.bounds[i] : w.bounds[i + 1]].tobytes().split(b"\n")
                lines[i] = len(parts)
                repeated[i] = 1 - len(set(parts)) / len(parts)
        columns = (
            np.log1p(np.diff(w.bounds)), np.log1p(n_words), _sums(w.end - w.start, w.offsets) / some,
            _sums(_UPPER[raw], w.bounds) / letters, _sums(_SYMBOL[raw], w.bounds) / size,
            _sums(_MARK[raw], w.bounds) / some, _sums(_PIPE[raw], w.bounds) / some, _sums(_DIGIT[raw], w.bounds) / size,
            _sums(raw >= 128, w.bounds) / size, distinct / some, _sums(same, w.offsets) / some, top / some,
            np.log1p(size / lines), repeated, _sums(odd_end, w.offsets) / some, _sums(_STOP[raw], w.bounds) / some,
        )
        out[w.first : w.first + n_texts] = np.stack(columns, axis=1)
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """(id, features) for (id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = text_features(batch.column(1))
            flat = pa.array(values.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "features"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, features array<float>")


class Model(NamedTuple):
    """Cut points and tables per feature, and tables per pair of features over coarser cuts."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], "right")]
        for (a, b), table in self.pairs.items():
            at = np.searchsorted(self.coarse[a], x[:, a], "right")
            total += table[at, np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; place 0 is no cut."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    best = int(np.argmax(gain))
    return (float(gain[best]), best + 1) if gain[best] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """Leaf values of a tree of cuts over ordered bins, per bin."""
    _, cut = _best_split(g, h, ridge) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:cut], h[:cut], ridge, depth - 1), _tree(g[cut:], h[cut:], ridge, depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree with one cut in one feature and one in the other on each side."""
    best, leaves = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            gain, value = 0.0, np.zeros_like(gg)
            for side in (slice(None, cut), slice(cut, None)):
                gs, hs = gg[side].sum(axis=0), hh[side].sum(axis=0)
                gain += _best_split(gs, hs, ridge)[0] + gs.sum() ** 2 / (hs.sum() + ridge)
                value[side] = _tree(gs, hs, ridge, 1)
            if gain > best:
                best, leaves = gain, value.T if turned else value
    return best, leaves


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 60, pair_rounds: int = 20,
    n_pairs: int = 6, rate: float = 0.15, ridge: float = 5.0,
) -> Model:
    """Boost the tables of single features in cycles, then those of the strongest pairs."""
    y = y.astype(float)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(
        float(np.log(share / (1 - share))),
        [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])], [],
        [np.unique(np.quantile(x[:, j], np.linspace(0, 1, coarse_bins + 1)[1:-1])) for j in range(x.shape[1])], {},
    )
    model.tables.extend(np.zeros(len(c) + 1) for c in model.cuts)
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.coarse)]
    logit = np.full(len(y), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = residuals()
            step = rate * _tree(
                np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), ridge, 2
            )
            table += step
            logit += step[at[j]]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = residuals()
    gains = {
        (a, b): _grid_tree(grid(a, b, g), grid(a, b, h), ridge)[0] for a, b in combinations(range(x.shape[1]), 2)
    }
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]:
        model.pairs[pair] = np.zeros((len(model.coarse[pair[0]]) + 1, len(model.coarse[pair[1]]) + 1))
    for _ in range(pair_rounds):
        for (a, b), table in model.pairs.items():
            g, h = residuals()
            step = rate * _grid_tree(grid(a, b, g), grid(a, b, h), ridge)[1]
            table += step
            logit += step[coarse[a], coarse[b]]
    return model


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit_on_labels(features: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | float:
    """The model from at most ``sample_rows`` labelled rows. Labels of one kind only give that kind as
    the score of every text (1.0 without any label: nothing speaks against a text)."""
    labels = labels.where("id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("id")))
    labels = labels.groupBy("id").agg(F.max("label").alias("label"))
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 12), 16, 10).cast("bigint") / F.lit(float(2**48))
    rows = stored(features.join(labels, "id").select("features", "label", draw.alias("draw")))
    # About this share of the rows, whatever their number: only the sample itself goes to the driver.
    share = 0.98 * sample_rows / max(1, rows.count())
    sample = rows.where(F.col("draw") < share).limit(sample_rows).toPandas()
    sample = sample.iloc[sorted(range(len(sample)), key=lambda i: (sample["draw"][i], tuple(sample["features"][i])))]
    if sample["label"].nunique() < 2:
        return float((sample["label"] > 0).all())
    return fit(np.array(sample["features"].tolist(), np.float32), (sample["label"] > 0).to_numpy())


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: id, held_out, score."""
    features = stored(with_features(only(docs, id=id_col, text=text_col)))
    model = fit_on_labels(features, only(labels, id=label_id_col, label=label_col), sample_rows)
    return score_features(features, model).select("id", held_out(F.col("id")).alias("held_out"), "score")


def score_features(features: DataFrame, model: Model | float) -> DataFrame:
    if isinstance(model, float):
        return features.select("id", F.lit(model).alias("score"))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.stack(values.to_numpy()).astype(np.float32)))

    return features.select("id", score("features").alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose text scores at least the threshold; all columns, rows told apart by their own text."""
    features = stored(with_features(only(docs, id=id_col, text=text_col)))
    model = fit_on_labels(features, only(labels, id="doc_id", label="quality"))
    if isinstance(model, float):
        return docs if model >= THRESHOLD else docs.limit(0)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text_features(pa.array(texts, pa.string()))), dtype=float)

    return docs.where(score(docs[f"`{text_col}`"]) >= THRESHOLD)
