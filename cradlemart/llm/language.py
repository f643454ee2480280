"""Language identification in two steps: first the family, then the language within it.

Texts become counts of hashed byte n-grams (2 to 4 bytes, everything but letters as blank) and
words. The languages of the training rows are grouped to families by their mean profiles: the most
alike groups are merged until about the square root of their number is left. A linear support vector
machine per family picks the family; within it every pair of languages has a machine of its own, and
the language with most votes wins. All machines are one weight table, so a text's decision values
are sums of table rows over its n-grams.

Training uses about ``per_language`` rows of each language, chosen by a hash of their id, as whole
texts and as short cuts of them; it runs on the driver. Prediction reads every whole text on Spark's
partitions.

Rules for odd input: null, empty and letterless texts are ``und`` with score 0, as is everything
when there is nothing to learn from; one language only is always predicted; ties go to the name that
sorts first. Rows with a null language are not learned from. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only
from .tokens import LETTERS, Words, words

BITS = 15
ORDERS = (2, 3, 4)
PER_LANGUAGE = 500
MAX_LANGUAGES = 1000
CUTS = 3  # short cuts of each training text
UNKNOWN = "und"

_GRAM = np.arange(256, dtype=np.uint32)
_GRAM[~LETTERS] = 32
_GRAM[48:58] = 32
_ALPHA = LETTERS.copy()
_ALPHA[48:58] = False


def _grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the table row of the n-gram that starts at every byte."""
    codes = _GRAM[data]
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        packed = np.zeros(n, np.uint32)
        for j in range(order):
            packed = (packed << np.uint32(8)) | codes[j : j + n]
        yield order, ((packed + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _vector(data: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows and shares of a piece of text."""
    rows = [r for _, r in _grams(data)] + [_word_rows(hashes)] * 2
    found, counts = np.unique(np.concatenate(rows).astype(np.int32), return_counts=True)
    return found, (counts / max(counts.sum(), 1)).astype(np.float32)


def _word_rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.uint32)


def _examples(docs: DataFrame) -> DataFrame:
    """(lang, rows, shares) of whole texts and of short cuts, for (id, text, lang)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_pylist()
            out: dict[str, list] = {"lang": [], "rows": [], "shares": []}
            for w in words(batch.column(1), LETTERS):
                for i in range(len(w.bounds) - 1):
                    for data, hashes in _cuts(w, i):
                        if len(data):
                            found, shares = _vector(data, hashes)
                            out["lang"].append(langs[w.first + i])
                            out["rows"].append(found)
                            out["shares"].append(shares)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["rows"], pa.list_(pa.int32())),
                 pa.array(out["shares"], pa.list_(pa.float32()))],
                names=["lang", "rows", "shares"],
            )

    return docs.select("id", "text", "lang").mapInArrow(rows, "lang string, rows array<int>, shares array<float>")


def _cuts(w: Words, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    low, high = int(w.offsets[i]), int(w.offsets[i + 1])
    yield w.data[w.bounds[i] : w.bounds[i + 1]], w.hash[low:high]
    for k in range(CUTS):
        length = 3 + 3 * k
        if high - low > length:
            at = low + (high - low - length) * (k + 1) // (CUTS + 1)
            yield w.data[w.start[at] : w.end[at + length - 1]], w.hash[at : at + length]


def _machine(xs: list, y: np.ndarray, epochs: int = 12, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine, by dual coordinate ascent; y is +1 or -1."""
    w, bias = np.zeros(1 << BITS, np.float32), 0.0
    alpha = np.zeros(len(y))
    weight = np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1)) * c
    norms = np.array([float(v @ v) + 1.0 for _, v in xs])
    order = np.random.RandomState(11)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            rows, v = xs[i]
            gap = y[i] * (float(w[rows] @ v) + bias) - 1
            new = min(max(alpha[i] - gap / norms[i], 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows] += np.float32(step) * v
                bias += step
                alpha[i] = new
    return w, bias


class Model(NamedTuple):
    families: list[list[str]]
    pairs: list[list[tuple[int, int, int]]]  # per family: (first, second, machine)
    weights: np.ndarray  # table row by machine; the first machines are those of the families
    bias: np.ndarray

    def decide(self, values: np.ndarray) -> tuple[str, float]:
        """Language and score from the machines' values for one text."""
        family, sure = 0, 1.0
        if len(self.families) > 1:
            margins = values[: len(self.families)]
            family = int(np.argmax(margins))
            rest = np.delete(margins, family).max()
            sure = _logistic(margins[family] - rest)
        names = self.families[family]
        votes, strength = np.zeros(len(names)), np.zeros(len(names))
        for a, b, m in self.pairs[family]:
            votes[a if values[m] >= 0 else b] += 1
            strength[a] += values[m]
            strength[b] -= values[m]
        best = max(range(len(names)), key=lambda i: (votes[i], strength[i], -i))
        inside = min([1.0, *(_logistic(values[m] if a == best else -values[m]) for a, b, m in self.pairs[family] if best in (a, b))])
        return names[best], float(sure * inside)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * x, -30, 30))))


SCALE = 30.0  # shares of n-grams are small; scaled so that margins are of the order of one


def fit(langs: list[str], examples: list[tuple[np.ndarray, np.ndarray]]) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    xs = [(r, v * np.float32(SCALE)) for r, v in examples]
    profiles = {}
    for name in names:
        total = np.zeros(1 << BITS)
        for lang, (r, v) in zip(langs, xs, strict=True):
            if lang == name:
                total[r] += v
        profiles[name] = np.sqrt(total / max(total.sum(), 1e-9))
    families = [[n] for n in names]
    while len(families) > max(1, round(len(names) ** 0.5)):
        alike = {
            (a, b): np.mean([profiles[m] @ profiles[n] for m in families[a] for n in families[b]])
            for a, b in combinations(range(len(families)), 2)
        }
        a, b = max(alike, key=lambda k: (alike[k], -k[0], -k[1]))
        families[a] = sorted(families[a] + families[b])
        del families[b]
    of = {n: k for k, members in enumerate(families) for n in members}
    machines = []
    if len(families) > 1:
        for k in range(len(families)):
            machines.append(_machine(xs, np.array([1.0 if of[n] == k else -1.0 for n in langs])))
    pairs: list[list[tuple[int, int, int]]] = []
    for members in families:
        pairs.append([])
        for a, b in combinations(range(len(members)), 2):
            use = [i for i, n in enumerate(langs) if n in (members[a], members[b])]
            y = np.array([1.0 if langs[i] == members[a] else -1.0 for i in use])
            pairs[-1].append((a, b, len(machines)))
            machines.append(_machine([xs[i] for i in use], y))
    if not machines:
        return Model(families, pairs, np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    return Model(families, pairs, np.stack([w for w, _ in machines], axis=1) * np.float32(SCALE),
                 np.array([b for _, b in machines]))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on about ``per_language`` rows of each language of (id, text, lang)."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    order = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("bigint")
    # One row for each language, for each of which the model has machines of its own: so few that they may be broadcast.
    if counts.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to tell apart")
    chosen = rows.join(F.broadcast(counts), "lang").where(order / F.lit(float(2**48)) * F.col("n") < per_language)
    sample = _examples(chosen).toArrow().combine_chunks()
    langs = sample["lang"].to_pylist()
    examples = [(r.values.to_numpy(), v.values.to_numpy()) for r, v in zip(sample["rows"], sample["shares"], strict=True)]
    order = sorted(range(len(langs)), key=lambda i: (langs[i], examples[i][0].tobytes(), examples[i][1].tobytes()))
    return fit([langs[i] for i in order], [examples[i] for i in order])


def _has_letter(text: np.ndarray) -> bool:
    return any(c.isalpha() for c in text.tobytes().decode("utf-8", "ignore"))


def predict_column(column: pa.Array, model: Model | None) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(column), [0.0] * len(column)
    if model is None:
        return langs, scores
    machines = model.weights.shape[1]
    for w in words(column, LETTERS):
        n = len(w.bounds) - 1
        sums, counts = np.zeros((n, machines)), np.zeros(n)
        for order, rows in _grams(w.data):
            ends = np.maximum(w.bounds[1:] - order + 1, w.bounds[:-1])
            counts += ends - w.bounds[:-1]
            for m in range(machines):
                total = np.zeros(len(w.data) + 1)
                np.cumsum(model.weights[rows, m], out=total[1 : len(rows) + 1], dtype=np.float64)
                sums[:, m] += total[ends] - total[w.bounds[:-1]]
        rows = _word_rows(w.hash)
        counts += 2 * np.diff(w.offsets)
        for m in range(machines):
            total = np.zeros(len(rows) + 1)
            np.cumsum(model.weights[rows, m], out=total[1:], dtype=np.float64)
            sums[:, m] += 2 * np.diff(total[w.offsets])
        values = sums / np.maximum(counts, 1)[:, None] + model.bias
        letters = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_ALPHA[w.data] & (w.data < 128), out=letters[1:])
        plain = np.diff(letters[w.bounds])
        for i in range(n):
            if plain[i] or _has_letter(w.data[w.bounds[i] : w.bounds[i + 1]]):
                langs[w.first + i], scores[w.first + i] = model.decide(values[i])
    return langs, scores


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; held-out rows are never learned from."""
    rows = only(docs, id=id_col, text=text_col, lang=lang_col)
    model = learn(rows.where(~held_out(F.col("id"))), per_language)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_column(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "text").mapInArrow(predicted, f"id {kind}, lang_pred string, score double")
    return out.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
