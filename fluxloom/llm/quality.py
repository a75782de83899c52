"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Every text becomes a row of statistics (`FEATURES`) in one pass; they are written, a few numbers per document. The
labelled rows that are allowed for learning are joined to them; the first ``max_rows`` in the order of an md5 draw of
the key are the training sample, the one bounded part (its bound is a parameter, it does not grow with the corpus).
Trees are grown on the driver from histograms of binned values, by logistic loss with second-order gains, then
flattened into arrays of feature, threshold, children and value. Tasks move all rows of a batch down all levels of a
tree at once in numpy. Scores depend on the statistics alone.

A null text counts as empty; empty texts are scored like any other. Without labels every score is 0.5. With labels of one
class only, the score is the share of the class with one row added to either side. Repeated rows repeat their
scores, repeated labels count as often as they are given. Rows travel as a struct, so their columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.functions.draws import draw
from fluxloom.llm.common import WORD, slices, texts_of
from fluxloom.session import settle

FEATURES = ("chars", "words", "lines", "chars_per_word", "words_per_line", "symbols", "marks", "upper", "digits",
            "stops", "bars", "other_ascii", "beyond_ascii", "spaces", "distinct_words", "top_word", "distinct_pairs",
            "distinct_lines", "capital_words", "upper_words", "odd_words", "long_words", "longest_word", "word_spread")
MAX_ROWS = 50_000
SEED = 5

_word = re.compile(WORD)
_odd = re.compile(r"[^\w\s.,;:'()\"-]")


def _class(*characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    for c in characters:
        for x in c:
            found[ord(x)] = True
    return found


_CLASSES = (
    _class("#*$%&<>@^~_=+\\/{}[]`"), _class("!?"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"),
    _class(".,;:'\"()-"), _class("|"),
)
_LETTERS = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SPACES = _class(" \t\n\r\x0b\x0c")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of `FEATURES`. Shares are of characters (bytes) or words."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    words = _word.findall(text)
    lines = [line for line in text.split("\n") if line.strip()]
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    parts = [float(raw[c].sum()) / size for c in _CLASSES]
    known = sum(parts) + float(raw[_LETTERS & ~_CLASSES[2]].sum() + raw[_SPACES].sum()) / size
    beyond = float(raw[128:].sum()) / size
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(len(lines))), float(lengths.mean()),
        len(words) / max(1, len(lines)), *parts, max(0.0, 1 - known - beyond), beyond,
        float(raw[_SPACES].sum()) / size, len(counts) / n, max(counts.values(), default=0) / n,
        pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)),
        sum(w[0].isupper() for w in words) / n, sum(len(w) > 1 and w.isupper() for w in words) / n,
        sum(_odd.search(w) is not None for w in counts) / max(1, len(counts)), float((lengths > 15).sum()) / n,
        float(np.log1p(lengths.max())), float(lengths.std()),
    ]


@dataclass(frozen=True)
class Growth:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    min_weight: float = 2.0


@dataclass
class Forest:
    """Trees as arrays, all with ``2 ** (depth + 1) - 1`` places: children of place i are 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, growth: Growth = Growth()) -> Forest:
    """Boosted trees. Rows that end early go on down a place whose threshold sends all of them left."""
    places, inner = 2 ** (growth.depth + 1) - 1, 2**growth.depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)),
                    np.zeros((0, places)), growth.depth)
    if len(y) == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, growth.bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(edge, column, "left") for edge, column in zip(edges, x.T, strict=True)], 1)
    width = growth.bins
    cells = binned + np.arange(x.shape[1]) * width
    total = np.full(len(y), forest.start)
    features, thresholds, values = [], [], []
    for _ in range(growth.trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(places)
        for place in range(inner):
            here = np.flatnonzero(at == place)
            if len(here) == 0:
                continue
            flat = cells[here].ravel()
            size = x.shape[1] * width
            g = np.bincount(flat, np.repeat(gradient[here], x.shape[1]), size).reshape(-1, width)
            h = np.bincount(flat, np.repeat(weight[here], x.shape[1]), size).reshape(-1, width)
            gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
            gt, ht = gradient[here].sum(), weight[here].sum()
            gain = (gl**2 / (hl + growth.ridge) + (gt - gl) ** 2 / (ht - hl + growth.ridge)
                    - gt**2 / (ht + growth.ridge))
            gain[(hl < growth.min_weight) | (ht - hl < growth.min_weight)] = -np.inf
            best = int(gain.argmax())
            f, cut = divmod(best, width - 1)
            left = np.ones(len(here), bool)
            if gain[f, cut] > 1e-9 and cut < len(edges[f]):
                feature[place], threshold[place] = f, edges[f][cut]
                left = binned[here, f] <= cut
            at[here] = 2 * place + 2 - left
        for place in range(inner, places):
            here = at == place
            if here.any():
                value[place] = -growth.rate * gradient[here].sum() / (weight[here].sum() + growth.ridge)
        total += value[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    forest.feature, forest.threshold, forest.value = np.array(features), np.array(thresholds), np.array(values)
    return forest


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row without its text as ``row``, and its ``statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = pa.array([statistics(t) for t in texts_of(part)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["row", "statistics"])

    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("statistics", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
        max_rows: int = MAX_ROWS, growth: Growth = Growth()) -> Forest:
    """Trees from measured rows whose key has a label."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("labelled"), F.col(label).alias("label"))
    sample = (measured.join(known, F.col(f"row.{key}") == F.col("labelled"))
              .select(draw(SEED, F.col("labelled").cast("string")).alias("draw"), "label", "statistics")
              .orderBy("draw", "label", "statistics").limit(max_rows).toArrow())
    x = np.array(sample["statistics"].to_pylist(), float).reshape(sample.num_rows, len(FEATURES))
    return grow(x, np.array(sample["label"].to_pylist(), float))


def score(measured: DataFrame, forest: Forest) -> DataFrame:
    """Every measured row with its ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(x))], ["row", "score"])

    schema = T.StructType([measured.schema["row"], T.StructField("score", T.DoubleType())])
    return measured.select("row", "statistics").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, learn_from: str = "true", key: str = "doc_id", text: str = "text",
             label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """Measures all rows, learns from those for which the condition ``learn_from`` on ``row`` holds, scores all."""
    measured = settle(measure(docs, text), "statistics")
    return score(measured, fit(measured.filter(learn_from), labels, key, label, max_rows))
