"""Interpolated modified Kneser-Ney model of words, counted in Spark and mapped into memory by the workers that score.

Tokens are the words of a text, A-Z lower-cased, then one end; the model has order two, with a start before the first
word. A word is the first 56 bits of its hash.

1. Tasks count the pairs of their texts and hand them on by ranges of the first word's hash, as packed lists: a pair
   travels once per task, however frequent it is.
2. Every range is merged in one task: sorted hashes of pairs and their counts, and for each first word its total and
   how many words follow it once, twice, more often. These arrays are the model's files. Second words are handed on by
   ranges of their hash, with the number of different words before them, and merged the same way.
3. Discounts follow from the counts of counts, which are the only numbers that reach the driver.
4. Workers look up the sorted hashes of a slice of texts range by range. Files are mapped when a slice needs them, and
   a bounded number stays open (`shelf.Shelf`), however many ranges there are.

p(w | v) = max(c(vw) - D(c), 0) / c(v) + back(v) p(w); p(w) is the same formula over the number of different words before
w, with the uniform 1 / (V + 1) below it. The unknown word has the uniform's share. A word v that never stood before
another leaves all to p(w).

The order is two because the pairs of a corpus already take most of the disk that scoring may use. The files grow
with the corpus; a worker reads the pages that its texts need, in the order of the hash, from the shared folder.

A null text counts as empty: it has the end alone. Without any training text all probabilities are 1. Repeated rows
count and score like any others. Rows to score travel as a struct, their columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm import shelf
from fluxloom.llm.common import WORD, slices, texts_of
from fluxloom.llm.order_minhash import mix
from fluxloom.session import scratch_path

START, END = 1, 2
BITS = 56
# Bytes of training text per range of hashes: a range's pairs fit a task with room to spare.
RANGE_BYTES = 8 << 20
# Pairs that a task holds before it hands them on.
HELD_TOKENS = 3_000_000

_word = re.compile(WORD)
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Arrays of a range's files, as `train` writes them.
KINDS = {"pairs": [np.uint64, np.uint32, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32],
         "words": [np.uint64, np.uint64, np.uint32]}


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by an end, and the number of tokens of each."""
    words = [_word.findall(text.translate(_lower)) if text else [] for text in texts]
    counts = np.array([len(own) + 1 for own in words], np.int64)
    flat = np.empty(int(counts.sum()) - len(texts), object)
    flat[:] = [w for own in words for w in own]
    hashes = pd.util.hash_array(flat, categorize=False) >> np.uint64(64 - BITS) if len(flat) else np.zeros(0, np.uint64)
    found = np.full(int(counts.sum()), END, np.uint64)
    ends = np.cumsum(counts) - 1
    inner = np.ones(len(found), bool)
    inner[ends] = False
    found[inner] = hashes
    return found, counts


def contexts(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each one; a start before the first of a text."""
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[np.cumsum(counts) - counts] = START
    return before


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) ^ w)


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash; ranges follow the order of hashes."""
    return ((hashes >> np.uint64(BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _narrow(values: np.ndarray) -> bytes:
    """The low seven bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    found = np.zeros((len(raw) // 7, 8), np.uint8)
    found[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return found.reshape(-1).view("<u8").astype(np.uint64)


def _pack(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Hashes and columns of whole numbers, compressed."""
    parts = [_narrow(keys), *(c.tobytes() for c in columns)]
    return zstandard.compress(np.array([len(keys)], np.int64).tobytes() + b"".join(parts), 1)


def _unpack(packed: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, found = 8 + 7 * n, [_wide(raw[8 : 8 + 7 * n])]
    for kind in kinds:
        found.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return found


def _add_up(order_keys: list[np.ndarray], columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal keys become one, sorted; columns are summed."""
    order = np.lexsort(order_keys[::-1])
    keys = [k[order] for k in order_keys]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(first)
    return [k[at] for k in keys], [np.add.reduceat(c[order].astype(np.int64), at) if len(at) else c[:0].astype(np.int64)
                                   for c in columns]


def _levels(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(levels: list[int]) -> list[float]:
    """Of counts 0, 1, 2 and more, from the numbers of counts 1 to 4; halves where these tell nothing."""
    n1, n2, n3, n4 = levels
    if not (n1 and n2 and n3):
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(d if 0 < d <= i else i / 2 for i, d in enumerate(found, 1))]


@dataclass(frozen=True)
class Model:
    """Where the files are, and the few numbers that hold for all of them."""

    path: str
    ranges: int
    n_tokens: int
    n_words: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    n_pairs: int
    word_levels: tuple[int, int, int]


def train(docs: DataFrame, text: str = "text", range_bytes: int = RANGE_BYTES) -> Model:
    """Counts all texts and writes the model's files to the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    ranges = int(max(1, min(1 << 20, -(-size // range_bytes))))
    path = scratch_path(spark, "kneser-ney")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                found, counts = tokens(texts_of(part))
                keys, sums = _add_up([contexts(found, counts), found], [np.ones(len(found), np.int64)])
                held.append((*keys, *sums))
                waiting += len(sums[0])
                if waiting > HELD_TOKENS:
                    yield from hand_on(held)
                    held, waiting = [], 0
        if held:
            yield from hand_on(held)

    def hand_on(held: list) -> Iterator[pa.RecordBatch]:
        (v, w), (c,) = _add_up([np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])],
                               [np.concatenate([h[2] for h in held])])
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        runs = np.diff(np.append(first, len(v))).astype(np.uint32)
        of_run = _range(v[first], ranges)
        cuts = np.flatnonzero(np.concatenate(([True], of_run[1:] != of_run[:-1])))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(first)), strict=True):
            a, b = first[lo], first[hi] if hi < len(first) else len(v)
            lists = [_pack(v[first[lo:hi]], [runs[lo:hi]]), _pack(w[a:b], [c[a:b].astype(np.uint32)])]
            yield pa.record_batch({"range": pa.array([int(of_run[lo])], pa.int32()), "lists": pa.array([lists], pa.list_(pa.binary()))})

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _groups(batches):
            held = []
            for heads, tails in rows:
                v, runs = _unpack(heads, [np.uint32])
                w, c = _unpack(tails, [np.uint32])
                held.append((np.repeat(v, runs), w, c))
            (v, w), (c,) = _add_up([np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])],
                                   [np.concatenate([h[2] for h in held])])
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            sums = [np.add.reduceat(x, first).astype(kind) for x, kind in (
                (c, np.uint64), ((c == 1).astype(np.int64), np.uint32), ((c == 2).astype(np.int64), np.uint32),
                ((c > 2).astype(np.int64), np.uint32))]
            keys = pair_key(v, w)
            order = np.argsort(keys)
            shelf.write(f"{path}/pairs-{at}", [keys[order], np.minimum(c[order], 0xFFFFFFFF).astype(np.uint32), v[first], *sums])
            (word,), (before, total) = _add_up([w], [np.ones(len(w), np.int64), c])
            of_word = _range(word, ranges)
            cuts = np.flatnonzero(np.concatenate(([True], of_word[1:] != of_word[:-1])))
            lists = [_pack(word[lo:hi], [before[lo:hi].astype(np.uint32), total[lo:hi].astype(np.uint64)])
                     for lo, hi in zip(cuts, np.append(cuts[1:], len(word)), strict=True)]
            yield _row([*of_word[cuts].tolist(), -1], [*([x] for x in lists), []], [*([0] * 6 for _ in lists), [*_levels(c), len(c), int(c.sum())]])

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _groups(batches, keep_stats=True):
            if at < 0:
                yield _row([-1] * len(rows), [[] for _ in rows], rows)
                continue
            held = [_unpack(packed, [np.uint32, np.uint64]) for (packed,) in rows]
            (word,), (before, total) = _add_up([np.concatenate([h[0] for h in held])],
                                               [np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])])
            shelf.write(f"{path}/words-{at}", [word, total.astype(np.uint64), before.astype(np.uint32)])
            yield _row([-2], [[]], [[*_levels(before), len(word), 0]])

    schema = "range int, lists array<binary>, stats array<bigint>"
    pairs = docs.select(F.col(text).alias("text")).mapInArrow(count, "range int, lists array<binary>")
    pairs = pairs.withColumn("stats", F.array().cast("array<bigint>")).repartition(ranges, "range").sortWithinPartitions("range")
    words = pairs.mapInArrow(merge_pairs, schema).repartition(ranges, "range").sortWithinPartitions("range")
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(6)]
    rows = {row["range"]: row for row in words.mapInArrow(merge_words, schema).groupBy("range").agg(*sums).collect()}
    pair, word = ([int(rows[k][f"s{i}"]) for i in range(6)] if k in rows else [0] * 6 for k in (-1, -2))
    return Model(path, ranges, pair[5], word[4], tuple(discounts(pair[:4])), tuple(discounts(word[:4])), pair[4],
                 (word[0], word[1], word[4] - word[0] - word[1]))


def _row(ranges: list[int], lists: list, stats: list) -> pa.RecordBatch:
    return pa.record_batch({"range": pa.array(ranges, pa.int32()), "lists": pa.array(lists, pa.list_(pa.binary())),
                            "stats": pa.array(stats, pa.list_(pa.int64()))})


def _groups(batches: Iterator[pa.RecordBatch], keep_stats: bool = False) -> Iterator[tuple[int, list]]:
    """Rows of each range; they stand together. Rows of numbers only are handed on as they come."""
    at, rows = None, []
    for batch in batches:
        for of, lists, stats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if of != at:
                if rows:
                    yield at, rows
                at, rows = of, []
            rows.append(stats.as_py() if keep_stats and of < 0 else lists.as_py())
    if rows:
        yield at, rows


class Reader:
    """Looks words and pairs up in the mapped files."""

    def __init__(self, model: Model):
        self.model = model
        self.files = shelf.Shelf()

    def _find(self, name: str, at_key: int, columns: list[int], of: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        """Columns of the files ``name`` at keys of the ranges ``of``; zero where a key is not held."""
        out = [np.zeros(len(keys), np.float64) for _ in columns]
        order = np.lexsort((keys, of))
        ranges, cuts = np.unique(of[order], return_index=True)
        for i, rows in zip(ranges, np.split(order, cuts[1:]), strict=False):
            arrays = self.files.get(f"{self.model.path}/{name}-{i}", KINDS[name])
            held = arrays[at_key]
            if not len(held):
                continue
            place = np.minimum(np.searchsorted(held, keys[rows]), len(held) - 1)
            hit = held[place] == keys[rows]
            for values, column in zip(out, columns, strict=True):
                values[rows[hit]] = arrays[column][place[hit]]
        return out

    def score(self, found: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base log10 probability, the model's, and whether the token is known, of every token."""
        m = self.model
        word, back = np.unique(found, return_inverse=True)
        count, kinds = self._find("words", 0, [1, 2], _range(word, m.ranges).astype(np.int64), word)
        base = np.log10((count + 1) / (m.n_tokens + m.n_words + 1))
        d = np.array(m.word_discounts)
        left = (d[1:] * m.word_levels).sum() / m.n_pairs if m.n_pairs else 1.0
        single = left / (m.n_words + 1)
        if m.n_pairs:
            single = single + np.maximum(kinds - d[np.minimum(kinds, 3).astype(np.int64)], 0) / m.n_pairs
        single = np.broadcast_to(single, len(word))
        head, at_head = np.unique(before, return_inverse=True)
        total, n1, n2, n3 = self._find("pairs", 2, [3, 4, 5, 6], _range(head, m.ranges).astype(np.int64), head)
        d = np.array(m.pair_discounts)
        rest = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        key, first, at_key = np.unique(pair_key(before, found), return_index=True, return_inverse=True)
        (c,) = self._find("pairs", 0, [1], _range(before[first], m.ranges).astype(np.int64), key)
        own = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)[at_key] / np.maximum(total, 1)[at_head]
        return base[back], np.log10(own + rest[at_head] * single[back]), (count > 0)[back]


_readers: dict[str, Reader] = {}


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row without its text as ``row``, with n_tokens, n_known, base_score and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.path not in _readers:
            _readers[model.path] = Reader(model)
        reader = _readers[model.path]
        for batch in batches:
            for part in slices(batch, "text"):
                found, counts = tokens(texts_of(part))
                base, own, known = reader.score(found, contexts(found, counts))
                starts = np.cumsum(counts) - counts
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, own)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), *map(pa.array, sums)],
                                                 ["row", "n_tokens", "n_known", "base_score", "score"])

    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
