"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is its three letter vectors, the first shifted by
two places, the second by one, multiplied place by place. A text is the sum of its trigrams, a language the sum of
its texts; a text belongs to the language whose sum has the greatest cosine with its own.

Texts are lower-cased, runs of anything that is not a letter become one boundary, which is a letter of its own, and
every text begins and ends with a boundary. Letter vectors come from the seed and the code point alone, so tasks
agree on them without any exchange. Sums are whole numbers: results do not depend on how rows are dealt out.

Null texts and texts without a letter have the language ``und`` and score 0. Without any learned language everything
is ``und``. Ties go to the first language by code point. Rows are judged one by one, so repeated rows repeat results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm.common import SLICE_CHARS, slices, texts_of
from fluxloom.session import bounded_rows, settle

UNDETERMINED = "und"
DIMENSIONS = 1024
SEED = 20
# Languages are labels, not data: a table with more distinct labels than this is taken for a mistake.
MAX_LANGUAGES = 4096
# Below this many possible trigrams they are counted in a table, above by sorting.
TABLE_CELLS = 1 << 22
# Trigrams multiplied at once, and counts of them by row.
TRIGRAM_BLOCK = 4096
COUNT_CELLS = 1 << 21


@dataclass
class Encoder:
    """Turns texts into the sums of their trigram vectors."""

    dimensions: int = DIMENSIONS
    seed: int = SEED
    _letters: dict[int, np.ndarray] = field(default_factory=dict, repr=False)
    _is_letter: np.ndarray | None = field(default=None, repr=False)

    def letter(self, code: int) -> np.ndarray:
        found = self._letters.get(code)
        if found is None:
            draw = np.random.Generator(np.random.Philox(key=[self.seed, code]))
            found = self._letters[code] = (draw.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
        return found

    def codes(self, text: str | None) -> np.ndarray | None:
        """Code points with single boundaries (0); None if there is no letter."""
        if not text:
            return None
        if self._is_letter is None:
            self._is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        plain = np.where(self._is_letter[raw], raw, 0)
        plain = np.concatenate(([0], plain, [0]))
        kept = plain[np.concatenate(([True], (plain[1:] != 0) | (plain[:-1] != 0)))]
        return kept if len(kept) > 2 else None

    def encode(self, texts: list[str | None], rows: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each row's texts, and whether it has a letter. By default every text is a row of its own;
        otherwise ``rows`` never falls. Long texts are added up piece by piece."""
        rows = list(range(len(texts))) if rows is None else rows
        n = rows[-1] + 1 if rows else 0
        sums, lettered = np.zeros((n, self.dimensions)), np.zeros(n, bool)
        pieces: list[tuple[int, np.ndarray]] = []
        waiting = 0
        for row, text in zip(rows, texts, strict=True):
            codes = self.codes(text)
            if codes is None:
                continue
            lettered[row] = True
            for start in range(0, len(codes) - 2, SLICE_CHARS):  # pieces overlap by two, no trigram is lost
                piece = codes[start : start + SLICE_CHARS + 2]
                if waiting and waiting + len(piece) > SLICE_CHARS:
                    self._add(sums, pieces)
                    pieces, waiting = [], 0
                pieces.append((row, piece))
                waiting += len(piece)
        if pieces:
            self._add(sums, pieces)
        return sums, lettered

    def _add(self, sums: np.ndarray, pieces: list[tuple[int, np.ndarray]]) -> None:
        codes = np.concatenate([piece for _, piece in pieces])
        lengths = np.array([len(piece) for _, piece in pieces])
        rows, row_of = np.unique([row for row, _ in pieces], return_inverse=True)
        piece_of = np.repeat(np.arange(len(pieces)), lengths)
        inside = piece_of[:-2] == piece_of[2:]
        owner = row_of[piece_of[:-2][inside]]
        alphabet, index = self._alphabet(codes)
        n = len(alphabet)
        keys = ((index[:-2] * n + index[1:-1]) * n + index[2:])[inside]
        if n**3 <= TABLE_CELLS:
            present = np.flatnonzero(np.bincount(keys, minlength=n**3))
            at = np.zeros(n**3, np.int64)
            at[present] = np.arange(len(present))
            column = at[keys]
        else:
            present, column = np.unique(keys, return_inverse=True)
        vectors = np.stack([self.letter(int(c)) for c in alphabet])
        first, second = np.roll(vectors, 2, 1), np.roll(vectors, 1, 1)
        step = max(64, min(TRIGRAM_BLOCK, COUNT_CELLS // len(rows)))
        for start in range(0, len(present), step):
            block = present[start : start + step]
            here = slice(None) if len(block) == len(present) else (column >= start) & (column < start + step)
            cells = owner[here] * len(block) + column[here] - start
            counts = np.bincount(cells, minlength=len(rows) * len(block)).reshape(len(rows), len(block))
            trigrams = first[block // (n * n)] * second[block // n % n] * vectors[block % n]
            sums[rows] += counts.astype(np.float32) @ trigrams.astype(np.float32)

    @staticmethod
    def _alphabet(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        place = np.zeros(len(seen), np.int64)
        place[alphabet] = np.arange(len(alphabet))
        return alphabet, place[codes]


@dataclass
class Profiles:
    """Learned languages: a name and a unit vector each. Its size is languages x dimensions."""

    names: list[str]
    vectors: np.ndarray
    encoder: Encoder

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums, lettered = self.encoder.encode(texts)
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if self.names and len(texts):
            size = np.linalg.norm(sums, axis=1)
            cosines = (sums @ self.vectors.T) / np.where(size > 0, size, 1)[:, None]
            best = cosines.argmax(1)
            for row in np.flatnonzero(lettered):
                names[row] = self.names[best[row]]
                scores[row] = min(1.0, max(0.0, cosines[row, best[row]]))
        return names, scores


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS,
          seed: int = SEED) -> Profiles:
    """Profiles from all rows with a language. Tasks add up one vector per language; only those are shuffled."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = Encoder(dimensions, seed), {}
        for batch in batches:
            for part in slices(batch, "text"):
                pairs = sorted(zip(texts_of(part, "lang"), texts_of(part), strict=True), key=lambda pair: pair[0])
                names = sorted({name for name, _ in pairs})
                sums, _ = encoder.encode([t for _, t in pairs], [names.index(name) for name, _ in pairs])
                for name, total in zip(names, sums.astype(np.int64), strict=True):
                    held[name] = held.get(name, 0) + total
            if len(held) > 256:  # many labels: hand on what there is
                yield _sums(held)
                held = {}
        if held:
            yield _sums(held)

    rows = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
        .mapInArrow(add_up, "lang string, sums array<bigint>")
        .select("lang", F.posexplode_outer("sums").alias("place", "total"))
        .groupBy("lang", "place").agg(F.sum("total").alias("total"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("cells"))
        .select("lang", F.col("cells.total").alias("sums"))
    )
    found = sorted(bounded_rows(rows, MAX_LANGUAGES, "the table of languages"), key=lambda r: r["lang"])
    found = [row for row in found if any(row["sums"])]
    vectors = np.array([row["sums"] for row in found], float).reshape(len(found), dimensions)
    return Profiles([row["lang"] for row in found], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                    if found else vectors, Encoder(dimensions, seed))


def _sums(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.array(list(held), pa.string()),
                            "sums": pa.array(list(held.values()), pa.list_(pa.int64()))})


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Every row as a struct ``row``, with ``lang_pred`` and ``score``. The row's own columns cannot clash with them."""
    return _judged(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), profiles)


def _judged(rows: DataFrame, profiles: Profiles) -> DataFrame:
    """(row, text) with the text's ``lang_pred`` and ``score`` in its place."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles.encoder = Encoder(profiles.encoder.dimensions, profiles.encoder.seed)
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = profiles.predict(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(judge, schema)


def known(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", quantile: float = 0.01,
          share: float = 0.5) -> DataFrame:
    """`identify` with ``known``: whether a text is in one of the learned languages at all.

    The cosine of a text with its language grows with its length and differs between languages, so the bar is learned
    too, from all rows that have a language and are taken for it: per language and length (a class per doubling),
    ``share`` of the ``quantile`` of their scores. Shorter texts' bars hold for longer ones, where they are higher or there are
    no own. Texts without a letter are not known; those of a language shorter than all its labelled texts are.
    The table is judged twice, for the bars and by them: a written copy of its texts would take the disk of the input once more.
    """
    def size_of(of: Column) -> Column:
        return F.coalesce(F.floor(F.log2(F.length(of) + F.lit(1))), F.lit(0)).cast("int")

    labelled = docs.filter(F.col(lang).isNotNull()).select(
        F.struct(F.col(lang).alias("lang"), size_of(F.col(text)).alias("size")).alias("row"), F.col(text).alias("text"))
    own = _judged(labelled, profiles).select("row.*", "lang_pred", "score")
    own = own.filter((F.col("lang_pred") == F.col("lang")) & (F.col("lang_pred") != UNDETERMINED))
    low = own.groupBy("lang_pred", "size").agg(F.percentile_approx("score", quantile).alias("low"))  # languages x 31 rows at most
    by_size = Window.partitionBy("lang_pred").orderBy("size")
    until = F.coalesce(F.lead("size").over(by_size) - 1, F.lit(31))
    bars = low.select(F.col("lang_pred").alias("of"), "size", until.alias("until"), (F.max("low").over(by_size) * share).alias("bar"))
    bars = bars.select("of", F.explode(F.sequence("size", "until")).alias("at"), "bar")
    bars = settle(bars, "bars")  # so that the join knows how small they are, and leaves the texts where they stand
    found = identify(docs, profiles, text).withColumn("size", size_of(F.col("row")[text]))
    judged = found.join(bars, (F.col("lang_pred") == F.col("of")) & (F.col("size") == F.col("at")), "left")
    enough = F.col("score") >= F.coalesce("bar", F.lit(0.0))
    return judged.select("row", "lang_pred", "score", ((F.col("lang_pred") != UNDETERMINED) & enough).alias("known"))
