"""Fill-in-middle transformation by rotations of blocks inside one buffer, and its exact inversion.

A text is cut into units: words with the white space before them, and white space at the end. Two cuts between units
give prefix, middle and suffix; the draws that choose them, and the form, come from sha256 of seed and key, so reruns
agree. The bytes of the text stand in one bytearray. Sentinels are inserted before each block, and one rotation, three
reversals in place, exchanges neighbouring blocks:

- ``psm``: prefix, suffix, middle - the middle and the suffix are exchanged;
- ``spm``: suffix, prefix, middle - all before the suffix is exchanged with it;
- ``plain``: the text as it is, if it is empty, holds a sentinel, or the draw says so.

`restore` finds the sentinels, rotates back and removes them. No text holds a sentinel unless its form is plain, and
sentinels cannot overlap, so the blocks are found exactly. A task holds one text and its buffer at a time.

A null text is an empty one. A null key draws like an empty one. Rows that repeat a key draw alike. An empty table gives
no rows. Columns of the input cannot clash: rows travel as one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm.common import slices

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Infill:
    seed: int = 42
    rate: int = 50  # per cent of texts that are rearranged
    spm: int = 80  # per cent of those whose suffix comes first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a[0] in b[1:] or (a in b and i != j)
                                 for i, a in enumerate(marks) for j, b in enumerate(marks)):
            raise ValueError("sentinels must differ and begin with a character that none of them has further on")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Where the units of a text's bytes end. White space is ASCII, so bytes tell what code points would."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _space[data]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(data)) if space[-1] else ends


def characters(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse a stretch in place: its halves change places from the outside in."""
    half = (end - start) // 2
    left, right = view[start:start + half], view[end - half:end]
    held = left.copy()
    left[:] = right[::-1]
    right[:] = held[::-1]


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbours ``[start, middle)`` and ``[middle, end)`` in place by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


def rearranged(data: bytes, first: int, second: int, form: str, how: Infill) -> bytearray:
    """Blocks cut at two byte positions, with sentinels, in the order of the form."""
    prefix, suffix, middle = how.marks
    buffer = bytearray(data)
    buffer[second:second] = suffix
    buffer[first:first] = middle
    buffer[0:0] = prefix
    middle_at = len(prefix) + first
    suffix_at = middle_at + len(middle) + second - first
    rotate(buffer, middle_at if form == "psm" else 0, suffix_at, len(buffer))
    return buffer


def restored(output: bytes, form: str, how: Infill) -> bytearray:
    """The text that was rearranged into ``output``. Raises where the sentinels of the form are not there."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    prefix, suffix, middle = how.marks
    at = {mark: buffer.find(mark) for mark in how.marks}
    if min(at.values()) < 0 or form not in ("psm", "spm") or at[prefix if form == "psm" else suffix]:
        raise ValueError(f"output is not in the form {form}")
    start = at[suffix]  # where the suffix block stands; what follows it in the output was before it
    follows = at[middle] if form == "psm" else at[prefix]
    if follows < start or at[middle] < at[prefix]:
        raise ValueError(f"sentinels are not in the order of {form}")
    rotate(buffer, start, follows, len(buffer))
    suffix_at = len(buffer) - (follows - start)
    middle_at = buffer.find(middle)
    del buffer[suffix_at:suffix_at + len(suffix)]
    del buffer[middle_at:middle_at + len(middle)]
    del buffer[0:len(prefix)]
    return buffer


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32: the first digits of sha256 of seed and key."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substr(digits, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("bigint") for i in range(4)]


def rearrange(docs: DataFrame, how: Infill = Infill(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as ``row``, with its units ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    h1, h2, h3, h4 = draws(F.col(key), how.seed)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("text"),
                       F.array(h1, h2, h3 % 100, h4 % 100).alias("draws"))

    def one(data: bytes, drawn: np.ndarray) -> tuple:
        seen = np.frombuffer(data, np.uint8)
        ends = unit_ends(seen)
        n = len(ends)
        if not data or drawn[2] >= how.rate or any(mark in data for mark in how.marks):
            return n, "plain", None, None, data
        cuts = [int(ends[at - 1]) if at else 0 for at in sorted(int(d) % (n + 1) for d in drawn[:2])]
        form = "spm" if drawn[3] < how.spm else "psm"
        return (n, form, characters(seen[:cuts[0]]), characters(seen[cuts[0]:cuts[1]]),
                bytes(rearranged(data, *cuts, form, how)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                drawn = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                found = [one(data or b"", d) for data, d in zip(part.column(1).to_pylist(), drawn, strict=True)]
                n, form, prefix, middle, output = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
                    ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restore(found: DataFrame, how: Infill = Infill(), out: str = "restored") -> DataFrame:
    """Adds the text rebuilt from ``output`` and ``form``; null where the output is."""
    rows = found.select(F.struct("*").alias("row"), F.col("output").cast("binary").alias("output"), "form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output"):
                texts = [None if data is None else bytes(restored(data, form, how)) for data, form in zip(
                    part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["row", "text"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.BinaryType())])
    return rows.mapInArrow(run, schema).select("row.*", F.col("text").cast("string").alias(out))
