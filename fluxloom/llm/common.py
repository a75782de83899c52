"""What the text operators share: reading the tables, words, hold-outs and slices of Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space; the same in Java's, Python's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Bytes of an Arrow batch where whole tables pass through Python.
BATCH_BYTES = 2 << 20

# Characters of text that one numpy pass of a task works on.
SLICE_CHARS = 1 << 18
# Rows of it at most: short texts must not make it tall.
SLICE_ROWS = 1 << 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column | str, fold: int, folds: int) -> Column:
    """True where crc32 of the key as text leaves ``fold`` modulo ``folds``. A null key is never held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def single_threaded() -> None:
    """One core is given to a task, so numpy's products must not start threads of their own."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``BATCH_BYTES``, so that a worker's memory does not follow the length of texts: 10,000 texts,
    Spark's default, may be of any size, and a batch is held by the executor and by its Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of at most `SLICE_ROWS` rows whose texts hold about ``chars`` bytes (one row at least). No row is cut."""
    column_at = batch.schema.get_field_index(column)
    lengths = pa.compute.binary_length(batch.column(column_at)).fill_null(0).to_pylist()
    start = total = 0
    for at, length in enumerate(lengths):
        if at > start and (total + length > chars or at - start == SLICE_ROWS):
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += length
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
