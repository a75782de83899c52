"""First lines of text files, by reading no more of them than that.

Spark's text source reads whole blocks, so a header costs it the file. Here the files are listed by Spark, without
content, and tasks read the first bytes of their files until the lines asked for are complete.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of the first read of a file; every further one doubles, so long lines take few reads.
FIRST_READ = 64 << 10
# Lines of an Arrow batch that a task hands on.
BATCH_LINES = 256


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark lists them, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def top(stream: BinaryIO, n: int, first_read: int = FIRST_READ) -> list[str]:
    """The first ``n`` lines that are not blank, or all if there are fewer. Lines end as in Spark's text source."""
    held, size, lines = b"", first_read, []
    while len(lines) < n:
        more = stream.read(size)
        held, size = held + more, size * 2
        # The last piece may go on in the next read, and so may a line end of two bytes.
        whole, held = (held, b"") if not more else _cut(held)
        text = whole.removeprefix(codecs.BOM_UTF8) if not lines else whole
        lines += [line.decode("utf-8", "replace") for line in text.splitlines() if line.strip(b" ")]
        if not more:
            break
    return lines[:n]


def _cut(held: bytes) -> tuple[bytes, bytes]:
    """What ends with a line end, and the rest."""
    end = max(held.rfind(b"\n"), held.rfind(b"\r", 0, -1) if held[-1:] == b"\r" else held.rfind(b"\r")) + 1
    return held[:end], held[end:]


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, at, value): the first ``n`` lines of every file under ``path`` that are not blank, numbered from 0."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"there is no file '{path}'.") from error

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = file_system(place)
                with system.open_input_file(inner) as stream:
                    lines = top(stream, n)
                for lo in range(0, len(lines), BATCH_LINES):
                    part = lines[lo : lo + BATCH_LINES]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part)],
                        ["path", "at", "value"])

    return listed.select(F.col("path").alias("place"), F.col("_metadata.file_path").alias("path")).mapInArrow(
        read, "path string, at bigint, value string")
