"""Seeded samples, chunks, mixes, batches and splits of sample rows.

Rows are keyed by (file_name, sample_n). Every choice ranks rows by a draw of their key, so it is the
same on any cluster; positions come from ``rank_by_draw`` and no file is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.draws import draw
from fluxloom.operators.harmonise import ROW_KEY
from fluxloom.operators.ranking import BUCKET_ROWS, dense_index, rank_by_draw
from fluxloom.session import settle

# Fixed value: a chunk below this share of the intended size is dropped.
MIN_CHUNK_SHARE = 0.8
# Chunk numbers that are listed at a time.
CHUNK_BLOCK = 256


def sample_rows(flux: DataFrame) -> DataFrame:
    """The distinct samples of a long table."""
    return flux.select(*ROW_KEY).distinct()


def chunk_size(rows, target):
    """Rows per chunk when a file is cut into the fewest chunks of at most ``target`` rows."""
    n_chunks = F.when(rows <= target, F.lit(1)).otherwise(F.ceil(rows / target))
    return F.ceil(rows / n_chunks).cast("bigint")


def random_chunks(samples: DataFrame, per_file: int, seed: int, only_first: bool = False,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Cut each file at random into chunks without replacement; a short last chunk is dropped."""
    ranked = rank_by_draw(samples, ["file_name"], draw(seed, *ROW_KEY), bucket_rows=bucket_rows)
    size = chunk_size(F.col("n_rows"), F.lit(per_file))
    at = F.col("rn") - 1
    chunk = F.floor(at / size)
    kept = F.least(size, F.col("n_rows") - chunk * size) >= F.lit(MIN_CHUNK_SHARE) * size
    chunks = ranked.withColumn("chunk", chunk).filter(kept)
    if only_first:
        chunks = chunks.filter(F.col("chunk") == 0)
    return chunks.drop("rn", "n_rows")


def chunk_table(samples: DataFrame, per_file: int) -> DataFrame:
    """Files with their chunk size and the number of chunks kept; no row is touched."""
    rows = F.col("n_rows")
    size = chunk_size(rows, F.lit(per_file))
    last = rows - (F.ceil(rows / size) - 1) * size
    full = F.ceil(rows / size) - F.when(last >= F.lit(MIN_CHUNK_SHARE) * size, F.lit(0)).otherwise(F.lit(1))
    return samples.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "file_name", "n_rows", size.alias("chunk_rows"), full.cast("bigint").alias("n_chunks"))


def balanced_sample(samples: DataFrame, n: int, seed: int, bucket_rows: int = BUCKET_ROWS,
                    trim: bool = False) -> DataFrame:
    """One chunk of every file (`chunk_size`), where a file's part of ``n`` is ``n // files``.

    A file with fewer rows than its part gives all of them. With ``trim`` every file gives only as many as the
    smallest chunk has.
    """
    per_file = settle(samples.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_file")), "file-sizes")
    files = per_file.count()
    spf = max(1, n // max(1, files))
    act = chunk_size(F.col("n_file"), F.lit(spf))
    most = per_file.agg(F.min(act) if trim else F.max(act)).first()[0] or 0
    ranked = rank_by_draw(samples, ["file_name"], draw(seed, *ROW_KEY), bucket_rows=bucket_rows, at_most=int(most))
    return ranked.filter(F.col("rn") <= chunk_size(F.col("n_rows"), F.lit(spf))).drop("rn", "n_rows")


def epoch_rotation(chunks: DataFrame, epochs: int, seed: int) -> DataFrame:
    """Chunk that each file serves in each epoch: the next unused one, reshuffled when all were used.

    ``chunks``: output of ``chunk_table``. The order within a cycle is by draw of (file, cycle, chunk).
    """
    chunks = chunks.filter("n_chunks > 0")
    turns = chunks.select("file_name", "n_chunks", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    n = F.col("n_chunks")
    turns = turns.withColumn("cycle", F.floor(F.col("epoch") / n)).withColumn("rn", F.col("epoch") % n + 1)
    cycles = chunks.select(
        "file_name", "n_chunks",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.lit(epochs - 1) / n))).alias("cycle"))
    # Chunk numbers in two steps, so that a file of very many chunks never makes one large array.
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / CHUNK_BLOCK)))
    inside = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CHUNK_BLOCK - 1).cast("bigint")))
    numbered = (
        cycles.withColumn("_block", block).withColumn("_at", inside)
        .withColumn("chunk", F.col("_block") * CHUNK_BLOCK + F.col("_at")).filter(F.col("chunk") < n)
        .select("file_name", "cycle", "chunk")
    )
    order = rank_by_draw(numbered, ["file_name", "cycle"], draw(seed, "file_name", "cycle", "chunk"),
                         at_most=epochs).drop("n_rows")
    return turns.join(order, ["file_name", "cycle", "rn"]).select(
        F.col("epoch").cast("bigint").alias("epoch"), "file_name", "chunk")


def sample_cap(rows: DataFrame, cap: int, seed: int, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """At most ``cap`` rows at random without replacement; all rows if there are no more than that."""
    return rank_by_draw(rows, [], draw(seed, *keys), bucket_rows=bucket_rows, at_most=cap).drop("rn", "n_rows")


def mix_split(samples: DataFrame, n: int, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Cut each file at random into n near equal parts; part i goes to mix i. Later parts take the remainder."""
    ranked = rank_by_draw(samples, ["file_name"], draw(seed, *ROW_KEY), bucket_rows=bucket_rows)
    at, base = F.col("rn") - 1, F.floor(F.col("n_rows") / n)
    small = F.lit(n) - F.col("n_rows") % n  # parts that hold ``base`` rows
    mix = F.when(at < small * base, F.floor(at / F.greatest(base, F.lit(1)))).otherwise(
        small + F.floor((at - small * base) / (base + 1)))
    return ranked.withColumn("mix", mix.cast("bigint")).drop("rn", "n_rows")


def shuffled_batches(samples: DataFrame, batch_size: int, seed: int, keys: list[str] = ROW_KEY,
                     bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Batch number of each row under a seeded shuffle of all rows."""
    ranked = rank_by_draw(samples, [], draw(seed, *keys), bucket_rows=bucket_rows)
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("bigint")).drop("rn", "n_rows")


def nested_train_test(files: DataFrame, sizes: list[int]) -> DataFrame:
    """Splits over the sorted files: ``train_i`` has the first ``sizes[i]``, ``test`` those after the largest."""
    indexed = dense_index(files, "file_name", "file_n")
    trains = [F.when(F.col("file_n") < n, F.lit(f"train_{i}")) for i, n in enumerate(sizes)]
    test = F.when(F.col("file_n") >= max(sizes), F.lit("test"))
    splits = F.array_compact(F.array(*trains, test))
    return indexed.select("file_name", F.explode(splits).alias("split"))
