"""Result tables, snapshots, run arguments and logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Parsed once, kept as Parquet, and read from there by everything later."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result table with a header and no row index."""
    df.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_run_args(args: DataFrame, path: str) -> None:
    """One JSON object per run; a missing argument is left out."""
    args.withColumn("folder", F.col("run")).repartition("folder").write.partitionBy("folder").json(path)


def read_run_args(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """Arguments of all runs; an argument that a run lacks takes its default, else null."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema).json(path)
    return raw.select(*[
        F.coalesce(F.col(c), F.lit(defaults[c]).cast(t)).alias(c) if c in defaults else F.col(c)
        for c, t in raw.dtypes])


def read_run_logs(spark: SparkSession, path: str, columns: list[str], file: str = "losses.csv") -> DataFrame:
    """Loss logs of a folder of runs, ``<path>/<run>/losses.csv``: the run's folder as text, the numbers of the
    evaluations in each file, and the asked columns. A column that a log lacks is null."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    text = text.filter(F.trim("value") != "").withColumn("cells", F.split("value", ","))
    # A log is one file of one run: its lines are numbered within the run.
    numbered = text.withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("block", "at")))
    headers = numbered.filter("line = 1").select("path", F.col("cells").alias("names"))
    rows = numbered.filter("line > 1").join(headers, "path")
    run = F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+)/[^/]+$", 1)
    cell = [F.get("cells", F.when(F.array_position("names", name) > 0, F.array_position("names", name) - 1).cast("int"))
            for name in columns]
    return rows.select(run.alias("run"), (F.col("line") - 2).cast("bigint").alias("eval_n"),
                       *[c.try_cast("double").alias(name) for c, name in zip(cell, columns, strict=True)])


def unreadable_runs(logs: DataFrame, args: DataFrame) -> DataFrame:
    """Runs that have a log but no arguments, or arguments but no log: (run, lacks)."""
    sides = logs.select("run").distinct().withColumn("log", F.lit(True)).join(
        args.select("run").distinct().withColumn("args", F.lit(True)), "run", "full_outer")
    return sides.filter("log is null or args is null").select(
        "run", F.when(F.col("log").isNull(), F.lit("log")).otherwise(F.lit("arguments")).alias("lacks"))


def write_stage(view: DataFrame, path: str, names: list[str], keys: list[str], v: str = "v") -> None:
    """Rows at a stage as CSV: the keys, then one column per value, named by its reaction or emb0, emb1 and so on.

    Lines are put together from the array, so no plan has a column per value.
    """
    header = ",".join([*keys, *(f'"{n}"' if set(n) & set(',"') else n for n in names)])
    values = F.concat_ws(",", *[F.col(k).cast("string") for k in keys], F.transform(v, lambda x: x.cast("string")))
    view.select(values.alias(header)).write.option("header", True).option("quote", "").option("sep", "\x01").csv(path)


def append_log(evaluations: DataFrame, path: str) -> None:
    """Add evaluations to a loss log; earlier files are not touched."""
    evaluations.write.mode("append").parquet(path)


def write_mixes(cells: DataFrame, path: str) -> None:
    """One folder per mix. AQE cuts a mix into tasks of its target size, so none is written by one task."""
    cells.hint("rebalance", F.col("mix")).write.partitionBy("mix").parquet(path)
