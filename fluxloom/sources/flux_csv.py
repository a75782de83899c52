"""Folders of wide sample files, ``<model>_<n>.csv``: an unnamed row index, then one column per reaction.

Every file has its own columns, so lines are read as text and turned into long rows; no plan has one
column per reaction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxloom.functions.text import model_name
from fluxloom.operators.harmonise import SOURCE_COLUMNS
from fluxloom.session import settle
from fluxloom.sources.heads import first_lines

# A comma outside double quotes.
QUOTED_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Fixed value: a saved row index without a name is read back under this one.
UNNAMED = "Unnamed: 0"


def csv_glob(path: str) -> str:
    """A single file stays; a folder means all its .csv files."""
    return path if path.endswith(".csv") else f"{path.rstrip('/')}/*.csv"


def file_name_of(path: Column) -> Column:
    """Name of the sample file without folder and extension; also of a folder of parts ``<name>.csv/``."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(decoded, r"([^/=]+)\.csv(/.*)?$", 1)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Files of a dataset: (file_name, label, bytes). Lists only, reads no content; an error if there are none."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(csv_glob(path))
    except AnalysisException as error:
        raise FileNotFoundError(f"'{path}' has no .csv files.") from error
    name = file_name_of(F.col("path"))
    return (
        listed.select(name.alias("file_name"), "length").groupBy("file_name").agg(F.sum("length").alias("bytes"))
        .select("file_name", model_name(F.col("file_name")).alias("label"), "bytes")
    )


def split_line(line: Column) -> Column:
    """Cells of a CSV line; the quote-aware split runs only on lines that hold a quote."""
    plain = F.split(line, ",")
    quoted = F.transform(F.split(line, QUOTED_SPLIT), lambda c: F.replace(
        F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    return F.when(line.contains('"'), quoted).otherwise(plain)


def without_index(cells: str) -> Column:
    return F.slice(cells, F.lit(2), F.size(cells) - 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        text = spark.read.option("recursiveFileLookup", True).text(csv_glob(path))
    except AnalysisException as error:
        raise FileNotFoundError(f"'{path}' has no .csv files.") from error
    return text.select("value", F.col("_metadata.file_path").alias("path")).filter(F.trim("value") != "")


def top_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first lines of each file (`heads.first_lines`); a folder without .csv files is an error."""
    try:
        return first_lines(spark, csv_glob(path), n)
    except FileNotFoundError as error:
        raise FileNotFoundError(f"'{path}' has no .csv files.") from error


def headers(tops: DataFrame) -> DataFrame:
    """The first line of each file and its column names, index left out: (path, header, names)."""
    return tops.filter("at = 0").withColumn("cells", split_line(F.col("value"))).select(
        "path", F.col("value").alias("header"), without_index("cells").alias("names"))


def row_number_of(index: Column) -> Column:
    """Whole-number indexes as they are, also written as 3.0; any other index by a hash of its text."""
    number = index.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("bigint"))
    return F.coalesce(index.try_cast("bigint"), whole, F.xxhash64(index))


def header_union(spark: SparkSession, path: str) -> DataFrame:
    """Every column name of the folder with the number of files that have it. Reads the first line of every file only."""
    names = headers(top_lines(spark, path, 1)).select(
        file_name_of(F.col("path")).alias("file_name"), F.explode("names").alias("reaction")).distinct()
    return names.groupBy("reaction").agg(F.count(F.lit(1)).alias("n_files"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Long rows (file_name, label, sample_n, reaction, flux) of all files.

    One pass over the text: headers are read from the first bytes of the files, then rows are joined to the header of
    their file. The headers are settled, so they are broadcast only while measured to be small; above that the lines are
    shuffled by file and AQE splits a file that holds too many of them. The header is a file's first line, whatever
    it looks like. An empty cell is 0; text that is not a number is an error, and so is a line with more or fewer
    cells than the header. A row index may be any text (`row_number_of`).
    """
    lines = read_lines(spark, path)
    named = settle(headers(top_lines(spark, path, 1)), "headers")
    return cells_of(lines.join(named, "path").filter(F.col("value") != F.col("header")))


def cells_of(rows: DataFrame) -> DataFrame:
    """Long rows of lines (path, value) that know the names of their columns."""
    rows = rows.withColumn("cells", split_line(F.col("value")))
    ragged = F.raise_error(F.concat(F.lit("a line of "), F.col("path"), F.lit(" has not as many cells as its header: "),
                                    F.substring("value", 1, 80)))
    even = F.when(F.size("cells") == F.size("names") + 1, without_index("cells")).otherwise(ragged)
    # Keys are made per line, before the line becomes thousands of cells.
    keyed = rows.select(file_name_of(F.col("path")).alias("file_name"), row_number_of(F.col("cells")[0]).alias("sample_n"),
                        "names", even.alias("cells"))
    flat = keyed.withColumn("label", model_name(F.col("file_name"))).select(
        "file_name", "label", "sample_n",
        F.explode(F.arrays_zip(F.col("names").alias("reaction"), F.col("cells").alias("cell"))).alias("c"))
    flux = F.when(F.col("c.cell") == "", F.lit(0.0)).otherwise(F.col("c.cell").cast("double"))
    return (
        flat.filter(~F.col("c.reaction").isin(UNNAMED, *SOURCE_COLUMNS))
        .select("file_name", "label", "sample_n", F.col("c.reaction").alias("reaction"),
                F.coalesce(flux, F.lit(0.0)).alias("flux"))
    )


def read_datasets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several datasets in one table, told apart by the column ``dataset``."""
    tagged = [read(spark, path).withColumn("dataset", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, tagged)


def quote(name: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(name.rlike('[",]'), doubled).otherwise(name)


def write(flux: DataFrame, path: str, rows_per_part: int = 10_000) -> None:
    """Write long rows as one wide table per file: ``<path>/file_name=<name>.csv/part=<k>/``.

    Each part starts with the header of its file, and a file is cut into as many parts as its rows
    need. A reaction that a sample lacks but its file has is written as 0.
    """
    # Distinct first: a file then brings its reactions and samples to one task once, not once per task.
    columns = flux.select("file_name", "reaction").distinct().groupBy("file_name").agg(
        F.sort_array(F.collect_list("reaction")).alias("names"))
    sizes = flux.select("file_name", "sample_n").distinct().groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_rows"))
    names = settle(columns.join(sizes, "file_name"), "names")
    parts = F.ceil(F.col("n_rows") / rows_per_part).cast("bigint")
    sample = flux.groupBy("file_name", "sample_n").agg(
        F.collect_list(F.struct("reaction", "flux")).alias("cells")).join(names, "file_name")
    lacking = F.transform(F.array_except("names", F.col("cells.reaction")),
                          lambda n: F.struct(n.alias("reaction"), F.lit(0.0).alias("flux")))
    values = F.transform(F.array_sort(F.concat("cells", lacking)), lambda c: c["flux"].cast("string"))
    rows = sample.select(
        "file_name", F.pmod(F.xxhash64("sample_n"), parts).alias("part"), "sample_n",
        F.concat_ws(",", F.col("sample_n").cast("string"), values).alias("value"))
    tops = names.select(
        "file_name", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"),
        F.lit(None).cast("bigint").alias("sample_n"),
        F.concat(F.lit(","), F.concat_ws(",", F.transform("names", quote))).alias("value"))
    (
        rows.unionByName(tops).withColumn("file_name", F.concat("file_name", F.lit(".csv")))
        .repartition("file_name", "part")
        .sortWithinPartitions("file_name", "part", F.col("sample_n").asc_nulls_first())
        .select("file_name", "part", "value").write.partitionBy("file_name", "part").text(path)
    )


def read_head(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Long rows of the first n samples of each file, from the first bytes of the files.

    Of a file of parts, each sorted by its index as `write` leaves them, these are the n least of the first n of every part.
    """
    tops = settle(top_lines(spark, path, n + 1), "tops")
    named = settle(headers(tops), "headers")
    return head(cells_of(tops.filter("at > 0").join(named, "path").filter(F.col("value") != F.col("header"))), n)


def head(flux: DataFrame, n: int) -> DataFrame:
    """Cells of the first n samples of each file."""
    order = Window.partitionBy("file_name").orderBy("sample_n")
    # Spark keeps n samples per file and task before the shuffle of this rank.
    first = (
        flux.select("file_name", "sample_n").distinct()
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("rn")
    )
    first = settle(first, "first")
    return flux.join(first, ["file_name", "sample_n"], "left_semi")
