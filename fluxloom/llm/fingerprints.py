"""Document fingerprints by Order MinHash, in DataFrame operations only.

A document's k-mers are its windows of ``k`` words (all its words, if they are fewer). Each is numbered by its
occurrence in the text, and the pair is hashed. The hash deals it to one of ``tuples`` x ``width`` bins, and each
bin keeps its least hash with the place of its k-mer. The ``width`` minima of a tuple are put in the order of their
places in the text and hashed together: the signature of the tuple. Two texts share a signature if they share the
k-mers *and* have them in the same order, so moved passages count as differences, as they do in the edit distance.
The likeness of two fingerprints is the share of equal signatures among the tuples that either of them has.

One hash per k-mer serves all bins, so a text is read once. The windows are exploded inside the task that holds the
document: rows stand partitioned by block of documents, and numbering, minima and signatures group by block first, so
after the texts are dealt to their blocks nothing is shuffled but finished fingerprints.

A null text counts as empty. Texts without words have the empty fingerprint; two of them are alike (1.0), one and any
other are not (0.0). Equal texts have equal fingerprints. Repeated keys are told apart by the text's hash, and rows that are
equal in both stand next to each other in an order that does not matter. Columns of the input cannot clash, only key
and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fluxloom.llm.common import SPACE
from fluxloom.session import bounded_rows, settle

# Documents in a block, about: what one task sorts at a time.
BLOCK_ROWS = 512
# Boundaries of blocks are quantiles of the key; a finer cut than this is not needed for any number of tasks.
MAX_BLOCKS = 100_000


@dataclass(frozen=True)
class Shape:
    k: int = 5
    tuples: int = 64
    width: int = 2


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def kmers(text: Column, k: int) -> Column:
    """Hashes of the windows of k words; one hash of all words if there are fewer; none without words."""

    def windows(own: Column) -> Column:
        n = F.size(own)
        cut = F.transform(F.slice(own, 1, F.greatest(n - (k - 1), F.lit(1))),
                          lambda w, i: F.xxhash64(w, *[F.get(own, i + j) for j in range(1, k)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(cut)

    return _let(words(text), windows)


def _block(key: Column, cuts: list) -> Column:
    """Number of cuts below the key, by halving; nulls stand in a block below all."""
    if not cuts:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    array = F.lit(cuts)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when(
        F.coalesce(F.get(array, low + step - 1) < key, F.lit(False)), low + step).otherwise(low))
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """Rows in blocks of neighbouring keys, with the next row's text in descending order of keys; the last row of all
    has the first one's. Also the blocks in descending order.

    Blocks are cut at quantiles of the key. Inside a block the next row is a window away; the first row of every
    block (one row each, found by its greatest key) is joined to the block before it.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // BLOCK_ROWS)))
    cuts = []
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        cuts = rows.agg(F.percentile_approx("key", shares, F.lit(10 * blocks)).alias("cuts")).first()["cuts"]
    rows = rows.withColumn("block", _block(F.col("key"), sorted(set(cuts or [])))).withColumn("tie", F.xxhash64("text"))
    tops = bounded_rows(rows.groupBy("block").agg(F.max(F.struct("key", "tie")).alias("top")), MAX_BLOCKS + 1,
                        "the table of blocks")
    order = sorted((row["block"] for row in tops), reverse=True)
    if not order:
        return rows.withColumn("at", F.lit(1)).withColumn("next_text", F.lit("")).drop("tie"), []
    firsts = _table(docs, {"block": [r["block"] for r in tops], "top": [r["top"]["key"] for r in tops],
                           "top_tie": [r["top"]["tie"] for r in tops]}, rows.schema["key"].dataType)
    # One row of numbers per block, at most MAX_BLOCKS of them.
    heads = (rows.join(F.broadcast(firsts.withColumnRenamed("block", "b")), (F.col("block") == F.col("b"))
                       & F.col("key").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie")))
             .groupBy("block").agg(F.min("text").alias("head")))
    heads = settle(heads.withColumnRenamed("block", "next").join(_links(docs, order), "next").select("block", "head"), "heads")
    window = Window.partitionBy("block").orderBy(F.col("key").desc_nulls_last(), F.col("tie").desc())
    rows = rows.withColumn("at", F.row_number().over(window)).withColumn("next_text", F.lead("text").over(window))
    rows = rows.join(heads, "block", "left").withColumn("next_text", F.coalesce("next_text", "head"))
    return rows.drop("tie", "head"), order


def _table(df: DataFrame, columns: dict, key_type: T.DataType) -> DataFrame:
    kinds = {"top": to_arrow_type(key_type), "block": pa.int32(), "next": pa.int32(), "top_tie": pa.int64()}
    return df.sparkSession.createDataFrame(pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()}))


def _links(df: DataFrame, order: list[int]) -> DataFrame:
    """Block and next block in descending order; the last leads to the first."""
    return _table(df, {"block": order, "next": order[1:] + order[:1]}, T.LongType())


def _signatures(side: str, shape: Shape) -> Column:
    """Array of (tuple, signature) from a document's collected bins, in order of tuples."""
    held = F.filter("bins", lambda b: b[f"h_{side}"].isNotNull() & (b["bin"] < shape.tuples * shape.width))
    bins = F.array_sort(F.transform(held, lambda b: F.struct(
        b["bin"].alias("bin"), F.floor(b["bin"] / shape.width).cast("int").alias("t"), b[f"p_{side}"].alias("p"),
        b[f"h_{side}"].alias("h"))))

    def sign(own: Column) -> Column:
        """The first bin of every tuple looks at those after it and signs for all."""

        def one(b: Column, i: Column) -> Column:
            group = F.filter(F.array(b, *[F.get(own, i + j) for j in range(1, shape.width)]), lambda x: x["t"] == b["t"])
            placed = F.array_sort(F.transform(group, lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"))))
            leads = ~F.coalesce(F.get(own, i - 1)["t"] == b["t"], F.lit(False))
            return F.when(leads, F.struct(b["t"].alias("t"), F.xxhash64(F.transform(placed, lambda x: x["h"])).alias("s")))

        return F.array_compact(F.transform(own, one))

    return _let(bins, sign)


def written(signatures: Column) -> Column:
    """A fingerprint as text: tuple and signature in hexadecimal, comma-joined."""
    return F.array_join(F.transform(signatures, lambda s: F.concat(
        F.lower(F.hex(s["t"])), F.lit(":"), F.lower(F.substring(F.lpad(F.hex(s["s"]), 16, "0"), 9, 8)))), ",")


def likeness(left: Column, right: Column) -> Column:
    """Share of equal entries among the tuples of either fingerprint (as `written`); 1 if both are empty."""
    entries = lambda c: F.filter(F.split(c, ","), lambda e: e != "")
    tuple_of = lambda c: F.transform(entries(c), lambda e: F.substring_index(e, ":", 1))
    either = F.size(F.array_union(tuple_of(left), tuple_of(right)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(entries(left), entries(right))) / either)


def _cell(at: Column, h: Column, of: int) -> Column:
    return F.struct(at.alias("at"), h.alias("h"), F.lit(of).alias("of"))


# Digits of a digest that one number of 64 bits holds, with the sign to spare.
_DIGITS = 13


def _digest_cells(text: Column) -> Column:
    """A text's digest as cells of no text (0), a few digits each: numbers, unlike strings, are aggregated by hashing."""
    digest = F.sha2(text, 256)
    return F.array(*[_cell(F.lit(-1 - j), F.conv(F.substring(digest, 1 + at, _DIGITS), 16, 10).cast("bigint"), 0)
                     for j, at in enumerate(range(0, 64, _DIGITS))])


def _digest(shape: Shape) -> Column:
    """The digest from the bins after those of the k-mers."""
    parts = F.array_sort(F.filter("bins", lambda b: b["bin"] >= shape.tuples * shape.width))
    return F.lower(F.concat(*[F.lpad(F.hex(parts[j]["h_own"]), min(_DIGITS, 64 - at), "0")
                              for j, at in enumerate(range(0, 64, _DIGITS))]))


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and that to the next text.

    The edited text has its last third replaced by the beginning of the next text. k-mers before the change are shared
    by both texts, so they are exploded once and serve both.
    """
    rows, order = neighbours(docs, key, text)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("block", "key", "at", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))

    def cut(own: Column, other: Column) -> Column:
        """k-mers of both texts: equal beginnings once (3), then the rest of the text (1) and of the edited text (2)."""
        differ = F.array_position(F.transform(own, lambda h, i: ~h.eqNullSafe(F.get(other, i))), F.lit(True))
        return _let(F.when(differ == 0, F.size(own)).otherwise(differ - 1).cast("int"), lambda same: F.concat(
            F.transform(F.slice(own, F.lit(1), same), lambda h, i: _cell(i, h, 3)),
            F.transform(F.slice(own, same + 1, F.size(own)), lambda h, i: _cell(i + same, h, 1)),
            F.transform(F.slice(other, same + 1, F.size(other)), lambda h, i: _cell(i + same, h, 2))))

    own, other = kmers(F.col("text"), shape.k), kmers(F.col("edited"), shape.k)
    rows = rows.select(
        "block", "key", F.col("at").alias("row"), "n_chars",
        F.concat(_digest_cells(F.col("edited")), _let(own, lambda a: _let(other, lambda b: cut(a, b)))).alias("cells"))
    # The document's facts ride on its first cell only; the other cells stay narrow.
    cells = rows.select("block", "key", "row", "n_chars", F.posexplode_outer("cells").alias("i", "cell"))
    facts = lambda c: F.when(F.col("i") == 0, F.col(c)).alias(c)
    cells = cells.select("block", "row", facts("key"), facts("n_chars"), "cell.*")
    same = Window.partitionBy("block", "row", "h").orderBy("at", "of").rowsBetween(Window.unboundedPreceding, 0)
    bins = shape.tuples * shape.width

    # Shared cells come first, so their numbers are the same on both sides.
    number = F.sum((F.col("of").bitwiseAND(1) > 0).cast("int")).over(same)
    edited_number = F.sum((F.col("of").bitwiseAND(2) > 0).cast("int")).over(same)
    cells = cells.withColumn("h", F.when(F.col("of") == 0, F.col("h")).otherwise(
        F.xxhash64("h", F.when(F.col("of") == 2, edited_number).otherwise(number))))
    cells = cells.withColumn("bin", F.when(F.col("of") == 0, F.lit(bins - 1) - F.col("at")).otherwise(
        F.pmod(F.shiftrightunsigned("h", 7), F.lit(bins))).cast("int"))
    own = F.when(F.col("of") != 2, F.col("h"))
    other = F.when(F.col("of") >= 2, F.col("h"))
    found = cells.groupBy("block", "row", "bin").agg(
        F.max("key").alias("key"), F.max("n_chars").alias("n_chars"),
        F.min(own).alias("h_own"), F.min_by("at", own).alias("p_own"),
        F.min(other).alias("h_edited"), F.min_by("at", other).alias("p_edited"))
    found = found.groupBy("block", "row").agg(
        F.max("key").alias("key"), F.max("n_chars").alias("n_chars"),
        F.collect_list(F.struct("bin", "h_own", "p_own", "h_edited", "p_edited")).alias("bins"))
    found = found.select("block", "row", "key", "n_chars", _digest(shape).alias("edited_sha256"),
                         written(_signatures("own", shape)).alias("fingerprint"),
                         written(_signatures("edited", shape)).alias("edited_fingerprint"))
    found = found.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("row")))
    found = settle(found, "fingerprints")
    if order:
        heads = found.filter("row = 1").select(F.col("block").alias("next"), F.col("fingerprint").alias("head"))
        heads = settle(heads.join(_links(docs, order), "next").select("block", "head"), "heads")
        # One row of a block lacks its next one; the others need not meet the heads.
        last = found.filter("next is null").join(heads, "block").withColumn("next", F.col("head")).drop("head")
        found = found.filter("next is not null").unionByName(last)
    return found.select(
        "key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
