"""Near duplicates by Order MinHash, candidates settled by banded alignment (see `order_minhash`).

1. Equal texts are one node (the md5 of the text), so a group of copies is one node however large it is.
2. Every text gets its bands in one pass; only nodes, counts and bands are written.
3. In every band with two nodes or more, each node is compared with the band's hub, the node with the least hash of
   node and table: a band with m nodes costs m comparisons, and a node has another hub in every table. Pairs are made
   distinct, texts are joined to them (a hub that many share is split by Spark's skew join), and tasks align them.
4. Links make components. Bands that still hold nodes of different components keep the rest: two of their nodes may be
   alike without either being like a hub. They are found exactly, without pairing up a band: texts whose similarity
   reaches the threshold t share most k-mers, so if each orders its k-mers from rare to frequent, they share one among
   the first n - ceil(t n) + 1 (prefix filter), standing early enough in both (positional filter). The k-mers of the
   rest are counted, and only nodes whose prefix holds a k-mer that another node has too are joined on it. These pairs
   are aligned like the others. Nodes of at most ``short / t`` k-mers always belong to the rest, whether they share a
   band or not: bands of few k-mers miss too often, and texts of less than ``length`` have bands of fewer minima.
5. Components of all links are the classes; a class is named by its least document id.

Before any alignment, 1,024 bits per text (`order_minhash.parities`) rule out pairs that differ in too many k-mers.

So no link between different texts with a band in common is lost, and none with a text of at most ``short`` k-mers. With
the defaults a longer pair at the threshold misses all bands with probability 0.003 at 40 k-mers; this falls with
the length to (1 - t**length) ** tables = 0.002.

Null texts are alike to nothing, not to each other. Texts without words are alike only if they are equal. Texts with
fewer than k words are alike only if their words are. Repeated ids with different texts are different rows; rows that repeat id
and text are in one class. A class without any id has a null name. Only id and text are read for classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.common import slices, texts_of
from fluxloom.llm.order_minhash import Sketch, bands, kmers, numbered, parities, similar
from fluxloom.session import settle, settle_alone


def sign(docs: DataFrame, sketch: Sketch = Sketch(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, n, bands, bits) of every row with a text, written."""
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("node"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = kmers(texts_of(part), sketch.k)
                labelled = numbered(hashes, counts)
                found = bands(labelled, counts, sketch).view(np.int64)
                bits = pa.array(list(parities(labelled, counts)), pa.list_(pa.int64()))
                lists = [row if n else row[:0] for row, n in zip(found, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), pa.array(lists, pa.list_(pa.int64())), bits],
                    ["id", "node", "n", "bands", "bits"])

    kind = rows.schema["id"].dataType.simpleString()
    return settle(rows.mapInArrow(run, f"id {kind}, node string, n bigint, bands array<bigint>, bits array<bigint>"), "signed")


def _possible(share: float, n: str, bits: str, other_n: str, other_bits: str) -> Column:
    """Not ruled out: texts at the threshold differ in so few k-mers, and bits differ in no more places than k-mers do."""
    apart = sum((F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other_bits)[i])) for i in range(16)), F.lit(0))
    return apart <= F.lit(1 - 2 * share / (1 + share)) * (F.col(n) + F.col(other_n)) + F.lit(1e-9)


def _texts(docs: DataFrame, nodes: DataFrame, first: DataFrame, key: str, text: str) -> DataFrame:
    """Text of every wanted node, read from the first row that has it. Other rows' texts are not shuffled."""
    wanted = first.join(nodes, "node", "left_semi").select(F.col("id").alias("of"), F.col("node").alias("wanted"))
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("node"), F.col(text).alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("wanted")))
    return rows.groupBy("node").agg(F.first("text").alias("text"))  # rows may repeat id and text


def align(pairs: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """Those of the pairs (a, b) whose similarity reaches the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            for part in slices(batch, "text_a"):
                hashes, counts = kmers(texts_of(part, "text_a"), sketch.k)
                ends = np.cumsum(counts)
                alike = []
                for at, hub in enumerate(part.column(1).to_pylist()):
                    if hub != held[0]:  # rows of a hub stand together
                        held = hub, kmers([part.column(3)[at].as_py()], sketch.k)[0]
                    alike.append(similar(hashes[ends[at] - counts[at] : ends[at]], held[1], sketch.threshold)[0])
                yield part.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return rows.mapInArrow(run, "a string, b string")


def _rest_pairs(rest: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """Pairs of the rest's nodes with different roots that the threshold does not rule out."""
    share = sketch.threshold
    rows = texts.join(rest.select("node", "root"), "node").select("node", "root", "text")
    of = rest.select("node", "bits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = kmers(texts_of(part), sketch.k)
                labelled = numbered(hashes, counts)
                ends = np.cumsum(counts)
                lists = [labelled[e - n : e].view(np.int64) for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), pa.array(lists, pa.list_(pa.int64()))],
                    ["node", "root", "n", "grams"])

    grams = rows.mapInArrow(cut, "node string, root string, n bigint, grams array<bigint>")
    grams = grams.select("node", "root", "n", F.explode("grams").alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    # K-mers of one component only cannot link two, but they keep their place in the order.
    held = settle(grams.join(counted.filter("rows > 1"), "gram"), "grams")
    alone = held.groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    ordered = Window.partitionBy("node").orderBy("rows", "gram")
    placed = (held.join(alone, "node")
              .withColumn("at", F.row_number().over(ordered) + F.col("n") - F.col("common"))  # unique ones come first
              .filter(F.col("at") <= F.col("n") - F.ceil(F.lit(share) * F.col("n") - F.lit(1e-9)) + 1)
              .filter("r0 <> r1").select("gram", "node", "root", "n", "at"))
    placed = settle(placed.join(of, "node"), "prefixes")
    other = placed.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "at", "bits")])
    common = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) + 1
    need = F.lit(share / (1 + share)) * (F.col("n") + F.col("n_b")) - F.lit(1e-9)
    pairs = placed.join(other, "gram").filter((F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b"))
                                              & (common >= need) & _possible(share, "n", "bits", "n_b", "bits_b"))
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the least node of its component.

    In a round every node steps to its least neighbour and to that one's step. Links are carried over to where their ends have
    gone, and those inside a node are dropped, so they shrink: a cloud whose nodes are all linked to each other is read once.
    """
    edges = settle(links.select("a", "b").filter("a <> b").distinct(), "edges")
    found = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = settle(found.withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least"))
        near = settle(near.select("v", F.least("v", "least").alias("up")), "near")
        step = settle(near.join(near.select(F.col("v").alias("up"), F.col("up").alias("to")), "up").select("v", "to"), "steps")
        ends = (edges.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
                .join(step.select(F.col("v").alias("y"), F.col("to").alias("z")), F.col("b") == F.col("y")).select("x", "z"))
        further = step.select(F.col("to").alias("x")).distinct().join(
            step.select(F.col("v").alias("x"), F.col("to").alias("z")), "x")  # nodes that others went to may have gone on
        ends = ends.union(further).filter("x <> z")
        edges = settle(ends.select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b")).distinct(), "edges")
        moved = found.join(step, F.col("root") == F.col("v"), "left")
        found = settle(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
    return found


def classes(docs: DataFrame, sketch: Sketch = Sketch(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, root, class_id) of every row, once per different (id, node): its text, a text that stands for its class,
    and the class's least id. Node and root are null where the text is."""
    signed = sign(docs, sketch, key, text)
    first = settle(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"),
                                              F.first("bands").alias("bands"), F.first("bits").alias("bits")), "nodes")
    # Bits are 128 bytes that do not compress: they meet pairs, not all bands of all nodes.
    members = first.select("node", "n", F.posexplode("bands").alias("table", "band"))
    full = members.groupBy("table", "band").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("node", "table").alias("h"), "node", "n")).alias("hub"))
    full = full.filter("m > 1").select("table", "band", F.col("hub.node").alias("b"), F.col("hub.n").alias("n_b"))
    members = settle(members.join(full, ["table", "band"]), "members")
    near = F.least("n", "n_b") >= F.lit(sketch.threshold) * F.greatest("n", "n_b") - F.lit(1e-9)
    met = settle(members.filter((F.col("node") != F.col("b")) & near)
                 .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "met")
    own = first.select(F.col("node").alias("a"), "n", "bits")
    other = first.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    pairs = settle(met.join(own, "a").join(other, "b").filter(_possible(sketch.threshold, "n", "bits", "n_b", "bits_b"))
                   .select("a", "b"), "pairs")
    short = first.filter((F.col("n") > 0) & (F.col("n") <= sketch.short / sketch.threshold)).select("node")
    nodes = members.select("node").union(short).distinct()
    texts = settle(_texts(docs, nodes, first, key, text), "texts")
    links = settle(align(pairs, texts, sketch), "links")

    found = connected(links).withColumnRenamed("node", "at")
    roots = nodes.join(found, F.col("node") == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = settle(roots, "roots")
    mixed = (members.join(roots, "node").groupBy("table", "band")
             .agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("table", "band"))
    rest = members.join(mixed, ["table", "band"], "left_semi").select("node").union(short).distinct()
    rest = first.select("node", "bits").join(rest, "node", "left_semi").join(roots, "node")
    more = settle(align(_rest_pairs(rest, texts, sketch), texts, sketch), "links")
    of = roots.select(F.col("node").alias("at"), "root")
    ends = (more.join(of.withColumnRenamed("root", "x"), F.col("a") == F.col("at")).drop("at")
            .join(of.withColumnRenamed("root", "y"), F.col("b") == F.col("at")).select(F.col("x").alias("a"), F.col("y").alias("b")))
    merged = connected(ends).select(F.col("node").alias("old"), F.col("root").alias("new"))
    roots = roots.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))

    named = first.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("id").alias("class_id"))
    named = named.join(names, "root").select("node", "root", "class_id")
    found = signed.select("id", "node").distinct().join(named, "node").select("id", "node", "root", "class_id")
    alone = docs.filter(F.col(text).isNull()).select(F.col(key).alias("id")).distinct()
    none = F.lit(None).cast("string")
    return found.unionByName(alone.select("id", none.alias("node"), none.alias("root"), F.col("id").alias("class_id")))


def classify(docs: DataFrame, sketch: Sketch = Sketch(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the table: its id and the id that names its class."""
    named = classes(docs, sketch, key, text).select(F.col("id").alias("i"), F.col("node").alias("n"), "class_id")
    rows = docs.select(F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("node"))
    joined = rows.join(named, F.col("id").eqNullSafe(F.col("i")) & F.col("node").eqNullSafe(F.col("n")))
    return joined.select("id", "class_id")


def representatives(docs: DataFrame, sketch: Sketch = Sketch(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every class with all its columns: that with the least id, then text; one of those that repeat both."""
    found = settle_alone(docs.sparkSession, lambda: classes(docs, sketch, key, text), "classes")
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("least")
    chosen = found.filter("node is not null").groupBy("root").agg(least).select("least.id", "least.node")
    chosen = chosen.unionByName(found.filter("node is null").select("id", "node"))
    chosen = chosen.select(F.col("id").alias("i"), F.col("node").alias("n"))
    repeated = docs.groupBy(F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("node")).count().filter("count > 1")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("node"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("i")) & F.col("node").eqNullSafe(F.col("n"))).drop("i", "n")
    if repeated.isEmpty():
        return kept.select("row.*")
    return kept.dropDuplicates(["id", "node"]).select("row.*")
