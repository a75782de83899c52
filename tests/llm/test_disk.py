"""What near duplicates and the pipeline leave on disk while they run, and what they hold in memory."""

import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluxloom.llm import common, languages, near_duplicates
from fluxloom.session import settle, settle_alone, shared_dir


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    settled = settle(rows.groupBy("k").agg(F.sum("id").alias("x")).groupBy("x").count())
    assert not shuffle_files(spark) - before
    assert settled.count() == 100


def test_bits_are_not_carried_by_every_band(spark, monkeypatch):
    columns = {}

    def seen(df, tag, *given):
        columns.setdefault(tag, set(df.columns))
        return settle(df, tag, *given)

    monkeypatch.setattr(near_duplicates, "settle", seen)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "another text altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: r["class_id"] for r in near_duplicates.classify(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert not {"bits", "bits_b"} & columns["members"] and columns["pairs"] == {"a", "b"}


def scratch(spark) -> set[str]:
    """Tags of the written tables, each as often as it is there."""
    root = f"{shared_dir(spark)}/fluxloom/{spark.sparkContext.applicationId}"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def tags(names: set[str]) -> list[str]:
    return sorted(name[:-33] for name in names)


DOCS = [(i, text, lang, source, len(text)) for i, (text, lang, source) in enumerate([
    ("the cat sat on the mat and looked at the dog in the garden", "en", "a"),
    ("the cat sat on the mat and looked at the dog in the garden", "en", "b"),
    ("le chat est sur le tapis et regarde le chien dans le jardin", "fr", "a"),
    ("call +44 20 7946 0958 or write to ann@example.com about the garden", "en", None), ("", None, "a")])]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_tables_of_the_way_go_when_the_result_is_written(spark):
    before = scratch(spark)

    def make(tag):
        return settle(settle(spark.range(10), f"{tag}-one").filter("id > 2"), f"{tag}-two")

    inner = settle_alone(spark, lambda: settle_alone(spark, lambda: make("in"), "inner").filter("id > 3").union(make("out")), "outer")
    assert tags(scratch(spark) - before) == ["outer"] and inner.count() == 13
    with pytest.raises(ValueError):
        settle_alone(spark, lambda: int("x"), "none")
    assert settle(spark.range(3), "after").count() == 3 and tags(scratch(spark) - before) == ["after", "outer"]


def test_language_bars_are_learned_without_a_copy_of_the_texts(spark):
    docs, before = spark.createDataFrame(DOCS, SCHEMA), scratch(spark)
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3]
    assert tags(scratch(spark) - before) == ["bars"]


def test_near_duplicates_leave_their_classes_only(spark):
    docs, before = spark.createDataFrame(DOCS, SCHEMA), scratch(spark)
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]
    assert tags(scratch(spark) - before) == ["classes"]


def test_the_pipeline_leaves_its_last_stage_only(spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    before = scratch(spark)
    found = corpus_pipeline.run(spark, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    assert set(texts) <= {0, 2, 3} and all("ann@" not in text for text in texts.values())
    assert tags(scratch(spark) - before) == ["ids", "stage"]


def test_ids_are_decoded_by_tasks_of_one_python_worker(spark):
    plan = corpus_pipeline.token_ids(spark, spark.createDataFrame(DOCS, SCHEMA), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InArrow") == 1


def test_short_texts_do_not_make_slices_tall(spark):
    batch = pa.record_batch({"text": pa.array(["abc"] * 5000)})
    parts = list(common.slices(batch, "text"))
    assert sum(part.num_rows for part in parts) == 5000 and max(part.num_rows for part in parts) <= common.SLICE_ROWS


def test_memory_of_an_encoder_is_bounded_by_its_cells():
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} {i % 7}x" for i in range(10_000)]
    encoder = languages.Encoder()
    encoder.encode(texts[:10])
    tracemalloc.start()
    sums, _ = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 260e6  # of which the sums are 82 MB
    alone = [languages.Encoder().encode([texts[i]])[0][0] for i in (0, 77, 9999)]
    assert all((sums[i] == own).all() for i, own in zip((0, 77, 9999), alone, strict=True))
