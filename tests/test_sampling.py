"""Exact ranks in cut-up groups, and the samples built on them."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxloom.functions.draws import draw
from fluxloom.operators import sampling
from fluxloom.operators.ranking import dense_index, rank_by_draw


@pytest.fixture(scope="module")
def files(spark):
    """One hot file with most of the rows, and small ones."""
    sizes = {"hot": 900, "mid": 45, "one": 1, "ten": 10}
    return spark.createDataFrame([(f, i) for f, n in sizes.items() for i in range(n)],
                                 "file_name string, sample_n bigint").cache()


def md5_order(name, n, seed):
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}|{name}|{i}".encode()).hexdigest())


@pytest.mark.parametrize("bucket_rows", [3, 40, 100_000])
def test_rank_is_the_same_for_any_bucket_size(files, bucket_rows):
    ranked = rank_by_draw(files, ["file_name"], draw(7, "file_name", "sample_n"), bucket_rows=bucket_rows).collect()
    for name, n in (("hot", 900), ("mid", 45), ("one", 1)):
        mine = sorted((r for r in ranked if r.file_name == name), key=lambda r: r.rn)
        assert [r.rn for r in mine] == list(range(1, n + 1))
        assert [r.sample_n for r in mine] == md5_order(name, n, 7)
        assert {r.n_rows for r in mine} == {n}


def test_dense_index_by_ranges_equals_one_window(spark):
    values = spark.createDataFrame([(f"k{i * 7919 % 1000:04d}",) for i in range(3000)], "k string")
    ranged = dense_index(values, "k", "i", partitions=7).collect()
    assert sorted((r.k, r.i) for r in ranged) == [(f"k{i:04d}", i) for i in range(1000)]


def test_chunks_are_disjoint_and_short_ones_dropped(files):
    rows = sampling.random_chunks(files, 40, seed=1, bucket_rows=50).collect()
    keys = [(r.file_name, r.sample_n) for r in rows]
    assert len(keys) == len(set(keys))
    per_chunk = Counter((r.file_name, r.chunk) for r in rows)
    # 45 rows in chunks of 40 give two of 23 and 22; 10 and 1 rows are one chunk each.
    assert sorted(n for (f, _), n in per_chunk.items() if f == "mid") == [22, 23]
    assert per_chunk[("ten", 0)] == 10 and per_chunk[("one", 0)] == 1
    first = sampling.random_chunks(files, 40, seed=1, only_first=True).collect()
    assert {r.chunk for r in first} == {0}


def test_last_chunk_below_four_fifths_is_dropped(spark):
    rows = spark.createDataFrame([("f", i) for i in range(11)], "file_name string, sample_n bigint")
    # 11 rows in chunks of at most 2: six chunks of 2, the last of 1 row is dropped.
    assert sampling.random_chunks(rows, 2, seed=0).count() == 10
    table = sampling.chunk_table(rows, 2).first()
    assert (table.chunk_rows, table.n_chunks) == (2, 5)


def test_balanced_sample_takes_the_same_from_each_file(files):
    counts = Counter(r.file_name for r in sampling.balanced_sample(files, 400, seed=2, bucket_rows=50).collect())
    sizes = Counter(r.file_name for r in files.collect())
    assert min(sizes.values()) == 1  # a tiny file gives all it has, and takes nothing from the others
    assert counts == {f: -(-k // -(-k // 100)) for f, k in sizes.items()}
    trimmed = Counter(r.file_name for r in sampling.balanced_sample(files, 400, seed=2, trim=True).collect())
    assert set(trimmed.values()) == {1} and len(trimmed) == 4
    large = files.filter("file_name in ('hot', 'mid')")
    counts = Counter(r.file_name for r in sampling.balanced_sample(large, 60, seed=2).collect())
    assert sorted(counts.values()) == [23, 30]  # 45 rows in chunks of 30 are two of 23


def test_rotation_uses_every_chunk_once_per_cycle(files):
    turns = sampling.epoch_rotation(sampling.chunk_table(files, 200), 12, seed=3).collect()
    hot = [r.chunk for r in sorted(turns, key=lambda r: r.epoch) if r.file_name == "hot"]
    assert sorted(hot[:5]) == sorted(hot[5:10]) == list(range(5))
    assert len(turns) == 12 * 4


def test_cap_is_exact_and_seeded(files):
    rows = sampling.sample_cap(files, 100, seed=4, keys=["file_name", "sample_n"], bucket_rows=30)
    again = sampling.sample_cap(files.repartition(13), 100, seed=4, keys=["file_name", "sample_n"])
    assert rows.count() == 100
    assert set(rows.collect()) == set(again.select(rows.columns).collect())
    assert sampling.sample_cap(files, 10_000, seed=4, keys=["file_name", "sample_n"]).count() == 956


def test_mixes_cover_the_file_and_later_parts_take_the_rest(files):
    rows = sampling.mix_split(files, 3, seed=5, bucket_rows=7).collect()
    assert len(rows) == 956
    assert [Counter(r.mix for r in rows if r.file_name == "ten")[i] for i in range(3)] == [3, 3, 4]
    assert [r.mix for r in rows if r.file_name == "one"] == [2]


def test_batches_have_the_asked_size(files):
    sizes = Counter(r.batch for r in sampling.shuffled_batches(files, 100, seed=6, bucket_rows=11).collect())
    assert sizes == {**{i: 100 for i in range(9)}, 9: 56}


def test_nested_splits(files):
    splits = {}
    for r in sampling.nested_train_test(files, [1, 3]).collect():
        splits.setdefault(r.split, set()).add(r.file_name)
    assert splits == {"train_0": {"hot"}, "train_1": {"hot", "mid", "one"}, "test": {"ten"}}


def test_draw_is_md5_of_seed_and_key(files):
    row = files.filter("file_name = 'mid' and sample_n = 3").select(draw(9, "file_name", "sample_n").alias("d")).first()
    assert row.d == hashlib.md5(b"9|mid|3").hexdigest()
