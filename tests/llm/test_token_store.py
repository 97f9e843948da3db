"""The store gives back the very ids, and notices every kind of damage."""

import shutil

import pytest
from pyspark.sql import functions as F

from graphspark.llm import token_store

from .test_contracts import library_ids


@pytest.fixture(scope="module")
def store(spark, odd, tmp_path_factory):
    import public_tokenizers as P

    path = str(tmp_path_factory.mktemp("store") / "s")
    token_store.write_store(odd, path, P.path("byte_bpe_50k.json"))
    return path


@pytest.fixture
def copy(store, tmp_path):
    return shutil.copytree(store, tmp_path / "c")


def rewrite(spark, folder, change):
    df = spark.read.parquet(str(folder))
    shutil.move(folder, f"{folder}-old")
    change(spark.read.schema(df.schema).parquet(f"{folder}-old")).write.parquet(str(folder))


def assert_damaged(spark, copy):
    for read in (token_store.read_digests, token_store.read_ids):
        with pytest.raises(Exception, match="(?s)fit|missing|length"):
            read(spark, str(copy)).collect()


def test_ids_are_those_of_the_texts(spark, rows, store):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in token_store.read_ids(spark, store).collect())
    assert got == sorted((i is not None, i or 0, library_ids(t).tolist()) for i, t in rows)


def test_swapped_chunks_are_noticed(spark, copy):
    swap = lambda c: F.when(F.size("chunks") > 2, F.reverse(c)).otherwise(F.col(c)).alias(c)
    rewrite(spark, copy / "recipes", lambda df: df.select(*(swap(c) if c in ("chunks", "sizes") else c for c in df.columns)))
    assert_damaged(spark, copy)


def test_changed_root_and_start_are_noticed(spark, copy):
    rewrite(spark, copy / "recipes", lambda df: df.withColumn("start", F.col("start") + F.when(F.col("doc_id") == 7, 1).otherwise(0)))
    assert_damaged(spark, copy)


def test_missing_recipe_is_noticed(spark, copy):
    rewrite(spark, copy / "recipes", lambda df: df.where("doc_id IS NULL OR doc_id <> 3"))
    assert_damaged(spark, copy)


def test_missing_chunk_is_noticed(spark, copy):
    one = spark.read.parquet(str(copy / "recipes")).where("doc_id = 3").first().chunks[0]
    rewrite(spark, copy / "objects" / "kind=chunk", lambda df: df.where(F.col("hash") != F.lit(bytes(one))))
    assert_damaged(spark, copy)


def test_altered_chunk_is_noticed(spark, copy):
    one = spark.read.parquet(str(copy / "recipes")).where("doc_id = 11").first().chunks[0]
    damage = F.when(F.col("hash") == F.lit(bytes(one)), F.concat(F.expr("substring(data, 1, length(data) - 2)"), F.lit(b"\x07\x07"))).otherwise(F.col("data"))
    rewrite(spark, copy / "objects" / "kind=chunk", lambda df: df.withColumn("data", damage))
    assert_damaged(spark, copy)


def test_wrong_manifest_is_noticed(spark, copy):
    rewrite(spark, copy / "manifest", lambda df: df.withColumn("rows", F.col("rows") + (F.col("block") == -1).cast("int")))
    assert_damaged(spark, copy)


def test_blocks_are_bounded(spark, odd, tmp_path, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(token_store, "BLOCK", 3)
    path = str(tmp_path / "b")
    token_store.write_store(odd, path, P.path("byte_bpe_50k.json"))
    manifest = spark.read.parquet(f"{path}/manifest")
    assert manifest.where("block >= 0").agg(F.max("rows")).first()[0] <= 3
    assert token_store.read_digests(spark, path).count() == odd.count()
