"""Columns of the caller with the operators' own names come back as they were."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import kd_sharding, line_quality, near_copies, secret_scan, simhash, toxicity

NAMES = "_h _found _parts _scores _any _features kept n_words base_failed _toxicity score piece start length _task _nth fp digest n keys _id _k _c0 _c1 node key value".split()


@pytest.fixture(scope="module")
def clashing(spark, odd):
    return odd.select("doc_id", "text", "source", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def check(out, clashing):
    want = {tuple(r) for r in clashing.drop("text").collect()}
    assert out.columns == clashing.columns
    got = [tuple(r) for r in out.drop("text").collect()]
    assert got and set(got) <= want


def test_stages_return_the_callers_columns(spark, clashing):
    check(toxicity.keep_clean(clashing, toxicity.fit_machine([], np.zeros(0, int)), threshold=2.0), clashing)
    check(line_quality.keep_good(clashing, line_quality.Field.blank()), clashing)
    check(near_copies.keep_one(clashing), clashing)
    check(secret_scan.redact(clashing, secret_scan.train(spark, secret_scan.labelled_findings(400))), clashing)


def test_shards_keep_named_columns(spark, clashing):
    out = kd_sharding.shard(clashing, {"s": F.col("source")}, shards=3, keep=("doc_id", "node", "key"))
    assert {(r.doc_id, r.node) for r in out.collect()} == {(r.doc_id, r.node) for r in clashing.collect()}


def test_repeated_ids_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k} bad worse", "x") for k in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(5)], "doc_id long, toxic int, quality int")
    assert toxicity._sample(docs, labels, "doc_id", "text", "toxic", 3).count() <= 3


def test_hubs_are_dealt_in_parts(spark):
    edges = spark.createDataFrame([(k, 0) for k in range(1, 500)] + [(k, 499) for k in range(500, 900)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 900)}
