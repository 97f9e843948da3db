"""Held-out accuracy, plans against bounds, distinctness, and the pipeline's stages."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from graphspark.llm import kd_sharding, line_quality, packing, secret_scan, surrogates, token_store, toxicity

SF = "/root/testdata/sf0.01"


def test_pair_weights_are_learnt():
    """Neither term alone is toxic; both together are."""
    rng = np.random.default_rng(0)
    rows = [(np.flatnonzero(x), int(x[0] and x[1])) for x in rng.random((3000, 6)) < 0.5]
    m = toxicity.fit_machine(rows, np.arange(6))
    score = lambda *at: m.score(np.zeros(len(at), int), np.array(at), 1)[0]
    assert score(0, 1) > 0.5 > max(score(0), score(1), score(2, 3))


def test_toxicity_held_out(spark):
    out = toxicity.op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("a")).first()
    assert r.a > 0.93


def test_line_quality_keeps_good(spark):
    out = line_quality.op4_line_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    share = {r.quality: r.k for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < 0.2


def test_viterbi_against_all_states():
    rng = np.random.default_rng(3)
    field = line_quality.Field(rng.normal(size=(line_quality.N_FEATURES + 1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    features = rng.integers(0, line_quality.N_FEATURES, (9, line_quality.PER_LINE))
    text = np.array([0, 0, 0, 0, 0, 1, 2, 2, 2])
    got = line_quality.viterbi(field, features, text)
    own = field.line[features].sum(1)
    for t in range(3):
        at = np.flatnonzero(text == t)
        score = lambda s: field.begin[s[0]] + sum(own[a, x] for a, x in zip(at, s)) + sum(field.step[a, b] for a, b in zip(s, s[1:]))  # noqa: E731,B023
        best = max((tuple(k >> j & 1 for j in range(len(at))) for k in range(1 << len(at))), key=score)
        assert tuple(got[at]) == best


def test_forest_held_out(spark):
    forest = secret_scan.train(spark, secret_scan.labelled_findings(3000, 11))
    fresh = secret_scan.labelled_findings(800, 99)
    df = spark.createDataFrame([(k, a + c + b, p, y) for k, (a, c, b, p, y) in enumerate(fresh)], "doc_id long, text string, source string, y int")
    found = secret_scan.scan(df, forest).groupBy("doc_id").agg(F.max(F.col("is_secret").cast("int")).alias("hit"))
    r = df.join(found, "doc_id", "left").agg(F.avg((F.coalesce("hit", F.lit(0)) == F.col("y")).cast("int")).alias("a")).first()
    assert r.a > 0.93
    redacted = secret_scan.redact(df, forest)
    assert redacted.columns == df.columns and redacted.count() == df.count()


def test_packing_reaches_the_bound():
    rng = np.random.default_rng(5)
    for size, high in ((4000, 2048), (3000, 900), (500, 60), (1, 5)):
        lengths = rng.integers(1, high + 1, size)
        values, counts = np.unique(lengths, return_counts=True)
        plan = packing.solve(values, counts)
        bound = max(math.ceil(lengths.sum() / 2048), (lengths > 1024).sum())
        assert bound <= plan.sequences <= bound * 1.04 + 1
    assert packing.solve(np.array([], int), np.array([], int)).sequences == 0


def test_store_gives_ids_back(spark, odd, tmp_path):
    import public_tokenizers as P

    path = str(tmp_path / "s")
    token_store.write_store(odd, path, P.path("byte_bpe_50k.json"))
    ids = token_store.read_ids(spark, path).collect()
    digests = {(r.doc_id, r.start): r.n_tokens for r in token_store.read_digests(spark, path).collect()}
    assert {(r.doc_id, r.start): len(r.ids) for r in ids} == digests
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_shards_are_near_equal(spark):
    got = kd_sharding.op5_kd_sharding(spark, "/root/testdata/sf0.1").groupBy("shard").agg(F.sum("size").alias("b")).agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n")).first()
    assert got.n == 40 and got.hi <= 1.03 * got.lo


def test_surrogates_keep_type_and_stay_distinct(spark):
    r = random.Random(1)
    rows = [(k, f"Dear Mrs. {r.choice('ABCDE')}{r.choice(('nna', 'lma'))} Name{chr(97 + k % 26)}x, {k % 97:03d}-55-{k:04d} ip 10.0.{k % 5}.{k % 200}. Mr Name{chr(97 + k % 26)}x") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (20_000, 0):
        new = {x.doc_id: x.text for x in surrogates.pseudonymise(df, b"key", closure_rows=bound).collect()}
        pairs = {}
        for i, t in rows:
            a, b = list(surrogates.entities(t)), list(surrogates.entities(new[i]))
            assert [x[2] for x in a] == [x[2] for x in b]
            for x, y in zip(a, b):
                assert pairs.setdefault((x[2], x[3]), y[3]) == y[3] != x[3]
        kinds = lambda k: k.split(":")[0]
        seen = [(kinds(k), v) for (k, _), v in pairs.items()]
        assert len(seen) == len(set(seen))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.common.cut(stage(spark, docs, sf), "stage")
        assert out.columns == columns and out.count() <= before, name
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_near_dedup_keeps_one_of_each_component(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from graphspark.llm import simhash

    marked = simhash.near_duplicates(docs)
    components = simhash.class_roots(marked.select("fp").distinct()).select("root").distinct().count()
    assert corpus_pipeline.drop_copies(spark, docs, sf).count() == components
