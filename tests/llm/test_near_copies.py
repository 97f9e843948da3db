"""The near-dedup stage against all pairs compared in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphspark.llm import near_copies


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                union = len(sets[a] | sets[b])
                if group[a] != group[b] and (not union or len(sets[a] & sets[b]) / union >= 0.8):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return sorted({g: min(i for (i, _), h in zip(rows, group) if h == g) for g in group}.values())


@pytest.fixture(scope="module")
def copies():
    """Copies with some words changed (similarity 0.6 to 1), chains of copies, short and empty texts."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(6))
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for k in range(40):
        base = [word() for _ in range(r.choice((60, 150, 400)))]
        texts.append(" ".join(base))
        for _ in range(3):
            for at in r.sample(range(len(base)), max(1, len(base) // r.choice((45, 60, 90)))):
                base[at] = word()
            texts.append(" ".join(base))
    return list(enumerate(texts))


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()) == plain_kept(copies)


def test_large_groups_are_dealt_in_chunks(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.keep_one(df, group_shingles=150).collect()) == plain_kept(copies)


def test_large_keys_are_dealt_in_parts(spark, copies, monkeypatch):
    monkeypatch.setattr(near_copies, "KEY_ROWS", 2)
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == plain_kept(copies)


def test_close_fingerprints_are_candidates_without_a_shared_key(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    classes = near_copies.signatures(df).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", "fp"))).withColumn("keys", F.array().cast("array<long>"))
    rows, group = classes.collect(), {r.digest: r.group for r in near_copies.candidate_groups(classes).collect()}
    close = [(a.digest, b.digest) for k, a in enumerate(rows) for b in rows[:k] if a.n and b.n and ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count() <= 4]
    assert close and all(group[a] == group[b] for a, b in close)
    assert set(group) == {d for pair in close for d in pair}
