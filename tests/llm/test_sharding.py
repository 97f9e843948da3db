"""The k-d tree against plain recursion over sorted rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphspark.llm import kd_sharding


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcdé ") for _ in range(r.randint(0, 400))) for _ in range(400)]
    rows = [(k, r.choice(texts) if k % 3 else "a copy of many " * 9, r.choice(("de", "en", "en", None)), f"https://host/{r.choice('abcdefgh')}", float(r.choice((1, 2, 7, math.nan))), "x", 7) for k in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rank double, node string, size int").repartition(5)


DIMS = ("lang", "source", "rank")


def keyed(spark, table, monkeypatch):
    """The rows with their keys, as the tree gets them."""
    seen = {}
    tree = kd_sharding.kd_tree

    def spy(meta, dims, shards):
        seen["rows"] = [r.asDict() for r in meta.collect()]
        return tree(meta, dims, shards)

    monkeypatch.setattr(kd_sharding, "kd_tree", spy)
    out = kd_sharding.shard(table, {d: F.col(d) for d in DIMS}, shards=7, keep=("doc_id", "node", "size"))
    assert out.columns[:3] == ["doc_id", "node", "size"]
    return seen["rows"], {r.doc_id: r for r in out.select("doc_id", "shard", "slot").collect()}


def plain(rows, shards, first, near=None):
    if shards == 1:
        return {r["uid"]: first for r in rows}
    half = shards // 2
    if not rows:
        return {}
    spread = [max(r[f"k{d}"] >> 41 for r in rows) - min(r[f"k{d}"] >> 41 for r in rows) for d in range(3)]
    dim = f"k{spread.index(max(spread))}"
    order = sorted((r[dim], r["uid"], r["size"]) for r in rows)
    key, row, moved = kd_sharding._choose(order, sum(r["size"] for r in rows) * half / shards)
    left = [r for r in rows if (r[dim], r["uid"]) < (key, row) or r["uid"] in moved]
    right = [r for r in rows if not ((r[dim], r["uid"]) < (key, row) or r["uid"] in moved)]
    return plain(left, half, first) | plain(right, shards - half, first + half)


def test_cuts_are_those_of_plain_recursion(spark, table, monkeypatch):
    rows, got = keyed(spark, table, monkeypatch)
    want = plain(rows, 7, 0)
    assert {r["_kept0"]: want[r["uid"]] for r in rows} == {k: r.shard for k, r in got.items()}


def test_histograms_find_the_same_balance(spark, table, monkeypatch):
    """Few bins and few rows around a cut: many rounds, ties among copies, and cuts still within one row's bytes."""
    monkeypatch.setattr(kd_sharding, "BINS", 16)
    monkeypatch.setattr(kd_sharding, "NEAR_ROWS", 16)
    rows, got = keyed(spark, table, monkeypatch)
    size = {}
    for r in rows:
        size.setdefault(got[r["_kept0"]].shard, []).append(r["size"])
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert len(rows) == 900 and len(size) == 7
    assert all(abs(sum(s) - total / 7) <= 3 * largest for s in size.values())
    for s in size:
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(len(size[s])))


def test_strings_count_as_a_whole(spark, table):
    """Sources that share their first bytes are told apart."""
    out = kd_sharding._codes(table.select("doc_id", "source"), "source").distinct()
    code = {r.source for r in out.select("source").distinct().collect()}
    assert code == {float(k) for k in range(8)}


def test_equal_texts_take_the_same_keys(spark, table, monkeypatch):
    rows, _ = keyed(spark, table, monkeypatch)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add((r["k0"], r["k1"], r["k2"]))
    assert all(len(v) == 1 for v in by_text.values())
