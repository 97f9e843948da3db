"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

1. Every text gets a 64-bit fingerprint from the XXH64 values of its word shingles.
2. Rows with one fingerprint are one class; only classes go on.
3. A fingerprint is split in ``blocks`` parts. Two fingerprints that differ in at
   most ``distance`` bits agree in at least ``blocks - distance`` parts, so each
   combination of so many parts is a key, and close pairs share a key.
4. Rows of a key are compared where they meet. A task gives back a spanning
   forest of the links it has verified, never all pairs of a group: within a
   large group a search goes from each linked row to the rows not yet reached.
   A group too large for that is dealt in chunks, and pairs of chunks are compared.
5. Components come from alternating large and small stars over these links.

Defined cases: a null or empty text, or one without words, has fingerprint zero,
which links like any other; repeated rows are members of one class; null ids
are allowed and come last in choosing the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import LOWER, Words, cut, documents, drop, in_batches, join_in_parts, text_bytes

#: Rows of a key that are compared in one place; a larger group is dealt in chunks.
GROUP_ROWS = 20_000
#: Groups up to this size are compared pair by pair, all groups of a batch at once.
SMALL_GROUP = 48


def _weigh(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: a bit is set if it is in over half of the run."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    counts = np.zeros((len(n), 64), np.int64)
    step = 1 << 17
    owner = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[a : a + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[a : a + step]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_hashes(column: pa.Array, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 values of the texts' word shingles one after another, and the bounds of each text's run."""
    import xxhash

    data, offsets = text_bytes(column)
    data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    w = Words(data, offsets)
    have = np.diff(w.first)
    shingles = np.where(have >= words, have - words + 1, np.minimum(have, 1))
    total = int(shingles.sum())
    ends = np.cumsum(shingles)
    begin = np.repeat(w.first[:-1] - (ends - shingles), shingles) + np.arange(total)
    last = np.minimum(begin + words - 1, np.repeat(w.first[1:], shingles) - 1)
    text, digest = w.joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(text[a:b], seed) for a, b in zip(w.start[begin].tolist(), w.end[last].tolist())), np.uint64, total
    )
    return hashes, np.concatenate([[0], ends])


def fingerprint_batch(column: pa.Array, words: int, seed: int) -> np.ndarray:
    return _weigh(*shingle_hashes(column, words, seed))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", words: int = 4, seed: int = 42) -> DataFrame:
    """Add a long column with the fingerprint of each text (its 64 bits, signed), and leave the text out."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, text, 4_000_000):
            fp = fingerprint_batch(batch.column(text), words, seed)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(fp.view(np.int64))], names=[*kept, out]
            )

    return df.select(*kept, text).mapInArrow(run, schema)


# --------------------------------------------------------------------------
# Links

def blocks_for(classes: int, distance: int) -> int:
    """More blocks make longer keys: expected rows of a key stay few as classes grow."""
    for blocks in range(distance + 2, 64):
        if classes < 1 << (64 * (blocks - distance) // blocks + 2):
            return blocks
    return 64


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask of bits for every combination of blocks - distance blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of values as links of each value to the least one of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _reach(values: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning links of one group: from reached rows to rows that nothing has reached."""
    left, right = [], []
    rest = values
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            new = []
            for f in frontier:
                near = _close(rest, f, distance)
                if near.any():
                    found = rest[near]
                    left.append(np.full(len(found), f, np.uint64))
                    right.append(found)
                    new.append(found)
                    rest = rest[~near]
                    if not len(rest):
                        break
            frontier = np.concatenate(new) if new else rest[:0]
    return left, right


def links_of_groups(key: np.ndarray, value: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by key, all groups together."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, len(key)))
    a, b = [], []
    for h, s in zip(head[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist()):
        left, right = _reach(value[h : h + s], distance)
        a += left
        b += right
    last = np.repeat(head + size, size)
    at = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL_GROUP), size))
    for step in range(1, SMALL_GROUP):
        at = at[at + step < last[at]]
        if not len(at):
            break
        near = _close(value[at], value[at + step], distance)
        a.append(value[at[near]])
        b.append(value[at[near] + step])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(a), np.concatenate(b))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a sorted partition in runs that never part a key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        key, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        held.append((key, value.view(np.uint64)))
        rows += len(key)
        if rows < 200_000:
            continue
        key, value = (np.concatenate(x) for x in zip(*held))
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield key[:end], value[:end]
        held, rows = [(key[end:], value[end:])], len(key) - end
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held))


def links(classes: DataFrame, distance: int = 4, fp: str = "fp", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all that differ in at most ``distance`` bits."""
    masks = block_masks(blocks_for(classes.count(), distance), distance)
    keyed = classes.select(F.col(fp).alias("v")).withColumn(
        "m", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)))
    ).select(F.xxhash64("m", F.col("v").bitwiseAND(F.col("m"))).alias("key"), "v")
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, value in _whole_groups(batches):
            a, b = links_of_groups(key, value, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "v").mapInArrow(run, schema)

    large = cut(keyed.groupBy("key").count().where(F.col("count") > group_rows), "large-keys")
    if not large.limit(1).count():
        return linked(keyed)
    # a large group is dealt in chunks, and each pair of chunks is a group of its own
    chunks = F.ceil(F.col("count") / group_rows).cast("int")
    own = F.pmod(F.xxhash64(F.lit(1), "v"), chunks).cast("int")
    dealt = keyed.join(large, "key").select("key", "v", own.alias("s"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("t"))
    pairs = dealt.select(F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t")).alias("key"), "v")
    return linked(keyed.join(large, "key", "left_anti")).unionByName(linked(pairs))


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) and the least node of its component.

    Large and small stars in turn until nothing changes; each round is written
    in the shared folder, the one before it deleted. The edges of a hub are dealt in parts.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = join_in_parts(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            join_in_parts(large, least, "a", "b")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        new = cut(small, name)
        drop(now)
        # stars only: no root is a node with a root of its own
        deep = new.select(F.col("b").alias("a")).distinct().join(new.select("a"), "a", "left_semi").limit(1).count()
        twice = new.groupBy("a").count().where("count > 1").limit(1).count()
        now = new
        if not deep and not twice:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def class_roots(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Add to distinct fingerprints ``fp`` the least fingerprint that links reach, ``root``."""
    roots = components(links(classes, distance))
    return classes.join(roots, classes.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4
) -> DataFrame:
    """One row for each row of ``df``: its id, ``fp``, and ``component_id``, the least id that links reach."""
    marked = cut(fingerprints(df.select(id_column, text), text, words=words), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min(id_column).alias("least")), "classes")
    joined = class_roots(classes, distance)
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = cut(join_in_parts(joined, of_root, "root", "fp").select("fp", "component_id"), "components")
    return join_in_parts(marked, of_class, "fp", id_column).select(id_column, "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
