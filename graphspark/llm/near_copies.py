"""Near copies by SimHash and the Jaccard similarity of word shingles: each link of fingerprints or MinHash keys is verified exactly.

1. A text is its set of distinct XXH64 values of word shingles. Texts with one
   set (``digest``) are one class; only classes go on.
2. Classes whose SimHash fingerprints (of the set) differ in at most
   ``DISTANCE`` bits are candidates, found by the SimHash operator's links: none
   of these pairs is missed.
3. Fingerprints of texts of similarity 0.8 differ in about 10 of 64 bits (up to
   20), too many for pigeonhole blocks that still tell texts apart (a block would
   have 3 to 6 bits). So there are further candidates: ``BANDS`` keys of a class
   each hash the minima of ``ROWS`` permutations. A pair of similarity s shares a
   key but for (1 - s^ROWS)^BANDS: 1.1e-4 at 0.8, 7e-7 at 0.85.
4. Classes that either connects are a candidate group (star components). The texts
   of a group meet once, whatever number of keys they share, and their sets are
   compared exactly: a search goes from each linked set to the sets not yet
   reached, so a group of near copies costs no pair of each two. A group of more
   than ``GROUP_SHINGLES`` shingles is dealt in chunks, and pairs of chunks are compared.
5. Components come from the verified links alone.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty
and wordless texts are one class and link to no other; repeated rows are members
of one class; null ids are allowed and come last in choosing the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, in_batches, join_in_parts, plain_names
from .simhash import _weigh, components, links, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of candidates may differ.
DISTANCE = 4
#: Classes that share a key and are joined in one place; those of a larger group are dealt in parts.
KEY_ROWS = 10_000
BANDS, ROWS = 30, 6
#: Shingles of a candidate group that are compared in one place; a larger group is dealt in chunks.
GROUP_SHINGLES = 4_000_000
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their number."""
    hashes, bounds = shingle_hashes(column, words, seed)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h = np.sort(hashes[a:b])
        sets.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h)
    return (np.concatenate(sets) if sets else hashes), np.array([len(x) for x in sets], np.int64)


def band_keys(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set; all sets have members."""
    head = np.cumsum(size) - size
    keys = np.zeros((len(size), BANDS), np.uint64)
    mixed = np.empty_like(values)
    for band in range(BANDS):
        key = np.full(len(size), band + 1, np.uint64)
        for m in _MULTIPLIERS[band * ROWS : (band + 1) * ROWS]:
            np.multiply(values, m, out=mixed)
            key = (key ^ np.minimum.reduceat(mixed, head)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def signatures(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Add ``digest`` (of the set of shingles), ``n`` (its size), ``fp`` (its SimHash fingerprint) and ``keys``, and leave the text out."""
    import xxhash

    kept = [c for c in df.columns if c != text]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField("digest", T.LongType(), False), T.StructField("n", T.LongType(), False), T.StructField("fp", T.LongType(), False), T.StructField("keys", T.ArrayType(T.LongType(), False), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, text, 1_000_000):
            values, size = shingle_sets(batch.column(text), words)
            ends = np.cumsum(size)
            digest = np.array([xxhash.xxh64_intdigest(values[e - n : e].tobytes()) for e, n in zip(ends.tolist(), size.tolist())], np.uint64)
            some = size > 0
            keys = band_keys(values, size[some]).view(np.int64).ravel() if some.any() else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            fp = _weigh(values, np.concatenate([[0], ends]))
            new = [pa.array(digest.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, "digest", "n", "fp", "keys"])

    return df.select(*kept, text).mapInArrow(run, schema)


def fingerprint_links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) of digests that connect all classes whose fingerprints differ in at most ``distance`` bits; a class without words has none."""
    some = classes.where("n > 0").select("digest", "fp")
    least = cut(some.groupBy("fp").agg(F.min("digest").alias("b")), "fingerprints")
    same = join_in_parts(some, least, "fp", "digest").select(F.col("digest").alias("a"), "b").where("a <> b")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("b").alias(f"of_{c}"))
    near = join_in_parts(join_in_parts(links(least, distance), of("a"), "a", "b"), of("b"), "b", "a")
    return same.unionByName(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(digest, group): classes that fingerprints or shared keys connect, those with no other left out."""
    keyed = classes.select("digest", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("digest").alias("b"), F.count("*").alias("rows")).where("rows > 1")
    least = cut(least, "shared-keys")
    large = least.where(F.col("rows") > KEY_ROWS)
    shared = keyed.join(least.where(F.col("rows") <= KEY_ROWS), "key")
    if large.limit(1).count():
        shared = shared.unionByName(join_in_parts(keyed, large, "key", "digest"))
    found = components(shared.select(F.col("digest").alias("a"), "b").unionByName(fingerprint_links(classes)), "candidates")
    pairs = found.select(F.col("node").alias("digest"), F.col("root").alias("group"))
    return pairs.unionByName(found.select(F.col("root").alias("digest"), F.col("root").alias("group")).distinct())


def spanning_links(values: np.ndarray, size: np.ndarray, similarity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (numbers of sets) that connect all sets of one group whose Jaccard similarity is enough."""
    code = np.unique(values, return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
    left, right = [], []
    rest, data = np.arange(len(size)), code
    while len(rest):
        frontier, data, rest = [int(rest[0])], data[size[rest[0]] :], rest[1:]
        while frontier and len(rest):
            f = frontier.pop()
            own = code[ends[f] - size[f] : ends[f]]
            n = size[rest]
            mark[own] = True
            shared = np.add.reduceat(mark[data], np.cumsum(n) - n, dtype=np.int64)
            mark[own] = False
            near = shared / (size[f] + n - shared) >= similarity
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), f))
                right.append(found)
                frontier += found.tolist()
                data, rest = data[np.repeat(~near, n)], rest[~near]
    return left, right


def verified_links(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of digests from texts (key, digest, text): within each key, all pairs that are similar enough are connected."""

    def linked(key, digest, values, size):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])  # repeated rows
        values, key, digest, size = values[np.repeat(new, size)], key[new], digest[new], size[new]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends, a, b = np.cumsum(size), [], []
        for h, e in zip(head.tolist(), [*head[1:].tolist(), len(key)]):
            if e - h > 1:
                left, right = spanning_links(values[ends[h] - size[h] : ends[e - 1]], size[h:e], similarity)
                a += [digest[h + x] for x in left]
                b += [digest[h + x] for x in right]
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in in_batches(batches, "text", 1_000_000):
            values, size = shingle_sets(batch.column("text"), words)
            held.append((*(batch.column(c).to_numpy() for c in ("key", "digest")), values, size))
            total += len(values)
            if total < 1_000_000:
                continue
            key, digest, values, size = (np.concatenate(x) for x in zip(*held))
            end = int(np.searchsorted(key, key[-1]))  # the last key may go on
            at = int(size[:end].sum())
            if end:
                yield linked(key[:end], digest[:end], values[:at], size[:end])
            held, total = [(key[end:], digest[end:], values[at:], size[end:])], len(values) - at
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return texts.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(run, "a long, b long")


def keep_one(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, group_shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """One row of each component of near copies stays: the least id, then the least hash of the text.

    Rows that repeat both are one row. Columns of the caller stay, whatever their names.
    """
    columns = df.columns
    df, names = plain_names(df)
    id_column, text = names[id_column], names[text]
    marked = cut(signatures(df.select(id_column, text, F.xxhash64(text).alias("_h")), text, words), "signatures")
    least = F.min(F.struct(F.col(id_column).isNull().alias("_null"), F.col(id_column).alias("_id"), F.col("_h").alias("_k"))).alias("least")
    classes = cut(marked.groupBy("digest").agg(least, *(F.first(c).alias(c) for c in ("n", "fp", "keys"))), "classes")
    groups = cut(candidate_groups(classes).join(classes.drop("fp", "keys"), "digest"), "groups")
    chunks = groups.groupBy("group").agg(F.ceil(F.sum("n") / group_shingles).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64(F.lit(1), "digest"), F.col("chunks")).cast("int")
    dealt = groups.join(chunks, "group").select("group", "digest", "least.*", own.alias("s"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("t"))
    placed = dealt.select(F.xxhash64("group", F.least("s", "t"), F.greatest("s", "t")).alias("key"), "digest", "_id", "_k")
    here = df.withColumn("_h", F.xxhash64(text))
    texts = here.select(F.col(id_column).alias("_i"), "_h", F.col(text).alias("text")).join(placed, F.expr("_i <=> _id AND _h = _k")).select("key", "digest", "text")
    roots = components(verified_links(texts, words, similarity), "near-copies")
    joined = classes.select("digest", "least").join(roots, F.col("digest") == F.col("node"), "left")
    kept = joined.groupBy(F.coalesce("root", "digest")).agg(F.min("least").alias("least")).select("least._id", "least._k")
    # rows that are there once need no shuffle to be one row
    rows = marked.groupBy(F.col(id_column).alias("_i"), "_h").agg(F.count("*").alias("_rows")).where("_rows > 1")
    kept = cut(kept.join(rows, F.expr("_i <=> _id AND _h = _k"), "left").select("_id", "_k", F.col("_rows").isNotNull().alias("_again")), "kept")
    of = lambda which: here.join(kept.where(which), here[id_column].eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left_semi")
    stay = of("NOT _again").drop("_h")
    if kept.where("_again").limit(1).count():
        stay = stay.unionByName(of("_again").dropDuplicates([id_column, "_h"]).drop("_h"))
    return stay.toDF(*columns)
