"""Token ids in a content-addressed store.

Three Parquet tables under one path:

* ``objects/kind=chunk`` (hash, n, data): id streams cut where a rolling hash says
  so; every unique chunk once, its ids little-endian (two bytes each, four where
  an id needs them), under the BLAKE2b hash of these bytes. ``kind=recipe`` has
  what the ordered recipes are made from.
* ``recipes`` (range, place, doc_id, row, start, n_tokens, root, chunks, sizes):
  in ascending id order, a document's chunks, the ids of all documents before
  it, and the Merkle root of its chunk hashes.
* ``manifest`` (range, block, rows, n_tokens, root): for each ``BLOCK`` documents
  of a range of the id order the Merkle root over their ids, starts, lengths and
  roots; in the row with block -1 the root over the roots of the range's blocks.

Reading verifies every step: a chunk's hash is computed anew from its bytes, a
document's root from its list of chunks, the blocks' and ranges' roots from the
documents. Whatever doesn't agree is an error (``Damaged``, or an error of the
query where Spark finds it).

The references to a chunk that many documents share are dealt in ``SALTS`` parts.
Defined cases: null and empty texts are documents of the end id alone; repeated
ids are documents of their own, ordered by their row; null ids come first; other
columns are not stored; an empty table gives an empty store.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .bpe_codec import library_encoder, rank_file
from .common import cut, documents, drop, in_batches, scratch

#: A chunk ends where the low bits of the rolling hash are zero, within these bounds.
MASK_BITS, LEAST, MOST, WINDOW = 8, 64, 2048, 8
#: Documents under one root of the manifest, and parts that references to one chunk are dealt in.
BLOCK, SALTS = 4096, 64


class Damaged(ValueError):
    """The files don't fit together."""


def _gear(ids: np.ndarray) -> np.ndarray:
    """A mixed 64-bit value for each id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_ends(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each stream (bounds in ``first``) the ends of its chunks, relative to its start."""
    gear = _gear(ids)
    rolling = np.zeros(len(ids), np.uint64)
    for k in range(WINDOW):
        rolling[k:] += gear[: len(ids) - k] << np.uint64(k + 1)
    hits = np.flatnonzero((rolling >> np.uint64(20)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1
    bounds = np.searchsorted(hits, first)
    out = []
    for k in range(len(first) - 1):
        a, n = int(first[k]), int(first[k + 1] - first[k])
        ends, last = [], 0
        for h in (hits[bounds[k] : bounds[k + 1]] - a).tolist():
            while h - last > MOST:
                last += MOST
                ends.append(last)
            if h - last >= LEAST:
                last = h
                ends.append(last)
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(np.array(ends, np.int64))
    return out


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is."""
    level = list(hashes)
    while len(level) > 1:
        pairs = [address(b"\x01" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) & ~1 :]
    return level[0] if level else address(b"")


# --------------------------------------------------------------------------
# CRC-32 of joined streams, from the CRC-32 of the parts


def _zero_tables() -> np.ndarray:
    """tables[k, b, v]: what byte b of a checksum, of value v, becomes after 2**k zero bytes."""
    one = np.zeros((4, 256), np.uint64)
    for b in range(4):
        for v in range(256):
            x = v << (8 * b)
            for _ in range(8):
                x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
            one[b, v] = x
    out = [one]
    for _ in range(47):
        last = out[-1]
        out.append(_through(last, last))
    return np.array(out)


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = np.zeros_like(x)
    for b in range(4):
        y ^= table[b][(x >> np.uint64(8 * b)) & np.uint64(255)]
    return y


_tables: np.ndarray | None = None


def shift_crc(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds (by exclusive or) to that of a whole with so many bytes after it."""
    global _tables
    if _tables is None:
        _tables = _zero_tables()
    crc = crc.astype(np.uint64)
    for k in range(int(following.max(initial=0)).bit_length()):
        some = np.flatnonzero(following >> k & 1)
        crc[some] = _through(_tables[k], crc[some])
    return crc


# --------------------------------------------------------------------------
# Writing

def _encode(df: DataFrame, tokenizer_path: str, id_column: str, text: str, end_id: int) -> DataFrame:
    """A row of kind "recipe" for every row, and one of kind "chunk" for every chunk that its task hasn't given yet."""
    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()), T.StructField("hash", T.BinaryType()), T.StructField("n", T.LongType()),
            T.StructField("data", T.BinaryType()), df.schema[id_column], T.StructField("row", T.LongType()),
            T.StructField("chunks", T.ArrayType(T.BinaryType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        ]
    )
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.binary(), None, pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encoder = library_encoder(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        given: set[bytes] = set()
        for batch in in_batches(batches, text, 4_000_000):
            kinds[4] = batch.column(id_column).type
            found, count = encoder.encode(batch.column(text).to_pylist())
            ids = np.insert(found, np.cumsum(count), end_id)
            first = np.concatenate([[0], np.cumsum(count + 1)])
            chunks, sizes, roots, new = [], [], [], {}
            small = ids.max(initial=0) < 1 << 16
            short = ids.astype("<u2").tobytes() if small else b""
            for a, ends in zip(first.tolist(), chunk_ends(ids, first)):
                parts, last = [], 0
                for e in ends.tolist():
                    if small:
                        data = short[2 * (a + last) : 2 * (a + e)]
                    else:
                        part = ids[a + last : a + e]
                        data = part.astype("<u2" if part.max() < 1 << 16 else "<u4").tobytes()
                    h = address(data)
                    parts.append(h)
                    if h not in given:
                        if len(given) < 300_000:  # what it forgets, the shuffle makes unique
                            given.add(h)
                        new[h] = (e - last, data)
                    last = e
                chunks.append(parts)
                sizes.append(np.diff(ends, prepend=0).tolist())
                roots.append(merkle(parts))
            n = batch.num_rows
            recipe = [["recipe"] * n, roots, count + 1, None, None, np.arange(number, number + n), chunks, sizes]
            columns = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(recipe, kinds)]
            columns[4] = batch.column(id_column)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            number += n
            size, data = zip(*new.values()) if new else ((), ())
            chunk = [["chunk"] * len(new), list(new), size, data, None, None, None, None]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(new), t) if c is None else pa.array(c, t) for c, t in zip(chunk, kinds)], names=schema.names
            )

    return df.select(id_column, text).mapInArrow(run, schema)


def write_store(
    df: DataFrame, path: str, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", end_id: int = 0
) -> None:
    """Encode ``text`` and write the three tables under ``path``."""
    spark = df.sparkSession
    coded = _encode(df, tokenizer_path, id_column, text, end_id)
    # one pass over the texts and one shuffle make chunks unique (a task gives each chunk once, so nothing is left to
    # merge before it); recipes, a tenth of the bytes, go along, each under its row: a pass of their own would cost more
    (
        coded.withColumn("once", F.coalesce(F.col("row").cast("string").cast("binary"), "hash"))
        .repartition("once")
        .dropDuplicates(["kind", "once"])
        .drop("once")
        .write.partitionBy("kind")
        .option("compression", "zstd")
        .parquet(f"{path}/objects")
    )
    recipes = _objects(spark, path, "recipe", coded.schema).select(
        id_column, "row", F.col("n").alias("n_tokens"), F.col("hash").alias("root"), "chunks", "sizes"
    )
    # ranges of the id order: the range of a row is written, so that it can't change later
    ranged = cut(
        recipes.repartitionByRange(id_column, "row").withColumn("range", F.spark_partition_id()), "ranged"
    )
    totals = ranged.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("range", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each range
    order = Window.partitionBy("range").orderBy(id_column, "row")
    inside = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.select("*", F.coalesce(inside, F.lit(0)).alias("inside"), (F.row_number().over(order) - 1).cast("long").alias("place")).join(base, "range")
    placed = placed.select(
        "range", "place", id_column, "row", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "root", "chunks", "sizes"
    )
    placed.sortWithinPartitions("range", "place").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop(ranged)
    _manifest(spark.read.schema(placed.schema).parquet(f"{path}/recipes"), id_column).write.parquet(f"{path}/manifest")


def _objects(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None) -> DataFrame:
    schema = schema or T._parse_datatype_string("hash binary, n long, data binary, kind string")  # an empty store has no files
    return spark.read.schema(schema).parquet(f"{path}/objects").where(F.col("kind") == kind)


def _manifest(recipes: DataFrame, id_column: str) -> DataFrame:
    """Roots of blocks, at most ``BLOCK`` documents each, and of ranges, over their blocks."""
    bound = [F.col(id_column).cast("string"), F.col("start"), F.col("n_tokens"), F.hex("root")]
    leaf = F.unhex(F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("?")) for c in bound)), 256))
    listed = lambda by, what: F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x["what"]).alias("roots")
    schema = "range int, block long, rows long, n_tokens long, root binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = pa.array([merkle(r) for r in batch.column("roots").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], roots], names=["range", "block", "rows", "n_tokens", "root"])

    def sums(df: DataFrame, keys: list[str], rows, by: str, what) -> DataFrame:
        return df.groupBy(*keys).agg(rows.alias("rows"), F.sum("n_tokens").alias("n_tokens"), listed(F.col(by).alias("by"), what.alias("what")))

    block = F.expr(f"place div {BLOCK}").cast("long").alias("block")
    leaves = recipes.select("range", block, "place", "n_tokens", leaf.alias("leaf"))
    blocks = sums(leaves, ["range", "block"], F.count("*"), "place", F.col("leaf")).mapInArrow(run, schema)
    ranges = sums(blocks, ["range"], F.sum("rows"), "block", F.col("root"))
    return blocks.unionByName(ranges.select("range", F.lit(-1).cast("long").alias("block"), "rows", "n_tokens", "roots").mapInArrow(run, schema))


# --------------------------------------------------------------------------
# Reading


def _numbers(data: bytes, n: int) -> np.ndarray:
    if not n or len(data) not in (2 * n, 4 * n):
        raise Damaged("a chunk doesn't have the length that the store says")
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def _open(chunks: DataFrame) -> DataFrame:
    """(hash, crc, size): the hash, the checksum of 32-bit ids and their number, all computed from a chunk's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, n = batch.column("data").to_pylist(), batch.column("n")
            size = n.to_numpy()
            if (pc.binary_length(batch.column("data")).to_numpy() == 2 * size).all() and size.all():
                wide = np.frombuffer(b"".join(data), "<u2").astype("<u4").tobytes()
                ends = (4 * np.cumsum(size)).tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends)]
            else:
                crc = [zlib.crc32(_numbers(d, k).tobytes()) for d, k in zip(data, size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([address(d) for d in data], pa.binary()), pa.array(crc, pa.int64()), n], names=["hash", "crc", "size"])

    return chunks.select("n", "data").mapInArrow(run, "hash binary, crc long, size long")


def _references(recipes: DataFrame, id_column: str) -> DataFrame:
    """A row for each chunk of each document, with the ids that follow it there; the document's root is verified."""
    kept = [recipes.schema[c] for c in (id_column, "row", "start")]
    schema = T.StructType([*kept, *(T.StructField(c, t) for c, t in (("parts", T.IntegerType()), ("k", T.IntegerType()), ("hash", T.BinaryType()), ("n", T.LongType()), ("after", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, sizes = batch.column("chunks"), batch.column("sizes")
            parts, n = pc.list_value_length(chunks).to_numpy(), sizes.flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(parts)
            total = np.concatenate([[0], np.cumsum(n)])
            whole = total[ends] - total[ends - parts]
            roots = [merkle(c) for c in chunks.to_pylist()]
            if roots != batch.column("root").to_pylist() or len(n) != parts.sum() or (whole != batch.column("n_tokens").to_numpy()).any():
                raise Damaged("a document's chunks don't fit its root")
            row = np.repeat(np.arange(batch.num_rows), parts)
            columns = [
                *(batch.column(f.name).take(pa.array(row)) for f in kept), pa.array(parts[row].astype(np.int32)),
                pa.array((np.arange(len(row)) - (ends - parts)[row]).astype(np.int32)), chunks.flatten(), pa.array(n), pa.array(total[ends][row] - total[1:]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return recipes.select(id_column, "row", "start", "n_tokens", "root", "chunks", "sizes").mapInArrow(run, schema)


def _verified(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """The recipes, once they agree with the manifest."""
    recipes = spark.read.parquet(f"{path}/recipes")
    wrong = (
        _manifest(recipes, id_column)
        .alias("a")
        .join(spark.read.parquet(f"{path}/manifest").alias("b"), ["range", "block"], "full")
        .where("not (a.root <=> b.root and a.rows <=> b.rows and a.n_tokens <=> b.n_tokens)")
    )
    if wrong.limit(1).count():
        raise Damaged("the recipes don't fit the manifest")
    return recipes


def read_ids(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """The documents' ids, put together from the files and verified: (id, row, start, ids).

    A document's ids are put together in one row; an empty store gives no rows.
    """
    references, chunks = _references(_verified(spark, path, id_column), id_column), _objects(spark, path, "chunk").select("hash", F.col("n").alias("size"), "data")
    parts = references.join(chunks, "hash", "left")
    listed = parts.groupBy(id_column, "row", "start").agg(F.array_sort(F.collect_list(F.struct("k", "size", "data", "hash"))).alias("parts"))
    schema = T.StructType([*listed.schema.fields[:3], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def ids(parts: list[dict]) -> np.ndarray:
        if any(p["data"] is None or address(p["data"]) != p["hash"] for p in parts):
            raise Damaged("a chunk is missing or doesn't have its hash")
        return np.concatenate([_numbers(p["data"], p["size"]).astype(np.int32) for p in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [ids(parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(whole, pa.list_(pa.int32()))], names=schema.names)

    return listed.mapInArrow(run, schema)


def read_digests(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from the files, verified against recipes and manifest."""
    recipes = _verified(spark, path, id_column)
    salt = F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")
    references = _references(recipes, id_column).select("*", salt)
    # a chunk goes to each part of its references that there is, so no part holds all references of a shared chunk
    wanted = recipes.select(F.explode("chunks").alias("hash"), salt).distinct().join(_open(_objects(spark, path, "chunk")), "hash")
    joined = references.join(wanted, ["hash", "salt"], "left").select(id_column, "row", "start", "parts", "n", "after", "crc", "size")
    schema = T.StructType([joined.schema[c] for c in (id_column, "row", "start", "parts", "n")] + [T.StructField("crc", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("crc").null_count or not batch.column("size").equals(batch.column("n")):
                raise Damaged("a chunk is missing or doesn't have its hash")
            crc = shift_crc(batch.column("crc").to_numpy(), batch.column("after").to_numpy() * 4)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in schema.names[:-1]), pa.array(crc.astype(np.int64))], names=schema.names
            )

    whole = joined.mapInArrow(run, schema).groupBy(id_column, "row", "start", "parts").agg(
        F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("found")
    )
    checked = F.when(F.col("found") == F.col("parts"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a chunk is there twice")))
    return whole.select(id_column, "start", checked.alias("n_tokens"), "ids_crc32")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to a store, and return digests of what its files hold."""
    path = scratch(spark, "token-store")
    write_store(documents(spark, sf_dir), path, rank_file("byte_bpe_50k.json"))
    return read_digests(spark, path)
