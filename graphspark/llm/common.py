"""What the corpus operators share: inputs, cut lineage, and words of a batch of texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# The bytes that part words, blank and \x09 to \x0D.
WHITE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
_IS_WHITE = bytes(int(b in WHITE_BYTES) for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="graphspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table in the shared folder and read it again: later steps survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own: these, with underscores before them until no column of ``df`` has the name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named _c0, _c1, ..., so that no name clashes with an operator's own, and the new names by the old ones."""
    new = [f"_c{k}" for k in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def join_in_parts(rows: DataFrame, table: DataFrame, key: str, spread: str, parts: int = 64, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each key), the rows of a key dealt in parts by the hash of ``spread``.

    The table's row of a key goes to each part that there is, so no task gets all rows of a hot key. Null keys match nothing.
    """
    (part,) = unused(rows, "_part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    wanted = dealt.select(key, part).distinct().join(table, key)
    return dealt.join(wanted, [key, part], how).drop(part)


def in_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches whose binary or text column holds about ``most`` bytes at most (or one row)."""
    for batch in batches:
        values = batch.column(column)
        size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        at = 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column one after another, and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, with one blank after each in ``joined``.

    start, end: bounds in ``joined``; first: bounds of each text's words;
    at: where each word starts in the texts' own bytes. ``parting``: for each
    byte, whether it parts words; white space unless given.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parting: bytes = _IS_WHITE):
        n = len(data)
        white = np.ones(n + 1, bool)
        white[:n] = np.frombuffer(data.tobytes().translate(parting), bool)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = ~white
        begins[1:] &= white[:-1] | edge[1:]
        ends = np.zeros(n + 1, bool)
        ends[1:] = ~white[:-1] & (white[1:] | edge[1:])
        self.at = np.flatnonzero(begins)
        length = np.flatnonzero(ends) - self.at
        self.start = np.cumsum(length + 1) - (length + 1)
        self.end = self.start + length
        self.joined = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        keep = np.ones(len(self.joined), bool)
        keep[self.end] = False
        self.joined[keep] = data[~white[:n]]
        self.first = np.searchsorted(self.at, offsets)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words."""
        if not len(self.start):
            return np.zeros(0, np.int32), pa.array([], pa.binary())
        # each slice takes the blank after the word with it
        bounds = np.append(self.start, len(self.joined)).astype(np.int64)
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(self.joined)]
        ).dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary
