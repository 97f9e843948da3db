"""BPE of words by a table of distinct words: encode each word once, join its ids back by position; decode by joining pieces to ids.

For tokenizers that drop white space between words (``word_bpe_49k.json``): the
ids of a text are the ids of its words ``[^\\x20\\x09-\\x0D]+`` one after another.

1. A task splits its texts in words. Blocks of about 16 MB of text number their
   distinct words, frequent ones first, and keep each text as the numbers of its
   words, in a table that is bucketed by block, so these sequences are never shuffled.
2. The table of distinct words: each block sends its words to the words' groups
   (by checksum), one row for each group; where the rows of a group stand
   together, a distinct word is encoded once, by the library: normalisation,
   contractions, added tokens and merges are its own.
3. The ids go back to where the words stood (block, group, place in it), and are
   joined there with the block's sequences; only words and ids are shuffled.
4. Decoding numbers the distinct ids of a batch, joins them with the table of
   pieces, as large as the vocabulary whatever the corpus is, and spells the
   batch; all in one pass without a shuffle.

Memory is bounded by a block (or one text, if that is longer). Between the steps
stand written tables, so a lost executor costs its tasks only.

Defined cases: null and empty texts, and texts without a word, have no ids and
decode to the empty text, as do null ids; ids outside the vocabulary decode to
nothing; other columns are kept, whatever their names; repeated rows stay; an
empty table gives an empty table. A tokenizer whose ids depend on white space,
or which has a decoder of its own, is refused.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bpe_codec import rank_file
from .common import WHITE_BYTES, Words, documents, in_batches, plain_names, scratch, text_bytes

#: Bytes of text of a block, bytes split at once, ids of a batch, remembered words of a task.
BLOCK_BYTES, SPLIT_BYTES, BATCH_IDS, MEMO_WORDS = 16_000_000, 4_000_000, 500_000, 1_000_000
PLANES = ["plane0", "plane1", "plane2", "plane3"]
IDS = T.ArrayType(T.IntegerType())

_tokenizers: dict[str, object] = {}


def tokenizer_of(path: str):
    """A process's tokenizer: no truncation, no padding."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


def _refuse_others(path: str) -> None:
    tokenizer = tokenizer_of(path)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if tokenizer.decoder is not None or any(ids(f"{w}a{w}b{w}{w}") != ids("a") + ids("b") for w in map(chr, WHITE_BYTES)):
        raise ValueError(f"{path}: ids depend on white space, or there is a decoder")


def _bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Write a table in the shared folder in buckets by ``column`` and read it again: joins on the column don't shuffle it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))  # Spark's bound for buckets
    df.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, name)).bucketBy(buckets, column).saveAsTable(table)
    return spark.table(table)


def word_blocks(df: DataFrame, text: str, groups: int) -> DataFrame:
    """Rows of three kinds, all with ``block``: the other columns with their words' numbers (bytes in four planes); the
    ``word_groups`` of the block's words in the order of numbers; and for each ``group`` its ``words``, in the same order."""
    kept = [c for c in df.columns if c != text]
    fields = [("block", T.LongType()), *((c, T.BinaryType()) for c in PLANES), ("word_groups", T.BinaryType()), ("group", T.IntegerType()), ("words", T.BinaryType())]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + [T.StructField(c, t) for c, t in fields])

    def rows(n: int, own: list[pa.Array], block: int, **given: pa.Array) -> pa.RecordBatch:
        types = {"group": pa.int32()}
        rest = [given.get(c, pa.nulls(n, types.get(c, pa.binary()))) for c, _ in fields[1:]]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, block)), *rest], names=schema.names)

    def whole(block: int, parts: list, numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        """A block, once all its texts are there: words are numbered anew, by how often they occur."""
        times = sum((np.bincount(codes, minlength=len(numbers)) for _, codes, _ in parts), np.zeros(len(numbers), np.int64))
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        for own, codes, bounds in parts:
            planes = rank[codes].view(np.uint8).reshape(-1, 4).T
            coded = {c: pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(p.tobytes())]) for c, p in zip(PLANES, planes)}
            yield rows(len(bounds) - 1, own, block, **coded)
        words = list(numbers)
        words = [words[k] for k in order.tolist()]
        of = np.fromiter((zlib.crc32(w) % groups for w in words), np.uint16, len(words))
        empty = [pa.nulls(1, a.type) for a in parts[0][0]]
        yield rows(1, empty, block, word_groups=pa.array([of.tobytes()], pa.binary()))
        sort = np.argsort(of, kind="stable")
        there, head = np.unique(of[sort], return_index=True)
        listed = [b" ".join(words[k] for k in sort[a:b].tolist()) for a, b in zip(head, [*head[1:], len(sort)])]
        yield rows(len(there), [pa.nulls(len(there), a.type) for a in empty], block, group=pa.array(there, pa.int32()), words=pa.array(listed, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, parts, numbers = TaskContext.get().partitionId() << 32, 0, [], {}
        for batch in in_batches(batches, text, SPLIT_BYTES):
            data, offsets = text_bytes(batch.column(text))
            if parts and size + len(data) > BLOCK_BYTES:
                yield from whole(block, parts, numbers)
                block, size, parts, numbers = block + 1, 0, [], {}
            size += len(data)
            words = Words(data, offsets)
            codes, distinct = words.codes()
            of = [numbers.setdefault(w[:-1], len(numbers)) for w in distinct.to_pylist()]
            parts.append(([batch.column(c) for c in kept], np.array(of, np.int32)[codes], words.first.astype(np.int32)))
        if parts:
            yield from whole(block, parts, numbers)

    return _bucketed(df.select(*kept, text).mapInArrow(run, schema), "word_blocks", "block")


def _gather(codes: np.ndarray, start: np.ndarray, count: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[start : start + count]`` of codes one after another, and where each run ends."""
    n = count[codes]
    kind = np.int32 if n.sum(dtype=np.int64) < 1 << 31 else np.int64
    ends = np.cumsum(n, dtype=kind)
    where = np.repeat((start[codes] - (ends - n)).astype(kind), n)
    where += np.arange(len(where), dtype=kind)
    return values[where], ends


def _bounds(size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bounds of rows that have ``size`` codes each, in what the codes' runs give."""
    return np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])]


def _id_type(path: str) -> type:
    return np.dtype("<u2") if tokenizer_of(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(of, group, counts, ids) of rows (block, group, words), the rows of a group dealt to one task: each distinct word is encoded once, whole, by the library.

    A task that has more than ``MEMO_WORDS`` distinct words forgets them and goes on.
    """
    schema = T.StructType([T.StructField("of", T.LongType()), T.StructField("group", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, kind, known = tokenizer_of(path), _id_type(path), {}
        for batch in batches:
            rows = [w.split(b" ") for w in batch.column("words").to_pylist()]
            if len(known) > MEMO_WORDS:
                known = {}
            new = [w for w in dict.fromkeys(w for ws in rows for w in ws) if w not in known]
            for at in range(0, len(new), 10_000):
                some = new[at : at + 10_000]
                found = tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
                known.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(some, found))
            ids = [[known[w] for w in ws] for ws in rows]
            counts = [np.fromiter(map(len, i), np.uint32, len(i)) // kind.itemsize for i in ids]
            arrays = [batch.column("block"), batch.column("group"), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array([b"".join(i) for i in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return words.select("block", "group", "words").repartition("group").mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text column by the ids of its words."""
    _refuse_others(path)
    plain, names = plain_names(df)
    groups = min(1 << 16, max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = word_blocks(plain, names[text], groups)
    own = [c for c in plain.columns if c != names[text]]
    new, kind = f"_c{len(df.columns)}", _id_type(path)
    schema = T.StructType([*(blocks.schema[c] for c in own), T.StructField(new, IDS)])

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        of = np.frombuffer(b"".join(x for x in left.column("word_groups").to_pylist() if x is not None), np.uint16)
        right = right.take(pc.sort_indices(right, [("group", "ascending")]))
        counts = np.frombuffer(b"".join(right.column("counts").to_pylist()), np.uint32).astype(np.int32)
        if len(counts) != len(of) or not np.array_equal(right.column("group").to_numpy(), np.unique(of)):
            raise ValueError("a block's words are not whole")
        values = np.frombuffer(b"".join(right.column("ids").to_pylist()), kind)
        number = np.argsort(of, kind="stable")  # the words in the order in which their groups listed them
        count, start = np.empty_like(counts), np.empty(len(counts), np.int32)
        count[number], start[number] = counts, np.cumsum(counts) - counts
        left = left.filter(left.column(PLANES[0]).is_valid())
        planes = [np.frombuffer(b"".join(left.column(c).to_pylist()), np.uint8) for c in PLANES]
        codes = np.stack(planes, axis=1).view("<u4").ravel()
        size = pc.binary_length(left.column(PLANES[0])).to_numpy()
        listed, ends = _gather(codes, start, count, values)
        made = pa.ListArray.from_arrays(pa.array(_bounds(size, ends).astype(np.int32)), pa.array(listed.astype(np.int32)))
        return pa.Table.from_arrays([*(left.column(c) for c in own), made], names=schema.names)

    rows = blocks.where(F.col("words").isNull()).select(*own, "block", "word_groups", *PLANES)
    found = encode_words(blocks.where(F.col("words").isNotNull()), path)
    out = rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(put, schema)
    kept = [c for c in df.columns if c not in (text, ids)]
    return out.select(*(F.col(names[c]).alias(c) for c in kept), F.col(new).alias(ids))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(key, piece) of every id of the vocabulary, added tokens included: as many rows as the file says."""
    schema = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            key = batch.column(0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([key, pa.array([tokenizer.id_to_token(i) for i in key.to_pylist()], pa.string())], names=schema.names)

    n = 1 + max(tokenizer_of(path).get_vocab(with_added_tokens=True).values())
    return spark.range(0, n, 1, 4).mapInArrow(run, schema)


def _numbered(df: DataFrame, ids: str) -> DataFrame:
    """Batches of rows: first a row for each distinct id of the batch (``key``), in the order of numbers, then the rows with their ids' numbers."""
    kept = [c for c in df.columns if c != ids]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + [T.StructField("key", T.IntegerType()), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            part, at = np.cumsum(length) // BATCH_IDS, 0
            for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
                if end == at:
                    continue
                rows, column = batch.slice(at, end - at), pa.array(batch.column(ids).slice(at, end - at))
                distinct, codes = np.unique(column.flatten().to_numpy(), return_inverse=True)
                bounds = np.concatenate([[0], np.cumsum(length[at:end])]) * 4
                coded = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(codes.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(distinct), rows.column(c).type) for c in kept), pa.array(distinct, pa.int32()), pa.nulls(len(distinct), pa.binary())], names=schema.names)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.nulls(len(column), pa.int32()), coded], names=schema.names)
                at = end

    return df.select(*kept, ids).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", digests: bool = False) -> DataFrame:
    """Replace the ids by the text that they decode to: their pieces with a blank between, added tokens too.

    With ``digests``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (of the text in UTF-8) instead.
    """
    _refuse_others(path)
    plain, names = plain_names(df)
    own = [c for c in plain.columns if c != names[ids]]
    # the vocabulary is as large as its file; the join streams the left side, so batches stay in order
    joined = _numbered(plain, names[ids]).join(F.broadcast(pieces(df.sparkSession, path)), "key", "left").select(*own, "key", "piece", "codes")
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [(out, T.StringType())]
    mine = [f"_c{len(df.columns) + k}" for k in range(len(new))]
    schema = T.StructType([*(joined.schema[c] for c in own), *(T.StructField(c, t) for c, (_, t) in zip(mine, new))])

    def spell(rows: pa.RecordBatch, key: np.ndarray, piece: list[str | None]) -> list[pa.Array]:
        spelt = [f"{p} ".encode() if p is not None else b"" for p in piece]
        count = np.array([len(p) for p in spelt], np.int32)
        coded = rows.column("codes")
        size = pc.binary_length(coded).to_numpy() // 4
        codes = np.frombuffer(b"".join(coded.to_pylist()), "<u4")
        if len(codes) and codes.max() >= len(key):
            raise ValueError("a batch's ids don't stand before it")
        letters, ends = _gather(codes, np.cumsum(count) - count, count, np.frombuffer(b"".join(spelt), np.uint8))
        at = _bounds(size, ends)
        texts = [letters[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        if not digests:
            return [pa.array(texts, pa.binary()).cast(pa.string())]
        values, first = key.astype("<u4")[codes], np.concatenate([[0], np.cumsum(size)]).tolist()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array(size, pa.int64()), pa.array([sha(values[a:b]) for a, b in zip(first[:-1], first[1:])], pa.string()), pa.array(map(sha, texts), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        found: list[str | None] = []
        spelling = False
        for batch in batches:
            is_key = batch.column("codes").is_null().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(is_key)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if is_key[a]:
                    if spelling:
                        keys, found, spelling = [], [], False
                    keys.append(part.column("key").to_numpy())
                    found += part.column("piece").to_pylist()
                    continue
                spelling = True
                made = spell(part, np.concatenate(keys) if keys else np.zeros(0, np.int32), found)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *made], names=schema.names)

    made = joined.mapInArrow(run, schema)
    kept = [c for c in df.columns if c != ids and c not in [n for n, _ in new]]
    return made.select(*(F.col(names[c]).alias(c) for c in kept), *(F.col(c).alias(n) for c, (n, _) in zip(mine, new)))


def op11_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text by the word table, decode its ids, and return digests of both."""
    path = rank_file("word_bpe_49k.json")
    return decode(encode(documents(spark, sf_dir).select("doc_id", "text"), path), path, digests=True)
