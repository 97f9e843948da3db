"""Byte-level BPE encoding and decoding as DataFrame operators.

``encode`` gives every row its ids and the byte offset at which each id ends;
``decode`` turns ids into bytes and verifies the offsets. Both work on Arrow
batches, keep no more than a bounded memo, and never divide a text.

Defined cases: null and empty texts have no ids and decode to no bytes; other
columns are kept as they are; equal texts get equal ids.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from . import bytebpe
from .common import documents, in_batches

_cache: dict[str, object] = {}


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(path: str) -> bytebpe.Ranks:
    if path not in _cache:
        _cache[path] = bytebpe.Ranks(path)
        gc.freeze()
    return _cache[path]


def rank_encoder(path: str) -> bytebpe.PieceEncoder:
    """A process's encoder by a rank file; its memo lives on between tasks."""
    key = f"encoder {path}"
    if key not in _cache:
        _cache[key] = bytebpe.PieceEncoder(ranks_of(path).merge)
    return _cache[key]


class LibraryEncoder:
    """Ids of whole texts as the library gives them: added tokens in a text are found first, what stands between is encoded by pieces."""

    def __init__(self, tokenizer):
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("an added token takes white space or whole words")
        self._id = {t.content: i for i, t in added.items()}
        self._find = re.compile("|".join(re.escape(t) for t in sorted(self._id, key=len, reverse=True)) or "(?!)")
        self._pieces = bytebpe.PieceEncoder(bytebpe.library_merge(tokenizer))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if not any(t and self._find.search(t) for t in texts):
            return self._pieces.encode(texts)
        parts, after, owner = [], [], []  # a stretch of text, the added token behind it (or -1), the text it is from
        for k, text in enumerate(texts):
            at = 0
            for m in self._find.finditer(text or ""):
                parts.append(text[at : m.start()])
                after.append(self._id[m[0]])
                at = m.end()
                owner.append(k)
            parts.append((text or "")[at:])
            after.append(-1)
            owner.append(k)
        ids, count = self._pieces.encode(parts)
        token = np.array(after, np.int32)
        ids = np.insert(ids, np.cumsum(count)[token >= 0], token[token >= 0])
        return ids, np.bincount(owner, count + (token >= 0), len(texts)).astype(np.int64)


def library_encoder(path: str) -> LibraryEncoder:
    """A process's encoder by the tokenizers library and one of its files."""
    key = f"library {path}"
    if key not in _cache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _cache[key] = LibraryEncoder(tokenizer)
        _cache[f"{key} itself"] = tokenizer
    return _cache[key]


class Spelling:
    """Bytes for ids, many at a time."""

    def __init__(self, of: dict[int, bytes]):
        size = max(of) + 1
        length = np.zeros(size, np.int32)
        for i, t in of.items():
            length[i] = len(t)
        self.length = length
        self.start = (np.cumsum(length) - length).astype(np.int32)
        self.data = np.frombuffer(b"".join(of.get(i, b"") for i in range(size)), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the byte at which each id ends."""
        length = self.length[ids]
        ends = np.cumsum(length, dtype=np.int32)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        where = np.repeat(self.start[ids] - (ends - length), length)
        where += np.arange(ends[-1], dtype=np.int32)
        return self.data[where], ends


def spelling_of(path: str) -> Spelling:
    key = f"spelling {path}"
    if key not in _cache:
        _cache[key] = Spelling(ranks_of(path).bytes_of)
    return _cache[key]


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", ends: str = "ends") -> DataFrame:
    """Replace the text column by ``ids`` and ``ends`` (the byte of the text at which each id ends)."""
    kept = [c for c in df.columns if c not in (text, ids, ends)]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField(c, T.ArrayType(T.IntegerType(), False), False) for c in (ids, ends)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encoder, spell = rank_encoder(ranks_path), spelling_of(ranks_path)
        for batch in in_batches(batches, text, 4_000_000):
            found, count = encoder.encode(batch.column(text).to_pylist())
            total = np.cumsum(spell.length[found], dtype=np.int64)
            first = np.cumsum(count) - count
            base = np.concatenate([[0], total])[first]
            end = (total - np.repeat(base, count)).astype(np.int32)
            columns = [batch.column(c) for c in kept] + [_lists(found, count), _lists(end, count)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, ends])

    return df.select(*kept, text).mapInArrow(run, schema)


def decode(
    df: DataFrame, ranks_path: str, ids: str = "ids", ends: str = "ends", out: str = "decoded", digests: bool = False
) -> DataFrame:
    """Bytes of the ids in a column ``out``; an offset that disagrees is an error.

    With ``digests``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas) and ``decoded_sha256`` instead, so that no bytes leave the process.
    """
    kept = [c for c in df.columns if c not in (ids, ends, out)]
    new = (
        [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
        if digests
        else [(out, T.BinaryType())]
    )
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t, False) for c, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = spelling_of(ranks_path)
        if (decimal := f"decimal {ranks_path}") not in _cache:
            _cache[decimal] = Spelling({i: b"%d," % i for i in range(len(spell.length))})
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for i, e in zip(part.column(ids), part.column(ends)):
                    one = i.values.to_numpy() if i.is_valid else np.zeros(0, np.int32)
                    if len(one) and not 0 <= one.min() <= one.max() < len(spell.length):
                        raise ValueError("an id is not of the vocabulary")
                    data, end = spell(one)
                    if not np.array_equal(end, e.values.to_numpy() if e.is_valid else end):
                        raise ValueError("the offsets don't fit the ids")
                    rows.append((one, data))
                columns = [part.column(c) for c in kept]
                if digests:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    columns += [
                        pa.array([len(i) for i, _ in rows], pa.int64()),
                        pa.array([sha(_cache[decimal](i)[0][:-1]) for i, _ in rows]),
                        pa.array([sha(d) for _, d in rows]),
                    ]
                else:
                    columns.append(pa.array([d.tobytes() for _, d in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(c for c, _ in new)])

    return df.mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both."""
    path = rank_file()
    return decode(encode(documents(spark, sf_dir).select("doc_id", "text"), path), path, digests=True)
