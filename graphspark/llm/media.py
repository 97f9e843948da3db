"""Media columns: payloads as FLAC streams, read back into PCM blocks and features.

``store`` writes a table with one FLAC stream for each row: its payload is a text's
UTF-8 bytes, padded by bytes 255 to whole blocks of 576, and each byte is one
8-bit sample. A fixed table gives frequent bytes small samples, as companding
does, so that Rice codes are short; the samples are otherwise the bytes.
``read_blocks`` decodes stored streams into PCM blocks with the offset of the
first sample, ``write_blocks`` keeps these as a table, ``read_samples`` reads
some samples by a stream's seek table alone, and ``read_features`` gives digests,
features and the offsets of the blocks.

Defined cases: null and empty texts are one block of padding; equal texts have
equal streams; a stream whose checksums don't fit is an error, naming the row.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import flac
from .common import documents, in_batches, scratch

PAD = 255

# Bytes by how common they are in European texts; the others follow in their order.
COMMON = b" enaitrsohdlucgmpbf.v,wyEA\n\xc3IOTRNSk\xa9LDHqUCzMGPx\xa8jBF\xbc\xb3!\xa1\xad|\xb1\xa4\xb6\xaa\xa7\x9f#$%&*0123456789"
_ORDER = [*dict.fromkeys(COMMON + bytes(range(256)))]
_RANK = np.argsort(_ORDER)
# rank 0, 1, 2, 3, ... are the samples 0, -1, 1, -2, ...
TO_SAMPLE = ((_RANK >> 1) ^ -(_RANK & 1)).astype(np.int8)
TO_BYTE = bytes(int(_ORDER[(v << 1) ^ (v >> 7) & 255]) for v in (np.arange(256).astype(np.int8).astype(int)).tolist())


def payload(text: bytes) -> bytes:
    short = -len(text) % flac.BLOCK if text else flac.BLOCK
    return text + bytes([PAD]) * short


def store(df: DataFrame, path: str, text: str = "text", out: str = "media") -> DataFrame:
    """Write the other columns and the stream of each text to ``path``; return the table as read from there."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in in_batches(batches, text, 1_500_000):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()]
            streams = flac.encode_many([TO_SAMPLE[np.frombuffer(payload(r), np.uint8)] for r in raw])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(list(map(len, raw)), pa.int64()), pa.array(streams, pa.binary())],
                names=[*kept, "n_bytes", out],
            )

    df.select(*kept, text).mapInArrow(run, schema).write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch], media: str):
    gc.disable()
    for batch in in_batches(batches, media, 1_500_000):
        streams = [m or b"" for m in batch.column(media).to_pylist()]
        yield (batch, streams, *flac.decode_many(streams))


def read_blocks(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each frame of each stream: ``block`` (its number), ``sample_offset``, ``samples``,
    ``rate``, ``channels``, ``bits``, ``pcm`` (little-endian samples of whole bytes)."""
    kept = [c for c in df.columns if c != media]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField(c, t, False) for c, t in (("block", T.IntegerType()), ("sample_offset", T.LongType()), ("samples", T.IntegerType()), ("rate", T.IntegerType()), ("channels", T.IntegerType()), ("bits", T.IntegerType()), ("pcm", T.BinaryType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, infos, blocks in _decoded(batches, media):
            rows = [
                (s, k, b.offset, len(b.pcm), infos[s].rate, infos[s].channels, infos[s].bits, flac.pcm_bytes([b], infos[s].bits))
                for s, own in enumerate(blocks)
                for k, b in enumerate(own)
            ]
            for s, own in enumerate(blocks):
                flac.verify_md5(infos[s], own)
            index, *columns = zip(*rows) if rows else [()] * 8
            taken = [batch.column(c).take(pa.array(index, pa.int64())) for c in kept]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(taken + [pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    return df.mapInArrow(run, schema)


def write_blocks(df: DataFrame, path: str, media: str = "media") -> DataFrame:
    """Write the PCM blocks of stored streams to ``path``, in the order of their offsets within each task; return them as read from there."""
    blocks = read_blocks(df, media)
    blocks.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(blocks.schema).parquet(path)


def read_samples(df: DataFrame, first: str, count: str, media: str = "media", out: str = "pcm") -> DataFrame:
    """Add the samples (little-endian, channels in turn) of ``count`` samples from ``first`` on, decoding only the frames that hold them.

    Fewer where a stream ends; a null stream, offset or count gives null; a column of the name ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, media, 1_500_000):
            asked = zip(*(batch.column(c).to_pylist() for c in (media, first, count)))
            found = [
                None if None in row else flac.pcm_bytes([flac.Block(0, row[1], flac.decode_range(*row))], flac.stream_info(row[0])[0].bits)
                for row in asked
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], names=schema.names)

    return df.select(*dict.fromkeys([*kept, media])).mapInArrow(run, schema)


def signal_features(samples: np.ndarray) -> str:
    """Samples, root mean square, peak, share of zero crossings, and mean step, as text."""
    x = samples.astype(np.int64)
    n = max(1, len(x))
    energy, peak = int((x * x).sum()), int(np.abs(x).max(initial=0))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    steps = int(np.abs(np.diff(x)).sum())
    return f"n={len(x)};rms={(energy / n) ** 0.5:.4f};peak={peak};zcr={crossings / n:.6f};step={steps / n:.4f}"


def read_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Digests and features of stored streams; the payload is put together from the decoded blocks."""
    kept = [c for c in df.columns if c != media]
    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("block_offsets", T.ArrayType(T.LongType(), False))]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t, False) for c, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, streams, infos, blocks in _decoded(batches, media):
            rows = []
            for stream, info, own in zip(streams, infos, blocks):
                pcm = flac.pcm_bytes(own, info.bits)
                if hashlib.md5(pcm).digest() != info.md5:
                    raise flac.Corrupt("MD5 of the samples")
                data = pcm.translate(TO_BYTE)
                rows.append(
                    (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), signal_features(np.frombuffer(pcm, np.int8)), [b.offset for b in own])
                )
            columns = zip(*rows) if rows else [()] * len(new)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(columns, types))], names=schema.names
            )

    return df.mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a FLAC stream, read the streams back, and return digests, features and the blocks' sample offsets."""
    stored = store(documents(spark, sf_dir).select("doc_id", "text"), scratch(spark, "media"))
    return read_features(stored)
