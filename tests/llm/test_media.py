"""FLAC streams with linear predictors, samples by the seek table, and stored PCM blocks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import flac, media


def wave(blocks, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(blocks * flac.BLOCK)
    return np.clip(np.rint(60 * np.sin(t / 7) + 40 * np.sin(t / 3.1) + rng.normal(0, 2, len(t))), -128, 127).astype(np.int8)


@pytest.mark.parametrize("order", [0, 1, 4, 8])
def test_linear_predictors_give_the_samples_back(order):
    rng = np.random.default_rng(1)
    payloads = [wave(5, 2), rng.integers(-128, 128, flac.BLOCK, np.int8), np.zeros(flac.BLOCK, np.int8), wave(1, 3), np.repeat(np.array([-128, 127], np.int8), flac.BLOCK // 2)]
    streams = flac.encode_many(payloads, linear=order)
    infos, blocks = flac.decode_many(streams)
    for p, info, own in zip(payloads, infos, blocks):
        assert flac.pcm_bytes(own, 8) == p.tobytes() and info.md5 == hashlib.md5(p.tobytes()).digest()
    if order == 8:
        assert len(streams[0]) < len(flac.encode_many(payloads[:1])[0])
        kinds = {s[own.body] >> 1 & 63 for s, fs in zip(streams, flac.frames_of(streams, infos, [flac.stream_info(s)[1] for s in streams])) for own in fs}
        assert 32 + order - 1 in kinds and 0 in kinds


def test_seeking_reads_only_the_frames_asked_for():
    x = wave(40, 4)
    (stream,) = flac.encode_many([x], linear=6)
    for first, count in ((0, 1), (575, 2), (576, 576), (20_000, 1500), (40 * 576 - 3, 10), (40 * 576, 5), (7, 0)):
        assert flac.decode_range(stream, first, count)[:, 0].tolist() == x[first : first + count].tolist()
    damaged = bytearray(stream)
    damaged[-30] ^= 8  # the last frame: others are read as before
    assert flac.decode_range(bytes(damaged), 100, 700)[:, 0].tolist() == x[100:800].tolist()
    with pytest.raises(flac.Corrupt):
        flac.decode_range(bytes(damaged), 39 * 576, 10)
    assert [p[0] for p in flac.seek_points(stream)] == list(range(0, 40 * 576, 576))


def test_blocks_are_written_and_samples_read(spark, odd, tmp_path):
    stored = media.store(odd.select("doc_id", "text"), str(tmp_path / "m"))
    blocks = media.write_blocks(stored.where("doc_id IN (2, 3, 12, 13)"), str(tmp_path / "b"))
    for i in (2, 3, 12, 13):
        own = blocks.where(F.col("doc_id") == i).orderBy("sample_offset").collect()
        text = odd.where(F.col("doc_id") == i).first().text
        assert b"".join(bytes(b.pcm) for b in own).translate(media.TO_BYTE) == media.payload(text.encode())
        assert [b.sample_offset for b in own] == list(range(0, 576 * len(own), 576))
    some = media.read_samples(stored.where("doc_id = 12").select("doc_id", "media", F.lit(1000).alias("at"), F.lit(50).alias("n")), "at", "n").first()
    assert bytes(some.pcm).translate(media.TO_BYTE) == odd.where("doc_id = 12").first().text.encode()[1000:1050]
    assert media.read_samples(stored.limit(1).select(F.lit(None).cast("binary").alias("media"), F.lit(1).alias("a"), F.lit(1).alias("b")), "a", "b").first().pcm is None


def test_query_gives_forms_and_offsets(spark, sf, rows):
    got = media.op2_media(spark, sf).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(media.payload((t or "").encode()))
    for r in got:
        assert r.block_offsets == list(range(0, r.payload_bytes, 576))
        match = [p for p in texts[r.doc_id] if hashlib.sha256(p).hexdigest() == r.payload_sha256]
        (stream,) = flac.encode_many([media.TO_SAMPLE[np.frombuffer(match[0], np.uint8)]])
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert r.feature == media.signal_features(media.TO_SAMPLE[np.frombuffer(match[0], np.uint8)])
