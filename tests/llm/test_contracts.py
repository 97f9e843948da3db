"""Every query over odd documents, against plain versions of what its contract says."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from graphspark.llm import bpe_codec, bytebpe, flac, media, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = queries.queries()


def collected(spark, name, sf):
    return ALL[name](spark, sf).collect()


@pytest.mark.parametrize("name", list(ALL))
def test_empty_tables(spark, empty_sf, name):
    assert collected(spark, name, empty_sf) == []


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1(spark, sf, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    n = len(rows)
    group = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if bin(fps[a] ^ fps[b]).count("1") <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, group))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in collected(spark, "op1_simhash", sf)) == want


def test_simhash_links_large_groups(spark):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 1 << 62)
    values = {int(center)}
    while len(values) < 400:  # a dense group of near copies
        v = int(center)
        for b in rng.choice(16, rng.integers(1, 5), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (20_000, 50):  # the second deals large keys again
        got = {r.fp: r.root for r in df.join(simhash.components(simhash.links(df, 4, group_rows=limit)), df.fp == simhash.F.col("node"), "left").withColumn("root", simhash.F.coalesce("root", "fp")).collect()}
        order = sorted(values)
        root = {v: v for v in order}
        changed = True
        while changed:
            changed = False
            for a in order:
                near = [b for b in order if bin(a ^ b).count("1") <= 4]
                low = min(root[b] for b in near)
                for b in near:
                    if root[b] > low:
                        root[b], changed = low, True
        assert got == root


def test_op2(spark, sf, rows):
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    got = collected(spark, "op2_media", sf)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter(want)


def test_media_blocks_and_damage(spark, odd, tmp_path):
    stored = media.store(odd.select("doc_id", "text").where("doc_id = 12"), str(tmp_path / "m"))
    blocks = media.read_blocks(stored).orderBy("sample_offset").collect()
    assert [b.sample_offset for b in blocks] == list(range(0, 576 * len(blocks), 576))
    data = b"".join(bytes(b.pcm) for b in blocks).translate(media.TO_BYTE).rstrip(b"\xff")
    assert data.decode() == odd.where("doc_id = 12").first().text
    stream = bytearray(stored.first().media)
    stream[-9] ^= 4
    with pytest.raises(flac.Corrupt):
        flac.decode_many([bytes(stream)])


def test_flac_reads_other_subframes():
    """A hand-written stream: two channels (left and side), a linear predictor, verbatim, and an escaped partition."""

    def bits(*parts):
        return "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in parts)

    left = [5, 7, 9, 11, 13, 15, 17, 19]
    side = [1, -1, 2, -2, 3, -3, 0, 4]
    lpc = bits((0, 1), (32 + 1, 6), (0, 1), (5, 8), (7, 8), (2, 4), (0, 5), (2, 3), (-1, 3), (0, 2), (0, 4), (15, 4), (2, 5)) + bits(*((0, 2),) * 6)
    verb = bits((0, 1), (1, 6), (0, 1), *((v, 9) for v in side))
    body = lpc + verb
    body += "0" * (-len(body) % 8)
    head = bytes([0xFF, 0xF8, 0x60, 0x82, 0, 7])
    frame = head + bytes([flac.crc8(head)]) + int(body, 2).to_bytes(len(body) // 8, "big")
    raw = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16_many(raw, np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
    info = (8).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 7 << 36 | 8).to_bytes(8, "big") + bytes(16)
    _, out = flac.decode_many([b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + frame])
    assert out[0][0].pcm[:, 0].tolist() == left
    assert out[0][0].pcm[:, 1].tolist() == [a - b for a, b in zip(left, side)]


def test_op3(spark, sf, rows):
    got = collected(spark, "op3_secret_scan", sf)
    texts = dict(rows)
    secrets = {texts[r.doc_id][r.start : r.start + r.length] for r in got if r.is_secret}
    assert secrets == {"3f9a7c2b1d4e5f60718293a4b5c6d7e8f9012345"}


def test_op4(spark, sf, rows):
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        n = len(w)
        seen = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
        cover = set()
        for k in range(n - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                cover |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n] += 1
    got = collected(spark, "op4_line_quality", sf)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_op5(spark, sf, rows):
    got = collected(spark, "op5_kd_sharding", sf)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(0 <= r.shard < 40 for r in got)


def test_op6(spark, sf, rows):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in collected(spark, "op6_byte_bpe", sf)) == want


def test_pieces_are_those_of_the_pattern():
    import public_tokenizers as P
    import regex

    pattern = regex.compile(P.PATTERN)
    rng = np.random.default_rng(2)
    letters = np.array(list("aZ9 \n\t's'tlrevmd'é !.你\U0001f600"))
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    data, offsets, count = bytebpe.split_pieces(texts)
    pieces = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert pieces == [m for t in texts for m in pattern.findall(t)]
    assert count.tolist() == [len(pattern.findall(t)) for t in texts]


def test_decode_gives_the_text_back(spark, odd):
    path = bpe_codec.rank_file()
    out = bpe_codec.decode(bpe_codec.encode(odd, path), path).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in out) == Counter((r.doc_id, r.text or "") for r in odd.collect())


def library_ids(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_op7(spark, sf, rows):
    got = collected(spark, "op7_token_store", sf)
    ids = [(i, library_ids(t)) for i, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order[:-1])]).tolist()
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known)


def test_op9(spark, sf, rows):
    got = collected(spark, "op9_packing", sf)
    want = Counter()
    for i, t in rows:
        x = library_ids(t)
        first = len(x) % 2048 or 2048
        cuts = [0, *range(first, len(x) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_op10(spark, sf, rows):
    got = collected(spark, "op10_toxicity", sf)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_op8(spark, sf, rows):
    got = {r.doc_id: r.text for r in collected(spark, "op8_surrogates", sf) if r.doc_id not in (None, 5)}
    texts = dict(rows)
    assert "a.b@c.example.com" not in got[17] and "555-7713" not in got[17] and re.search(r"\(\d{3}\) \d{3}-\d{4}", got[17])
    assert all(got[i] == texts[i] for i in got if i not in (17,) and not re.search(r"\d{4}|@", texts[i] or ""))


@pytest.mark.parametrize("text", ["ab <|endoftext|> cd", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a<|endoftext|>", "<|endoftext| >", "", None])
def test_added_tokens_are_the_librarys(text):
    encoder = bpe_codec.library_encoder(bpe_codec.rank_file("byte_bpe_50k.json"))
    want = [library_ids(t)[:-1].tolist() for t in (text, "plain it's", text)]
    ids, count = encoder.encode([text, "plain it's", text])
    assert ids.tolist() == sum(want, []) and count.tolist() == [len(w) for w in want]


def test_vocabularies_above_65536(spark, tmp_path):
    """Every two bytes are a piece: ids up to 65,791."""
    path = tmp_path / "pairs.tiktoken"
    pieces = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(pieces)))
    ids = [65_791, 65_700, 0]
    data = b"".join(pieces[i] for i in ids)
    df = spark.createDataFrame([(1, ids, [2, 4, 5])], "n int, ids array<int>, ends array<int>")
    r = bpe_codec.decode(df, str(path), digests=True).first()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (3, hashlib.sha256(b"65791,65700,0").hexdigest(), hashlib.sha256(data).hexdigest())
    with pytest.raises(Exception, match="not of the vocabulary"):
        bpe_codec.decode(spark.createDataFrame([(1, [65_792], [2])], df.schema), str(path), digests=True).collect()
