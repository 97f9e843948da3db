"""FLAC streams: a decoder for general files and an encoder for plain payloads.

The decoder finds frames by their sync code, header checksum and frame number,
verifies the checksum of every frame, and decodes the Rice residuals of many
subframes at once: one step decodes the next residual of all of them. Constant,
verbatim, fixed and linear predictors, wasted bits, and the stereo modes are
read. The result is PCM blocks, each with the offset of its first sample.

The encoder writes streams of one channel with a seek point for every frame,
fixed predictors and, on request, linear ones that it fits to each block.
``decode_range`` reads some samples by the seek table, and no other frames.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

import numpy as np

# Codes of the format.
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class Corrupt(ValueError):
    """A stream that isn't what its checksums or its format say."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for v in range(256):
        x = v << (bits - 8)
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = _CRC8_LIST[x ^ b]
    return x


def crc16_many(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of slices of data. Zeros before a slice don't change it, so slices are aligned at their ends."""
    crc = np.zeros(len(start), np.uint16)
    if not len(start):
        return crc
    order = np.argsort(start - end, kind="stable")
    start, end = start[order], end[order]
    size = end - start
    reach = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "right").tolist()
    for back in range(int(size[0]), 0, -1):
        n = reach[back]
        c = crc[:n]
        crc[:n] = (c << 8) ^ _CRC16[(c >> 8) ^ data[end[:n] - back]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = 0
    while n < 7 and first & (0x80 >> n):
        n += 1
    if n == 1 or n > 7 or at + n > len(data):
        raise Corrupt("frame number")
    value = first & (0x7F >> n)
    for b in data[at + 1 : at + n]:
        if b & 0xC0 != 0x80:
            raise Corrupt("frame number")
        value = value << 6 | b & 0x3F
    return value, at + n


def _number_code(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + max(0, 6 - more)):
        more += 1
    head = (0xFF << (7 - more)) & 0xFF
    return bytes([head | n >> (6 * more), *(0x80 | n >> (6 * k) & 0x3F for k in range(more - 1, -1, -1))])


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    block: int


@dataclass
class Frame:
    start: int
    body: int
    number: int
    block: int
    mode: int
    bits: int
    variable: bool


def stream_info(data: bytes) -> tuple[Info, int]:
    """STREAMINFO, and where the frames begin."""
    if data[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            raise Corrupt("metadata")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            b = data[at + 4 : at + 4 + size]
            x = int.from_bytes(b[10:18], "big")
            info = Info(x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, b[18:34], int.from_bytes(b[2:4], "big"))
        at += 4 + size
    if info is None:
        raise Corrupt("no STREAMINFO")
    return info, at


def _frame_at(data: bytes, at: int, info: Info) -> Frame:
    if data[at + 1] & 0xFE != 0xF8 or len(data) < at + 6:
        raise Corrupt("sync")
    size, rate, mode, width = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    number, pos = _coded_number(data, at + 4)
    if size == 1:
        block = 192
    elif 2 <= size <= 5:
        block = 576 << (size - 2)
    elif size in (6, 7):
        block, pos = int.from_bytes(data[pos : pos + size - 5], "big") + 1, pos + size - 5
    elif size >= 8:
        block = 256 << (size - 8)
    else:
        raise Corrupt("block size")
    pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if mode > 10 or width == 3 or crc8(data[at:pos]) != data[pos]:
        raise Corrupt("header checksum")
    return Frame(at, pos + 1, number, block, mode, _WIDTHS.get(width, info.bits), bool(data[at + 1] & 1))


def find_frames(data: bytes, info: Info, at: int, first: int = 0) -> list[Frame]:
    """Frames in order, from number ``first`` on. A candidate counts if header checksum and number fit, and the frame before ends in its checksum."""
    raw = np.frombuffer(data, np.uint8)
    sync = np.flatnonzero((raw[at:-1] == 0xFF) & (raw[at + 1 :] & 0xFE == 0xF8)) + at if len(data) > at + 1 else np.zeros(0, int)
    frames: list[Frame] = []
    position = 0
    for s in sync.tolist():
        try:
            f = _frame_at(data, s, info)
        except (Corrupt, IndexError):
            continue
        if f.number == first + (position if f.variable else len(frames)):
            if frames and f.number == 0:
                continue
            frames.append(f)
            position += f.block
    if not frames or frames[0].start != at:
        if info.samples or len(data) > at:
            raise Corrupt("no frame where the first should be")
        return []
    return frames


def frames_of(streams: list[bytes], infos: list[Info], begins: list[int], first: int = 0) -> list[list[Frame]]:
    """Frames of every stream, the checksums of all verified together; one that fails is searched again frame by frame."""
    found = [find_frames(d, i, b, first) for d, i, b in zip(streams, infos, begins)]
    base = np.cumsum([0, *map(len, streams)])
    start = np.array([base[s] + f.start for s, fs in enumerate(found) for f in fs], np.int64)
    end = np.array([base[s] + e for s, fs in enumerate(found) for e in [*(f.start for f in fs[1:]), len(streams[s])][: len(fs)]], np.int64)
    owner = np.repeat(np.arange(len(streams)), [len(f) for f in found])
    raw = np.frombuffer(b"".join(streams), np.uint8)
    for s in np.unique(owner[crc16_many(raw, start, end) != 0]).tolist():  # a checksum over itself is zero
        found[s] = _slow_frames(streams[s], np.frombuffer(streams[s], np.uint8), infos[s], begins[s], first)
    return found


def _slow_frames(data: bytes, raw: np.ndarray, info: Info, at: int, first: int = 0) -> list[Frame]:
    """Frame by frame: every possible end is tried until the checksum fits."""
    sync = [s for s in (np.flatnonzero((raw[at:-1] == 0xFF) & (raw[at + 1 :] & 0xFE == 0xF8)) + at).tolist()]
    frames, position = [], 0
    while at < len(data):
        f = _frame_at(data, at, info)
        if f.number != first + (position if f.variable else len(frames)):
            raise Corrupt("frame number")
        ends = np.array([s for s in sync if s > at + 2] + [len(data)])
        for e in ends.tolist():
            if not crc16_many(raw, np.array([at]), np.array([e]))[0]:
                try:
                    if e < len(data):
                        _frame_at(data, e, info)
                    break
                except (Corrupt, IndexError):
                    continue
        else:
            raise Corrupt(f"checksum of frame {len(frames)}")
        frames.append(f)
        position += f.block
        at = e
    return frames


# --------------------------------------------------------------------------
# Subframes


class _Bits:
    """Reads of one position in each of many bit strings."""

    def __init__(self, data: np.ndarray):
        # 64 bits from any byte on, big-endian
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.bytes = padded

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each bit position on, at the top of a word."""
        byte = at >> 3
        word = np.zeros(len(at), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | self.bytes[byte + k]
        return word << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.peek(at) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(at), np.int64)

    def signed(self, at: np.ndarray, n: int) -> np.ndarray:
        v = self.take(at, n)
        return v - ((v >> (n - 1)) << n)


def _leading_zeros(word: np.ndarray) -> np.ndarray:
    """Zeros above the highest bit that is set, of words that aren't zero."""
    exponent = np.frexp((word >> np.uint64(11)).astype(np.float64))[1]  # 53 bits are exact
    return np.where(word >> np.uint64(11), 53 - exponent, 64)


def _rice_step(bits: _Bits, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next Rice code of every string, and the positions after it."""
    word = bits.peek(at)
    zeros = _leading_zeros(word)
    high = zeros.astype(np.int64)
    over = np.flatnonzero(zeros + 1 + k > 56)
    kk = k.astype(np.uint64)
    low = (word << (np.minimum(zeros, 62) + 1).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - kk)
    if len(over):  # long runs of zeros
        for o in over.tolist():
            run, p = 0, int(at[o])
            while not (w := int(bits.peek(np.array([p]))[0]) >> 8):
                run, p = run + 56, p + 56
                if p > 8 * len(bits.bytes):
                    raise Corrupt("residual")
            run += 56 - w.bit_length()
            high[o] = run
            low[o] = bits.take(np.array([at[o] + run + 1]), int(k[o]))[0]
    value = high << k | low.astype(np.int64)
    return (value >> 1) ^ -(value & 1), at + high + 1 + k


def _residuals(bits: _Bits, at: np.ndarray, block: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (block - order rows, one column for each string) and the positions after them."""
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any():
        raise Corrupt("residual coding")
    out = np.zeros((block - order, len(at)), np.int64)
    at = at + 6
    for m, p in sorted({*zip(method.tolist(), parts.tolist())}):
        some = np.flatnonzero((method == m) & (parts == p))
        pos, size, row = at[some], block >> p, 0
        if block % (1 << p) or size < order:
            raise Corrupt("partitions")
        width = 5 if m else 4
        for part in range(1 << p):
            k = bits.take(pos, width)
            pos = pos + width
            n = size - (order if part == 0 else 0)
            raw = k == (1 << width) - 1
            if raw.any():  # this partition has plain numbers
                plain = np.flatnonzero(raw)
                wide = bits.take(pos[plain], 5)
                pos[plain] += 5
            rice = np.flatnonzero(~raw)
            whole = len(rice) == len(some)
            cols, p_rice, k_rice = some if whole else some[rice], pos if whole else pos[rice], k if whole else k[rice]
            for t in range(n):
                out[row + t, cols], p_rice = _rice_step(bits, p_rice, k_rice)
            pos = p_rice if whole else pos
            if not whole:
                pos[rice] = p_rice
                for c, w in zip(plain.tolist(), wide.tolist()):
                    for t in range(n):
                        out[row + t, some[c]] = bits.signed(pos[c : c + 1], w)[0] if w else 0
                        pos[c] += w
            row += n
        at[some] = pos
    return out, at


def _predict(out: np.ndarray, order: int, coefficients: np.ndarray, shift: np.ndarray) -> None:
    """Turn residuals (below the first ``order`` rows) into samples, all columns together."""
    for t in range(order, len(out)):
        guess = np.zeros(out.shape[1], np.int64)
        for j in range(order):
            guess += coefficients[j] * out[t - 1 - j]
        out[t] += guess >> shift


def _subframes(bits: _Bits, at: np.ndarray, block: int, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (block rows, one column for each subframe) and the positions after them."""
    head = bits.take(at, 8)
    if (head >> 7).any():
        raise Corrupt("subframe padding")
    kind, waste = head >> 1 & 63, head & 1
    at = at + 8
    some = np.flatnonzero(waste)
    if len(some):
        zeros = _leading_zeros(bits.peek(at[some]))
        waste[some] = zeros + 1
        at[some] += zeros + 1
    width = width - waste
    samples = np.zeros((block, len(at)), np.int64)
    for kd, w in sorted({*zip(kind.tolist(), width.tolist())}):
        cols = np.flatnonzero((kind == kd) & (width == w))
        pos = at[cols]
        if kd == 0:
            samples[:, cols] = bits.signed(pos, w)
            pos = pos + w
        elif kd == 1:
            for t in range(block):
                samples[t, cols] = bits.signed(pos, w)
                pos = pos + w
        elif 8 <= kd <= 12 or kd >= 32:
            order = kd - 8 if kd < 32 else kd - 31
            if order > block:
                raise Corrupt("order")
            own = np.zeros((block, len(cols)), np.int64)
            for t in range(order):
                own[t] = bits.signed(pos, w)
                pos = pos + w
            if kd < 32:
                coefficients = np.repeat(np.array(FIXED[order], np.int64)[:, None], len(cols), 1)
                shift = np.zeros(len(cols), np.int64)
            else:
                precision, shift = bits.take(pos, 4) + 1, bits.signed(pos + 4, 5)
                if (precision == 16).any() or (shift < 0).any():
                    raise Corrupt("predictor")
                pos = pos + 9
                coefficients = np.zeros((order, len(cols)), np.int64)
                for p in np.unique(precision).tolist():
                    mine = precision == p
                    for j in range(order):
                        coefficients[j, mine] = bits.signed(pos[mine] + j * p, p)
                pos = pos + order * precision
            own[order:], pos = _residuals(bits, pos, block, order)
            if order:
                _predict(own, order, coefficients, shift)
            samples[:, cols] = own
        else:
            raise Corrupt("subframe type")
        at[cols] = pos
    return samples << waste, at


@dataclass
class Block:
    """PCM of one frame: (samples, channels), and the offset of its first sample."""

    stream: int
    offset: int
    pcm: np.ndarray


def decode_many(streams: list[bytes]) -> tuple[list[Info], list[list[Block]]]:
    """PCM blocks of every stream, frames of all streams decoded together."""
    heads = [stream_info(data) for data in streams]
    infos = [info for info, _ in heads]
    found = frames_of(streams, infos, [begin for _, begin in heads])
    for info, own in zip(infos, found):
        if info.samples and sum(f.block for f in own) != info.samples:
            raise Corrupt("samples are missing")
    return infos, _decoded(streams, found, 0)


def seek_points(data: bytes) -> list[tuple[int, int]]:
    """(first sample, byte from the first frame on) of every seek point, in order; placeholders are left out."""
    at, last, out = 4, False, []
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 3:
            for p in range(at + 4, at + 4 + size, 18):
                sample = int.from_bytes(data[p : p + 8], "big")
                if sample < (1 << 64) - 1:
                    out.append((sample, int.from_bytes(data[p + 8 : p + 16], "big")))
        at += 4 + size
    return sorted(out)


def decode_range(data: bytes, first: int, count: int) -> np.ndarray:
    """Samples (count, channels) from sample ``first`` on, fewer where the stream ends; only the frames between two seek points are read."""
    info, begin = stream_info(data)
    points = seek_points(data) or [(0, 0)]
    starts = [p[0] for p in points]
    low = max(0, bisect.bisect_right(starts, first) - 1)
    high = bisect.bisect_left(starts, first + count)
    if starts[low] > first:
        points, low, high = [(0, 0), *points], 0, high + 1
    piece = data[begin + points[low][1] : begin + points[high][1] if high < len(points) else len(data)]
    if not piece or count <= 0:
        return np.zeros((0, info.channels), np.int64)
    frames = frames_of([piece], [info], [0], _frame_at(piece, 0, info).number)
    pcm = np.concatenate([b.pcm for b in _decoded([piece], frames, points[low][0])[0]])
    return pcm[first - points[low][0] :][:count]


def _decoded(streams: list[bytes], found: list[list[Frame]], position: int) -> list[list[Block]]:
    """PCM blocks of the frames found in each stream, the first at sample ``position``."""
    frames, first = [], position
    base, at = [], 0
    for s, own in enumerate(found):
        position = first
        for f in own:
            frames.append((s, position, f))
            position += f.block
        base.append(at)
        at += len(streams[s])
    bits = _Bits(np.frombuffer(b"".join(streams), np.uint8))
    out: list[list[Block]] = [[] for _ in streams]
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (s, _, f) in enumerate(frames):
        groups.setdefault((f.block, f.mode), []).append(k)
    done: list[np.ndarray | None] = [None] * len(frames)
    for (block, mode), members in groups.items():
        pos = np.array([8 * (base[frames[k][0]] + frames[k][2].body) for k in members], np.int64)
        width = np.array([frames[k][2].bits for k in members], np.int64)
        channels = []
        for c in range(mode + 1 if mode < 8 else 2):
            side = (mode == 8 and c == 1) or (mode == 9 and c == 0) or (mode == 10 and c == 1)
            samples, pos = _subframes(bits, pos, block, width + side)
            channels.append(samples)
        if mode == 8:
            channels[1] = channels[0] - channels[1]
        elif mode == 9:
            channels[0] = channels[0] + channels[1]
        elif mode == 10:
            mid, side = channels[0] << 1 | channels[1] & 1, channels[1]
            channels = [(mid + side) >> 1, (mid - side) >> 1]
        pcm = np.stack(channels, axis=2)  # (block, frame, channel)
        for j, k in enumerate(members):
            done[k] = pcm[:, j]
    for (s, position, _), pcm in zip(frames, done):
        out[s].append(Block(s, position, pcm))
    return out


def pcm_bytes(blocks: list[Block], bits: int) -> bytes:
    """Samples as little-endian signed numbers of whole bytes, channels in turn (what the stream's MD5 is of)."""
    size = -(-bits // 8)
    raw = b"".join(np.ascontiguousarray(b.pcm).astype("<i4").tobytes() for b in blocks)
    return np.frombuffer(raw, np.uint8).reshape(-1, 4)[:, :size].tobytes()


def verify_md5(info: Info, blocks: list[Block]) -> None:
    if any(info.md5) and hashlib.md5(pcm_bytes(blocks, info.bits)).digest() != info.md5:
        raise Corrupt("MD5 of the samples")


# --------------------------------------------------------------------------
# Encoding: one channel of 8 bits, blocks of 576 samples

BLOCK = 576


def _rice_bits(folded_sum: np.ndarray, k: int, n: int) -> np.ndarray:
    """About the bits of n Rice codes."""
    return n * (k + 1) + (folded_sum >> k)


def _linear(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (frames, order), shifts and residuals of linear predictors fitted to each row by its autocorrelation."""
    w = x * np.hanning(BLOCK + 2)[1:-1]
    r = np.stack([(w[:, lag:] * w[:, : BLOCK - lag]).sum(1) for lag in range(order + 1)], axis=1)
    a, error = np.zeros((len(x), order)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= 1 - k**2
    top = np.abs(a).max(1)
    shift = np.clip(precision - 2 - np.floor(np.log2(np.maximum(top, 1e-9))).astype(np.int64), 0, 15)
    limit = 1 << (precision - 1)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64)
    guess = sum(q[:, j : j + 1] * x[:, order - 1 - j : BLOCK - 1 - j] for j in range(order)) >> shift[:, None]
    return q, shift, (x[:, order:] - guess).astype(np.int32)


#: Bits of a linear predictor's coefficients.
PRECISION = 7


def encode_many(payloads: list[np.ndarray], linear: int = 0) -> list[bytes]:
    """8-bit streams of payloads (signed samples, whole blocks): fixed predictors of the best order, or linear ones of order ``linear`` where they are shorter."""
    size = np.array([len(p) // BLOCK for p in payloads])
    owner = np.repeat(np.arange(len(payloads)), size)
    first = np.cumsum(size) - size
    number = np.arange(len(owner)) - first[owner]
    x = np.concatenate(payloads).astype(np.int32).reshape(-1, BLOCK)
    best_bits = np.full(len(x), 8 * BLOCK, np.int64)  # verbatim
    order, rice = np.full(len(x), -1), np.zeros(len(x), np.int64)
    folded_best = np.zeros((len(x), BLOCK), np.int32)
    diff = x
    for o in range(5):
        if o:
            diff = np.diff(diff, axis=1)
        folded = (diff << 1) ^ (diff >> 31)
        total = folded.sum(1, dtype=np.int64)
        n = BLOCK - o
        for k in range(12):
            # exact enough to choose by; the true length is measured below
            estimate = 8 * o + _rice_bits(total, k, n)
            better = estimate < best_bits
            if better.any():
                best_bits[better], order[better], rice[better] = estimate[better], o, k
        mine = order == o
        folded_best[mine, o:] = folded[mine]
    coefficients = shift = None
    if linear:
        coefficients, shift, rest = _linear(x, linear, PRECISION)
        folded = (rest << 1) ^ (rest >> 31)
        total = folded.sum(1, dtype=np.int64)
        mine = np.zeros(len(x), bool)
        for k in range(15):
            estimate = (8 + PRECISION) * linear + 9 + _rice_bits(total, k, BLOCK - linear)
            better = estimate < best_bits
            best_bits[better], rice[better] = estimate[better], k
            mine |= better
        order[mine] = 32 + linear
        folded_best[mine, linear:] = folded[mine]
    constant = (x == x[:, :1]).all(1)
    order[constant] = -2
    out_frames: list[bytes] = [b""] * len(x)
    heads = []
    for k in number.tolist():
        head = bytes([0xFF, 0xF8, 0x20, 0x02]) + _number_code(k)
        heads.append(head + bytes([crc8(head)]))
    for o in sorted(set(order.tolist())):
        rows = np.flatnonzero(order == o)
        for a in range(0, len(rows), 2000):
            some = rows[a : a + 2000]
            predictor = (coefficients[some], shift[some]) if o > 32 else None
            bodies = _bodies(x[some], folded_best[some], rice[some], o - 32 if o > 32 else o, predictor)
            for r, body in zip(some.tolist(), bodies):
                out_frames[r] = heads[r] + body
    length = np.array([len(f) for f in out_frames])
    data = np.frombuffer(b"".join(out_frames), np.uint8)
    end = np.cumsum(length)
    crc = crc16_many(data, end - length, end).tolist()
    streams = []
    for s, p in enumerate(payloads):
        mine = range(int(first[s]), int(first[s] + size[s]))
        body, points, at = [], [], 0
        for r in mine:
            points.append(int.to_bytes((r - int(first[s])) * BLOCK << 80 | at << 16 | BLOCK, 18, "big"))
            body.append(out_frames[r] + crc[r].to_bytes(2, "big"))
            at += len(body[-1])
        sizes = [len(b) for b in body]
        pack = 44100 << 44 | 0 << 41 | 7 << 36 | len(p)
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += pack.to_bytes(8, "big") + hashlib.md5(p.astype(np.int8).tobytes()).digest()
        table = b"".join(points[:: max(1, -(-len(points) // 900_000))])
        streams.append(
            b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(body)
        )
    return streams


def _bodies(x: np.ndarray, folded: np.ndarray, rice: np.ndarray, order: int, predictor: tuple[np.ndarray, np.ndarray] | None = None) -> list[bytes]:
    """Subframes, padded to whole bytes, of frames with one kind of subframe."""
    if order == -2:
        return [bytes([0, v & 255]) for v in x[:, 0].tolist()]
    if order == -1:
        return [bytes([2]) + row.tobytes() for row in x.astype(np.int8)]
    n = BLOCK - order
    quotient = folded[:, order:] >> rice[:, None]
    width = quotient + 1 + rice[:, None]
    start = np.cumsum(width, axis=1) - width
    lead = 8 + 8 * order + (9 + PRECISION * order if predictor else 0) + 6 + 4  # subframe header, warm-up, predictor, residual header
    bits_used = lead + start[:, -1] + width[:, -1]
    row_bytes = -(-int(bits_used.max()) // 8)
    bits = np.zeros((len(x), row_bytes * 8), np.uint8)
    bits[:, 1:7] = np.unpackbits(np.array([31 + order if predictor else 8 + order], np.uint8))[2:]
    if predictor:
        at = 8 + 8 * order
        bits[:, at : at + 4] = np.unpackbits(np.array([PRECISION - 1], np.uint8))[4:]
        bits[:, at + 4 : at + 9] = np.unpackbits(predictor[1].astype(np.uint8)[:, None], axis=1)[:, 3:]
        for j in range(order):
            place = at + 9 + PRECISION * j
            bits[:, place : place + PRECISION] = np.unpackbits(predictor[0][:, j].astype(np.int8).view(np.uint8)[:, None], axis=1)[:, 8 - PRECISION :]
    if order:
        bits[:, 8 : 8 + 8 * order] = np.unpackbits(x[:, :order].astype(np.int8).view(np.uint8), axis=1)
    bits[:, lead - 4 : lead] = np.unpackbits(rice.astype(np.uint8)[:, None], axis=1)[:, 4:]
    at = lead + start + quotient + np.arange(len(x))[:, None] * bits.shape[1]
    flat = bits.reshape(-1)
    flat[at] = 1
    for k in range(int(rice.max(initial=0))):  # bit k of the remainder
        rows = np.flatnonzero(rice > k)
        place = at[rows] + (rice[rows] - k)[:, None]
        flat[place] = (folded[rows, order:] >> k) & 1
    packed = np.packbits(bits, axis=1)
    return [row[: -(-int(u) // 8)].tobytes() for row, u in zip(packed, bits_used.tolist())]
