"""Byte-level BPE: vectorised pre-tokenisation and cached pair merging.

Texts are cut into pieces exactly as the pattern ``public_tokenizers.PATTERN``
cuts them, without a regular expression. Each code point gets a symbol (its
class, plus one code point of look-ahead); each symbol is a transition function
of a small automaton; functions compose associatively, so the composed function
at every code point is found by a blocked scan over a whole batch of texts. The
pieces are slices of the UTF-8 buffer, are made distinct by Arrow, and every
distinct piece is merged once and kept in a bounded memo.

Defined cases: a null text is the empty text, an empty text has no ids, texts of
any length are cut and merged whole.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

# --------------------------------------------------------------------------
# Code point classes and symbols

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
# The code points that Unicode marks as White_Space.
_WHITE = (
    [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Symbols: letter, number, other, an apostrophe that opens a contraction of two
# or three characters, the blank before a non-blank, another white character
# before a non-blank, and a white character before white or the end.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK, S_LAST, S_WHITE = range(8)
# States: in a run of letters, numbers or others; after a blank that joins what
# follows; one or two letters of a contraction to go; in white; token ended.
IN_LETTER, IN_NUMBER, IN_OTHER, JOINING, ONE_LEFT, TWO_LEFT, IN_WHITE, ENDED = range(8)
_N = 8
_FIRST = 8  # added to the symbol of a text's first code point

_classes: np.ndarray | None = None


def codepoint_classes() -> np.ndarray:
    """Class of every code point, built once for a process."""
    global _classes
    if _classes is None:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter(
            (kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000
        )
        table[_WHITE] = _SPACE
        _classes = table
    return _classes


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this code point."""
    if symbol == S_LETTER:
        if state in (IN_LETTER, JOINING):
            return IN_LETTER, False
        if state in (ONE_LEFT, TWO_LEFT):
            return (ENDED if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTER, True
    if symbol == S_NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, JOINING)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_OTHER, JOINING):
            return IN_OTHER, False
        return {S_OTHER: IN_OTHER, S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}[symbol], True
    if symbol == S_BLANK:
        return JOINING, True
    if symbol == S_LAST:
        return ENDED, True
    return IN_WHITE, state != IN_WHITE


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions closed under composition.

    Returns the element of each symbol, the table ``compose[a, b]`` (first a,
    then b), and ``result[a]``, the state after a from ENDED.
    """
    basic = [tuple(_step(s, y)[0] for s in range(_N)) for y in range(_FIRST)]
    basic += [(f[ENDED],) * _N for f in basic]  # a first code point forgets what was before
    elements = {tuple(range(_N)): 0}
    todo = [tuple(range(_N))]
    while todo:
        f = todo.pop()
        for g in basic:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    of = list(elements)
    compose = np.array([[elements[tuple(g[x] for x in f)] for g in of] for f in of], np.uint8)
    return np.array([elements[g] for g in basic], np.uint8), compose, np.array([f[ENDED] for f in of], np.uint8)


_ELEMENT, _COMPOSE, _RESULT = _monoid()
# Tables of 256 for two half bytes: symbol to function, two functions to their
# composition and to the state after both, state and symbol to "a piece starts".
_ELEMENT_BYTES = bytes(_ELEMENT).ljust(256, b"\0")
_PAIRS = [(i >> 4, i & 15) for i in range(256)]
_COMPOSE_BYTES = bytes(int(_COMPOSE[a, b]) if max(a, b) < len(_COMPOSE) else 0 for a, b in _PAIRS)
_RESULT_BYTES = bytes(int(_RESULT[_COMPOSE_BYTES[a << 4 | b]]) if max(a, b) < len(_COMPOSE) else 0 for a, b in _PAIRS)
_STARTS_BYTES = bytes(int(s < _N and (y >= _FIRST or _step(s, y)[1])) for s, y in _PAIRS)


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """points: code points of texts one after another; first: where texts start."""
    kind = codepoint_classes()[points]
    begins = np.zeros(len(points) + 1, bool)
    begins[first] = True
    begins[-1] = True
    out = kind.copy()
    white = np.flatnonzero(kind == _SPACE)
    if len(white):
        after = np.append(kind, _SPACE)[white + 1]
        ends = begins[white + 1] | (after == _SPACE)
        out[white] = np.where(ends, S_WHITE, np.where(points[white] == 0x20, S_BLANK, S_LAST))
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        near = np.append(points, [0, 0])
        one, two = near[quote + 1], near[quote + 2]
        same1 = ~begins[quote + 1]
        same2 = same1 & ~begins[np.minimum(quote + 2, len(points))]
        short = same1 & np.isin(one, [ord(c) for c in "stmd"])
        long = same2 & np.isin(one * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        out[quote] = np.where(short, S_SHORT, np.where(long, S_LONG, S_OTHER))
    out[first] += _FIRST
    return out


def _by_byte(table: bytes, index: np.ndarray) -> np.ndarray:
    """table[index] for bytes."""
    return np.frombuffer(index.tobytes().translate(table), np.uint8).reshape(index.shape)


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked scan of functions."""
    n = len(symbols)
    width = max(1, int(np.sqrt(n / 16)))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint8)
    padded[:n] = _by_byte(_ELEMENT_BYTES, symbols)
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    scanned = np.empty_like(columns)
    acc = scanned[0] = columns[0]
    for t in range(1, width):  # all blocks take a step together
        acc = _by_byte(_COMPOSE_BYTES, (acc << 4) | columns[t])
        scanned[t] = acc
    before = np.zeros(blocks, np.uint8)
    total = 0
    for b, f in enumerate(acc.tolist()):
        before[b] = total
        total = _COMPOSE_BYTES[total << 4 | f]
    states = _by_byte(_RESULT_BYTES, (before << 4)[None, :] | scanned).T.reshape(-1)[:n]
    return np.concatenate([np.array([ENDED], np.uint8), states[:-1]])


def split_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into pieces.

    Returns the UTF-8 bytes of all texts, the byte offsets of the pieces (one
    more than pieces), and the number of pieces of each text.
    """
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(joined):
        return data, np.zeros(1, np.int32), np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    at = np.cumsum(sizes) - sizes
    symbols = _symbols(points, at[sizes > 0])
    begin = np.flatnonzero(_by_byte(_STARTS_BYTES, (_states_before(symbols) << 4) | symbols))
    if len(data) == len(points):
        offsets = begin
    else:
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offsets = (np.cumsum(width) - width)[begin]
    count = np.diff(np.searchsorted(begin, np.append(at, len(points))))
    return data, np.append(offsets, len(data)).astype(np.int32), count


# --------------------------------------------------------------------------
# Pair merging

_NO_PAIR = np.int32(2**31 - 1)
#: Longer pieces are merged one by one with a heap.
LONG_PIECE = 256


class Ranks:
    """Merge ranks of a rank file: every token's bytes and every pair that makes a token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self._key, self._made = key[order], np.array(made, np.int32)[order]
        self._pairs = None
        self._set_slots()

    def _set_slots(self) -> None:
        """A table without chains: pairs whose slot is taken stay in the sorted list only."""
        self._bits = 22
        slot = self._slot(self._key)
        self._slot_key = np.full(1 << self._bits, -1, np.int64)
        self._slot_made = np.full(1 << self._bits, _NO_PAIR, np.int32)
        self._slot_key[slot[::-1]] = self._key[::-1]
        self._slot_made[slot[::-1]] = self._made[::-1]
        taken = self._slot_key[slot] != self._key
        self._crowded = np.zeros(1 << self._bits, bool)
        self._crowded[slot[taken]] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(64 - self._bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or _NO_PAIR."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        out = np.where(self._slot_key[slot] == key, self._slot_made[slot], _NO_PAIR)
        again = np.flatnonzero((out == _NO_PAIR) & self._crowded[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self._key, key[again]), len(self._key) - 1)
            out[again] = np.where(self._key[at] == key[again], self._made[at], _NO_PAIR)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece by a heap of pairs: the lowest rank first, the leftmost of equals."""
        sym = [int(self.single[b]) for b in piece]
        text = self.bytes_of
        ranks = self.ranks
        n = len(sym)
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get(text[sym[i]] + text[sym[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not live[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = rank
            live[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (r := ranks.get(text[rank] + text[sym[nxt[j]]])) is not None:
                    heapq.heappush(heap, (r, i, rank, sym[nxt[j]]))
            if prv[i] >= 0:
                p = prv[i]
                if (r := ranks.get(text[sym[p]] + text[rank])) is not None:
                    heapq.heappush(heap, (r, p, sym[p], rank))
        return [s for s, ok in zip(sym, live) if ok]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        long = [k for k, p in enumerate(pieces) if len(p) > LONG_PIECE]
        if long:
            parts: list[list[int] | None] = [None] * len(pieces)
            for k in long:
                parts[k] = self.merge_long(pieces[k])
            rest = [k for k, p in enumerate(parts) if p is None]
            ids, count = self.merge([pieces[k] for k in rest])
            at = np.cumsum(count) - count
            for k, a, c in zip(rest, at.tolist(), count.tolist()):
                parts[k] = ids[a : a + c].tolist()
            return np.array([i for p in parts for i in p], np.int32), np.array([len(p) for p in parts], np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        final = np.zeros(len(pieces), np.int64)
        sym = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        rank = np.full(len(sym), _NO_PAIR, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(sym) > 1 else np.zeros(0, np.int64)
        rank[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, head)
            local = np.diff(np.append(head, len(sym)))
            over = least == _NO_PAIR
            if over.any():  # these pieces are merged as far as they can be
                gone = np.repeat(over, local)
                done_ids.append(sym[gone])
                done_owner.append(owner[gone])
                final[owner[head[over]]] = local[over]
                sym, owner, rank = sym[~gone], owner[~gone], rank[~gone]
                if not len(sym):
                    break
                least, local = least[~over], local[~over]
                head = np.cumsum(local) - local
            hit = np.flatnonzero(rank == np.repeat(least, local))
            own = np.repeat(np.arange(len(head)), local)[hit]
            hit = hit[np.concatenate([[True], own[1:] != own[:-1]])]  # the leftmost of each piece
            sym[hit] = rank[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            hit = moved[hit]
            for at in (hit, hit[hit > 0] - 1):
                right = np.minimum(at + 1, len(sym) - 1)
                inside = (right > at) & (owner[at] == owner[right])
                new = np.full(len(at), _NO_PAIR, np.int32)
                new[inside] = self.pair(sym[at[inside]], sym[right[inside]])
                rank[at] = new
        ids, own = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(own, kind="stable")], final

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


# --------------------------------------------------------------------------
# Memo

#: Distinct pieces and ids that a process keeps; beyond these the memo starts anew.
MEMO_PIECES, MEMO_IDS = 700_000, 4_000_000
#: Code points that are cut, and made distinct, at a time (a text is never divided).
CUT_POINTS, BATCH_POINTS = 400_000, 6_000_000


class PieceEncoder:
    """Encodes texts; ``merge`` gets distinct pieces that are not in the memo."""

    def __init__(self, merge: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self._merge = merge
        self._clear()

    def _clear(self) -> None:
        self._known: dict[bytes, int] = {}
        self._start = np.zeros(1 << 16, np.int32)
        self._count = np.zeros(1 << 16, np.int32)
        self._ids = np.zeros(1 << 18, np.int32)
        self._used = 0

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(size, 3 * len(array) // 2) - len(array), array.dtype)])

    def _learn(self, pieces: list[bytes]) -> None:
        ids, count = self._merge(pieces)
        n = len(self._known)
        self._start = self._room(self._start, n + len(pieces))
        self._count = self._room(self._count, n + len(pieces))
        self._ids = self._room(self._ids, self._used + len(ids))
        self._start[n : n + len(pieces)] = self._used + np.cumsum(count) - count
        self._count[n : n + len(pieces)] = count
        self._ids[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        self._known.update(zip(pieces, range(n, n + len(pieces))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for group in _groups([t or "" for t in texts], BATCH_POINTS):
            self._batch(group, ids, counts)
        return np.concatenate(ids), np.concatenate(counts)

    def _batch(self, texts: list[str], ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        data, offsets, pieces, base = [], [np.zeros(1, np.int32)], [], 0
        for group in _groups(texts, CUT_POINTS):
            d, o, p = split_pieces(group)
            data.append(d)
            offsets.append(o[1:] + np.int32(base))
            pieces.append(p)
            base += len(d)
        offset = np.concatenate(offsets)
        if len(offset) == 1:
            counts.append(np.zeros(len(texts), np.int64))
            return
        slices = pa.Array.from_buffers(
            pa.binary(), len(offset) - 1, [None, pa.py_buffer(offset), pa.py_buffer(np.concatenate(data))]
        ).dictionary_encode()
        distinct = slices.dictionary.to_pylist()
        if len(self._known) > MEMO_PIECES or self._used > MEMO_IDS:
            self._clear()
        known = self._known.get
        entry = [known(p, -1) for p in distinct]
        new = [p for p, e in zip(distinct, entry) if e < 0]
        if new:
            n = len(self._known)
            self._learn(new)
            entry = np.array(entry, np.int32)
            entry[entry < 0] = np.arange(n, n + len(new), dtype=np.int32)
        at = np.asarray(entry, np.int32)[slices.indices.to_numpy()]
        count = self._count[at]
        ends = np.cumsum(count, dtype=np.int32)
        where = np.repeat(self._start[at] - (ends - count), count)
        where += np.arange(ends[-1], dtype=np.int32)
        ids.append(self._ids[where])
        total = np.concatenate([[0], ends])
        bound = np.concatenate([[0], np.cumsum(np.concatenate(pieces))])
        counts.append((total[bound[1:]] - total[bound[:-1]]).astype(np.int64))


def _groups(texts: list[str], most: int) -> Iterable[list[str]]:
    """Runs of texts that reach ``most`` code points each, but for the last."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def library_merge(tokenizer) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Merging of pieces by the model of a byte-level tokenizer of the tokenizers library."""
    shown = {chr(b): chr(b) for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
    hidden = [chr(b) for b in range(256) if chr(b) not in shown]
    letters = str.maketrans(shown | {c: chr(256 + k) for k, c in enumerate(hidden)})
    tokenize = tokenizer.model.tokenize

    def merge(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [[x.id for x in tokenize(p.decode("latin-1").translate(letters))] for p in pieces]
        return (
            np.fromiter((i for p in parts for i in p), np.int32),
            np.fromiter(map(len, parts), np.int64, len(parts)),
        )

    return merge
