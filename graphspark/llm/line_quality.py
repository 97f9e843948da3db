"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Lines with a word form a chain. Binary features of a line (shares of symbols,
bars, exclamation marks, capitals, digits and repeated words, its length, being
a repeat, legal wording) score its two states, pairs of states score the steps
between lines, and Viterbi decoding finds the best states of the whole chain.
The share of word characters in content lines decides whether a text stays.

Learning: labels of whole texts (1 good, 0 bad) start as labels of their lines;
a model without steps relabels the lines of bad texts, and the field is fitted
to these by gradient ascent on its conditional likelihood. It takes at most
``SAMPLE_ROWS`` labelled rows (the least hashes of the id), a documented bound.

Defined cases: null, empty and wordless texts have zero counts and fail the base
rules; repeated rows get equal results; without usable labels the field has no
weights, marks every line as content, and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Words, documents, in_batches, plain_names, text_bytes

SAMPLE_ROWS = 6000
STEPS, RATE, RIDGE = 150, 0.5, 1e-3
CONTENT_SHARE = 0.5
#: Base rules: the fewest words, and the largest share of words in repeated windows of so many words.
LEAST_WORDS, REPEAT_SHARE, REPEAT_WINDOW = 20, 0.3, 8

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
# Words of legal and navigation lines.
LEGAL = (b"licens", b"copyright", b"all rights reserved", b"cookie", b"privacy policy", b"terms of use", b"warranty")
_EDGES = np.array([0.0, 0.05, 0.2, 0.5])
_LENGTHS = np.array([2, 4, 8, 16, 32])
_RATIOS = ("symbols", "bars", "bangs", "capitals", "digits", "repeats")
N_FEATURES = len(_RATIOS) * 5 + len(_LENGTHS) + 1 + 3
PER_LINE = len(_RATIOS) + 1 + 3
NO_FEATURE = N_FEATURES  # a slot that never scores


def _total(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags set in [a, b)."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[b] - sums[a]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Batch:
    """What a batch of texts shows: counts for each text, features for each line with a word."""

    counts: dict[str, np.ndarray]
    line_text: np.ndarray  # the text of each line, ascending
    line_chars: np.ndarray  # code points in its words
    line_features: np.ndarray  # (lines, PER_LINE)


def describe(column: pa.Array) -> Batch:
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    words = Words(data, offsets)
    codes, _ = words.codes()
    first, count = words.first, np.diff(words.first)
    owner = np.repeat(np.arange(n), count)
    point = (data & 0xC0) != 0x80  # the first byte of a code point
    length = words.end - words.start
    word_chars = _total(point, words.at, words.at + length)
    # windows of words that occur twice or more in their text
    repeat = np.zeros(n, np.int64)
    if len(codes) >= REPEAT_WINDOW:
        mixed = _mix(codes)
        m = len(codes) - REPEAT_WINDOW + 1
        window = np.zeros(m, np.uint64)
        for k in range(REPEAT_WINDOW):
            window = window * np.uint64(0xFF51AFD7ED558CCD) + mixed[k : k + m]
        at = np.flatnonzero(owner[:m] == owner[REPEAT_WINDOW - 1 :])
        key = window[at] ^ _mix(owner[at] + (1 << 40))
        order = np.argsort(key)
        key = key[order]
        twin = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        begin = at[order[twin]]
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + REPEAT_WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        repeat = _total(covered, first[:-1], first[1:])
    # lines: bounds are starts of texts and what follows line feeds
    feeds = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([offsets, feeds]))
    begin, end = bounds[:-1], bounds[1:]
    fw, lw = np.searchsorted(words.at, begin), np.searchsorted(words.at, end)
    some = lw > fw
    begin, end, fw, lw = begin[some], end[some], fw[some], lw[some]
    text = owner[fw] if len(fw) else np.zeros(0, np.int64)
    stop = end - (data[end - 1] == 10) if len(end) else end
    slices = [data[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist())]
    seen: set[tuple[int, bytes]] = set()
    dup = np.zeros(len(slices), bool)
    for k, key in enumerate(zip(text.tolist(), slices)):
        if key in seen:
            dup[k] = True
        else:
            seen.add(key)
    legal = np.array([any(x in s for x in LEGAL) for s in (s.lower() for s in slices)], bool)
    stops = np.array([s.rstrip()[-1:] in (b".", b"?", b"!") for s in slices], bool)
    n_words = np.maximum(lw - fw, 1)
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122)) | (data >= 0xC3)
    adjacent = np.zeros(len(codes), bool)
    adjacent[1:] = codes[1:] == codes[:-1]
    sums = lambda flags: _total(flags, begin, end)
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    ratios = [
        (sums(symbol) - sums(data == 0x7C)) / n_words,
        sums(data == 0x7C) / n_words,
        sums(data == 0x21) / n_words,
        sums(upper) / np.maximum(sums(letters), 1),
        sums((data >= 48) & (data <= 57)) / np.maximum(end - begin, 1),
        _total(adjacent, np.minimum(fw + 1, lw), lw) / n_words,
    ]
    columns = [5 * k + np.searchsorted(_EDGES, r, "left") for k, r in enumerate(ratios)]
    at = 5 * len(ratios)
    columns.append(at + np.searchsorted(_LENGTHS, lw - fw, "right"))
    at += len(_LENGTHS) + 1
    columns += [np.where(flag, at + k, NO_FEATURE) for k, flag in enumerate((dup, legal, stops))]
    chars = np.concatenate([[0], np.cumsum(word_chars)])
    features = np.stack(columns, axis=1).astype(np.int16) if len(fw) else np.zeros((0, PER_LINE), np.int16)
    return Batch(
        {
            "n_words": count,
            "word_chars": chars[first[1:]] - chars[first[:-1]],
            "n_symbols": _total(symbol, offsets[:-1], offsets[1:]),
            "n_dup_lines": np.bincount(text, dup, n).astype(np.int64),
            "n_repeat_words": repeat,
        },
        text,
        chars[lw] - chars[fw],
        features,
    )


# --------------------------------------------------------------------------
# The field

CONTENT, BOILERPLATE = 0, 1


@dataclass
class Field:
    """line: (N_FEATURES + 1, 2) scores of features, the last row zero; step: (2, 2); begin: (2,)."""

    line: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    @staticmethod
    def blank() -> Field:
        return Field(np.zeros((N_FEATURES + 1, 2)), np.zeros((2, 2)), np.zeros(2))


def _chains(text: np.ndarray) -> list[np.ndarray]:
    """Positions of the first lines of all chains, of the second lines, and so on; longest chains first."""
    head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(text)))
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    return [head[: np.searchsorted(-size, -t, "left")] + t for t in range(int(size[0]) if len(size) else 0)]


def viterbi(field: Field, features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The best state of each line; content on ties."""
    own = field.line[features].sum(1)
    chains = _chains(text)
    states = np.zeros(len(text), np.int8)
    if not chains:
        return states
    score = own[chains[0]] + field.begin
    scores, back = [score], []
    for at in chains[1:]:
        ways = scores[-1][: len(at), :, None] + field.step[None]
        back.append(ways.argmax(1))
        scores.append(ways.max(1) + own[at])
    state = np.zeros(0, np.int64)
    for t in range(len(chains) - 1, -1, -1):
        new = scores[t].argmax(1)
        if len(state):
            new[: len(state)] = back[t][np.arange(len(state)), state]
        states[chains[t]] = new
        state = new
    return states


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _likelihood_step(field: Field, features: np.ndarray, text: np.ndarray, state: np.ndarray) -> Field:
    """Gradient of the mean conditional log-likelihood."""
    own = field.line[features].sum(1)
    chains = _chains(text)
    forward = [own[chains[0]] + field.begin]
    for at in chains[1:]:
        forward.append(_log_sum(forward[-1][: len(at), :, None] + field.step[None], 1) + own[at])
    grad = Field.blank()
    diff = np.zeros((len(text), 2))
    diff[np.arange(len(text)), state] += 1
    behind = [np.zeros((len(c), 2)) for c in chains]
    for t in range(len(chains) - 2, -1, -1):
        at = chains[t + 1]
        behind[t][: len(at)] = _log_sum(field.step[None] + (own[at] + behind[t + 1])[:, None, :], 2)
    for t, at in enumerate(chains):
        joint = forward[t] + behind[t]
        p = np.exp(joint - _log_sum(joint, 1)[:, None])
        diff[at] -= p
        if t + 1 < len(chains):
            after = chains[t + 1]
            k = len(after)
            pair = forward[t][:k, :, None] + field.step[None] + (own[after] + behind[t + 1])[:, None, :]
            flat = pair.reshape(k, 4)
            grad.step -= np.exp(flat - _log_sum(flat, 1)[:, None]).sum(0).reshape(2, 2)
            np.add.at(grad.step, (state[at[:k]], state[after]), 1)
    grad.begin += diff[chains[0]].sum(0)
    for k in range(features.shape[1]):
        for s in (0, 1):
            grad.line[:, s] += np.bincount(features[:, k], diff[:, s], N_FEATURES + 1)
    for part in (grad.line, grad.step, grad.begin):
        part /= len(text)
    grad.line[-1] = 0
    return grad


def _ascend(field: Field, features, text, state, with_steps: bool) -> Field:
    memory = Field.blank()
    for _ in range(STEPS):
        grad = _likelihood_step(field, features, text if with_steps else np.arange(len(text)), state)
        for name in ("line", "step", "begin") if with_steps else ("line",):
            w, g, m = getattr(field, name), getattr(grad, name), getattr(memory, name)
            g = g - RIDGE * w
            m += g**2
            w += RATE * g / np.sqrt(m + 1e-10)
    return field


def fit_field(features: np.ndarray, text: np.ndarray, good: np.ndarray) -> Field:
    """good: for each line whether its text is labelled good."""
    if not len(text) or good.all() or not good.any():
        return Field.blank()
    state = np.where(good, CONTENT, BOILERPLATE)
    alone = _ascend(Field.blank(), features, text, state, False)
    own = alone.line[features].sum(1)
    state = np.where(good | (own[:, CONTENT] >= own[:, BOILERPLATE]), CONTENT, BOILERPLATE)
    return _ascend(Field(alone.line.copy(), np.zeros((2, 2)), np.zeros(2)), features, text, state, True)


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Field:
    chosen = (
        labels.where(F.col(label).isin(0, 1))
        .groupBy(id_column)
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(id_column), id_column)
        .limit(sample_rows)
        .withColumnRenamed(id_column, "_id")
    )
    found = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("t")).join(F.broadcast(chosen), "_id")
    # an id that several documents have counts once, by the text of the least hash: the bound holds for any table
    one = found.groupBy("_id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "t", 1_000_000):
            d = describe(batch.column("t"))
            bounds = np.searchsorted(d.line_text, np.arange(batch.num_rows + 1))
            lines = [d.line_features[a:b].astype("<i2").tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), batch.column("y")], names=["lines", "y"])

    rows = one.select("x.t", "x.y").mapInArrow(run, "lines binary, y int").collect()  # of a bounded sample
    rows = sorted((bytes(r.lines), r.y) for r in rows)
    parts = [np.frombuffer(x, "<i2").reshape(-1, PER_LINE) for x, _ in rows]
    size = np.array([len(p) for p in parts], np.int64)
    if not size.sum():
        return Field.blank()
    return fit_field(
        np.concatenate(parts), np.repeat(np.arange(len(parts)), size), np.repeat([bool(y) for _, y in rows], size)
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = [*((c, T.LongType()) for c in COUNTS), ("base_failed", T.BooleanType()), ("content_share", T.DoubleType()), ("kept", T.BooleanType())]


def judge(df: DataFrame, field: Field, text: str = "text", content_share: float = CONTENT_SHARE, keep_text: bool = False) -> DataFrame:
    """Add counts, ``base_failed``, ``content_share`` and ``kept``, in place of columns of these names; the text goes unless ``keep_text``."""
    new = [c for c, _ in VERDICT]
    kept = [c for c in df.columns if c not in new and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t, False) for c, t in VERDICT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, text, 1_000_000):
            d = describe(batch.column(text))
            state = viterbi(field, d.line_features, d.line_text)
            content = np.bincount(d.line_text, d.line_chars * (state == CONTENT), batch.num_rows)
            share = content / np.maximum(d.counts["word_chars"], 1)
            n = d.counts["n_words"]
            failed = (n < LEAST_WORDS) | (100 * d.counts["n_repeat_words"] > round(100 * REPEAT_SHARE) * n)
            arrays = [d.counts[c] for c in COUNTS] + [failed, share, ~failed & (share >= content_share)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *map(pa.array, arrays)], names=[*kept, *new]
            )

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_good(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Rows that the rules keep, with all columns of the caller, whatever their names."""
    plain, names = plain_names(df)
    return judge(plain, field, names[text], keep_text=True).where("kept").select(*names.values()).toDF(*df.columns)
