"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their first four and five letters,
hashed into buckets. Buckets whose document counts differ most between labels
become the machine's inputs (1 if present). The score is the logistic of

    w0 + sum_f w_f + sum_{f<g} <v_f, v_g>

so pairs of terms have weights of their own. Only the text is an input.

Learning takes labelled rows outside the held-out part, at most ``sample_rows``
of them (the least hashes of the id), a documented bound; document counts of
terms are summed by Spark, and the machine is fitted on the driver from the few
chosen buckets of each sampled row.

Defined cases: null and empty texts, and texts without chosen terms, get the
score of the bias alone; repeated rows get equal scores; labels that are null
or of absent documents are not used; without labels of both kinds every score
is the share of label 1 (0 without any label).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Words, cut, documents, in_batches, unused

BUCKET_BITS = 20
#: Labelled rows that a fit takes at most, and buckets that it chooses at most.
SAMPLE_ROWS, CHOSEN = 20_000, 4096
FACTORS, EPOCHS, RATE, DECAY = 8, 12, 0.05, 1e-4
THRESHOLD = 0.3


@dataclass
class Machine:
    """bucket: chosen buckets, ascending; weights and factors by position in it."""

    bucket: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, rows: np.ndarray, inputs: np.ndarray, n: int) -> np.ndarray:
        """rows, inputs: pairs (row, position), rows ascending; n: rows in all."""
        z = np.full(n, self.bias)
        if len(rows):
            head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            factor = self.factor[inputs]
            total = np.add.reduceat(factor, head, axis=0)
            square = np.add.reduceat((factor**2).sum(1), head)
            z[rows[head]] += np.add.reduceat(self.weight[inputs], head) + ((total**2).sum(1) - square) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def term_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, rows ascending."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    codes, distinct = words.codes()
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask, crc = (1 << BUCKET_BITS) - 1, zlib.crc32
    table = np.full((len(distinct), 3), -1, np.int64)
    for k, word in enumerate(distinct.to_pylist()):
        letters = word.decode("utf-8", "surrogatepass").strip(" .,;:!?\"'()[]{}#*$%&|<>-_")
        if letters:
            table[k, 0] = crc(letters.encode("utf-8", "surrogatepass")) & mask
            if len(letters) > 4:
                table[k, 1] = crc(b"4" + letters[:4].encode("utf-8", "surrogatepass")) & mask
            if len(letters) > 5:
                table[k, 2] = crc(b"5" + letters[:5].encode("utf-8", "surrogatepass")) & mask
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    one = np.unique(row.astype(np.int64) * len(distinct) + codes)
    row, found = one // len(distinct), table[one % len(distinct)]
    pair = (row[:, None] << BUCKET_BITS | found)[found >= 0]
    pair = np.unique(pair)
    return pair >> BUCKET_BITS, pair & mask


def _chosen_inputs(texts: list[str | None], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, found = term_buckets(texts)
    if not len(bucket):
        return row[:0], found[:0]
    at = np.minimum(np.searchsorted(bucket, found), len(bucket) - 1)
    ok = bucket[at] == found
    return row[ok], at[ok]


def fit_machine(rows: list[tuple[np.ndarray, int]], bucket: np.ndarray, seed: int = 7) -> Machine:
    """rows: (positions, label). Mini-batches with Adagrad steps."""
    rng = np.random.default_rng(seed)
    label = np.array([y for _, y in rows], float)
    base = label.mean() if len(rows) else 0.0
    m = Machine(bucket, 0.0, np.zeros(len(bucket)), rng.normal(0, 0.02, (len(bucket), FACTORS)))
    m.bias = float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    if not len(rows) or not 0 < base < 1 or not len(bucket):
        return m
    g_bias, g_weight, g_factor = 1e-6, np.full(len(bucket), 1e-6), np.full(m.factor.shape, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            size = np.array([len(rows[k][0]) for k in some])
            at = np.concatenate([rows[k][0] for k in some]).astype(np.int64)
            own = np.repeat(np.arange(len(some)), size)
            error = m.score(own, at, len(some)) - label[some]
            total = np.stack([np.bincount(own, m.factor[at, f], len(some)) for f in range(FACTORS)], axis=1)
            step_w = error[own] + DECAY * m.weight[at]
            step_v = error[own][:, None] * (total[own] - m.factor[at]) + DECAY * m.factor[at]
            uniq, inv = np.unique(at, return_inverse=True)
            gw = np.bincount(inv, step_w, len(uniq)) / len(some)
            gv = np.stack([np.bincount(inv, step_v[:, f], len(uniq)) for f in range(FACTORS)], axis=1) / len(some)
            gb = error.mean()
            g_weight[uniq] += gw**2
            g_factor[uniq] += gv**2
            g_bias += gb**2
            m.weight[uniq] -= RATE * gw / np.sqrt(g_weight[uniq])
            m.factor[uniq] -= RATE * gv / np.sqrt(g_factor[uniq])
            m.bias -= RATE * gb / np.sqrt(g_bias)
    return m


def held_out(id_column: str = "doc_id"):
    """Whether an id is in the part that no labels are learnt from; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, rows: int) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled rows outside the held-out part."""
    chosen = (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_column))
        .groupBy(id_column)
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(id_column), id_column)
        .limit(rows)
    )
    # at most ``rows`` short rows
    found = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("t")).join(
        F.broadcast(chosen.withColumnRenamed(id_column, "_id")), "_id"
    )
    # an id that several documents have counts once, by the text of the least hash: the bound holds for any table
    one = found.groupBy("_id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("x"))
    return cut(one.select("x.t", "x.y"), "toxicity-sample")


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, chosen: int = CHOSEN,
) -> Machine:
    sample = _sample(docs, labels, id_column, text, label, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "t", 1_000_000):
            row, bucket = term_buckets(batch.column("t").to_pylist())
            y = batch.column("y").to_numpy()[row]
            key, n = np.unique(bucket * 2 + y, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key >> 1), pa.array(np.where(key & 1, 0, n)), pa.array(np.where(key & 1, n, 0))],
                names=["bucket", "n0", "n1"],
            )

    all0, all1 = sample.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not all0 or not all1:
        return fit_machine([(np.zeros(0, np.int64), y) for y in [0] * min(all0, 1) + [1] * min(all1, 1)], np.zeros(0, np.int64))
    # log odds with a prior, over its standard error
    odds = f"log((n1 + 0.5) / ({all1} + 1 - n1)) - log((n0 + 0.5) / ({all0} + 1 - n0))"
    best = (
        sample.mapInArrow(count, "bucket long, n0 long, n1 long")
        .groupBy("bucket")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where("n0 + n1 >= 5")
        .withColumn("z", F.expr(f"abs(({odds}) / sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)))"))
        .where("z > 3")
        .orderBy(F.desc("z"), "bucket")
        .limit(chosen)
        .select("bucket")
    )
    bucket = np.array(sorted(r.bucket for r in best.collect()), np.int64)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "t", 1_000_000):
            row, at = _chosen_inputs(batch.column("t").to_pylist(), bucket)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("y")], names=["at", "y"])

    rows = sample.mapInArrow(inputs, "at array<int>, y int").collect()  # few positions of a bounded sample
    rows = sorted((tuple(r.at), r.y) for r in rows)  # one order, however Spark returns them
    return fit_machine([(np.array(a, np.int64), y) for a, y in rows], bucket)


def score(df: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each text; a column of that name is replaced."""
    columns = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, text, 1_000_000):
            row, at = _chosen_inputs(batch.column(text).to_pylist(), machine.bucket)
            found = machine.score(row, at, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(found)], names=[*columns, out]
            )

    return df.select(*columns).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt outside the held-out quarter."""
    docs = documents(spark, sf_dir)
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), machine).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def keep_clean(df: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows that score below the threshold."""
    (name,) = unused(df, "_toxicity")
    return score(df, machine, text, name).where(F.col(name) < threshold).drop(name)
