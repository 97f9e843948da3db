"""Source divergence audit: how far the terms of each source are from those of each other source, and from its language's.

Terms are runs of letters (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``), A-Z
lower-cased. A language keeps the terms in at least ``least`` of its documents.
A (lang, source) group and a language give each kept term
p = 1 + floor(10^9 (count + 1) / (N + V)), and a group's p diverges from q by
f = floor((p - q)^2 / q).

1. Batches of texts give counts by (lang, source, term), with the documents that
   hold the term; these are summed.
2. Terms are dealt in blocks by their hash, so many for each language that a
   block of all its sources has about ``CELLS`` cells. A block gives one row: a
   dense int64 matrix of its groups by its kept terms.
3. Totals by group are summed from the matrices and joined to them. For each
   block all pairs of groups are broadcast against each other; partial pair sums
   and the block's best terms of each group come out.
4. Pair sums are added up. The best terms of the blocks are merged by rank: each
   block gives ``ranks`` of a group at most, and tasks keep so many before a shuffle.

Exact: whole numbers only; quotients of large counts are taken in three steps of
a thousand, right for up to 9 * 10^15 counted terms.

The pair part has a row for each two sources of a language, as is asked for; a
matrix row, and the array of a language's totals, are as long as it has sources.

Defined cases: a null text, lang or source is ''; groups without terms give
their pairs (value 0 where the language keeps no term); repeated rows are
documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import LOWER, Words, cut, documents, in_batches, join_in_parts, text_bytes

SCALE = 1_000_000_000
#: Cells of a block's matrix.
CELLS = 1 << 18
#: Languages whose number of blocks is known by name; the others have as many blocks as the last of these.
NAMED = 1000
_PARTING = bytes(int(b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256))

_COUNT = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "docs")])
_TILE = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("matrix", T.BinaryType()),
])
_PART = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "part", "item")] + [T.StructField("value", T.LongType())])


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over ``docs`` (lang, source, text); a null term for each group that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            words = Words(np.frombuffer(data.tobytes().translate(LOWER), np.uint8), offsets, _PARTING)
            codes, distinct = words.codes()
            terms = pc.binary_slice(distinct.cast(pa.binary()), 0, -1).cast(pa.string())
            names = [batch.column(c) for c in ("lang", "source")]
            langs, sources = (pc.fill_null(c, "").dictionary_encode() for c in names)
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            groups, own = np.unique(group, return_inverse=True)
            width = max(1, len(terms))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            # times of a term in a document, then over the documents of a group
            pairs, times = np.unique(doc * width + codes, return_counts=True)
            order = np.argsort(key := own[pairs // width] * width + pairs % width, kind="stable")
            key, head = key[order], np.flatnonzero(np.diff(key[order], prepend=-1))
            n = np.add.reduceat(times[order], head) if len(head) else np.zeros(0, np.int64)
            docs_with = np.diff(np.append(head, len(key)))
            term = pa.concat_arrays([pa.array(key[head] % width, pa.int64()), pa.nulls(len(groups), pa.int64())])
            of = groups[np.concatenate([key[head] // width, np.arange(len(groups))])]
            zero = np.zeros(len(groups), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                    terms.take(term) if len(terms) else pa.nulls(len(of), pa.string()),
                    pa.array(np.concatenate([n, zero]), pa.int64()), pa.array(np.concatenate([docs_with, zero]), pa.int64()),
                ],
                names=_COUNT.names,
            )

    found = docs.select("lang", "source", "text").mapInArrow(run, _COUNT)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def with_blocks(counts: DataFrame, cells: int = CELLS) -> DataFrame:
    """Add ``block`` by the term's hash: a language has so many that a block has about ``cells`` cells."""
    sizes = (
        counts.groupBy("lang")
        .agg(F.approx_count_distinct("term", 0.02).alias("terms"), F.count(F.when(F.col("term").isNull(), 1)).alias("sources"))
        .select("lang", F.ceil(F.col("terms") * F.col("sources") / cells).alias("blocks"))
        .where("blocks > 1")
        .orderBy(F.desc("blocks"), "lang")
        .limit(NAMED)
        .collect()  # NAMED rows at most
    )
    rest = sizes[-1].blocks if len(sizes) == NAMED else 1
    known = F.create_map([F.lit(x) for r in sizes for x in (r.lang, r.blocks)])[F.col("lang")] if sizes else F.lit(None)
    blocks = F.coalesce(known, F.lit(rest)).cast("int")
    return counts.withColumn("block", F.when(F.col("term").isNull(), 0).otherwise(F.pmod(F.xxhash64("term"), blocks)).cast("int"))


def matrices(counts: DataFrame, least: int) -> DataFrame:
    """A row for each (lang, block): its groups' counts of its kept terms (terms in order) as a matrix."""

    def run(table: pa.Table) -> pa.Table:
        lang, block = table.column("lang")[0], table.column("block")[0]
        sources, own = np.unique(np.array(table.column("source").to_pylist(), object), return_inverse=True)
        real = table.column("term").is_valid().to_numpy()
        coded = table.column("term").combine_chunks().filter(pa.array(real)).dictionary_encode()
        code, own = coded.indices.to_numpy(), own[real]
        docs, n = (table.column(c).to_numpy()[real] for c in ("docs", "n"))
        held = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(held, code, docs)
        kept = coded.dictionary.filter(pa.array(held >= least))
        order = pc.sort_indices(kept.cast(pa.binary())).to_numpy()  # of UTF-8 bytes
        column = np.full(len(held), -1)
        column[np.flatnonzero(held >= least)[order]] = np.arange(len(order))
        stays = column[code] >= 0
        matrix = np.zeros((len(sources), len(order)), np.int64)
        matrix[own[stays], column[code[stays]]] = n[stays]
        values = [[lang.as_py()], [block.as_py()], [sources.tolist()], [kept.take(pa.array(order)).to_pylist()], [matrix.sum(axis=1).tolist()], [matrix.tobytes()]]
        types = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=_TILE.names)

    return counts.groupBy("lang", "block").applyInArrow(run, _TILE)


def totals(tiles: DataFrame) -> DataFrame:
    """(lang, kept, groups): how many terms a language keeps, and its groups as (source, total), by source."""
    kept = tiles.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("kept"))
    sums = tiles.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.sums").alias("total"))
    groups = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"))
    return kept.join(groups, "lang")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / total), exactly."""
    out, rest = np.ones_like(count), count + 1
    for step in (1_000_000, 1000, 1):
        rest = rest * 1000
        out += rest // total * step
        rest = rest % total
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _best(value: np.ndarray, ranks: int) -> np.ndarray:
    """Places of the ``ranks`` largest values, the first ones of equals; places are in the items' order."""
    if len(value) > ranks:
        edge = np.partition(value, len(value) - ranks)[len(value) - ranks]
        over = np.flatnonzero(value > edge)
        return np.concatenate([over, np.flatnonzero(value == edge)[: ranks - len(over)]])
    return np.arange(len(value))


def parts(tiles: DataFrame, ranks: int) -> DataFrame:
    """Partial results of blocks: (lang, source, part, item, value)."""
    known = tiles.withColumnRenamed("sources", "here")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["lang", "here", "terms", "matrix", "kept", "groups"]).to_pylist():
                names = [g["source"] for g in row["groups"]]
                total = np.array([g["total"] for g in row["groups"]], np.int64)
                place = {s: k for k, s in enumerate(names)}
                count = np.zeros((len(names), len(row["terms"])), np.int64)
                if row["terms"]:
                    count[[place[s] for s in row["here"]]] = np.frombuffer(row["matrix"], np.int64).reshape(len(row["here"]), -1)
                p = shares(count, (total + row["kept"])[:, None]) if row["terms"] else count
                q = shares(count.sum(axis=0), total.sum() + row["kept"]) if row["terms"] else count.sum(axis=0)
                for k, source in enumerate(names):
                    # a group's p against all groups' p of the block at once
                    pair = divergence(p[k], p).sum(axis=1)
                    far = np.flatnonzero((count[k] > 0) & (p[k] > q))
                    value = divergence(p[k][far], q[far])
                    top = _best(value, ranks)
                    others = [j for j in range(len(names)) if j != k]
                    n = len(others) + len(top)
                    yield pa.RecordBatch.from_arrays(
                        [
                            _strings([row["lang"]] * n), _strings([source] * n), _strings(["pair"] * len(others) + ["term"] * len(top)),
                            _strings([names[j] for j in others] + [row["terms"][t] for t in far[top]]), pa.array(np.concatenate([pair[others], value[top]]).astype(np.int64)),
                        ],
                        names=_PART.names,
                    )

    return known.mapInArrow(run, _PART)


def audit(docs: DataFrame, least: int = 3, ranks: int = 200, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs`` (lang, source, text).

    Part ``pair``: other sources of the language by the summed divergence of the
    group's terms from theirs. Part ``term``: the group's ``ranks`` terms that
    diverge most upwards from the language's.
    """
    counts = cut(term_counts(docs), "term-counts")
    tiles = cut(matrices(with_blocks(counts, cells), least), "term-tiles")
    found = cut(parts(join_in_parts(tiles, totals(tiles), "lang", "block"), ranks), "divergence-parts")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit over all documents."""
    return audit(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT x.lang, x.source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY x.lang, x.source
), l AS (
  SELECT lang, sum(total)::HUGEINT AS total FROM g GROUP BY lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 1)) // (any_value(l.total) + any_value(v.v)) AS q
  FROM k JOIN c USING (lang, term) JOIN l USING (lang) JOIN v USING (lang) GROUP BY k.lang, k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
QUALIFY part = 'pair' OR rank <= 200
"""
