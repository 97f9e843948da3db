"""Late session merging: every version of every session, as events arrive in batches.

A key's events so far form sessions: neighbours in time at most ``gap`` apart
share one. After each batch, a session that holds an event of the batch is a new
version and retracts the standing sessions that it contains.

1. Events of one key, time and batch are counted and summed.
2. Events of one key and batch that are neighbours within the gap always act
   together, whatever else arrives: they become one run (first, last, count,
   sum). Runs end at the borders of time tiles, so a hot key is dealt by tiles.
3. A pause over the gap among all events stays one in each snapshot, so what
   lies between two such pauses (an island) is worked on alone. Islands are
   numbered within tiles; tiles are linked by a join of neighbours; islands that
   go through whole tiles find their first tile by pointer jumping.
4. Islands are laid side by side on one time axis, as a matrix of batch by run:
   a running maximum of the active runs' last times marks breaks, cumulative ids
   number the sessions of all snapshots, and ``reduceat`` sums them up. Rows of
   the matrix are worked on in slabs, so memory is bounded by ``CELLS`` and by
   the runs of one island (a session without a pause: a few runs for each of
   the batches that it lasts, however many events it has).

Nothing is gathered by key, on the driver or in a broadcast.

Defined cases: rows without key, time or batch are no events; a null value
counts as zero; repeated rows are events of their own; an empty table gives no
versions; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import cut

#: Cells of a matrix that are worked on at once.
CELLS = 1_000_000
VERSION = T.StructType([
    T.StructField(c, T.LongType())
    for c in "user batch start_s end_s n_events n_new n_retracted h_sum retracted_batch retracted_start_s".split()
])


def _floor(value: Column, by: int) -> Column:
    """floor(value / by) of whole numbers."""
    return ((value - F.pmod(value, F.lit(by))) / by).cast("long")


def runs(events: DataFrame, gap: int, tile: int) -> DataFrame:
    """(user, tile, batch, start, end, n, h): events of one batch that are neighbours within the gap and within a tile."""
    seconds = (
        events.dropna(subset=["user", "seconds", "batch"])
        .groupBy("user", _floor(F.col("seconds"), tile).alias("tile"), "seconds", "batch")
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("h", F.lit(0))).alias("h"))
    )
    order = Window.partitionBy("user", "tile", "batch").orderBy("seconds")
    # one shuffle by tile serves the runs and, later, the islands of the tile
    apart = F.coalesce((F.col("seconds") - F.lag("seconds").over(order) > gap).cast("int"), F.lit(0))
    marked = seconds.repartition("user", "tile").withColumn("apart", apart)
    numbered = marked.withColumn("run", F.sum("apart").over(order))
    return numbered.groupBy("user", "tile", "batch", "run").agg(
        F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.sum("n").alias("n"), F.sum("h").alias("h")
    ).drop("run")


def _first_tiles(bounds: DataFrame) -> DataFrame:
    """(user, tile, root): for each tile whose first island goes on from the tile before, the tile in which that island begins.

    ``bounds``: (user, tile, first, last, islands) of tiles. Pointer jumping: a
    tile that is one island and goes on itself is passed over, twice as many in each round.
    """
    before = bounds.select("user", (F.col("tile") + 1).alias("tile"), F.col("last").alias("before"))
    linked = bounds.join(before, ["user", "tile"]).where("first - before <= gap")
    at = cut(linked.select("user", "tile", (F.col("tile") - 1).alias("root"), (F.col("islands") == 1).alias("through")), "tile-links")
    while True:
        # a root that goes through itself passes its own root on
        onward = at.where("through").select("user", F.col("tile").alias("root"), F.col("root").alias("next"))
        moved = at.join(onward, ["user", "root"], "left")
        if not moved.where("next is not null").limit(1).count():
            return at.select("user", "tile", "root")
        at = cut(moved.select("user", "tile", F.coalesce("next", "root").alias("root"), "through"), "tile-links")


def islands(found: DataFrame, gap: int) -> DataFrame:
    """The runs with ``home`` and ``island``: the tile in which the island begins, and its number there."""
    order = Window.partitionBy("user", "tile").orderBy("start", "end", "batch")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_apart", F.coalesce((F.col("start") - reach > gap).cast("long"), F.lit(0)))
    local = cut(marked.withColumn("island", F.sum("_apart").over(order)).drop("_apart"), "runs")
    bounds = cut(
        local.groupBy("user", "tile").agg(F.min("start").alias("first"), F.max("end").alias("last"), (F.max("island") + 1).alias("islands"), F.lit(gap).alias("gap")),
        "tiles",
    )
    roots = _first_tiles(bounds).join(bounds.select("user", F.col("tile").alias("root"), (F.col("islands") - 1).alias("last_island")), ["user", "root"])
    # only a tile's first island can go on from another tile
    heads = roots.select("user", "tile", F.lit(0).cast("long").alias("island"), "root", "last_island")
    return local.join(heads, ["user", "tile", "island"], "left").select(
        "user", F.coalesce("root", "tile").alias("home"), F.coalesce("last_island", "island").alias("island"), "batch", "start", "end", "n", "h"
    )


class _Matrix:
    """Snapshots of islands laid side by side: runs in order of time, each with the rank of its batch in its island."""

    def __init__(self, island: np.ndarray, batch: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, h: np.ndarray, gap: int):
        self.island, self.start, self.end, self.n, self.h, self.gap = island, start, end, n, h, gap
        head = np.flatnonzero(np.concatenate([[True], island[1:] != island[:-1]]))
        size = np.diff(np.append(head, len(island)))
        # batches of an island, ranked; known[first_batch + rank] is a batch
        order = np.lexsort((batch, island))
        new = np.concatenate([[True], (island[order][1:] != island[order][:-1]) | (batch[order][1:] != batch[order][:-1])])
        number = np.empty(len(island), np.int64)
        number[order] = np.cumsum(new) - 1
        self.known = batch[order][new]
        self.first_batch = np.minimum.reduceat(number, head)
        self.rank = number - np.repeat(self.first_batch, size)
        self.rows = int(self.rank.max()) + 1
        # one axis: each island begins more than a gap after the one before
        low, high = start[head], np.maximum.reduceat(end, head)
        shift = np.concatenate([[0], np.cumsum(high - low + gap + 1)[:-1]]) - low
        self.axis_start, self.axis_end = start + np.repeat(shift, size), end + np.repeat(shift, size)

    def versions(self, cells: int = CELLS) -> Iterator[dict[str, np.ndarray]]:
        """Versions in the order of the rows; what retracts a version may come with a later slab and is set before any is given."""
        width, step = len(self.island), max(2, cells // max(1, len(self.island)))
        out: list[dict[str, np.ndarray]] = []
        open_run, open_part, open_at = (np.zeros(0, np.int64) for _ in range(3))
        for k0 in range(0, self.rows, step - 1):
            rows = np.arange(max(0, k0 - 1), min(self.rows, k0 + step - 1))
            skip = int(rows[0] < k0)  # a row of the slab before, for the sessions that stood then
            active = self.rank <= rows[:, None]
            reach = np.maximum.accumulate(np.where(active, self.axis_end, np.iinfo(np.int64).min // 2), axis=1)
            breaks = active.copy()
            breaks[:, 1:] &= self.axis_start[1:] - reach[:, :-1] > self.gap
            flat = np.flatnonzero(active)
            row, run = flat // width, flat % width
            at = np.flatnonzero(breaks.ravel()[flat])
            session = np.full(active.shape, -1, np.int64)
            session.ravel()[flat] = np.cumsum(breaks.ravel()[flat]) - 1
            new = np.add.reduceat(np.where(self.rank[run] == rows[row], self.n[run], 0), at)
            own_row, own_run = row[at], run[at]
            # sessions of the row before, by the session that now has their first run
            stood = own_row < len(rows) - 1
            merged = np.bincount(session[own_row[stood] + 1, own_run[stood]], minlength=len(at))
            is_new = (new > 0) & (own_row >= skip)
            pick = np.flatnonzero(is_new)
            batch_of = lambda s: self.known[self.first_batch[self.island[own_run[s]]] + rows[own_row[s]]]
            # for each run and row, the next row from there on whose session is new
            fresh = np.where(session >= 0, is_new[session], False)
            following = np.where(fresh, np.arange(len(rows))[:, None], len(rows))
            following = np.vstack([np.minimum.accumulate(following[::-1], axis=0)[::-1], np.full(width, len(rows))])
            part = {
                "user": own_run[pick], "batch": batch_of(pick), "start_s": self.start[own_run[pick]], "end_s": np.maximum.reduceat(self.end[run], at)[pick],
                "n_events": np.add.reduceat(self.n[run], at)[pick], "n_new": new[pick], "n_retracted": merged[pick], "h_sum": np.add.reduceat(self.h[run], at)[pick],
                "retracted_batch": np.zeros(len(pick), np.int64), "retracted_start_s": np.zeros(len(pick), np.int64), "retracted": np.zeros(len(pick), bool),
            }
            out.append(part)
            waiting_run = np.concatenate([open_run, own_run[pick]])
            waiting_part = np.concatenate([open_part, np.full(len(pick), len(out) - 1)])
            waiting_at = np.concatenate([open_at, np.arange(len(pick))])
            since = np.concatenate([np.full(len(open_run), skip), own_row[pick] + 1])
            to = following[since, waiting_run]
            found = to < len(rows)
            by = session[to[found], waiting_run[found]]
            for p in np.unique(waiting_part[found]):
                these = waiting_part[found] == p
                where = waiting_at[found][these]
                out[p]["retracted_batch"][where] = batch_of(by[these])
                out[p]["retracted_start_s"][where] = self.start[own_run[by[these]]]
                out[p]["retracted"][where] = True
            open_run, open_part, open_at = waiting_run[~found], waiting_part[~found], waiting_at[~found]
        yield from out


def _versions(table: pa.Table, gap: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Versions of whole islands, whose runs stand together in order of time."""
    column = {c: table.column(c).to_numpy() for c in table.column_names}
    new = np.zeros(len(table), bool)
    new[:1] = True
    for c in ("user", "home", "island"):
        new[1:] |= column[c][1:] != column[c][:-1]
    island = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(table)))
    # islands with about as many batches go together, so that few cells are empty
    pairs = np.unique(np.stack([island, column["batch"]], axis=1), axis=0)
    batches = np.bincount(pairs[:, 0], minlength=len(head))
    kind = np.ceil(np.log2(batches)).astype(np.int64)
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        chunk = np.cumsum(size[mine]) * (1 << int(k)) // cells
        for c in np.unique(chunk):
            group = mine[chunk == c]
            n = size[group]
            row = np.repeat(head[group] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            one = np.repeat(np.arange(len(group)), n)
            matrix = _Matrix(one, *(column[x][row] for x in ("batch", "start", "end", "n", "h")), gap)
            for part in matrix.versions(cells):
                users = column["user"][row][part.pop("user")]
                none = ~part.pop("retracted")
                arrays = [pa.array(users)] + [pa.array(v, pa.int64(), mask=none if name.startswith("retracted") else None) for name, v in part.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=VERSION.names)


def versions(events: DataFrame, gap: int = 240, tile: int = 7200, cells: int = CELLS) -> DataFrame:
    """Every version of every session of ``events`` (user, seconds, batch, h: all long), with the version that retracts it.

    n_retracted: 0 where a session is created, 1 where one is extended, more
    where several merge. ``tile`` (over ``gap``) is the length of the time tiles
    by which a user's events are dealt.
    """
    if tile <= gap:
        raise ValueError("a tile is longer than the gap")
    found = islands(runs(events, gap, tile), gap)
    parted = found.repartition("user", "home", "island").sortWithinPartitions("user", "home", "island", "start", "end", "batch")
    key = ("user", "home", "island")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = np.logical_and.reduce([batch.column(c).to_numpy() == batch.column(c)[-1].as_py() for c in key])
            goes_on = bool(kept) and all(kept[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in key)
            if goes_on and last.all():
                kept.append(batch)
                continue
            at = int(np.argmax(last))  # the last island may go on in the next batch
            yield from _versions(pa.Table.from_batches([*kept, batch.slice(0, at)]).combine_chunks(), gap, cells) if kept or at else ()
            kept = [batch.slice(at)]
        if kept:
            yield from _versions(pa.Table.from_batches(kept).combine_chunks(), gap, cells)

    return parted.mapInArrow(run, VERSION)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as events: users, seconds and the batches in which they arrive, from checksums of their ids."""
    c = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    h = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    found = conversations.where(F.col("turn").isNotNull() & F.col("conv_id").isNotNull()).select("conv_id", "turn", c.alias("c"), h.alias("h"))
    seconds = _floor(F.col("c"), 2) % 7200 + 300 * F.col("turn") + F.col("h") % 600
    g = _floor(F.col("h"), 600)
    timed = found.select((2 * _floor(F.col("conv_id"), 8) + F.col("c") % 2).alias("user"), seconds.alias("seconds"), g.alias("g"), "h")
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)
    return timed.select("user", "seconds", (_floor(F.col("seconds"), 1800) + late).alias("batch"), "h")


def op13_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every user's sessions over the conversations' turns."""
    return versions(conversation_events(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
