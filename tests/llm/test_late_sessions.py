"""Versions of sessions against a plain replay, batch after batch."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from graphspark.llm import late_sessions

SCHEMA = "user long, seconds long, batch long, h long"


def plain(events, gap=240):
    out, by = [], defaultdict(list)
    for user, seconds, batch, h in events:
        if None not in (user, seconds, batch):
            by[user].append((seconds, batch, h or 0))
    for user, own in by.items():
        standing = {}
        for batch in sorted({b for _, b, _ in own}):
            groups = []
            for e in sorted(x for x in own if x[1] <= batch):
                if groups and e[0] - groups[-1][-1][0] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            for g in groups:
                if new := sum(b == batch for _, b, _ in g):
                    start, end = g[0][0], g[-1][0]
                    gone = [k for k in standing if start <= k[0] and k[1] <= end]
                    row = [user, batch, start, end, len(g), new, len(gone), sum(x[2] for x in g), None, None]
                    for k in gone:
                        standing.pop(k)[8:] = [batch, start]
                    standing[start, end] = row
                    out.append(row)
    return Counter(map(tuple, out))


def turns(rows):
    for conv, turn in rows:
        if conv is None or turn is None:
            continue
        c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
        seconds, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
        yield 2 * (conv // 8) + c % 2, seconds, seconds // 1800 + (g % 4 if g % 3 == 0 else 0), h


def got(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn").collect()
    assert got(late_sessions.op13_late_sessions(spark, folder)) == plain(turns(rows))


def test_odd_conversations(spark, tmp_path):
    rows = [(8, 0), (8, 0), (8, 1), (8, None), (None, 3), (-3, 2), *((17, k) for k in range(400)), *((17, 5) for _ in range(300))]
    spark.createDataFrame([(c, t, None, None) for c, t in rows], "conv_id long, turn long, role string, user string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(late_sessions.op13_late_sessions(spark, str(tmp_path))) == plain(turns(rows))


# cells: whole matrices, or slabs of few rows; tile: islands within tiles, or through many
@pytest.mark.parametrize("cells,tile,span", [(1_000_000, 7200, 60_000), (40, 7200, 60_000), (40, 250, 4000), (1_000_000, 250, 20_000)])
def test_random_batches(spark, cells, tile, span):
    r = random.Random(cells + tile)
    events = [(r.randint(0, 3) if k % 2 else 0, r.randint(-500, span), r.randint(-2, 12), r.randint(0, 9)) for k in range(700)]
    events += events[:50] + [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (9, 5, 5, None)]
    assert got(late_sessions.versions(spark.createDataFrame(events, SCHEMA), tile=tile, cells=cells)) == plain(events)


def test_gap_is_inclusive_and_ties_meet(spark):
    events = [(1, 0, 0, 1), (1, 240, 0, 2), (1, 481, 0, 4), (1, 481, 1, 8), (1, 361, 2, 16), (1, 361, 2, 16)]
    assert got(late_sessions.versions(spark.createDataFrame(events, SCHEMA))) == plain(events)


def test_session_through_many_tiles(spark):
    """One user without a pause over 200 tiles: one island, found by jumping."""
    events = [(7, 200 * k, 200 * k // 1800 + k % 3, k) for k in range(300)]
    found = late_sessions.islands(late_sessions.runs(spark.createDataFrame(events, SCHEMA), 240, 300), 240)
    assert found.select("home", "island").distinct().count() == 1
    assert got(late_sessions.versions(spark.createDataFrame(events, SCHEMA), tile=300)) == plain(events)


def test_empty_and_short_tiles(spark):
    assert late_sessions.versions(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        late_sessions.versions(spark.createDataFrame([], SCHEMA), tile=240)
