"""The divergence audit against SQL and a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphspark.llm import divergence

from ..oracle import compare, connect

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, ranks=200):
    lower = {k: k + 32 for k in range(65, 91)}
    count, held, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        count.update((lang, source, t) for t in terms)
        held.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (own, t), n in held.items() if own == lang and n >= least]
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))
        p = {(s, t): share(count[lang, s, t], n[s]) for s in sources for t in kept}
        q = {t: share(sum(count[lang, s, t] for s in sources), sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s, t], q[t]), t) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(items)]
    return Counter(out)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op12(spark, folder):
    assert compare(spark, connect(folder), "op12", divergence.op12_divergence, divergence.ORACLE_SQL, folder) is None


def test_op12_over_odd_documents(spark, sf, odd):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert Counter(map(tuple, divergence.op12_divergence(spark, sf).collect())) == plain(rows)


# cells: one block, or many; ranks: ties at the edge
@pytest.mark.parametrize("cells,ranks", [(1 << 18, 200), (8, 3), (8, 1)])
def test_ties_and_blocks(spark, cells, ranks):
    words = ["a", "B", "b", "é", "É", "日本", "x-y", "z1z", "\U0001f600", "zz"]
    rows = [(lang, f"s{k % 5}", " ".join(words[(k * j) % len(words)] for j in range(1, 9))) for k in range(60) for lang in ("en", "fr", None)]
    rows += [("xx", "only", None), ("yy", "a", "rare"), ("yy", "b", None), ("yy", None, "")] + rows[:7]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, block int").repartition(3)
    assert Counter(map(tuple, divergence.audit(df, ranks=ranks, cells=cells).collect())) == plain(rows, ranks=ranks)


def test_shares_of_large_counts():
    count = np.array([0, 7, 10**13, 3 * 10**15])
    total = 8 * 10**15
    assert divergence.shares(count, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]


def test_best_keeps_first_of_equals():
    assert sorted(divergence._best(np.array([3, 9, 3, 3, 1]), 3).tolist()) == [0, 1, 2]
