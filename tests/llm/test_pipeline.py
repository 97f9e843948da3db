"""The whole pipeline against plain versions of its stages, on a small corpus with every kind of document."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from graphspark.llm import line_quality, secret_scan, toxicity

from .test_contracts import WORD, library_ids
from .test_near_copies import plain_kept


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeilnorstu") for _ in range(r.randint(3, 9)))
    vocabulary = [word() for _ in range(300)]
    prose = lambda n: "\n".join(" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(n))
    junk = lambda: "\n".join("### $$$ | Home | Login | " + r.choice(vocabulary).upper() + " !!! ***" for _ in range(12))
    texts, labels = [], []
    for k in range(240):
        kind = k % 8
        body = prose(r.randint(6, 14))
        if kind == 1:
            body = body.replace(".", " you stupid idiot scum.", 4)
        elif kind == 2:
            body = junk()
        elif kind == 3:
            body += f'\napi_key = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"\n' + prose(2)
        elif kind == 4 and texts:
            body = texts[-4]
        elif kind == 5 and len(texts) > 8:
            old = texts[-5].split(" ")
            old[len(old) // 2] = "changed"
            body = " ".join(old)
        texts.append(body)
        labels.append((k, int(kind != 2), int(kind == 1)))
    texts += [None, "", " \n", "too short", "a " * 400, "é" * 900, prose(400)]
    rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def plain_score(m, text):
    terms = set()
    for w in WORD.findall((text or "").lower()):
        w = w.strip(" .,;:!?\"'()[]{}#*$%&|<>-_")
        for t in [w] * bool(w) + ["4" + w[:4]] * (len(w) > 4) + ["5" + w[:5]] * (len(w) > 5):
            terms.add(zlib.crc32(t.encode()) & (1 << toxicity.BUCKET_BITS) - 1)
    at = [k for k, b in enumerate(m.bucket.tolist()) if b in terms]
    z = m.bias + sum(m.weight[k] for k in at) + sum(float(m.factor[a] @ m.factor[b]) for i, a in enumerate(at) for b in at[:i])
    return 1 / (1 + math.exp(-z))


def plain_good(field, text):
    words = WORD.findall(text or "")
    n = len(words)
    seen = Counter(tuple(words[k : k + 8]) for k in range(n - 7))
    cover = {j for k in range(n - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    if n < 20 or 100 * len(cover) > 30 * n:
        return False
    import pyarrow as pa

    d = line_quality.describe(pa.array([text]))
    own = field.line[d.line_features].sum(1)
    best = [(field.begin + own[0], [[0], [1]])]
    score, paths = best[0]
    for line in own[1:]:
        step = [[score[a] + field.step[a, b] + line[b] for a in (0, 1)] for b in (0, 1)]
        keep = [int(np.argmax(s)) for s in step]
        paths = [paths[keep[b]] + [b] for b in (0, 1)]
        score = np.array([step[b][keep[b]] for b in (0, 1)])
    state = paths[int(np.argmax(score))]
    content = sum(int(c) for c, s in zip(d.line_chars, state) if s == line_quality.CONTENT)
    return content >= line_quality.CONTENT_SHARE * max(1, sum(map(len, words)))


def test_rows_are_those_of_plain_stages(spark, corpus):
    path, rows = corpus
    got = corpus_pipeline.run(spark, path).collect()
    labels = spark.read.parquet(f"{path}/labels.parquet")
    table = lambda rs: spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long")

    machine = toxicity.fit(table(rows), labels)
    clean = [x for x in rows if plain_score(machine, x[1]) < toxicity.THRESHOLD]
    toxic = {x[0] for x in rows} - {x[0] for x in clean}
    assert len([k for k in toxic if k < 240 and k % 8 == 1]) >= 0.9 * 30 and len([k for k in toxic if k % 8 in (0, 6, 7)]) <= 2

    field = line_quality.fit(table(clean), labels)
    good = [x for x in clean if plain_good(field, x[1])]
    assert not [x for x in good if x[0] < 240 and x[0] % 8 == 2]

    kept = set(plain_kept([(x[0], x[1]) for x in good]))
    one = [x for x in good if x[0] in kept]
    assert len(one) < len(good)

    spans = {}
    for f in secret_scan.scan(table(one), secret_scan.train(spark, words=secret_scan.known_words())).where("is_secret").collect():
        spans.setdefault(f.doc_id, []).append((f.start, f.length))
    masked = {}
    for x in one:
        t = x[1]
        for start, length in sorted(spans.get(x[0], []), reverse=True):
            t = t[:start] + "[SECRET]" + t[start + length :]
        masked[x[0]] = t
    assert spans and not any(re.search(r"[0-9a-f]{40}", t) for t in masked.values())

    want = Counter()
    for i, t in masked.items():
        ids = library_ids(t)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= math.ceil(sum(used.values()) / 2048) + 1


def test_empty_tables(spark, empty_sf):
    assert corpus_pipeline.run(spark, empty_sf).count() == 0
