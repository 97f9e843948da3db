import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, ids string, length int, kind string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, other scripts, and columns whose names operators use."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    base = prose(300)
    near = base.replace(base.split()[150], "changed", 1)
    texts = [
        None, "", " \t\n ", "one", "it's we'll 'sabc ''s x's're  a\n\n b  c 12²3 İß 你好!! \U0001f600\U0001f600 's", base, base, near,
        "word " * 30_000, "a" * 3000, "\n".join([prose(30)] * 3), prose(40), prose(2000), "é" * 700, "a\x00b \x0b c\r\n" + prose(25), "<|endoftext|> x <|endoftext|>",
        'api_key = "3f9a7c2b1d4e5f60718293a4b5c6d7e8f9012345" ' + prose(20), "Mail a.b@c.example.com or (017) 555-7713 " + prose(20), "### $$$ " * 40, "x y z",
    ]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", None if t is None else len(t), k, 0.5, "x", 1, "k") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, None, None, None, None, None), (5, prose(50), "en", "src0", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


@pytest.fixture(scope="session")
def sf(spark, odd, tmp_path_factory):
    """A folder with the odd documents and labels for some."""
    path = str(tmp_path_factory.mktemp("sf"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(18)] + [(None, 1, 1), (999, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty_sf(spark, odd, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    odd.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path
