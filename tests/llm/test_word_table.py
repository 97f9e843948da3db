"""Words' ids by table against the library over whole texts, over odd documents."""

import hashlib

import numpy as np
import pytest

from graphspark.llm import bpe_codec, word_table

PATH = bpe_codec.rank_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_op11(spark, sf, rows, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_table.op11_word_table(spark, sf).collect())
    assert got == sorted((str(i), *want(library, t)) for i, t in rows)


TEXTS = [
    None, "", "  \n", "á é\tÉ 한 İΣς ß", "<|startoftext|>x<|endoftext|> y<|endoftext|>", "'s't're've 'm'll'd 's's 'sabc ''s !!'s",
    "12²3 naïve​zero\x85next\xa0x y \x0b\x0c\r", "\U0001f600\U0001f601 🇩🇪", "w" * 5000, "the cat " * 4000, "the cat",
]


@pytest.mark.parametrize("block,split", [(32_000_000, 8_000_000), (50, 20)])
def test_round_trip(spark, library, monkeypatch, block, split):
    """Any size of block gives the library's ids; columns that clash stay."""
    monkeypatch.setattr(word_table, "BLOCK_BYTES", block)
    monkeypatch.setattr(word_table, "SPLIT_BYTES", split)
    df = spark.createDataFrame([(k, t, "w", k % 3, "p") for k, t in enumerate(TEXTS + TEXTS[-2:])], "block long, text string, word string, number int, piece string").repartition(2)
    encoded = word_table.encode(df, PATH)
    assert encoded.columns == ["block", "word", "number", "piece", "ids"]
    for r in encoded.collect():
        assert r.ids == library.encode((TEXTS + TEXTS[-2:])[r.block] or "", add_special_tokens=False).ids and (r.word, r.piece, r.number) == ("w", "p", r.block % 3)
    for r in word_table.decode(encoded, PATH).collect():
        ids = library.encode((TEXTS + TEXTS[-2:])[r.block] or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_decode_odd_ids(spark, library):
    df = spark.createDataFrame([(0, None), (1, []), (2, [49_407, 320, 320]), (3, [70_000, 5]), (4, [5])], "n int, ids array<int>")
    got = {r.n: r.decoded for r in word_table.decode(df, PATH).collect()}
    assert got == {0: "", 1: "", **{k: library.decode(i, skip_special_tokens=False) for k, i in ((2, [49_407, 320, 320]), (3, [70_000, 5]), (4, [5]))}}


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        word_table.encode(spark.createDataFrame([("a b",)], "text string"), bpe_codec.rank_file("byte_bpe_50k.json"))


def test_each_word_of_a_group_is_encoded_once(spark, library):
    """Rows of one group give a word the same ids in every block, in the order of the words."""
    words = spark.createDataFrame([(b, g, f"the cat word{b}".encode()) for b in range(50) for g in range(3)], "block long, group int, words binary")
    rows = word_table.encode_words(words, PATH).collect()
    assert len(rows) == 150
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        counts = np.frombuffer(r.counts, np.uint32).tolist()
        want = [library.encode(w, add_special_tokens=False).ids for w in ("the", "cat", f"word{r.of}")]
        assert ids == sum(want, []) and counts == [len(w) for w in want]


def test_forgotten_words_are_encoded_again(spark, library, monkeypatch):
    monkeypatch.setattr(word_table, "MEMO_WORDS", 1)
    df = spark.createDataFrame([(k, f"a b c w{k % 7} a") for k in range(300)], "n int, text string").repartition(4)
    for r in word_table.encode(df, PATH).collect():
        assert r.ids == library.encode(f"a b c w{r.n % 7} a", add_special_tokens=False).ids
