"""Surrogates of single entities, of whole networks, and of names and their later mentions."""

import datetime
import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from graphspark.llm import surrogates as S

KEY = b"a key"


def changed(spark, *texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in S.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_mentions_without_the_title_agree(spark):
    (new,) = changed(spark, "Mr John Smith met Smith. Smith left; John stayed. Write to smith@x.org or Smithson.")
    m = re.fullmatch(r"Mr (\w+) (\w+) met (\w+)\. (\w+) left; (\w+) stayed\. Write to (\S+) or Smithson\.", new)
    assert m and m[2] == m[3] == m[4] != "Smith" and m[1] == m[5] != "John" and m[6] != "smith@x.org"


def test_scripts_and_hyphens_stay(spark):
    new = changed(spark, "Mme Anne-Marie Dupont", "السيد محمد حسن", "Господин Иван Петров", "גברת שרה לוי")
    assert re.fullmatch(r"Mme [A-Z][a-z]+-[A-Z]?[a-z]+ [A-Z][a-z]+", new[0]) and "Dupont" not in new[0]
    for text, script in zip(new[1:], ("ARABIC", "CYRILLIC", "HEBREW")):
        assert {S.script_of(w) for w in text.split()} == {script}
    assert not {"محمد", "حسن", "Иван", "Петров", "שרה", "לוי"} & set(" ".join(new).split())


def test_more_kinds(spark):
    iban, v6, born = changed(spark, "account DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01", "host 2001:db8::8a2e:370:7334 up at 12:30:45", "born on 1984-02-29, geboren am 03.11.1979; on 2020-01-01 nothing")
    new = re.match(r"account (DE\d\d(?: \d{4}){4} \d\d), not DE89 3704 0044 0532 0130 01$", iban)[1]
    assert new != "DE89 3704 0044 0532 0130 00" and S._is_entity("iban", new)
    host = re.match(r"host (\S+) up at 12:30:45$", v6)[1]
    assert host.startswith("2001:") and ipaddress.IPv6Address(host) != ipaddress.IPv6Address("2001:db8::8a2e:370:7334")
    a, b = re.match(r"born on (\S+), geboren am (\S+); on 2020-01-01 nothing$", born).groups()
    assert datetime.date.fromisoformat(a) != datetime.date(1984, 2, 29) and datetime.datetime.strptime(b, "%d.%m.%Y") and b != "03.11.1979"


def test_a_whole_network_stays_distinct(spark):
    """Every address of a network is an entity: no replacement is free, and all stay distinct."""
    df = spark.range(256).select("id", F.concat(F.lit("at "), F.concat_ws(" and ", *(F.concat(F.lit(f"192.168.{k}."), F.col("id").cast("string")) for k in range(0, 256, 2)))).alias("text"))
    old, new = ([a for r in d.orderBy("id").collect() for a in r.text[3:].split(" and ")] for d in (df, S.pseudonymise(df, KEY)))
    assert len(set(new)) == len(set(old)) == 256 * 128 and all(a.startswith("192.168.") for a in new)


@pytest.mark.parametrize("kind, token", [("email", "a1b@cd.org"), ("ip", "10.1.2.3"), ("ip", "8.8.4.4"), ("ip6", "fe80::1"), ("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("phone", "+49 30 1234567"), ("birth", "1990-05-17"), ("iban", "DE89370400440532013000")])
def test_replacements_stay_in_their_space(kind, token):
    for attempt in range(4):
        new = S.surrogate(kind, token, KEY, attempt)
        assert S.space(kind, new) == S.space(kind, token)
        assert S._is_entity(kind, new) == S._is_entity(kind, token)


def test_small_spaces_are_permuted():
    """Every value of a space, and every replacement once."""
    for kind, tokens in (("phone", [f"+49 {k:02d}" for k in range(100)]), ("ip6", [f"fe80::{k:x}" for k in range(16)]), ("email", [f"{a}{k}@x.org" for a in "abc" for k in range(10)])):
        assert len({S.surrogate(kind, t, KEY) for t in tokens}) == len(tokens)


def test_keys_differ(spark):
    assert changed(spark, "ip 8.8.4.4") != changed(spark, "ip 8.8.4.4", key=b"other")


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "Mr Bob Miller", "a", "b", 3), (2, None, "a", "b", 4), (3, "", None, None, 5)], "doc_id long, text string, _h string, _x string, n_entities long")
    for bound in (0, 20_000):
        out = S.pseudonymise(df, KEY, closure_rows=bound)
        assert out.columns == df.columns
        assert {(r.doc_id, r._h, r._x, r.n_entities) for r in out.collect()} == {(1, "a", "b", 2), (2, "a", "b", 0), (3, None, None, 0)}
