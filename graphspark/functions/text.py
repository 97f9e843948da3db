"""Text functions as column expressions."""

from __future__ import annotations

import re

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

def _greek() -> dict[str, str]:
    """Greek letters and their names, from the names of the code points (final sigma is sigma)."""
    out = {}
    for c in (*range(0x391, 0x3CA), 0x3D5, 0x3F5):
        name = unicodedata.name(chr(c), "")
        if name.startswith(("GREEK SMALL LETTER ", "GREEK CAPITAL LETTER ")) and "WITH" not in name:
            word = name.split("LETTER ")[1].removeprefix("FINAL ").lower()
            out[chr(c)] = {"lamda": "lambda"}.get(word, word)
    return out | {"\u03d5": "phi", "\u03f5": "epsilon", "\u00b5": "mu"}


GREEK = _greek()


def capitalize_words(c: Column) -> Column:
    """Initial capitals for words of lower-case letters only."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.rlike("^[a-z]+$"), F.initcap(w)).otherwise(w)), " ")


def english_join(items: Column) -> Column:
    """"a, b and c"."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.element_at(items, -1))
    )


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")


def type_abbreviation(c: Column) -> Column:
    """The first three letters of each camel-case word."""
    return F.array_join(F.transform(F.split(split_camel(c), " "), lambda w: F.left(w, F.lit(3))), "")


def greek_names(c: Column) -> Column:
    """Greek letters spelt out; texts without any stay as they are."""
    return _spelt(c, GREEK)


def tokenize(c: Column) -> Column:
    """Words without marks and underscores, Greek letters spelt out, lower-cased."""
    return F.filter(F.split(F.regexp_replace(F.lower(greek_names(c)), "(?U)[\\W_]+", " "), " "), lambda w: w != "")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters that become one other without marks, and what they become; those that become several. Hangul syllables stay."""
    out = {chr(c): _plain(chr(c)) for c in range(0x80, 0x20000) if not (0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000)}
    one = {c: t for c, t in out.items() if len(t) == 1 and t != c}
    return "".join(one), "".join(one.values()), {c: t for c, t in out.items() if len(t) > 1}


_ONE, _TO, _SEVERAL = _decompositions()


@F.pandas_udf(T.StringType())
def _transliterated(texts: pd.Series) -> pd.Series:
    def letter(c: str) -> str:
        if c.isascii():
            return c
        name = unicodedata.name(c, "")
        for case in ("SMALL LETTER ", "CAPITAL LETTER "):
            if case in name:
                word = name.split(case)[1].split(" ")[0].lower()
                return word if case.startswith("SMALL") else word.capitalize()
        return " " if c.isspace() else "-" if unicodedata.category(c) == "Pd" else ""

    return texts.map(lambda t: t if t is None else "".join(map(letter, _plain(t))).strip())


def _spelt(c: Column, mapping: dict[str, str]) -> Column:
    """Single characters replaced by strings; a text without any of them is looked at once."""
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in mapping.items())), F.lit("\x01"), F.lit("\x02"))  # folded to one literal
    each = F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x))
    return F.when(c.rlike("[" + "".join(mapping) + "]"), F.array_join(each, "")).otherwise(c)


def decomposed(c: Column) -> Column:
    """NFKD without marks (but Hangul syllables stay whole), as an expression that may stand in a lambda."""
    single = F.translate(F.regexp_replace(c, "\\p{Mn}+", ""), _ONE, _TO)
    return F.when(c.rlike("[^\\x00-\\x7f]"), _spelt(single, _SEVERAL)).otherwise(c)


def ascii_text(c: Column) -> Column:
    """Letters of other scripts by the names of their code points, dashes as "-", other marks left out (in Python, so not in a lambda)."""
    return F.when(c.rlike("[^\\x00-\\x7f]"), _transliterated(F.when(c.rlike("[^\\x00-\\x7f]"), c))).otherwise(F.trim(c))


def normalize_name(c: Column) -> Column:
    """Lower case, no accents, dashes and marks as blanks, single blanks."""
    plain = F.lower(greek_names(decomposed(F.lower(c))))
    return F.trim(F.regexp_replace(plain, "(?U)[\\W_]+", " "))


def normalize_keeping(c: Column) -> Column:
    """Lower case without accents, Greek letters spelt, runs of blanks as one; marks stay."""
    return F.trim(F.regexp_replace(F.lower(greek_names(decomposed(F.lower(c)))), "\\s+", " "))


def yes_no(line: Column) -> Column:
    """YES or NO at the start of a line, whatever follows; else null."""
    found = F.upper(F.regexp_extract(line, "(?i)^(yes|no)", 1))
    return F.when(found != "", found)


def paragraphs(c: Column, least: int) -> Column:
    """Paragraphs (parted by blank lines) of at least so many characters, trimmed."""
    return F.filter(F.transform(F.split(c, "\\n\\s*\\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def node_text(c: Column, types: dict[str, str] | None = None) -> Column:
    """(type, name) of "Type: Name"; without a type the whole is the name. ``types`` maps types to those in use."""
    has = c.contains(": ")
    kind = F.trim(F.split_part(c, F.lit(": "), F.lit(1)))
    for old, new in (types or {}).items():
        kind = F.when(kind == old, new).otherwise(kind)
    return F.struct(
        F.when(has, kind).otherwise("Unknown").alias("type"),
        F.when(has, F.trim(F.regexp_replace(c, "^[^:]*: ", ""))).otherwise(F.trim(c)).alias("name"),
    )


_NODE = "^[^:|]+: \\S.*$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def edge_line(c: Column) -> Column:
    """(head, relation, tail) of "head | relation | tail", fewer than three parts give null.

    Of the parts that look like "Type: Name" the first is the head and the last the tail; one alone in third place or
    later is the tail, with the first two parts as head and relation; one alone before that is both (a loop, as it is
    written); without any the first part is the head and the last the tail. What remains, joined by " + ", is the
    relation. "Disease: new disease" as head is the tail.
    """

    def of_parts(parts: Column) -> Column:
        places = F.filter(F.transform(parts, lambda x, k: F.when(x.rlike(_NODE), k)), lambda k: k.isNotNull())
        return _let(places, lambda places: of_places(parts, places))

    def of_places(parts: Column, places: Column) -> Column:
        found, one = F.size(places), F.get(places, 0)
        late = (found == 1) & (one > 1)
        head = F.when(late | (found == 0), F.lit(0)).otherwise(one)
        tail = F.when(found == 0, F.size(parts) - 1).otherwise(F.element_at(places, -1))
        return _let(F.struct(head.alias("head"), tail.alias("tail"), late.alias("late")), lambda at: of_ends(parts, at))

    def of_ends(parts: Column, at: Column) -> Column:
        rest = F.filter(F.transform(parts, lambda x, k: F.when((k != at["head"]) & (k != at["tail"]), x)), lambda x: x.isNotNull())
        relation = F.when(at["late"], F.get(parts, 1)).otherwise(F.array_join(rest, " + "))
        a, b = F.get(parts, at["head"]), F.get(parts, at["tail"])
        swap = a.rlike("(?i)^disease: new disease$")
        return F.when(
            F.size(parts) >= 3,
            F.struct(F.when(swap, b).otherwise(a).alias("head"), relation.alias("relation"), F.when(swap, a).otherwise(b).alias("tail")),
        )

    return _let(F.transform(F.split(c, "\\s*\\|\\s*"), lambda x: F.trim(x)), of_parts)


def json_list(c: Column) -> Column:
    """Strings of the first JSON list in a text."""
    return F.from_json(F.regexp_extract(c, "(?s)(\\[.*?\\])", 1), "array<string>")


def json_list_between(c: Column, start: str, end: str, several: bool = False) -> Column:
    """Strings of the JSON list between two marks; with ``several``, those of all such lists, one after another.

    White space around the list doesn't matter. Null where there are no marks or no list between them.
    """
    mark = lambda m: re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", m)
    pattern = F.lit(f"(?s){mark(start)}\\s*(\\[.*?\\])\\s*{mark(end)}")
    lists = F.filter(F.transform(F.regexp_extract_all(c, pattern, F.lit(1)), lambda x: F.from_json(x, "array<string>")), lambda x: x.isNotNull())
    return F.when(F.size(lists) > 0, F.flatten(lists) if several else F.get(lists, 0))


def node_to_drug_id(c: Column) -> Column:
    """"DrugBank:DB09130" as "DB:DB09130"; null where it is no such node."""
    return F.when(c.startswith("DrugBank:"), F.concat(F.lit("DB:"), F.substring_index(c, ":", -1)))


def drug_id_to_node(c: Column) -> Column:
    """"DB:DB09130" as "DrugBank:DB09130"; null where it is no such id."""
    return F.when(c.startswith("DB:"), F.concat(F.lit("DrugBank:"), F.substring_index(c, ":", -1)))


def parse_name(c: Column) -> Column:
    """(main, alternates, examples) of names like "Long Name (LN) (e.g. A, B)"."""
    examples = F.regexp_extract(c, "\\(e\\.g\\.,? ([^)]*)\\)", 1)
    rest = F.regexp_replace(c, "\\s*\\(e\\.g\\.,? [^)]*\\)", "")
    return F.struct(
        F.trim(F.regexp_replace(rest, "\\s*\\([^()]*\\)", "")).alias("main"),
        F.transform(F.regexp_extract_all(rest, F.lit("\\(([^()]*)\\)"), F.lit(1)), lambda x: F.trim(x)).alias("alternates"),
        F.filter(F.transform(F.split(examples, ",\\s*|\\s+and\\s+"), lambda x: F.trim(x)), lambda x: x != "").alias("examples"),
    )


def hyphen_variants(c: Column) -> Column:
    """All other spellings of a name, each of its hyphens kept, as a blank, or left out (3^n - 1 for n hyphens).

    A hyphen that begins or ends the name is no hyphen. Where one is left out after a small letter, the next letter is small.
    """
    parts = F.regexp_extract_all(c, F.lit("(.[^-]*-$|.[^-]*)(?:-|$)"), F.lit(1))
    small = lambda x: F.concat(F.lower(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))

    def longer(state, part):
        after_small = F.right(state["last"], F.lit(1)).rlike("\\p{Ll}")
        joined = F.when(after_small, small(part)).otherwise(part)
        each = F.flatten(F.transform(state["all"], lambda a: F.array(F.concat(a, F.lit("-"), part), F.concat(a, F.lit(" "), part), F.concat(a, joined))))
        return F.struct(each.alias("all"), part.alias("last"))

    first = F.get(parts, 0)
    start = F.struct(F.array(F.coalesce(first, F.lit(""))).alias("all"), F.coalesce(first, F.lit("")).alias("last"))
    every = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, longer, lambda s: s["all"])
    return F.when(F.size(parts) > 1, F.slice(every, 2, F.size(every) - 1)).otherwise(F.array().cast("array<string>"))


def file_name(c: Column, longest: int = 20) -> Column:
    """A normalised name for a file: underscores for blanks, cut, with "Z" where the name was longer."""
    plain = F.regexp_replace(F.trim(c), "\\s+", " ")
    return F.concat(F.left(F.replace(normalize_name(plain), F.lit(" "), F.lit("_")), F.lit(longest)), F.when(F.length(plain) > longest, "Z").otherwise(""))


def names_and_examples(names: Column) -> Column:
    """(names, examples), sorted: an alternate "A (for B, C)" is the examples A, B and C."""
    pattern = "^([^(]+)\\s+\\(for ([^)]+)\\)$"
    given = F.filter(names, lambda x: x.rlike(pattern))
    split = F.transform(given, lambda x: F.concat(F.array(F.trim(F.regexp_extract(x, pattern, 1))), F.transform(F.split(F.regexp_extract(x, pattern, 2), ","), lambda y: F.trim(y))))
    return F.struct(F.array_sort(F.array_distinct(F.filter(names, lambda x: ~x.rlike(pattern)))).alias("names"), F.array_sort(F.array_distinct(F.flatten(split))).alias("examples"))


def long_names(names: Column, least: int = 50, blanks: int = 3) -> Column:
    """(short, long): names of at least so many characters and blanks are long."""
    is_long = lambda x: (F.length(x) >= least) & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= blanks)
    return F.struct(F.filter(names, lambda x: ~is_long(x)).alias("short"), F.filter(names, is_long).alias("long"))


def type_pattern(c: Column, types: list[str]) -> Column:
    """(type, least) of a pattern like "eff.3+, gen.1": the first type that starts with the abbreviation, and its least degree (1 without a number).

    Abbreviations of no type are left out.
    """
    each = F.transform(F.filter(F.split(c, ", "), lambda x: x != ""), lambda x: F.struct(
        F.get(F.filter(F.array(*map(F.lit, types)), lambda t: t.startswith(F.split_part(x, F.lit("."), F.lit(1)))), 0).alias("type"),
        F.coalesce(F.nullif(F.regexp_extract(x, "\\.(\\d+)\\+?$", 1), F.lit("")).cast("int"), F.lit(1)).alias("least"),
    ))
    return F.filter(each, lambda x: x["type"].isNotNull())


def score_map(ref: Column, target: Column, score: Column, separator: str = "||") -> Column:
    """An aggregate: a map from "ref||target" to the score."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(ref, F.lit(separator), target).alias("key"), score.alias("value")))))


def difference(a: Column, b: Column) -> Column:
    """(prefix, first, second, suffix, distance): what two strings share at either end, what differs between, and their edit distance.

    Null where one is null.
    """
    shared = lambda x, y: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(x), F.length(y)), F.lit(1))), lambda k: (k <= F.least(F.length(x), F.length(y))) & (F.left(x, k) == F.left(y, k))))
    head = shared(a, b)
    tail = F.least(shared(F.reverse(a), F.reverse(b)), F.least(F.length(a), F.length(b)) - head)
    mid = lambda x: x.substr(head + 1, F.length(x) - head - tail)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.left(a, head).alias("prefix"), mid(a).alias("first"), mid(b).alias("second"), F.right(a, tail).alias("suffix"), F.levenshtein(a, b).alias("distance")))


def longest(items: Column) -> Column:
    """The longest string, the first of equals."""
    return F.aggregate(items, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def compound_ids(c: Column, width: int = 7) -> Column:
    return F.transform(F.split(c, "_"), lambda x: F.lpad(x, width, F.lit("0")))


def qualified_node(kind: Column, name: Column, node: Column) -> Column:
    """"Type: Name (id)"; null where a part is."""
    return F.concat(kind, F.lit(": "), name, F.lit(" ("), node, F.lit(")"))


def edge_text(head: Column, relation: Column, tail: Column) -> Column:
    """"head | relation | tail"."""
    return F.concat_ws(" | ", head, relation, tail)


@F.pandas_udf(T.StringType())
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: w if w is None else " ".join(map(stem, w.split(" "))))


def _measure(word: str) -> int:
    """How often a run of vowels is followed by a consonant."""
    kinds = ""
    for k, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and k > 0 and kinds[-1] == "c")
        kinds += "v" if vowel else "c"
    return sum(kinds[k] == "v" and kinds[k + 1] == "c" for k in range(len(kinds) - 1))


def stem(word: str) -> str:
    """A word without its English endings: plurals, -ed and -ing, -ly, and suffixes of nouns and adjectives, while what is left has a vowel."""
    w = word.lower()
    if len(w) <= 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    for end in ("eed", "ed", "ing"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end == "eed":
                w = base + "ee" if _measure(base) > 0 else w
            elif any(c in "aeiouy" for c in base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
            break
    if w.endswith("y") and any(c in "aeiouy" for c in w[:-1]):
        w = w[:-1] + "i"
    for end, new in SUFFIXES.items():
        if w.endswith(end):
            if _measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + new
            break
    if w.endswith("e") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# Endings and what they become, longest first.
SUFFIXES = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous",
    "ation": "ate", "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al", "ator": "ate", "logi": "log",
    "ical": "ic", "ness": "", "ment": "", "able": "", "ible": "", "eli": "e", "ful": "", "ive": "", "ous": "",
}


def stems(c: Column) -> Column:
    """Every word of a text (parted by blanks) without its ending."""
    return _stemmed(c)


# Functions for SQL texts: name, signature and body.
SQL_FUNCTIONS = {
    "qualified_node": ("(kind STRING, name STRING, id STRING) RETURNS STRING", "kind || ': ' || name || ' (' || id || ')'"),
    "yes_no": ("(line STRING) RETURNS STRING", "nullif(upper(regexp_extract(line, '(?i)^(yes|no)', 1)), '')"),
    "compound_ids": ("(ids STRING) RETURNS ARRAY<STRING>", "transform(split(ids, '_'), x -> lpad(x, 7, '0'))"),
}


def register(spark) -> list[str]:
    """Make the functions of ``SQL_FUNCTIONS``, and the table function ``graph_lines(text)`` (pos, head, relation, tail), known to the session's SQL."""
    for name, (signature, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")

    class GraphLines:
        def eval(self, text: str):
            for pos, line in enumerate((text or "").split("\n")):
                parts = [p.strip() for p in line.split("|")]
                if len(parts) >= 3:
                    yield pos, parts[0], " + ".join(parts[1:-1]), parts[-1]

    spark.udtf.register("graph_lines", F.udtf(GraphLines, returnType="pos int, head string, relation string, tail string"))
    return [*SQL_FUNCTIONS, "graph_lines"]
