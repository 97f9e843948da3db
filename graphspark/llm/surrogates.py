"""PII surrogates: every detected entity gets a keyed replacement of its own type and format.

Entities: mail addresses, addresses of machines (IPv4, IPv6), cards, bank
accounts (IBAN), social security numbers, phones, dates after a word for birth,
and names after a title with all other mentions of their words in the same text.
Names without a title anywhere in their text are not detected.

Numbers go through a keyed Feistel permutation of their digits, so length,
separators, check digits, a date's being a date and the range of an address
stay. Mail addresses keep their shape and top-level domain. Names keep gender,
script, case and hyphens: a given name and a surname have replacements of their
own, so a mention of the surname alone agrees with the full name. Scripts with
syllables of their own here get names of these; any other script gets as many
letters of its own block.

A replacement depends on the key, the entity and an attempt alone, so equal
entities get equal ones everywhere (coreference). Distinctness is checked over
the whole corpus: where two entities of a kind share a replacement, or it is
itself an entity of the corpus, all but the least try again, until none does.
Every attempt is a permutation of the entities of one format (its space). Where
the corpus holds more than a quarter of a space (every address of a network),
the first attempt stands for all of it: replacements stay distinct, but may be
other entities of that space.

The key is the caller's: who has it can undo the permutations. Defined cases:
null texts stay null, empty texts stay empty; repeated rows get equal texts;
texts without entities stay as they are; a column ``n_entities`` of the caller
is replaced; an empty table stays empty.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, documents, drop, in_batches, unused

#: The session's setting for the query's key, and a public key for tests, where it is unset.
KEY_SETTING, TEST_KEY = "spark.graphspark.surrogates.key", "a public key, for tests only"
#: A space is full where the corpus holds more than one in so many of its entities.
FULL = 4
#: Retried entities up to this number travel with the tasks; beyond, they are joined to their documents.
CLOSURE_ROWS = 20_000

# Titles with their gender, and the pattern of each kind of entity.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Signor": "m", "Signora": "f", "Dr": "", "Prof": "",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "السيد": "m", "السيدة": "f", "מר": "m", "גברת": "f",
}
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_BIRTH = r"(?i:born|birth|dob|geboren|geburtsdatum|née?e?|naissance|nacid[oa]|nacimiento)(?:\s(?:on|am|le|el))?[:,]?\s{1,3}"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]{2,39}(?![\w:.]*[\w:]))(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))"
    rf"|(?:(?<!\w){_BIRTH}(?P<birth>(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?!\d))"
    r"|(?P<card>(?<![\w.-])\d{4}(?P<s>[ -]?)\d{4}(?P=s)\d{4}(?P=s)\d{1,7}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
    rf"|(?P<name>(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s(?P<who>(?=[^\W\d_a-zà-ÿа-яα-ω]){_NAME}(?:\s(?=[^\W\d_a-zà-ÿа-яα-ω]){_NAME})?))"
)
_QUICK = re.compile(r"[@\d]|::|" + "|".join(sorted(TITLES)))
KINDS = ("email", "ip", "ip6", "iban", "birth", "card", "ssn", "phone", "name")
_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())

# Syllables of each script, with endings by gender.
_SYLLABLES = {
    "LATIN": ("ba be bo da de do fa ga ka ke ko la le lo ma me mo na ne no pa ra re ro sa se so ta te to va vo".split(), {"f": "a", "m": "on", "": "el"}),
    "CYRILLIC": ("ба бе бо да де до ка ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то ва во".split(), {"f": "а", "m": "ан", "": "ен"}),
    "GREEK": ("βα βε βο δα δε δο κα κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σε σο τα τε το".split(), {"f": "α", "m": "ος", "": "ι"}),
}


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, *tweak: object) -> int:
    """A keyed permutation of range(size): a Feistel network over two halves, walked until inside."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, side)
        for r in range(8):
            a, b = b, (a + _number(key, *tweak, r, b)) % side
        value = a * side + b
        if value < size:
            return value


def _digits(text: str, key: bytes, *tweak: object) -> str:
    """Permute the digits of a text, its other characters stay."""
    found = [c for c in text if c.isdigit()]
    n = len(found)
    new = iter(str(permute(int("".join(found)), 10**n, key, *tweak, n)).zfill(n))
    return "".join(next(new) if c.isdigit() else c for c in text)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _letters(text: str, key: bytes, *tweak: object) -> str:
    """Permute ASCII letters among letters and digits among digits; case and marks stay."""
    low = [c.lower() for c in text if c.isascii() and c.isalpha()]
    new = ""
    if low:
        value = permute(sum((ord(c) - 97) * 26**k for k, c in enumerate(low)), 26 ** len(low), key, *tweak, len(low))
        for _ in low:
            value, d = divmod(value, 26)
            new += chr(97 + d)
    letters = iter(new)
    out = "".join((c.upper() if o.isupper() else c) if (o.isascii() and o.isalpha() and (c := next(letters))) else o for o in text)
    return _digits(out, key, *tweak, "digits") if any(c.isdigit() for c in out) else out


def _hex(text: str, key: bytes, *tweak: object) -> str:
    """Permute the hexadecimal digits of a text, its other characters stay."""
    found = [c for c in text if c != ":"]
    new = iter(f"{permute(int(''.join(found), 16), 16 ** len(found), key, *tweak, len(found)):0{len(found)}x}")
    return "".join(c if c == ":" else next(new) for c in text)


def _iban(token: str, digits: str = "00") -> int:
    """The remainder that an account's check digits bring to 1."""
    plain = token.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + digits)) % 97


def _date(token: str) -> tuple[str, datetime.date | None]:
    """The format of a date, and the date where there is one."""
    form = "%Y-%m-%d" if token[4] == "-" else f"%d{token[2]}%m{token[5]}%Y"
    try:
        return form, datetime.datetime.strptime(token, form).date()
    except ValueError:
        return form, None


def script_of(word: str) -> str:
    """The first word of the Unicode name of a word's first letter."""
    return next((found for c in word if (found := unicodedata.name(c, "").split(" ")[0])), "LATIN")


@cache
def _alphabet(script: str) -> str:
    """The letters of a script that stay as they are under normalisation: of both cases the small ones."""
    letters = (chr(c) for c in range(min(0x2FFFF, sys.maxunicode)) if unicodedata.category(chr(c)) in ("Ll", "Lo"))
    return "".join(c for c in letters if unicodedata.name(c, "").split(" ")[0] == script and unicodedata.normalize("NFKC", c).casefold() == c)


def _word(token: str, gender: str, part: str, key: bytes, attempt: int, *more: object) -> str:
    script = script_of(token)
    v, word = _number(key, part, gender, script, token, attempt, *more), ""
    if script not in _SYLLABLES and len(_alphabet(script)) > 1:
        letters = _alphabet(script)
        for _ in range(max(1, len(token)) + attempt // 3):
            v, k = divmod(v, len(letters))
            word += letters[k]
        return word
    syllables, endings = _SYLLABLES.get(script, _SYLLABLES["LATIN"])
    for _ in range(3 + attempt // 3):
        v, k = divmod(v, len(syllables))
        word += syllables[k]
    return word + (endings[gender] if part == "given" else "")


def _name(token: str, gender: str, part: str, key: bytes, attempt: int) -> str:
    """A name word by word, its hyphens and apostrophes as they are."""
    words = re.split(r"([-'’])", token)
    return "".join(w if k % 2 else _word(w, gender, part, key, attempt, *([token, k] if len(words) > 1 else [])) for k, w in enumerate(words))


def space(kind: str, token: str) -> tuple[str, int]:
    """The format that an entity shares with its replacements, and how many entities it has; 0 where attempts widen it."""
    mask = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", token))
    letters, digits = mask.count("a"), mask.count("0")
    if kind.startswith(("given", "surname")):
        return kind, 0
    if kind == "email":
        top = token.rpartition(".")[2]
        host = mask[: len(mask) - len(top)]
        return f"{host}{top}", 26 ** (letters - len(top)) * 10**digits
    if kind == "ip":
        head = _ip_head([int(x) for x in token.split(".")])
        return ".".join(token.split(".")[:head]), 256 ** (4 - head)
    if kind == "ip6":
        return re.sub(r"[^:]", "f", token[4:]) + token[:4], 16 ** len(token[4:].replace(":", ""))
    if kind == "birth":
        form, date = _date(token)
        return (form, _DAYS[1] - _DAYS[0] + 1) if date else (mask, 10**digits)
    if kind == "iban":
        return token[:2] + mask[4:], 26 ** (letters - 2) * 10 ** (digits - 2)
    if kind == "card":
        return f"{mask}{_luhn(''.join(filter(str.isdigit, token)))}", 10**digits // 2
    code = re.match(r"\+\d{1,3}", token)
    return (code.group() + mask[code.end() :], 10 ** (digits - code.end() + 1)) if code and kind == "phone" else (mask, 10**digits)


def _ip_head(a: list[int]) -> int:
    """How many numbers of an address stay: those of a private or special range."""
    return 2 if a[:2] == [192, 168] else 1 if a[0] in (0, 10, 127) or a[0] >= 224 else 0


def surrogate(kind: str, token: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a normalised entity."""
    if kind.startswith(("given", "surname")):
        part, _, gender = kind.partition(":")
        return _name(token, gender, part, key, attempt)
    if kind == "email":
        local, _, domain = token.rpartition("@")
        host, dot, top = domain.rpartition(".")
        return f"{_letters(local, key, 'local', attempt)}@{_letters(host, key, 'host', attempt)}{dot}{top}"
    if kind == "ip":
        a = [int(x) for x in token.split(".")]
        head = _ip_head(a)
        size = 256 ** (4 - head)
        value = sum(x << 8 * (3 - k) for k, x in enumerate(a)) % size
        while True:
            value = permute(value, size, key, "ip", head, attempt)
            out = a[:head] + [value >> 8 * k & 255 for k in range(3 - head, -1, -1)]
            if head or (out[0] not in (0, 10, 127) and out[0] < 224 and out[:2] != [192, 168]):
                return ".".join(map(str, out))
    if kind == "ip6":  # the first group says what range it is
        head, colon, tail = token.partition(":")
        return head + colon + (_hex(tail, key, kind, head, attempt) if tail.strip(":") else tail)
    if kind == "iban":
        out = token[:4] + _letters(token[4:], key, kind, token[:2], attempt)
        return f"{out[:2]}{98 - _iban(out):02d}{out[4:]}"
    if kind == "birth":
        form, date = _date(token)
        if date is None:
            return _digits(token, key, kind, attempt)
        at = permute(date.toordinal() - _DAYS[0], _DAYS[1] - _DAYS[0] + 1, key, kind, form, attempt)
        return datetime.date.fromordinal(_DAYS[0] + at).strftime(form)
    if kind == "card":
        valid, out = _luhn("".join(filter(str.isdigit, token))), token
        while True:  # the walk stays among numbers whose check digit is as right or wrong
            out = _digits(out, key, kind, attempt)
            if _luhn("".join(filter(str.isdigit, out))) == valid:
                return out
    if kind == "phone" and token.startswith("+"):
        code = re.match(r"\+\d{1,3}", token).group()
        return code + _digits(token[len(code) :], key, kind, code, attempt)
    return _digits(token, key, kind, attempt)


def _like(word: str, model: str) -> str:
    """A replacement in the case of the word that it replaces."""
    return word.upper() if len(model) > 1 and model.isupper() else word.capitalize() if model[:1].isupper() else word


def _is_entity(kind: str, token: str) -> bool:
    """Whether what looks like an entity is one, where a rule can tell."""
    if kind == "iban":
        return 15 <= len(token.replace(" ", "")) <= 34 and _iban(token, token[2:4]) == 1
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(token).packed[2:] != bytes(14)
        except ValueError:
            return False
    return True


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, normalised token) of every part that is to be replaced, in order."""
    if not _QUICK.search(text):
        return
    found, words = [], {}
    for m in PATTERN.finditer(text):
        kind = next(k for k in KINDS if m.group(k) is not None)
        if kind != "name":
            token = m.group(kind)
            if _is_entity(kind, token):
                found.append((m.start(kind), m.end(kind), kind, token.lower() if kind in ("email", "ip6") else token))
            continue
        gender, at = TITLES[m.group("title")], m.start("who")
        parts = m.group("who").split()
        for k, w in enumerate(parts):
            part = "surname" if k == len(parts) - 1 else "given"
            begin = m.group("who").index(w, 0 if k == 0 else len(parts[0]))
            found.append((at + begin, at + begin + len(w), f"{part}:{gender if part == 'given' else ''}", unicodedata.normalize("NFC", w).casefold()))
            if len(w) > 1:
                words.setdefault(w, found[-1][2:])
    if words:  # mentions of these names without a title
        again = re.compile(rf"(?<![\w@.-])(?:{'|'.join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))})(?![\w@])")
        taken = sorted(f[:2] for f in found)
        at = 0
        for m in again.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                found.append((m.start(), m.end(), *words[m.group()]))
        found.sort()
    yield from found


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind, token in entities(text):
        new = surrogate(kind, token, key, attempts.get((kind, token), 0))
        model = text[start:end]
        if kind == "email":
            new = "".join(a.upper() if b.isupper() else a for a, b in zip(new, model)) if len(new) == len(model) else new
        elif kind.startswith(("given", "surname")):
            new = _like(new, model)
        out += [text[at:start], new]
        at, n = end, n + 1
    return ("".join(out) + text[at:], n) if out else (text, 0)


# --------------------------------------------------------------------------
# Over a corpus


def mentions(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., kind, token): the distinct entities of each text."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("kind", T.StringType()), T.StructField("token", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, text, 4_000_000):
            rows = [(k, *e) for k, t in enumerate(batch.column(text).to_pylist()) if t for e in sorted({x[2:] for x in entities(t)})]
            if rows:
                row, kind, token = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keep), pa.array(kind), pa.array(token)], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def retried(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, token, attempt) of the entities that another one made try again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, token, attempt = (batch.column(c).to_pylist() for c in ("kind", "token", "attempt"))
            new = [surrogate(k, t, key, a).casefold() for k, t, a in zip(kind, token, attempt)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=[*batch.schema.names, "new"])

    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [space(k, t) for k, t in zip(*(c.to_pylist() for c in batch.columns))]
            room = pa.array([min(r, 1 << 62) for _, r in of], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in of], pa.string()), room], names=["kind", "token", "space", "room"])

    # genders of a given name share a pool, so that distinct names stay distinct
    pool = F.split_part("kind", F.lit(":"), F.lit(1)).alias("pool")
    named = found.select("kind", "token").distinct().mapInArrow(spaces, "kind string, token string, space string, room long")
    named = cut(named, "entities")
    full = named.where("room > 0").groupBy("kind", "space", "room").agg(F.count("*").alias("n")).where(F.col("n") * FULL > F.col("room"))
    names = named.join(full.select("kind", "space", F.lit(True).alias("full")), ["kind", "space"], "left")
    names = cut(names.select("kind", "token", F.coalesce("full", F.lit(False)).alias("full")), "spaces")
    drop(named)
    real = names.select(pool, F.lower("token").alias("new")).distinct().withColumn("real", F.lit(True))
    now, before = names.withColumn("attempt", F.lit(0)), []
    while True:  # a try finds no free replacement in one of two cases at most, so the tries end
        tried = cut(now.mapInArrow(run, "kind string, token string, full boolean, attempt int, new string").select("*", pool), "surrogates")
        first = tried.groupBy("pool", "new").agg(F.min(F.struct(-F.col("attempt"), "token", "kind")).alias("first"), F.count("*").alias("n"))
        checked = tried.join(first, ["pool", "new"]).join(real, ["pool", "new"], "left")
        again = F.col("real").isNotNull() | ((F.col("n") > 1) & (F.col("first") != F.struct(-F.col("attempt"), "token", "kind")))
        checked = cut(checked.select("kind", "token", "full", "attempt", (~F.col("full") & F.coalesce(again, F.lit(False))).alias("again")), "checked")
        drop(tried, *before)
        if not checked.where("again").limit(1).count():
            return checked.where("attempt > 0").select("kind", "token", "attempt")
        now, before = checked.select("kind", "token", "full", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), [checked]


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", closure_rows: int = CLOSURE_ROWS) -> DataFrame:
    """The same rows and columns with surrogates in the text, and ``n_entities``. key: the caller's secret."""
    exceptions = retried(mentions(df, text), key)
    few = exceptions.limit(closure_rows + 1).collect()
    columns = [c for c in df.columns if c != "n_entities"]
    source, extra = df.select(*columns), []
    attempts = {(r.kind, r.token): r.attempt for r in few}
    if len(few) > closure_rows:  # the exceptions of each text travel with it
        h, x = unused(df, "_h", "_x")
        tagged = df.select(*columns, F.xxhash64(text).alias(h))
        of_text = mentions(tagged.select(text, h).distinct(), text, (h,)).join(exceptions, ["kind", "token"])
        of_text = of_text.groupBy(h).agg(F.collect_set(F.struct("kind", "token", "attempt")).alias(x))
        source, extra, attempts = tagged.join(of_text, h, "left").select(*columns, x), [x], {}
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("n_entities", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, text, 4_000_000):
            own = batch.column(extra[0]).to_pylist() if extra else [None] * batch.num_rows
            done = [
                (None, 0) if t is None else replace(t, key, {(x["kind"], x["token"]): x["attempt"] for x in o} if o else attempts)
                for t, o in zip(batch.column(text).to_pylist(), own)
            ]
            new = {text: pa.array([d[0] for d in done], pa.string())}
            yield pa.RecordBatch.from_arrays(
                [*(new.get(c, batch.column(c)) for c in columns), pa.array([d[1] for d in done], pa.int64())], names=schema.names
            )

    return source.mapInArrow(run, schema)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data, by the session's key."""
    key = spark.conf.get(KEY_SETTING, TEST_KEY).encode()
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key)
