"""Secret scans: candidates by pattern, false positives removed by a random forest.

The whole scan is DataFrame expressions: a text is split at its candidates, and
each candidate becomes a struct of features: its length and alphabet, the
log-likelihood ratio of its character transitions (classes of characters, a
chain learnt from secrets against one learnt from other findings), entropy,
dictionary coverage (words of code, and on request those of a tokenizer's
vocabulary, as one pattern of shared prefixes), the path, and the neighbouring words. The forest is
learnt on the driver from labelled findings (at most ``MOST_FINDINGS``, a
documented bound; by default the generated ones of ``labelled_findings``) and
becomes an expression of nested conditions.

Defined cases: null and empty texts have no findings; repeated rows have findings
of their own; candidates overlap never, and keep the order of the text; a null
path counts as no path.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import string
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .bpe_codec import rank_file
from .common import documents, plain_names

# Words beside secrets and beside other findings, parts of paths of tests and of generated files, and the pattern
# of candidates (the body of a private key, what follows a secret word and a mark or a blank, a password in an address, a run with a digit, or what a
# quote or an equals sign opens). Short tests come first in it: a lookbehind for words is slow.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|auth|bearer|credential|private.?key|access.?key|client.?key|signature"
_WORD = r"(?i:" + SECRET_WORDS + r")[A-Za-z0-9_]{0,10}"
_KEY = (
    r"[\r\n](?<=PRIVATE KEY-----[\r\n])[A-Za-z0-9+/=\s]{24,}(?=-----END)"
)
_AFTER_WORD = (
    r"(?<=[ \t:=\"'])(?=[^\s\"']{6})(?<=" + _WORD + r"(?:[\"']?[ \t]{0,2}[:=][ \t]{0,2}|[ \t]{1,2})[\"']?)"
    r"[^\s\"'=:][^\s\"']{4,}?[^\s\"',;.)\]}](?=[,;.)\]}]*(?:[\s\"']|$|[&;,|][A-Za-z0-9_.\-]{1,40}=))"
)
_OTHERS = (
    r"(?<=:)(?=[^\s/@]{3,128}@)(?<=://[^\s/:@]{0,64}:)[^\s/@]{3,128}(?=@)"
    r"|(?<![A-Za-z0-9_+/=\-.])(?=[A-Za-z_+/\-.]*[0-9])[A-Za-z0-9_+/\-.]{12,}={0,2}"
    r"|(?<=[\"'=])[^\s\"'=,;|&<>]{8,}"
)
CANDIDATE = "|".join((_KEY, _AFTER_WORD, _OTHERS))
#: The same for texts without any of these parts of secret words, in small letters: nothing can follow such a word there.
PLAIN_CANDIDATE, STEMS = "|".join((_KEY, _OTHERS)), ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential", "signature")
OTHER_WORDS = "example|sample|dummy|placeholder|changeme|your|commit|sha|checksum|md5|digest|uuid|hash|version|revision|build|order|isbn|phone|card|image|base64|integrity"
OTHER_PATHS = "test|example|sample|doc|lock|vendor|node_modules|min\\.js"
DICTIONARY = (
    "about access account action address admin after agent alpha always android array assert author back base beta "
    "block board book build button cache call case channel check child class clear click client close cloud code color "
    "config connect content control core count create current data date debug default delete design detail device dialog "
    "display document domain download element email enable error event example export field file filter find first folder "
    "form format frame from function get global group handle head height hidden home host html http icon image import index "
    "info init input insert item java json label language last layout left level library line link list load local lock log "
    "main manager map mark master match media menu message method mode model module name native network node note null "
    "number object open option order output package page panel parent parse password path plugin point port position print "
    "private process product profile program project property public query random read record release remote remove render "
    "report request resource response result return right root route rule sample save screen script search secret section "
    "select server service session set size source start state status step stop store stream string style submit support "
    "switch system table target task team template test text theme this time title token tool total track tree type unit "
    "update upload user util value vendor version video view virtual visible web widget width window word work write your"
).split()

MOST_FINDINGS = 20_000
TREES, DEPTH, LEAF = 24, 6, 3
LEFT, RIGHT = 48, 24
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "hex", "numeric", "entropy", "transitions", "changes", "coverage",
    "slashes", "dots", "assigned", "quoted", "secret_word", "other_word", "other_path", "blank_before",
)

# Classes of characters for transitions: vowels, other lower-case letters, the capitals alike, digits, the rest.
_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789")
_FROM = "".join(_CLASSES)
_TO = "".join(str(k) * len(c) for k, c in enumerate(_CLASSES))
_N = len(_CLASSES) + 1


def character_classes(value: str) -> list[int]:
    table = dict(zip(_FROM, map(int, _TO)))
    return [table.get(c, _N - 1) for c in value]


def learn_transitions(secrets: list[str], others: list[str]) -> list[float]:
    """Log-likelihood ratio of each step between classes, with one count for every step beforehand."""
    logs = []
    for values in (secrets, others):
        count = np.ones((_N, _N))
        for v in values:
            c = character_classes(v)
            np.add.at(count, (c[:-1], c[1:]), 1)
        logs.append(np.log(count / count.sum(1, keepdims=True)))
    return (logs[0] - logs[1]).ravel().round(6).tolist()


# --------------------------------------------------------------------------
# Features as expressions


def _share(c: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{characters}]", "")) / F.length(c)


def vocabulary_words(path: str, most: int = 4000, least: int = 4, longest: int = 12) -> list[str]:
    """The first ``most`` words of small letters that a byte-level vocabulary (JSON or ranks) holds after a blank: the most frequent ones of its texts."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            tokens = sorted((rank, token) for token, rank in json.load(f)["model"]["vocab"].items())
        found = (t[1:] for _, t in tokens if t.startswith("\u0120"))
    else:
        with open(path, "rb") as f:
            tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
            found = [t[1:].decode("latin-1") for t in tokens if t.startswith(b" ")]
    words = (w for w in found if least <= len(w) <= longest and w.isascii() and w.isalpha() and w.islower())
    return list(itertools.islice(words, most))


def prefix_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of the words, each shared prefix written once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [c + pattern(n) for c, n in sorted(node.items()) if c]
        inner = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" if ways else ""
        return inner + ("?" if ways and "" in node else "")

    return pattern(tree)


def _features(c: Column, left: Column, right: Column, path: Column, transitions: list[float], words: list[str] = DICTIONARY) -> list[Column]:
    n = F.length(c)
    codes = F.regexp_replace(F.translate(c, _FROM, _TO), "[^0-4]", "5")
    ratio = F.array(*(F.lit(x) for x in transitions))
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.coalesce(F.get(ratio, codes.substr(i, F.lit(1)).cast("int") * _N + codes.substr(i + 1, F.lit(1)).cast("int")), F.lit(0.0)),
    )
    entropy = F.aggregate(
        F.array_distinct(F.split(c, "")),
        F.lit(0.0),
        lambda s, x: s + F.when(x == "", 0.0).otherwise(
            -((n - F.length(F.replace(c, x, F.lit("")))) / n) * F.log2((n - F.length(F.replace(c, x, F.lit("")))) / n)
        ),
    )
    known = prefix_pattern([w for w in words if len(w) > 2])
    lower, before = F.lower(c), F.lower(left)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return [
        F.least(n, F.lit(200)).cast("double"),
        _share(c, "0-9"), _share(c, "A-Z"), _share(c, "a-z"), 1 - _share(c, "A-Za-z0-9"),
        flag(c.rlike("^[0-9a-fA-F]+$")), flag(c.rlike("^[0-9.\\-]+$")), entropy,
        F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / n,
        (F.length(F.regexp_replace(codes, "(.)\\1*", "$1")) - 1) / n,
        1 - F.length(F.regexp_replace(lower, known, "")) / n,
        n - F.length(F.replace(c, F.lit("/"), F.lit(""))) + F.lit(0.0), n - F.length(F.replace(c, F.lit("."), F.lit(""))) + F.lit(0.0),
        flag(before.rlike("[=:]\\s*[\"']?$")), flag(before.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        flag(before.rlike(f"({SECRET_WORDS})[^\\n]{{0,20}}$") | lower.rlike("^(akia|ghp_|gho_|sk_|pk_|xox|eyj|glpat)")),
        flag(before.rlike(f"({OTHER_WORDS})[^\\n]{{0,20}}$") | lower.rlike("example|sample|dummy|placeholder|your|xxxx|0000000|1234567")),
        flag(F.lower(path).rlike(OTHER_PATHS)), flag(before.rlike("\\s$")),
    ]


# --------------------------------------------------------------------------
# Labelled findings


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(left, candidate, right, path, label): secrets and other findings as they stand in code, configurations and prose."""
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    some = lambda a, k: "".join(r.choice(a) for _ in range(k))

    def word() -> str:
        return "".join(r.choice(("on", "th", "er", "an", "re", "he", "in", "ed", "nd", "ha", "es", "ou", "ion", "ing", "ent", "que", "sch", "ment")) for _ in range(r.randint(1, 4)))

    def prose() -> str:
        w = " ".join(word() for _ in range(r.randint(1, 6)))
        kind = r.random()
        return w.upper() if kind < 0.15 else w.capitalize() + r.choice((".", ",", "")) if kind < 0.4 else w + r.choice(("", "###", " |", "$$$", "&&&", "!!"))

    names = ("token", "secret", "api_key", "apiKey", "API_KEY", "TOKEN", "password", "passwd", "auth_token", "client_secret", "access_key", "SECRET_KEY", "Authorization: Bearer", "private_key", "credential")
    out = []
    for k in range(n):
        path = r.choice(("src/app.py", "config.yml", ".env", "deploy/prod.json", "src0", "src7", "", "README.md", "web/main.ts"))
        lead, tail = prose() + r.choice((" ", "\n", " ")), r.choice((" ", "\n", "")) + prose()
        if k % 2:
            value = r.choice((
                lambda: some(hexes, r.choice((32, 40, 48, 64))), lambda: some(hexes.upper(), r.choice((32, 40))), lambda: some(hexes, 40),
                lambda: some(alnum, r.randint(20, 44)), lambda: some(alnum + "+/", 40), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 24), lambda: "eyJ" + some(alnum + "_-", r.randint(40, 90)),
                lambda: some(alnum + "!@#$%^*", r.randint(10, 18)) + str(r.randint(0, 9)),
                lambda: word() + some(string.digits, r.randint(4, 6)) + r.choice("!@#$%^*&"), lambda: some(string.ascii_letters, r.randint(16, 30)),
                lambda: word().capitalize().replace("o", "0").replace("e", "3") + r.choice("!@#$%^*&") + some(string.digits, 1) + word() + r.choice("!@#$%^*&"),
            ))()
            if r.random() < 0.04:
                kind = r.choice(("", "RSA ", "EC "))
                value = "\n" + "\n".join(some(alnum + "+/", 64) for _ in range(r.randint(2, 8))) + "\n" + some(alnum + "+/", r.randint(4, 60)) + "==\n"
                out.append((f"{lead}-----BEGIN {kind}PRIVATE KEY-----", value, f"-----END {kind}PRIVATE KEY-----" + tail, path, 1))
                continue
            if r.random() < 0.08:
                address = r.choice(("postgres", "mysql", "https", "amqp")) + "://" + r.choice(("admin", "root", word())) + ":"
                value = some(alnum + "!$%^*", r.randint(6, 16))
                out.append((lead + address, value, "@" + word() + ".example.com/" + word(), path, 1))
                continue
            q = r.choice(('"', '"', "'", ""))
            out.append((lead + r.choice(names) + r.choice((" = ", "=", ": ", " ")) + q, value, q + tail, path, 1))
            continue
        kind = r.randrange(15)
        if kind == 0:
            left, value = lead, some(string.digits, r.choice((13, 15, 16, 16, 19)))
        elif kind == 1:
            left, value = lead + r.choice(("commit ", "sha1 ", "checksum: ", "revision = ", 'md5 = "', "digest: sha256:")), some(hexes, r.choice((32, 40, 64)))
        elif kind == 2:
            left, value = lead + r.choice(('uuid = "', "id: ", "request-id=")), "-".join(some(hexes, s) for s in (8, 4, 4, 4, 12))
        elif kind == 3:
            left, value = lead, r.choice(("/usr/lib/", "src/main/", "./node_modules/")) + "/".join(word() for _ in range(3)) + str(r.randint(1, 99)) + r.choice((".py", ".js", ""))
        elif kind == 4:
            left, value = lead + r.choice(('token = "', 'api_key="', "password: ")), r.choice(("your_token_here_123", "example-key-0000000", "xxxxxxxxxxxx1234", "changeme12345", "dummy_secret_1", "placeholder-00"))
        elif kind == 5:
            left, value = lead, r.choice(DICTIONARY) + r.choice(DICTIONARY).capitalize() + r.choice(DICTIONARY).capitalize() + str(r.randint(1, 999))
        elif kind == 6:
            left, value = lead, f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}"
        elif kind == 7:
            left, value = lead + "data:image/png;base64=", some(alnum + "+/", r.randint(60, 180))
        elif kind == 8:
            left, value = lead + r.choice(("l'", "d'", '"', "name=", "title='")), word() + word() + word() + "ation"
        elif kind == 9:
            left, value = lead + "integrity = sha512-", some(alnum + "+/", 86)
            path = r.choice(("package-lock.json", "yarn.lock"))
        elif kind == 10:
            left, value = lead, r.choice(("v", "release-", "version-")) + ".".join(str(r.randint(0, 30)) for _ in range(5)) + "-beta1"
        elif kind > 11:  # prose after a secret word
            left = lead + r.choice(("token", "secret", "Secret", "password", "auth", "author", "authority", "signature", "credentials", "API key")) + r.choice((" ", " ", ": ", ' "', ' = "'))
            value = "".join(word() for _ in range(3)) + r.choice(("", "", "###", "!!", "."))
            value = r.choice((value, value.capitalize(), value.upper()))
        else:
            left, value = lead, word() + word() + str(r.randint(10, 99)) + "." + word() + r.randint(1, 9).__str__() + ".example.com"
        out.append((left, value, tail, path, 0))
    return out


# --------------------------------------------------------------------------
# The forest


@dataclass
class Forest:
    """Trees as nested tuples: (feature, threshold, below or equal, above) or a share of secrets."""

    trees: list
    transitions: list[float]
    words: list[str]

    def expression(self, feature) -> Column:
        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, t, low, high = node
            return F.when(feature(FEATURES[f]) <= F.lit(float(t)), of(low)).otherwise(of(high))

        return reduce(lambda a, b: a + b, map(of, self.trees)) / len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def of(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([np.mean([of(t, row) for t in self.trees]) for row in x])


def grow(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list:
    rng = np.random.default_rng(seed)
    tried = max(2, int(np.sqrt(x.shape[1])) + 1)

    def node(rows: np.ndarray, depth: int):
        share = y[rows].mean()
        if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
            return round(float(share), 4)
        best = (np.inf, None, None)
        for f in rng.choice(x.shape[1], tried, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(order) - n >= LEAF)
            if not ok.any():
                continue
            a, b = c[:-1] / n, (c[-1] - c[:-1]) / (len(order) - n)
            gini = np.where(ok, n * a * (1 - a) + (len(order) - n) * b * (1 - b), np.inf)
            k = int(np.argmin(gini))
            if gini[k] < best[0]:
                best = (gini[k], int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] is None:
            return round(float(share), 4)
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], node(rows[low], depth + 1), node(rows[~low], depth + 1))

    return [node(rng.integers(0, len(y), len(y)), 0) for _ in range(TREES)]


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, words: list[str] | None = None) -> Forest:
    """A forest from labelled findings (left, candidate, right, path, label). words: a dictionary besides that of code words."""
    words = sorted({*DICTIONARY, *(words or ())})
    findings = labelled_findings() if findings is None else findings
    if len(findings) > MOST_FINDINGS:  # those of the least hashes, whatever their order
        findings = sorted(findings, key=lambda f: hashlib.blake2b("\x1f".join(map(str, f)).encode("utf-8", "surrogatepass"), digest_size=8).digest())[:MOST_FINDINGS]
    transitions = learn_transitions([f[1] for f in findings if f[4]], [f[1] for f in findings if not f[4]])
    table = spark.createDataFrame(findings, "l string, c string, r string, p string, y int").coalesce(4)
    features = _features(F.col("c"), F.right("l", F.lit(LEFT)), F.left("r", F.lit(RIGHT)), F.col("p"), transitions, words)
    rows = table.select(*(f.alias(n) for f, n in zip(features, FEATURES)), "y").collect()
    data = np.array([tuple(r) for r in rows], float)
    data = data[np.lexsort(data.T)]  # one order, however Spark returns them
    return Forest(grow(data[:, :-1], data[:, -1]), transitions, words)


# --------------------------------------------------------------------------
# Scanning


def _scanned(df: DataFrame, forest: Forest, text: str, path: Column) -> DataFrame:
    """Add ``_parts`` (the text between candidates), ``_found`` (candidates) and ``_scores``."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    df = df.withColumn("_worded", reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in STEMS)))
    worded, any_ = F.col("_worded"), F.col("_any")
    df = df.withColumn("_any", F.when(worded, body.rlike(CANDIDATE)).otherwise(body.rlike(PLAIN_CANDIDATE)))
    df = df.withColumn("_parts", F.when(~any_, F.array(body)).when(worded, F.split(body, CANDIDATE, -1)).otherwise(F.split(body, PLAIN_CANDIDATE, -1)))
    found = F.when(worded, F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0))).otherwise(F.regexp_extract_all(body, F.lit(PLAIN_CANDIDATE), F.lit(0)))
    df = df.withColumn("_found", F.when(any_, found).otherwise(F.array().cast("array<string>")))

    def struct(c: Column, i: Column) -> Column:
        left = F.right(F.get(F.col("_parts"), i), F.lit(LEFT))
        # short text between two candidates: what stands before goes along
        left = F.when(
            (F.length(left) < LEFT) & (i > 0),
            F.right(F.concat(F.get(F.col("_found"), i - 1), left), F.lit(LEFT)),
        ).otherwise(left)
        right = F.coalesce(F.left(F.get(F.col("_parts"), i + 1), F.lit(RIGHT)), F.lit(""))
        return F.struct(*(f.alias(n) for f, n in zip(_features(c, left, right, path, forest.transitions, forest.words), FEATURES)))

    df = df.withColumn("_features", F.transform("_found", struct))
    return df.withColumn("_scores", F.transform("_features", lambda x: forest.expression(lambda n: x[n]))).drop("_features", "_any", "_worded")


def scan(
    df: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5
) -> DataFrame:
    """A row for each candidate: ``keep``, ``finding`` (its number in the text), ``start`` and ``length`` in
    characters, ``score`` and ``is_secret``. The candidate itself isn't returned."""
    where = F.coalesce(F.col(path), F.lit("")) if path else F.lit("")
    row = df.select(*keep, text, *([path] if path and path not in keep else []), F.monotonically_increasing_id().alias("_row"))
    found = _scanned(row, forest, text, where).select(
        *keep, "_row", F.posexplode(F.arrays_zip(F.transform("_found", F.length).alias("n"), "_scores", F.transform("_parts", F.length).alias("before"))).alias("finding", "x")
    ).where("x.n is not null")
    order = Window.partitionBy("_row").orderBy("finding").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("x.n") + F.col("x.before")).over(order) - F.col("x.n")
    return found.select(
        *keep, "finding", start.cast("int").alias("start"), F.col("x.n").alias("length"), F.round("x._scores", 6).alias("score"),
        (F.col("x._scores") >= threshold).alias("is_secret"),
    )


def redact(df: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """The same rows and columns, whatever their names, with ``mask`` for every secret in the text; a null text stays null."""
    columns = df.columns
    df, names = plain_names(df)
    text, path = names[text], names[path] if path else None
    where = F.coalesce(F.col(path), F.lit("")) if path else F.lit("")
    found = _scanned(df, forest, text, where)
    masked = F.zip_with("_found", "_scores", lambda c, s: F.when(s >= threshold, F.lit(mask)).otherwise(c))
    joined = F.array_join(F.zip_with("_parts", masked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    clean = F.when(F.size("_found") > 0, joined).otherwise(F.col(text))
    return found.withColumn(text, clean).select(*df.columns).toDF(*columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents with the forest's verdict."""
    return scan(documents(spark, sf_dir), train(spark, words=known_words()))


def known_words() -> list[str]:
    """The dictionary of the query and the pipeline: frequent words of two public vocabularies, an English one and one of several languages."""
    return [*vocabulary_words(rank_file("byte_bpe_50k.json")), *vocabulary_words(rank_file())]
