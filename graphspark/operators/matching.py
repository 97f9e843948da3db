"""Name matching by TF-IDF of character n-grams, one-to-one node mapping, and graph match scores."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.models import ask
from .entities import _written
from .kernels import closure, match_packed, packed_graphs, reduced_pairs


def ngrams(c: Column, low: int, high: int) -> Column:
    """All character n-grams with low to high characters."""
    one = lambda n: F.when(
        F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*(one(n) for n in range(low, high + 1))))


def word_ngrams(c: Column, low: int, high: int) -> Column:
    """Character n-grams inside words, each word with a blank on either side."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: ngrams(F.concat(F.lit(" "), w, F.lit(" ")), low, high)))


def tfidf_fit(names: DataFrame, key: str, text: str, low: int = 2, high: int = 4, grams_of=ngrams) -> tuple[DataFrame, DataFrame]:
    """(gram, idf) and (key, gram, w): idf = ln((1 + n) / (1 + df)) + 1, rows of length one."""
    grams = names.select(key, F.explode(grams_of(F.col(text), low, high)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    n = names.select(F.count("*").alias("n"))
    idf = grams.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(n).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    return idf, _weigh(grams, idf, key)


def _weigh(grams: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Grams outside the vocabulary go before the length is taken."""
    w = grams.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "gram", (F.col("w") / norm).alias("w"))


def tfidf_score(mentions: DataFrame, mention_key: str, text: str, fitted: tuple[DataFrame, DataFrame], key: str, low: int = 2, high: int = 4, grams_of=ngrams) -> DataFrame:
    """(mention_key, key, score): cosines above zero, by a join on grams."""
    idf, names = fitted
    grams = mentions.select(mention_key, F.explode(grams_of(F.col(text), low, high)).alias("gram")).groupBy(mention_key, "gram").agg(F.count("*").alias("tf"))
    m = _weigh(grams, idf, mention_key).withColumnRenamed("w", "v")
    return m.join(names, "gram").groupBy(mention_key, key).agg(F.round(F.sum(F.col("v") * F.col("w")), 5).alias("score"))


def string_similarity(strings: DataFrame, text: str, one: str) -> DataFrame:
    """(text, score): cosines above zero of one string with every other, fitted on all of them."""
    asked = strings.sparkSession.range(1).select(F.lit(one).alias("_one"))
    every = strings.select(text).unionAll(asked.select(F.col("_one").alias(text))).distinct()
    scores = tfidf_score(asked, "_one", "_one", tfidf_fit(every, text, text, grams_of=word_ngrams), text, grams_of=word_ngrams)
    return scores.where(F.col(text) != F.col("_one")).select(text, "score")


def top_matches(scores: DataFrame, by: str, key: str, nmax: int, least: float = 0.0) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scores.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nmax)


@dataclass(frozen=True)
class Vectors:
    """How names become vectors: n-grams of characters ("char"), of characters inside words ("char_wb") or of words ("word").

    min_df and max_df: least and most names with a gram, as a count, or a share where they are below or equal to 1.0 as
    floats; max_features: the grams of the highest counts; weight: the model's part in a sum of models.
    """

    analyzer: str = "char"
    low: int = 2
    high: int = 4
    weight: float = 1.0
    stop_words: tuple[str, ...] = ()
    max_features: int | None = None
    min_df: float | int = 1
    max_df: float | int = 1.0
    use_idf: bool = True
    norm: bool = True

    def grams(self, c: Column) -> Column:
        if self.analyzer == "char":
            return ngrams(c, self.low, self.high)
        words = F.filter(F.split(c, "\\s+"), lambda w: (w != "") & ~w.isin(*self.stop_words) if self.stop_words else w != "")
        if self.analyzer == "char_wb":
            return F.flatten(F.transform(words, lambda w: ngrams(F.concat(F.lit(" "), w, F.lit(" ")), self.low, self.high)))
        one = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*(one(n) for n in range(self.low, self.high + 1))))


def _weighed(counts: DataFrame, idf: DataFrame, key: str, norm: bool) -> DataFrame:
    w = counts.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    if not norm:
        return w.select(key, "gram", "w")
    return w.select(key, "gram", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("w"))


def _counts(df: DataFrame, key: str, text: str, v: Vectors) -> DataFrame:
    return df.select(key, F.explode(v.grams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def fit(names: DataFrame, key: str, text: str, v: Vectors) -> tuple[DataFrame, DataFrame]:
    """(gram, idf, df) and (key, gram, w) of names; a null or empty name has no grams."""
    counts = _counts(names, key, text, v)
    n = names.select(F.count("*").alias("n"))
    vocabulary = counts.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("_all")).crossJoin(F.broadcast(n))  # one row
    bound = lambda x: F.col("n") * F.lit(x) if isinstance(x, float) else F.lit(x)
    vocabulary = vocabulary.where((F.col("df") >= bound(v.min_df)) & (F.col("df") <= bound(v.max_df)))
    if v.max_features:
        vocabulary = vocabulary.orderBy(F.desc("_all"), "gram").limit(v.max_features)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1 if v.use_idf else F.lit(1.0)
    vocabulary = vocabulary.select("gram", idf.alias("idf"), "df")
    return vocabulary, _weighed(counts, vocabulary, key, v.norm)


def scores(mentions: DataFrame, mention: str, text: str, names: DataFrame, key: str, name: str, models: list[Vectors], least: float = 0.0) -> DataFrame:
    """(mention, key, score): the weighted sum of the models' cosines, at ``least`` (above zero where that is 0).

    With ``least`` above 0 and one normalised model, pairs are found by each mention's rarest grams alone: those that
    leave a rest shorter than ``least``, since a pair that shares none of them can't reach it. Frequent grams then join
    nothing, and each candidate's cosine is computed once.
    """
    parts = []
    for v in models:
        vocabulary, fitted = fit(names, key, name, v)
        m = _weighed(_counts(mentions, mention, text, v), vocabulary, mention, v.norm).withColumnRenamed("w", "_v")
        if least > 0 and len(models) == 1 and v.norm:
            rare = Window.partitionBy(mention).orderBy(F.desc("df"), "gram").rowsBetween(Window.unboundedPreceding, 0)
            ranked = m.join(vocabulary.select("gram", "df"), "gram").withColumn("_rest", F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(rare)))
            heads = ranked.where(F.col("_rest") >= least / v.weight - 1e-9).select(mention, "gram")
            pairs = heads.join(fitted.select(key, "gram"), "gram").select(mention, key).distinct()
            joined = pairs.join(m, mention).join(fitted, [key, "gram"])
        else:
            joined = m.join(fitted, "gram")
        parts.append(joined.groupBy(mention, key).agg((v.weight * F.sum(F.col("_v") * F.col("w"))).alias("s")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = every.groupBy(mention, key).agg(F.round(F.sum("s"), 5).alias("score"))
    return found.where(F.col("score") >= least) if least > 0 else found.where("score > 0")


def ranked_names(found: DataFrame, mention: str, names: DataFrame, key: str, nmax: int, weights: dict[str, float] | None = None, types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """(mention, concept columns, score, rank): the best names of each mention by rounded score, then name type (highest first), then order.

    names: (key, concept_id, concept_type, name_type, name_idx). ``weights`` of name types are added to the score;
    ``types`` restricts concepts; a name type without a weight adds nothing.
    """
    joined = found.join(names, key)
    if types is not None:
        joined = joined.where(F.col("concept_type").isin(types))
    extra = F.lit(0.0)
    for t, w in (weights or {}).items():
        extra = F.when(F.col("name_type") == t, F.lit(float(w))).otherwise(extra)
    joined = joined.withColumn("score", F.round(F.col("score") + extra, 5)).where(F.col("score") >= least)
    order = Window.partitionBy(mention).orderBy(F.desc("score"), F.desc("name_type"), "name_idx")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nmax)


def dictionary(rows: DataFrame, concept: str, name: Column) -> DataFrame:
    """Names without repeats within a concept: of equal normalised names the first by ``name_idx`` stays."""
    first = Window.partitionBy(concept, name).orderBy("name_idx")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def equivalents(groups: list[list[str]]) -> dict[str, list[str]]:
    """Each type of the groups with the other types that it may stand for."""
    out: dict[str, list[str]] = {}
    for g in groups:
        for t in g:
            out[t] = sorted({*out.get(t, []), *g} - {t})
    return out


def compatible(ref_type: Column, target_type: Column, same: dict[str, list[str]]) -> Column:
    ok = ref_type == target_type
    for t, others in same.items():
        ok = ok | ((ref_type == t) & target_type.isin(others))
    return ok


#: The score of pairs that are set beforehand.
FORCED = 999.0


def greedy_mapping(scores: DataFrame, keys: list[str], least: float = 0.5, same: dict[str, list[str]] | None = None, forced: DataFrame | None = None) -> DataFrame:
    """One-to-one pairs (ref, target) of each group by descending score; ties by names.

    With columns ref_type and target_type only compatible types are paired (equal, or by ``same``). ``forced`` (keys, ref,
    target) come first, whatever their names and types. Null refs and targets pair with nothing. Rows of a group come
    sorted to one task, which holds no more than the names that it has used.
    """
    some = scores.where(F.col("ref").isNotNull() & F.col("target").isNotNull() & (F.col("score") >= least))
    if {"ref_type", "target_type"} <= set(scores.columns):
        some = some.where(compatible(F.col("ref_type"), F.col("target_type"), same or {}))
    some = some.select(*keys, "ref", "target", F.col("score").cast("double").alias("score"))
    if forced is not None:
        some = some.unionByName(forced.where("ref IS NOT NULL AND target IS NOT NULL").select(*keys, "ref", "target", F.lit(FORCED).alias("score")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, refs, targets = object(), set(), set()
        for batch in batches:
            keep = []
            for at, r, t in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("ref").to_pylist(), batch.column("target").to_pylist()):
                if at != group:
                    group, refs, targets = at, set(), set()
                ok = r not in refs and t not in targets
                keep.append(ok)
                if ok:
                    refs.add(r)
                    targets.add(t)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return some.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"), "ref", "target").mapInArrow(run, some.schema)


def _of_pairs(edges: DataFrame, pairs: DataFrame, moa: str, mapping: DataFrame, end: str) -> DataFrame:
    """The edges of each pair's graph as graphs of their own: the pair's key as moa_id, "M" and "X" as types of matched and other nodes."""
    e = edges.select(F.col("moa_id").alias(moa), "head", "relation", "tail").join(pairs, moa)
    m = mapping.select("pair", F.col(end).alias("node"), F.lit("M").alias("t"))
    typed = e.join(m.select("pair", F.col("node").alias("head"), F.col("t").alias("htype")), ["pair", "head"], "left")
    typed = typed.join(m.select("pair", F.col("node").alias("tail"), F.col("t").alias("ttype")), ["pair", "tail"], "left")
    return typed.select(F.col("pair").alias("moa_id"), "head", F.coalesce("htype", F.lit("X")).alias("htype"), "relation", "tail", F.coalesce("ttype", F.lit("X")).alias("ttype"))


def match_graphs(pairs: DataFrame, ref: DataFrame, target: DataFrame, mapping: DataFrame, ends: DataFrame, prompts: DataFrame | None = None, homomorphic: bool = False, forced: bool = True) -> DataFrame:
    """Scores of pairs of graphs.

    pairs: (pair, ref_id, target_id); ref and target: edges of graphs; mapping: (pair, ref, target); ends: (moa_id, drug,
    disease) of graphs that have both; prompts: (pair, node) of the reference named in the prompt. An edge of the
    reference, reduced to its matched nodes, is consistent if its images are one node or joined: by a path in the target,
    or with ``homomorphic`` by an edge of the target reduced to its matched nodes. Edges are not looked at where at most
    one node matches, or only the forced ends of a reference with inner nodes. Without nodes in the prompt its score is NaN;
    a reference without edges has null ratios.
    """
    count = lambda df, name: df.groupBy("pair").agg(F.count("*").alias(name))
    size = lambda e, name: e.select("moa_id", F.explode(F.array("head", "tail")).alias("v")).distinct().groupBy("moa_id").agg(F.count("*").alias(name))
    edges_of = lambda e, name: e.select("moa_id", "head", "relation", "tail").distinct().groupBy("moa_id").agg(F.count("*").alias(name))
    out = pairs.select("pair", "ref_id", "target_id")
    for e, side in ((ref, "ref"), (target, "target")):
        stats = size(e, f"n_nodes_{side}").join(edges_of(e, f"n_edges_{side}"), "moa_id").withColumnRenamed("moa_id", f"{side}_id")
        out = out.join(stats, f"{side}_id", "left")
    both = ends.select("moa_id", "drug", "disease")
    out = out.join(both.select(F.col("moa_id").alias("ref_id"), F.col("drug").alias("rd"), F.col("disease").alias("rs")), "ref_id", "left")
    out = out.join(both.select(F.col("moa_id").alias("target_id"), F.col("drug").alias("td")), "target_id", "left")
    m = mapping.select("pair", "ref", "target").distinct()
    inner = m.join(out.select("pair", "rd", "rs"), "pair").where("NOT (ref <=> rd) AND NOT (ref <=> rs)")
    out = out.join(count(m, "n_nodes_matched"), "pair", "left").join(count(inner, "n_inner_matched"), "pair", "left")
    named = prompts if prompts is not None else m.select("pair", F.col("ref").alias("node")).limit(0)
    hit = named.join(m.select("pair", F.col("ref").alias("node")), ["pair", "node"], "left_semi")
    out = out.join(count(named.distinct(), "n_prompt_nodes"), "pair", "left").join(count(hit.distinct(), "n_prompt_matched"), "pair", "left")
    reduced = reduced_pairs(_of_pairs(ref, pairs, "ref_id", m, "ref"), ["M"]).withColumnRenamed("moa_id", "pair").distinct()
    reduced = _written(reduced, "reduced")
    there = _of_pairs(target, pairs, "target_id", m, "target")
    joined = (reduced_pairs(there, ["M"]) if homomorphic else closure(there)).select(F.col("moa_id").alias("pair"), F.col("head").alias("a"), F.col("tail").alias("b"), F.lit(True).alias("joined")).distinct()
    joined = _written(joined, "joined")
    image = lambda end, new: m.select("pair", F.col("ref").alias(end), F.col("target").alias(new))
    checked = reduced.join(image("head", "a"), ["pair", "head"]).join(image("tail", "b"), ["pair", "tail"]).join(joined, ["pair", "a", "b"], "left")
    consistent = checked.groupBy("pair").agg(F.count("*").alias("n_edges_ref_reduced"), F.count_if(F.coalesce("joined", F.lit(False)) | (F.col("a") == F.col("b"))).alias("n_edges_consistent"))
    consistent = _written(consistent, "consistent")
    out = _written(out, "sizes")
    out = out.join(consistent, "pair", "left").fillna(0, ["n_nodes_ref", "n_nodes_target", "n_edges_ref", "n_edges_target", "n_nodes_matched", "n_inner_matched", "n_prompt_nodes", "n_prompt_matched", "n_edges_ref_reduced", "n_edges_consistent"])
    out = _written(out, "counts")
    return _ratios(out.withColumn("has_ends", F.col("rd").isNotNull() & F.col("td").isNotNull()), forced)


def _ratios(out: DataFrame, forced: bool) -> DataFrame:
    """Scores from counts; ``has_ends``: both graphs have their ends."""
    has_ends = F.col("has_ends")
    looked = F.col("n_nodes_matched") > 1
    if forced:
        looked = looked & ~(has_ends & (F.col("n_nodes_matched") <= 2) & (F.col("n_nodes_ref") > 2))
    part = lambda a, b: F.when(looked & (F.col(b) > 0), F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return out.select(
        "pair", "n_nodes_ref", "n_nodes_target", "n_edges_ref", "n_edges_target", "n_nodes_matched", "n_prompt_nodes", "n_prompt_matched",
        F.round(F.try_divide("n_nodes_target", "n_nodes_ref"), 6).alias("node_ratio"), F.round(F.try_divide("n_nodes_matched", "n_nodes_ref"), 6).alias("node_match"),
        F.when(has_ends, F.when(F.col("n_nodes_ref") > 2, F.round(F.col("n_inner_matched") / (F.col("n_nodes_ref") - 2), 6)).otherwise(0.0)).alias("interior_match"),
        F.when(F.col("n_prompt_nodes") == 0, F.lit(float("nan"))).otherwise(F.round(F.col("n_prompt_matched") / F.col("n_prompt_nodes"), 6)).alias("prompt_match"),
        F.when(looked, F.col("n_edges_ref_reduced")).otherwise(0).alias("n_edges_ref_reduced"), F.when(looked, F.col("n_edges_consistent")).otherwise(0).alias("n_edges_consistent"),
        part("n_edges_consistent", "n_edges_ref").alias("edge_match"), part("n_edges_consistent", "n_edges_ref_reduced").alias("edge_match_reduced"),
    )


def matched_pairs(pairs: DataFrame, edges: DataFrame, candidates: DataFrame, root_type: str, sink_type: str, scored: list[str], named: list[str], parts: int, homomorphic: bool = False) -> DataFrame:
    """The mapping and the counts of each pair of graphs of ``edges``, whole, in two passes over the edges.

    What ``synthesis.ends``, ``greedy_mapping`` with forced ends and ``match_graphs`` find one by one. pairs: (pair, ref_id,
    target_id), ``pair`` unique and target_id not null; candidates: (pair, target_id, ref, target, score) for nodes of the types
    ``scored``, nodes of other types are paired by equal names. Edges that are dealt by moa_id into ``parts`` partitions stay
    where they are: each reference goes to its target's partition as one row, and nothing else is shuffled.
    """
    fields = "nodes types u v drug disease n_nodes n_edges".split()
    asked = pairs.where("ref_id IS NOT NULL").select(F.col("ref_id").alias("moa_id"), F.struct("pair", "target_id").alias("item"))
    packed = packed_graphs(edges, asked.repartition(parts, "moa_id"), root_type, sink_type).select(F.col("item.target_id").alias("moa_id"), F.col("item.pair").alias("pair"), *fields)
    none = {"drug": F.lit(-1), "disease": F.lit(-1), "n_nodes": F.lit(0), "n_edges": F.lit(0)}
    empty = pairs.where("ref_id IS NULL").select(F.col("target_id").alias("moa_id"), "pair", *(none.get(c, F.lit(None)).cast(packed.schema[c].dataType).alias(c) for c in fields))
    given = {"ref": "string", "target": "string", "score": "double"}
    item = lambda here: F.struct("pair", *(F.col(c) if c in here else F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in fields), *(F.col(c).cast(t).alias(c) if c in here else F.lit(None).cast(t).alias(c) for c, t in given.items())).alias("item")
    refs = packed.unionByName(empty).repartition(parts, "moa_id").select("moa_id", item(fields))
    near = candidates.where("ref IS NOT NULL AND target IS NOT NULL AND score IS NOT NULL").withColumnRenamed("target_id", "moa_id").select("moa_id", item(list(given)))
    return match_packed(edges, refs.unionAll(near), root_type, sink_type, scored, named, FORCED, homomorphic)


def pair_scores(matched: DataFrame, forced: bool = True) -> DataFrame:
    """The scores of ``match_graphs`` from the counts of ``matched_pairs``."""
    return _ratios(matched, forced)


# --------------------------------------------------------------------------
# Options


def check_options(options: dict[str, str]) -> None:
    """No option may begin another."""
    low = {k: v.lower() for k, v in options.items()}
    for a in low:
        for b in low:
            if a != b and low[a].startswith(low[b]):
                raise ValueError(f"option {b!r} begins option {a!r}")


def option_paragraph(c: Column, options: dict[str, str], heading: str = "Summary", cut: bool = True) -> Column:
    """What an answer says after its last ``heading`` line that enough text follows, else its last paragraph of enough text.

    Blank lines and asterisks around lines go. With ``cut`` it ends after 1.4 times the longest option, and an option that
    it begins with is all of it. Texts shorter than 0.8 times the shortest option stay as they are.
    """
    texts = list(options.values())
    least, most = int(0.8 * min(map(len, texts))), int(1.4 * max(map(len, texts)))
    mark = F.regexp_replace(c, f"(?im)^#*\\s*[*]*\\s*{heading}[*]*:?", "\x01")
    pieces = F.split(mark, "\x01")
    n = F.size(pieces)
    rest = lambda k: F.array_join(F.slice(pieces, k + 1, n), "")
    after = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.when((k < n) & (F.length(rest(k)) >= least), rest(k))), lambda x: x.isNotNull())
    last = F.element_at(F.filter(F.transform(F.split(c, "\n\\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least), -1)
    said = F.trim(F.coalesce(F.get(after, F.size(after) - 1), last, F.lit("")))
    lines = F.filter(F.transform(F.split(said, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^([*]\\s*)+", ""), "[*]+$", "")), lambda x: x != "")
    out = F.array_join(lines, "\n")
    if cut:
        out = F.left(out, F.lit(most))
        for t in sorted(texts, key=len):  # the longest that fits wins
            out = F.when(F.startswith(F.lower(out), F.lit(t.lower())), F.left(out, F.lit(len(t)))).otherwise(out)
    return F.when(c.isNotNull(), F.when(F.length(c) < least, c).otherwise(out))


def substituted(c: Column, replacements: list[tuple[str, str]]) -> Column:
    """Whole words replaced, the longest first."""
    for old, new in sorted(replacements, key=lambda x: (-len(x[0]), x[0])):
        c = F.regexp_replace(c, rf"\b{re.escape(old)}\b", new.replace("\\", r"\\").replace("$", r"\$"))
    return c


OPTION_VECTORS = Vectors("char", 2, 5)


def best_options(answers: DataFrame, key: str, text: str, options: dict[str, str], least: float = 0.4, default: str | None = None, replacements: list[tuple[str, str]] = ()) -> DataFrame:
    """(key, option_key, match_score): the option nearest to each text; null (or ``default``) where the score is below ``least``. A null text has score 0."""
    check_options(options)
    spark = answers.sparkSession
    table = spark.createDataFrame([(k, t.lower()) for k, t in options.items()], "_o string, _t string")
    asked = answers.select(key, F.lower(substituted(F.col(text), list(replacements))).alias("_a"))
    distinct = asked.select(F.xxhash64("_a").alias("_h"), "_a").distinct()
    found = scores(distinct, "_h", "_a", table, "_o", "_t", [OPTION_VECTORS])
    best = top_matches(found, "_h", "_o", 1).select("_h", "_o", "score")
    joined = asked.select(key, F.xxhash64("_a").alias("_h")).join(best, "_h", "left")
    chosen = F.when(F.col("score") >= least, F.col("_o")).otherwise(F.lit(default))
    return joined.select(key, chosen.alias("option_key"), F.coalesce("score", F.lit(0.0)).alias("match_score"))


def negative_answers(answers: DataFrame, key: str, text: str, options: dict[str, str], least: float = 0.4) -> DataFrame:
    """(key, no_graph_found, score_no, score_yes): the best scores of the options NO and YES among lines that begin with either word."""
    lines = answers.select(key, F.posexplode(F.split(F.trim(text), "\n")).alias("pos", "line")).select(key, "pos", F.trim("line").alias("line"))
    lines = lines.where(F.col("line").rlike("(?i)^(yes|no)")).select(F.struct(key, "pos").alias("_l"), "line")
    best = best_options(lines, "_l", "line", options, least).where("option_key IS NOT NULL")
    top = lambda o: F.coalesce(F.max(F.when(F.col("option_key") == o, F.col("match_score"))), F.lit(0.0))
    found = best.groupBy(F.col(f"_l.{key}").alias(key)).agg(top("NO").alias("score_no"), top("YES").alias("score_yes"))
    whole = answers.select(key).join(found, key, "left").fillna(0.0, ["score_no", "score_yes"])
    return whole.select(key, (F.col("score_no") > F.col("score_yes")).alias("no_graph_found"), "score_no", "score_yes")


def multiple_choice(df: DataFrame, key: str, prompt: str, options: dict[str, str], client=None, default: str | None = None, least: float = 0.4, **asking) -> DataFrame:
    """Asks each row's prompt and adds ``option_key`` and ``match_score`` of the answer's option paragraph; ``default`` where none is near."""
    answered = ask(df, prompt, **({"client": client} if client else {}), out="answer", **asking)
    said = answered.withColumn("_said", option_paragraph(F.col("answer"), options))
    return answered.join(best_options(said, key, "_said", options, least, default), key, "left")
