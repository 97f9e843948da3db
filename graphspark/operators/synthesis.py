"""New graphs by adding a link from one graph's node to another graph's protein, and the choice of pairs for it.

Edges are rows (moa_id, head, htype, relation, tail, ttype); ``ends`` has one row
for each graph: (moa_id, drug, disease). Null ends match nothing; empty tables give
no rows; repeated rows of ``ends`` are the caller's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.views import pick
from .entities import _written
from .graphs import closure, nodes_of, simulate
from .kernels import link_sources, link_targets


def ends(edges: DataFrame, root_type: str, sink_type: str) -> DataFrame:
    """(moa_id, drug, disease): the least root and sink node of each graph that has both."""
    nodes = nodes_of(edges, "moa_id")
    of = lambda t: F.min(F.when(F.col("type") == t, F.col("node")))
    return nodes.groupBy("moa_id").agg(of(root_type).alias("drug"), of(sink_type).alias("disease")).where("drug IS NOT NULL AND disease IS NOT NULL")


def single_graph_pairs(ends: DataFrame) -> DataFrame:
    """Graphs whose drug and disease have no other graph."""
    return ends.withColumn("_n", F.count("*").over(Window.partitionBy("drug", "disease"))).where("_n = 1").drop("_n")


def targets(edges: DataFrame, protein_type: str, from_types: list[str], inverse: dict[str, str]) -> DataFrame:
    """(moa_id, protein, in_relation): proteins with a way in from one of the types by an invertible relation."""
    ok = (F.col("ttype") == protein_type) & F.col("htype").isin(from_types) & F.col("relation").isin(list(inverse))
    return edges.where(ok).select("moa_id", F.col("tail").alias("protein"), F.col("relation").alias("in_relation")).distinct()


def exclusions(edges: DataFrame, ends: DataFrame, targets: DataFrame, protein_type: str, indications: DataFrame | None = None) -> DataFrame:
    """(target_moa, protein, source_moa), distinct: sources of another disease that can't be joined to a target.

    A source is out if its drug is a node of the target, if it holds the protein, or if its drug has an indication
    (drug, disease) for the target's disease. Sources of the same disease and the target itself are out as well, and
    not listed: they are a condition on ``disease``, not a join.
    """
    t = targets.select(F.col("moa_id").alias("target_moa"), "protein").distinct().join(ends.select(F.col("moa_id").alias("target_moa"), F.col("disease").alias("target_disease")), "target_moa")
    sources = ends.select(F.col("moa_id").alias("source_moa"), "drug", "disease")
    nodes = nodes_of(edges, "moa_id")
    other = F.col("disease") != F.col("target_disease")
    in_target = nodes.select(F.col("moa_id").alias("target_moa"), F.col("node").alias("drug")).join(sources, "drug")
    by_drug = t.join(in_target, "target_moa").where(other)
    holds = nodes.where(F.col("type") == protein_type).select(F.col("moa_id").alias("source_moa"), F.col("node").alias("protein")).join(sources, "source_moa")
    by_protein = t.join(holds, "protein").where(other)
    out = [by_drug, by_protein]
    if indications is not None:
        known = indications.select("drug", F.col("disease").alias("target_disease")).distinct().join(sources, "drug")
        out.append(t.join(known, "target_disease").where(other))
    rows = [o.select("target_moa", "protein", "source_moa") for o in out]
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    return found.distinct()


#: Graphs of one drug that are worked on in one place; those of a drug with more are dealt by protein as well.
DRUG_GRAPHS = 20_000


def packed_ends(edges: DataFrame, root_type: str, sink_type: str, protein_type: str, from_types: list[str], inverse: dict[str, str]) -> DataFrame:
    """(moa_id, drug, disease, nodes, held, proteins): what ``ends`` and ``targets`` find, with the nodes' names and the proteins
    of each graph, in one row for each that has both ends; edges may be repeated."""
    of = lambda f, t: [f(F.when(F.col(kind) == t, F.col(c))) for c, kind in (("head", "htype"), ("tail", "ttype"))]
    ok = (F.col("ttype") == protein_type) & F.col("htype").isin(from_types) & F.col("relation").isin(list(inverse))
    packed = edges.groupBy("moa_id").agg(
        F.least(*of(F.min, root_type)).alias("drug"), F.least(*of(F.min, sink_type)).alias("disease"), F.array_union(F.collect_set("head"), F.collect_set("tail")).alias("nodes"),
        F.array_union(*of(F.collect_set, protein_type)).alias("held"), F.collect_set(F.when(ok, F.struct(F.col("tail").alias("protein")))).alias("proteins"),
    )
    return packed.where("drug IS NOT NULL AND disease IS NOT NULL")


def eligible_counts(graphs: DataFrame, indications: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(target_moa, protein, sources): how many graphs may be joined to each target; ``graphs`` are ``packed_ends``.

    Neither pairs nor exclusions are listed. Whole graphs go to their drugs (one row each, the graphs as sources and as
    targets), where sources out by their drug, but for those that hold the protein as well, are counted; then one row for
    each target goes to its protein and disease, where those out by the protein are. Sources out by an indication are a
    number for each disease and, of those with the protein, one for each protein and disease. Drugs that are nodes of other
    drugs' graphs are looked for among the distinct names. ``parts`` are the partitions of the drugs.
    """
    none = F.array().cast("array<string>")
    n = parts or graphs.sparkSession.sparkContext.defaultParallelism
    mine = F.coalesce(F.array_contains("nodes", F.col("drug")), F.lit(False))
    held = F.coalesce("held", none)
    rest = F.array_except(F.array_except(F.coalesce("nodes", none), held), F.array("drug"))
    g = _written(graphs.select("moa_id", "drug", "disease", mine.alias("mine"), held.alias("held"), rest.alias("rest"), F.coalesce("proteins", F.array().cast("array<struct<protein:string>>")).alias("proteins")), "packed")
    sources, targets = g.where("disease IS NOT NULL"), g.where("disease IS NOT NULL").withColumnRenamed("disease", "target_disease")
    # of each drug: its graphs by disease, and its indications
    drugs = sources.groupBy("drug", "disease").agg(F.count("*").alias("n")).groupBy("drug").agg(F.sum("n").alias("graphs"), F.collect_list(F.struct("disease", "n")).alias("by_disease"))
    known = F.lit(None).cast("array<string>").alias("known")
    if indications is not None:
        drugs = drugs.join(indications.groupBy("drug").agg(F.collect_set("disease").alias("known")), "drug", "left")
        known = "known"
    drugs = _written(drugs.select("drug", "graphs", "by_disease", known).withColumn("known", F.coalesce("known", none)), "drugs")
    own = lambda disease: F.coalesce(F.get(F.filter("by_disease", lambda x: x["disease"] == disease), 0)["n"], F.lit(0))
    # of each disease: its graphs, and those of others whose drug is indicated for it
    same = drugs.select(F.inline("by_disease")).groupBy(F.col("disease").alias("target_disease")).agg(F.sum("n").alias("same"))
    indicated = drugs.select("graphs", "by_disease", F.explode("known").alias("target_disease")).withColumn("n", F.col("graphs") - own(F.col("target_disease"))).groupBy("target_disease").agg(F.sum("n").alias("indicated"))
    every = g.agg(F.count("*").alias("every"))  # one row
    diseases = _written(same.join(indicated, "target_disease", "left").crossJoin(F.broadcast(every)), "diseases")
    # drugs in the graphs of others
    names = g.select("drug", F.explode(F.concat("held", "rest")).alias("name"))
    other = F.col("name") != F.col("drug")
    # a semi-join would go before the distinct names, and shuffle all of them
    marked = names.where(other | F.col("drug").isNull()).select("name", F.lit(1).alias("node"), F.lit(0).alias("drug")).unionAll(drugs.where("drug IS NOT NULL").select("drug", F.lit(0), F.lit(1)))
    abroad = _written(marked.groupBy("name").agg(F.max("node").alias("node"), F.max("drug").alias("drug")).where("node = 1 AND drug = 1").select("name"), "abroad")
    asked = targets.select("drug", "mine", "moa_id", "target_disease", "proteins")
    if several := not abroad.isEmpty():
        guests = targets.withColumn("name", F.explode(F.concat("held", "rest"))).where(other | F.col("drug").isNull()).join(abroad, "name")
        asked = asked.unionAll(guests.select(F.col("name").alias("drug"), F.lit(True).alias("mine"), "moa_id", "target_disease", "proteins"))
    hot = F.broadcast(drugs.where(F.col("graphs") > DRUG_GRAPHS).select("drug", F.ceil(F.col("graphs") / DRUG_GRAPHS).alias("buckets")))
    bucket = lambda p: F.pmod(F.xxhash64(p), F.col("buckets"))
    dealt = lambda df, c, of: df.join(hot, "drug", "left").withColumn("_b", F.when(F.col("buckets").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("bucket"), F.col(c).alias("in")))).otherwise(
        F.transform(c, lambda x: F.struct(bucket(of(x)).alias("bucket"), F.array(x).alias("in"))))).drop(c, "buckets").select("*", F.inline("_b")).drop("_b").withColumnRenamed("in", c).repartition(n, "drug", "bucket")
    info = drugs.join(hot, "drug", "left").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("buckets", F.lit(1)) - 1))).drop("buckets").repartition(n, "drug", "bucket")
    sources = dealt(sources.select("drug", "disease", "held"), "held", lambda x: x)
    asked = dealt(asked, "proteins", lambda x: F.coalesce(x["protein"], F.lit(""))).join(info, ["drug", "bucket"], "left")
    # sources and targets of a drug and a protein side by side: those with the protein that are out by their drug already
    out = F.when(F.col("mine") & F.col("graphs").isNotNull() & ~F.array_contains("known", F.col("target_disease")), F.col("graphs") - own(F.col("target_disease")))
    rows = asked.select("drug", "bucket", "moa_id", "target_disease", out.alias("out"), F.inline("proteins")).select("drug", "bucket", "protein", F.col("target_disease").alias("disease"), "moa_id", "out", F.lit(0).alias("n"))
    each = sources.select("drug", "bucket", F.explode("held").alias("protein"), "disease").withColumns({"moa_id": F.lit(None).cast(g.schema["moa_id"].dataType), "out": F.lit(None).cast("long"), "n": F.lit(1)})
    both, key = rows.unionAll(each.select(*rows.columns)), ["drug", "bucket", "protein"]
    both = both.withColumn("_own", F.sum("n").over(Window.partitionBy(*key, "disease"))).withColumn("_all", F.sum("n").over(Window.partitionBy(*key))).where("moa_id IS NOT NULL")
    by_drug = both.select("moa_id", "protein", F.col("disease").alias("target_disease"), F.coalesce(F.col("out") - (F.col("_all") - F.col("_own")), F.lit(0)).alias("out"))
    if several:
        by_drug = by_drug.groupBy("moa_id", "protein", "target_disease").agg(F.sum("out").alias("out"))
    # sources with the protein: of the disease, of others, and of others by an indication for it
    counts = "array<struct<target_disease:string,own:int,known_n:int>>"
    count = lambda disease, own, known: F.struct(disease.alias("target_disease"), F.lit(own).alias("own"), F.lit(known).alias("known_n"))
    if indications is not None:
        sources = sources.join(info.select("drug", "bucket", "known"), ["drug", "bucket"], "left")
        more = F.transform(F.filter(F.coalesce("known", none), lambda x: x != F.col("disease")), lambda x: count(x, 0, 1)).cast(counts)
    else:
        more = F.array().cast(counts)
    holds = sources.select(F.explode("held").alias("protein"), F.concat(F.array(count(F.col("disease"), 1, 0)), more).alias("_c")).select("protein", F.inline("_c"))
    unheld = targets.select(F.explode(F.array_except(F.transform("proteins", lambda x: x["protein"]), "held")).alias("protein"), "target_disease").where("protein IS NOT NULL")
    holds = holds.unionAll(unheld.select("protein", "target_disease", F.lit(0), F.lit(0))).groupBy("protein", "target_disease").agg(F.sum("own").alias("own"), F.sum("known_n").alias("known_n"))
    held_out = F.sum("own").over(Window.partitionBy("protein")) - F.col("own") - F.col("known_n")
    by_protein = holds.select("protein", "target_disease", held_out.alias("held_out"))
    counted = by_drug.join(by_protein, ["protein", "target_disease"], "left").join(diseases, "target_disease")
    gone = F.when(F.col("protein").isNotNull(), F.col("out") + F.coalesce("held_out", F.lit(0)) + F.coalesce("indicated", F.lit(0))).otherwise(F.lit(0))
    return counted.select(F.col("moa_id").alias("target_moa"), "protein", (F.col("every") - F.col("same") - gone).alias("sources"))


def eligible_sources(edges: DataFrame, ends: DataFrame, targets: DataFrame, protein_type: str, indications: DataFrame | None = None) -> DataFrame:
    """(target_moa, protein, sources): ``eligible_counts`` of graphs with these ends and targets."""
    nodes = nodes_of(edges, "moa_id").groupBy("moa_id").agg(F.collect_set("node").alias("nodes"), F.collect_set(F.when(F.col("type") == protein_type, F.col("node"))).alias("held"))
    proteins = targets.groupBy("moa_id").agg(F.collect_set(F.struct("protein")).alias("proteins"))
    graphs = ends.select("moa_id", "drug", "disease").join(nodes, "moa_id", "left").join(proteins, "moa_id", "left")
    return eligible_counts(graphs, indications)


def admissible(samples: DataFrame, edges: DataFrame, ends: DataFrame, protein_type: str, indications: DataFrame | None = None) -> DataFrame:
    """Samples (target_moa, protein, source_moa, ...) whose source may be joined to the target: three look-ups for each sample."""
    s = samples.join(ends.select(F.col("moa_id").alias("target_moa"), F.col("disease").alias("_td")), "target_moa")
    s = s.join(ends.select(F.col("moa_id").alias("source_moa"), F.col("disease").alias("_sd"), F.col("drug").alias("_drug")), "source_moa").where("_td <> _sd")
    nodes = nodes_of(edges, "moa_id")
    s = s.join(nodes.select(F.col("moa_id").alias("target_moa"), F.col("node").alias("_drug")).distinct(), ["target_moa", "_drug"], "left_anti")
    holds = nodes.where(F.col("type") == protein_type).select(F.col("moa_id").alias("source_moa"), F.col("node").alias("protein")).distinct()
    s = s.join(holds, ["source_moa", "protein"], "left_anti")
    if indications is not None:
        s = s.join(indications.select(F.col("drug").alias("_drug"), F.col("disease").alias("_td")).distinct(), ["_drug", "_td"], "left_anti")
    return s.select(*samples.columns)


def new_relation(source_level: Column, target_level: Column, in_relation: Column, signs: dict[str, int], inverse: dict[str, str]) -> Column:
    """The relation of a new link: the one into the protein if its sign is the product of the two levels, else its inverse; null where a level is 0."""
    product = source_level * target_level
    return F.when(product != 0, F.when(product == pick(signs, in_relation), in_relation).otherwise(pick(inverse, in_relation)))


def with_relations(samples: DataFrame, edges: DataFrame, signs: dict[str, int], inverse: dict[str, str], root_type: str) -> DataFrame:
    """Samples (source_moa, source_node, target_moa, protein, in_relation, ...) with levels and ``new_relation``; samples of level 0 go."""
    levels = simulate(edges, signs, root_type)
    of = lambda moa, node, level: levels.select(F.col("moa_id").alias(moa), F.col("node").alias(node), F.col("level").alias(level))
    s = samples.join(of("source_moa", "source_node", "source_level"), ["source_moa", "source_node"]).join(of("target_moa", "protein", "target_level"), ["target_moa", "protein"])
    s = s.withColumn("new_relation", new_relation(F.col("source_level"), F.col("target_level"), F.col("in_relation"), signs, inverse))
    return s.where("new_relation IS NOT NULL").select(*samples.columns, "source_level", "target_level", "new_relation")


def synthesised(samples: DataFrame, edges: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """(key, head, htype, relation, tail, ttype): for each sample (key, source_moa, source_node, target_moa, protein, new_relation)
    the way from the source's drug to its node, the way from the protein to the target's disease, and the new link."""
    reach = closure(edges).select("moa_id", "head", "tail")
    itself = nodes_of(edges, "moa_id")
    reach = reach.unionByName(itself.select("moa_id", F.col("node").alias("head"), F.col("node").alias("tail"))).distinct()
    types = itself.select("moa_id", "node", "type")
    drug = ends.select(F.col("moa_id").alias("source_moa"), "drug")
    disease = ends.select(F.col("moa_id").alias("target_moa"), "disease")
    whole = samples.join(drug, "source_moa").join(disease, "target_moa")
    parts = whole.select(key, F.inline(F.array(
        F.struct(F.col("source_moa").alias("moa_id"), F.col("drug").alias("a"), F.col("source_node").alias("b")),
        F.struct(F.col("target_moa").alias("moa_id"), F.col("protein").alias("a"), F.col("disease").alias("b")),
    )))
    down = reach.select("moa_id", F.col("head").alias("a"), F.col("tail").alias("head"))
    up = reach.select("moa_id", F.col("head").alias("tail"), F.col("tail").alias("b"))
    ways = edges.join(parts, "moa_id").join(down, ["moa_id", "a", "head"], "left_semi").join(up, ["moa_id", "tail", "b"], "left_semi")
    named = lambda moa, node, t: types.select(F.col("moa_id").alias(moa), F.col("node").alias(node), F.col("type").alias(t))
    link = samples.join(named("source_moa", "source_node", "htype"), ["source_moa", "source_node"]).join(named("target_moa", "protein", "ttype"), ["target_moa", "protein"])
    link = link.select(key, F.col("source_node").alias("head"), "htype", F.col("new_relation").alias("relation"), F.col("protein").alias("tail"), "ttype")
    return ways.select(key, "head", "htype", "relation", "tail", "ttype").unionByName(link).distinct()


def linked(
    edges: DataFrame, pairs: DataFrame, signs: dict[str, int], inverse: dict[str, str], root_type: str, sink_type: str, protein_type: str, from_types: list[str], parts: int, ways: bool = True
) -> DataFrame:
    """Samples of pairs of graphs (target_moa, source_moa), whole: each link from the source's least protein to one of the target's.

    What ``ends``, ``targets``, ``admissible``, ``with_relations`` and ``synthesised`` find one by one, here in two passes over
    the edges, which stay where they are if they are dealt by moa_id into ``parts`` partitions: each source's drug, proteins and
    way go to its target's partition, and nothing else is shuffled. Rows: (target_moa, protein, in_relation, source_moa,
    source_node, source_level, target_level, new_relation, edges), where ``edges`` lists the new graph's edges, each once; without ``ways`` it is left out, and no
    way is looked for.
    """
    asked = pairs.where("source_moa IS NOT NULL AND target_moa IS NOT NULL").distinct().repartition(parts, "source_moa")
    sources = link_sources(edges, asked.select(F.col("source_moa").alias("moa_id"), F.struct("target_moa").alias("item")), signs, root_type, sink_type, protein_type, ways)
    sources = sources.where("level <> 0").select(F.col("item.target_moa").alias("moa_id"), F.struct(F.col("moa_id").alias("source_moa"), "drug", "disease", "node", "level", "held", *(["way"] if ways else [])).alias("item"))
    found = link_targets(edges, sources.repartition(parts, "moa_id"), signs, root_type, sink_type, protein_type, from_types, list(inverse), ways)
    found = found.where("NOT array_contains(item.held, protein)").withColumn("new_relation", new_relation(F.col("item.level"), F.col("level"), F.col("in_relation"), signs, inverse)).where("new_relation IS NOT NULL")
    link = F.struct(F.col("item.node").alias("head"), F.lit(protein_type).alias("htype"), F.col("new_relation").alias("relation"), F.col("protein").alias("tail"), F.lit(protein_type).alias("ttype"))
    return found.select(
        F.col("moa_id").alias("target_moa"), "protein", "in_relation", "item.source_moa", F.col("item.node").alias("source_node"), F.col("item.level").alias("source_level"),
        F.col("level").alias("target_level"), "new_relation", *([F.array_distinct(F.concat("item.way", "way", F.array(link))).alias("edges")] if ways else []),
    )


def joined_samples(samples: DataFrame, corpus: DataFrame, moa: str = "source_moa_id", kind: str = "left") -> DataFrame:
    """Samples with the columns of their graph in ``corpus`` (moa_id, ...), prefixed by ``moa_``; unknown ids keep nulls, or go with ``kind`` "inner"."""
    named = corpus.select(*(F.col(c).alias(f"moa_{c.removeprefix('moa_')}") for c in corpus.columns))
    return samples.join(named, samples[moa] == named["moa_id"], kind)


def factual_samples(edges: DataFrame, ends: DataFrame, examples: DataFrame, least_nodes: int = 4) -> DataFrame:
    """Graphs for factual questions: at least so many nodes, the only graph of their pair, and none of ``examples`` (moa_id)."""
    size = nodes_of(edges, "moa_id").groupBy("moa_id").agg(F.count_distinct("node").alias("n")).where(F.col("n") >= least_nodes)
    return single_graph_pairs(ends).join(size, "moa_id", "left_semi").join(examples.select("moa_id"), "moa_id", "left_anti")
