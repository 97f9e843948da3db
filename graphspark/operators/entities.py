"""Entity resolution: records that share a normalised name are one entity; interactions follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as t
from ..sources.files import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write a round's rows in the folder of ``spark.checkpoint.dir`` (one of our own where that is unset) and read them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve(records: DataFrame, key: str, names: str) -> DataFrame:
    """(key, entity): the least key that shared names reach. ``names`` is an array of normalised names.

    Each record is linked to the least record of each of its names; large and small
    stars in turn, until nothing changes, find the least key of chains of any length.
    """
    pairs = records.select(F.col(key).alias("a"), F.explode(names).alias("name")).where("name <> ''").distinct()
    least = pairs.groupBy("name").agg(F.min("a").alias("b"))
    now = _written(pairs.join(least, "name").where("a <> b").select("a", "b").distinct(), "names")
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")
        small = large.join(least, "a").select(ends).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        now = _written(small, "names")
        # stars only: no entity has an entity of its own
        deep = now.select(F.col("b").alias("a")).distinct().join(now.select("a"), "a", "left_semi").limit(1).count()
        if not deep and not now.groupBy("a").count().where("count > 1").limit(1).count():
            break
    found = now.select(F.col("a").alias(key), F.col("b").alias("entity"))
    return records.select(key).distinct().join(found, key, "left").select(key, F.coalesce("entity", key).alias("entity"))


def merged(records: DataFrame, resolved: DataFrame, key: str, name: str, alternates: str, short: int = 7) -> DataFrame:
    """One row for each entity: the least name of at least ``short`` characters (else the longest), and all other names."""
    r = records.join(resolved, key).groupBy("entity").agg(F.array_distinct(F.flatten(F.collect_list(F.array_union(F.array(name), alternates)))).alias("all"))
    long = F.array_sort(F.filter("all", lambda x: F.length(x) >= short))
    main = F.coalesce(F.get(long, 0), F.get(F.array_sort("all"), 0))
    return r.select("entity", main.alias("name"), F.array_sort(F.array_except("all", F.array(main))).alias("alternates"))


def rewired(interactions: DataFrame, resolved: DataFrame, key: str, *ends: str) -> DataFrame:
    """Interactions between entities, without repeats and self-loops."""
    for e in ends:
        interactions = interactions.join(resolved.select(F.col(key).alias(e), F.col("entity").alias(f"{e}_entity")), e).drop(e).withColumnRenamed(f"{e}_entity", e)
    return interactions.where(F.col(ends[0]) != F.col(ends[1])).distinct()


def _first_of(items: Column, *excluded: Column) -> Column:
    """Names of ``items`` without those whose normalised form stands in ``excluded`` (arrays) or earlier in ``items``."""
    items = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    norms = F.transform(items, t.normalize_name)
    out = F.transform(F.filter(F.flatten(F.array(*excluded)), lambda x: x.isNotNull()), t.normalize_name)
    kept = lambda x, i: (F.array_position(norms, t.normalize_name(x)) == i + 1) & ~F.array_contains(out, t.normalize_name(x))
    return F.filter(items, kept)


def family_members(families: DataFrame, key: str, name: str, alternates: str, examples: str) -> DataFrame:
    """(key, pos, name, alternates, families): the drugs of each drug or family.

    Examples stand in the name ("(e.g. A, B)"), in ``examples``, or in an alternate
    "A (for B, C)"; very long ones are alternates. Without examples the row is one
    drug of no family; else each example is a drug, and the row's own names are its families.
    """
    none = F.array().cast("array<string>")
    given = lambda c: F.coalesce(F.col(c), none)
    parsed = families.select(key, t.parse_name(F.col(name)).alias("x"), given(alternates).alias("_a"), given(examples).alias("_e"))
    main = F.array("x.main")
    r = parsed.select(
        key, F.col("x.main").alias("main"), _first_of(F.concat("x.alternates", "_a"), main).alias("alt"),
        _first_of(F.concat("x.examples", "_e"), main, F.col("x.alternates"), F.col("_a")).alias("ex"),
    )
    long = lambda x: (F.length(x) >= 50) & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 3)
    r = r.select(key, "main", F.concat("alt", F.filter("ex", long)).alias("alt"), F.filter("ex", lambda x: ~long(x)).alias("ex"))
    pattern = "^([^(]+)\\s+\\(for ([^)]+)\\)"
    # examples among the alternates count for families only
    named = F.flatten(F.transform(F.filter("alt", lambda x: x.rlike(pattern)), lambda x: F.concat(
        F.array(F.trim(F.regexp_extract(x, pattern, 1))), F.transform(F.split(F.regexp_extract(x, pattern, 2), ","), lambda y: F.trim(y))
    )))
    own = F.concat(F.array("main"), F.filter("alt", lambda x: ~x.rlike(pattern)))
    drug = F.array(F.struct(F.col("main").alias("name"), F.col("alt").alias("alternates"), none.alias("families")))
    each = F.transform(F.concat("ex", named), lambda x: F.struct(
        t.parse_name(x)["main"].alias("name"), t.parse_name(x)["alternates"].alias("alternates"), own.alias("families")
    ))
    return r.select(key, F.posexplode(F.when(F.size("ex") == 0, drug).otherwise(each)).alias("pos", "d")).select(key, "pos", "d.*")


def expand_families(families: DataFrame, key: str, name: str, alternates: str, examples: str) -> tuple[DataFrame, DataFrame]:
    """Drugs of all families, merged by connected names: (entity, name, alternates, families), and (key, entity) for ``rewired``.

    An interaction of a family is one of each of its drugs.
    """
    members = family_members(families, key, name, alternates, examples).withColumn("_id", F.struct(key, "pos"))
    members = _written(members.withColumn("_names", F.transform(F.concat(F.array("name"), "alternates"), t.normalize_name)), "members")
    resolved = _written(resolve(members, "_id", "_names"), "entities")
    of = members.join(resolved, "_id")
    groups = of.groupBy("entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"))
    return merged(members, resolved, "_id", "name", "alternates").join(groups, "entity"), of.select(key, "entity").distinct()


def lookup(mentions: DataFrame, mention: str, entities: DataFrame, key: str, name: str, alternates: str, families: str | None = None, substring: bool = False) -> DataFrame:
    """Mentions with the ``key`` of every entity of that normalised name or alternate (or family, where asked); with ``substring``, of every name that holds the mention."""
    none = F.array().cast("array<string>")
    names = F.concat(F.array(name), F.coalesce(alternates, none), F.coalesce(families, none) if families else none)
    index = entities.select(F.col(key).alias("_key"), F.explode(F.transform(names, t.normalize_name)).alias("_name")).where("_name IS NOT NULL").distinct()
    asked = mentions.withColumn("_asked", t.normalize_name(F.col(mention)))
    distinct = asked.select("_asked").distinct()
    found = distinct.join(index, F.contains("_name", "_asked") if substring else F.col("_name") == F.col("_asked")).select("_asked", F.col("_key").alias(key)).distinct()
    return asked.join(found, "_asked").drop("_asked")


# In which order an entity is looked for.
ORDER = ("id", "name", "alternate", "normalised")


def find(mentions: DataFrame, mention: str, entities: DataFrame, key: str, name: str, alternates: str) -> DataFrame:
    """``mentions`` with ``found`` (the entity's key) and ``how``: the entity whose id is the mention, else the one of that
    name, else of that alternate name, else of that normalised name or alternate; of several the least key. Null where none is.

    Distinct mentions are joined once, with all four kinds of names as one key.
    """
    others = F.coalesce(alternates, F.array().cast("array<string>"))
    known = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    every = lambda kind, c: F.transform(c, lambda x: known(kind, x))
    names = F.concat(F.array(known(0, F.col(key).cast("string")), known(1, F.col(name))), every(2, others), every(3, F.transform(F.concat(F.array(name), others), t.normalize_name)))
    index = entities.select(F.col(key).alias("_key"), F.inline(names)).where("text <> ''").groupBy("kind", "text").agg(F.min("_key").alias("_key"))
    asked = mentions.select(F.col(mention).alias("_asked")).where("_asked IS NOT NULL").distinct()
    wanted = F.array(*(known(k, F.col("_asked")) for k in range(3)), known(3, t.normalize_name(F.col("_asked"))))
    best = asked.select("_asked", F.inline(wanted)).join(index, ["kind", "text"]).groupBy("_asked").agg(F.min(F.struct("kind", "_key")).alias("_best"))
    how = F.get(F.array(*map(F.lit, ORDER)), F.col("_best.kind"))
    joined = mentions.join(best, mentions[mention] == best["_asked"], "left")
    return joined.select(*mentions.columns, F.col("_best._key").alias("found"), how.alias("how"))


def upserted(rows: DataFrame, name: Column, order: str, values: dict[str, Column]) -> DataFrame:
    """(name, values, n): one entity for each name, with the first known (not null) value of each kind by ``order``, and its number of rows.

    A null name is an entity of its own.
    """
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    return rows.groupBy(name.alias("name")).agg(*(first(c).alias(k) for k, c in values.items()), F.count("*").alias("n"))


def answer_graphs(answers: DataFrame, key: str, text: str, types: dict[str, str] | None = None, root_name: Column | None = None, sink: tuple[str, str] = ("Disease", "new disease"), gate: bool = True) -> DataFrame:
    """(key, root, sink, edges) of the graphs that answers describe, a line "Type: name | relation | Type: name" for each edge;
    ``edges`` lists (head, htype, hname, relation, tail, ttype, tname).

    With ``gate`` an answer counts from its first line YES on; without one, or with NO first, it has no graph. Nodes are
    numbered within their type as they appear ("Drug.1"). The root is the only node without a way in; of several (or
    none) the only drug of the name ``root_name``. The sink is the only other node without a way out; of several the only
    one that has the type and name of ``sink``, else a new node of that type and name, to which all of them lead.

    Each line is read once, and all steps go by the key: one shuffle, and none where answers are dealt by it.
    """
    root_name = root_name if root_name is not None else F.lit(None).cast("string")
    lines = answers.where(F.col(key).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"), root_name.alias("_root"))
    if gate:
        said = lines.withColumn("_said", t.yes_no(F.trim("line")))
        first = F.min(F.when(F.col("_said").isNotNull(), F.struct("pos", "_said"))).over(Window.partitionBy(key))
        lines = said.withColumn("_first", first).where("_first._said = 'YES' AND pos > _first.pos").drop("_said", "_first")
    # as many parts as edge_line asks for: a look at its result would read the line twice
    parsed = lines.where(F.size(F.split("line", "\\|")) >= 3).select(key, "pos", "_root", t.edge_line(F.col("line")).alias("e"))
    each = parsed.select(key, "pos", "_root", t.node_text(F.col("e.head"), types).alias("h"), "e.relation", t.node_text(F.col("e.tail"), types).alias("t"))
    at = lambda c, k: F.struct(F.col(c).alias("node"), F.col(f"{c}.type").alias("kind"), (F.col("pos") * 2 + k).alias("at"), F.lit(k).alias("side"))
    seen = each.select(key, "_root", "h", "relation", "t", F.inline(F.array(at("h", 0), at("t", 1))))
    first = seen.withColumn("first", F.min("at").over(Window.partitionBy(key, "node")))
    numbered = first.withColumn("number", F.dense_rank().over(Window.partitionBy(key, "kind").orderBy("first", "node")))
    of = lambda k: F.max(F.when(F.col("side") == k, F.col("number")))
    distinct = numbered.groupBy(key, "_root", "h", "relation", "t").agg(of(0).alias("hn"), of(1).alias("tn"))
    named = lambda c, n: F.concat(F.col(f"{c}.type"), F.lit("."), F.col(n).cast("string"))
    edges = distinct.select(key, "_root", named("h", "hn").alias("head"), F.col("h.type").alias("htype"), F.col("h.name").alias("hname"), "relation", named("t", "tn").alias("tail"), F.col("t.type").alias("ttype"), F.col("t.name").alias("tname"))
    edge = F.struct("head", "htype", "hname", "relation", "tail", "ttype", "tname")
    way = lambda c, k, o: F.struct(F.col(k).alias("id"), F.col(f"{c}type").alias("type"), F.col(f"{c}name").alias("name"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"), F.when(F.lit(o == 1), edge).alias("edge"))
    ways = edges.select(key, "_root", F.inline(F.array(way("h", "head", 1), way("t", "tail", 0))))
    degree = ways.groupBy(key, "id", "type", "name").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.first("_root").alias("_root"), F.collect_list("edge").alias("edges"))
    drug = (F.col("type") == "Drug") & (F.lower("name") == F.lower("_root"))
    only = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    sets = degree.groupBy(key).agg(
        F.collect_list(F.when(F.col("i") == 0, F.col("id"))).alias("roots"), F.collect_list(F.when(drug & (F.col("i") == 0), F.col("id"))).alias("named_roots"), F.collect_list(F.when(drug, F.col("id"))).alias("drugs"),
        F.collect_list(F.when((F.col("o") == 0) & (F.col("i") > 0), F.struct(F.col("id").alias("head"), F.col("type").alias("htype"), F.col("name").alias("hname")))).alias("sinks"),
        F.collect_list(F.when((F.col("o") == 0) & (F.col("i") > 0) & F.contains(F.lower("type"), F.lit(sink[0].lower())) & (F.lower("name") == sink[1].lower()), F.col("id"))).alias("named_sinks"),
        F.count_if(F.col("type") == sink[0]).alias("_n"), F.max(F.when((F.col("type") == sink[0]) & (F.col("name") == sink[1]), F.col("id"))).alias("_there"), F.flatten(F.collect_list("edges")).alias("edges"),
    )
    new = F.coalesce("_there", F.concat(F.lit(f"{sink[0]}."), (F.col("_n") + 1).cast("string")))
    root = F.when(F.size("roots") == 1, F.get("roots", 0)).when(F.size("roots") == 0, only(F.col("drugs"))).otherwise(only(F.col("named_roots")))
    end = F.when(F.size("sinks") == 1, F.get("sinks", 0)["head"]).when(F.size("sinks") > 1, F.coalesce(only(F.col("named_sinks")), new))
    chosen = sets.select(key, root.alias("root"), end.alias("sink"), "sinks", "edges", ((F.size("sinks") > 1) & (F.size("named_sinks") != 1)).alias("_more"))
    to_sink = F.transform(F.filter("sinks", lambda x: x["head"] != F.col("sink")), lambda x: F.struct(
        x["head"].alias("head"), x["htype"].alias("htype"), x["hname"].alias("hname"), F.lit("associated with").alias("relation"), F.col("sink").alias("tail"), F.lit(sink[0]).alias("ttype"), F.lit(sink[1]).alias("tname")
    ))
    return chosen.select(key, "root", "sink", F.when(F.col("_more"), F.concat("edges", to_sink)).otherwise(F.col("edges")).alias("edges"))


def graphs_from_text(answers: DataFrame, key: str, text: str, types: dict[str, str] | None = None, root_name: Column | None = None, sink: tuple[str, str] = ("Disease", "new disease"), gate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, ends) of ``answer_graphs``: a row for each edge, and (key, root, sink)."""
    graphs = answer_graphs(answers, key, text, types, root_name, sink, gate)
    return graphs.select(key, F.inline("edges")), graphs.select(key, "root", "sink")
