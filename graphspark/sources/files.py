"""Readers and writers of the files that graphs, ontologies, samples and sessions come in."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .versions import append_run, cached, runs_to_do  # noqa: F401

GRAPH = "graph struct<_id string, disease string, disease_mesh string, drug string, drug_mesh string, drugbank string>, nodes array<struct<id string, label string, name string>>, links array<struct<source string, target string, key string>>"
KG = "relation string, display_relation string, x_index long, x_id string, x_type string, x_name string, x_source string, y_index long, y_id string, y_type string, y_name string, y_source string"
SAMPLE = "drug_id string, drug_name string, disease_id string, disease_name string, is_negative_sample boolean, query_type string, edit_link_info map<string,string>"


def _yaml_record(text: str) -> list:
    """The record of a stretch between starts of records: none where it holds only marks and comments."""
    import yaml

    lines = text.split("\n")
    while lines and (not lines[0].strip() or lines[0].startswith(("---", "#", "%"))):
        lines.pop(0)
    if not lines:
        return []
    body = "\n".join(lines)
    return yaml.load(body if body.startswith("- ") else f"- {body}", getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or []


def read_corpus(spark: SparkSession, path: str, deprecated: str | None = None) -> DataFrame:
    """Graph records from YAML or JSON lists; ids in the headerless file ``deprecated`` go.

    In a YAML list "- " at the start of a line always begins a record, so files are read by byte ranges, a record by the
    task in whose range it begins: one large file is read by many tasks. A JSON file is parsed whole by one task.
    """

    def frame(records: list) -> pd.DataFrame:
        return pd.DataFrame({k: [r.get(k) for r in records if r] for k in ("graph", "nodes", "links")})

    def from_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield frame([r for text in pdf.value for r in _yaml_record(text)])

    def from_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf.content:
                yield frame(json.loads(data))

    is_json = F.lower("_metadata.file_name").endswith(".json")
    stretches = spark.read.option("lineSep", "\n- ").text(path).where(~is_json).select("value")
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("content")
    out = stretches.mapInPandas(from_yaml, GRAPH).unionAll(whole.mapInPandas(from_json, GRAPH))
    if deprecated:
        ids = spark.read.text(deprecated).select(F.trim("value").alias("id"))
        out = out.join(ids, F.col("graph._id") == ids.id, "left_anti")
    return out


def repaired(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus: (moa_id, node, type, name, role) and (moa_id, head, htype, relation, tail, ttype).

    The drug id is the MeSH id, or the DrugBank id where that is empty or a list. The first node without a way in is
    the root; if it is no drug or chemical it becomes a chemical. Nodes without a way out are diseases; one named
    "MESH..." takes the graph's disease name.
    """
    ids = lambda c: F.transform("links", lambda x: x[c])
    fresh = corpus.select("graph", "nodes", "links", ids("source").alias("s"), ids("target").alias("t"))
    first_root = F.get(F.filter(F.transform("nodes", lambda n: n["id"]), lambda i: ~F.array_contains("t", i)), 0)
    mesh = F.col("graph.drug_mesh")
    drug = F.when(mesh.isNull() | (mesh == "") | mesh.contains(","), F.col("graph.drugbank")).otherwise(mesh)
    rooted = fresh.withColumn("root", F.coalesce(first_root, drug))

    def node(n):
        sink = ~F.array_contains("s", n["id"]) & F.array_contains("t", n["id"])
        root = n["id"] == F.col("root")
        kind = F.when(sink, "Disease").when(root & ~n["label"].isin("Drug", "ChemicalSubstance"), "ChemicalSubstance").otherwise(n["label"])
        name = F.when(sink & n["name"].startswith("MESH"), F.col("graph.disease")).otherwise(n["name"])
        return F.struct(n["id"].alias("node"), kind.alias("type"), name.alias("name"), F.when(root, "root").when(sink, "sink").alias("role"))

    nodes = rooted.select(F.col("graph._id").alias("moa_id"), F.inline(F.transform("nodes", node))).dropDuplicates(["moa_id", "node"])
    links = rooted.select(F.col("graph._id").alias("moa_id"), F.explode("links").alias("l")).select(
        "moa_id", F.col("l.source").alias("head"), F.col("l.key").alias("relation"), F.col("l.target").alias("tail")
    ).distinct()
    typed = lambda e: nodes.select("moa_id", F.col("node").alias(e), F.col("type").alias("htype" if e == "head" else "ttype"))
    edges = links.join(typed("head"), ["moa_id", "head"]).join(typed("tail"), ["moa_id", "tail"])
    return nodes, edges.select("moa_id", "head", "htype", "relation", "tail", "ttype")


def read_kg(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Knowledge graph rows of a CSV file with a header; ids stay strings. A gzipped file is one task's: its rows are dealt anew, in ``parts`` or as many as shuffles have."""
    rows = spark.read.schema(KG).option("header", True).csv(path)
    return rows.repartition(parts) if parts else rows.repartition("x_index")


# The types of nodes that the parts of a relation's name stand for.
RELATION_TYPES = {
    "anatomy": "anatomy", "bioprocess": "biological_process", "cellcomp": "cellular_component", "disease": "disease", "drug": "drug", "effect": "effect/phenotype",
    "exposure": "exposure", "molfunc": "molecular_function", "pathway": "pathway", "phenotype": "effect/phenotype", "protein": "gene/protein",
}


def kg_tables(rows: DataFrame, xrefs: DataFrame | None = None, parents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes with all their names; distinct edges, their relation named by the types of their ends, ``rev-`` where swapped.

    A relation's first two parts name its end types (one part alone: drug and disease); a row whose types fit neither way
    is an error when it is read. xrefs (id, xrefs): cross-references of terms, joined to nodes by their compound ids.
    parents (child, parent): with it, edges between diseases point from parent to child, and a pair that it doesn't know
    is an error; without it they stay as they are.
    """
    side = lambda s: rows.select(*(F.col(f"{s}_{c}").alias(c) for c in ("index", "id", "type", "name", "source")))
    nodes = side("x").unionByName(side("y")).groupBy("index", "id", "type", "source").agg(F.array_sort(F.collect_set("name")).alias("names"))
    if xrefs is not None:
        known = nodes.select("index", F.explode(F.transform(F.split("id", "_"), lambda x: F.lpad(x, 7, F.lit("0")))).alias("part")).join(xrefs.select(F.col("id").alias("part"), "xrefs"), "part")
        known = known.groupBy("index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("xrefs")))).alias("xrefs"))
        nodes = nodes.join(known, "index", "left")
    parts = F.split("relation", "_")
    table = F.create_map(*(F.lit(x) for kv in RELATION_TYPES.items() for x in kv))
    first = F.when(F.size(parts) >= 2, F.element_at(table, parts[0])).otherwise("drug")
    second = F.when(F.size(parts) >= 2, F.element_at(table, parts[1])).otherwise("disease")
    fits = (first == F.col("x_type")) & (second == F.col("y_type"))
    swapped = (first == F.col("y_type")) & (second == F.col("x_type"))
    way = F.when(fits, False).when(swapped, True)
    if parents is not None:
        own = rows.where((F.col("x_type") == "disease") & (F.col("y_type") == "disease")).select("x_id", "y_id").distinct()
        split = lambda c, n: F.explode(F.transform(F.split(c, "_"), lambda x: F.lpad(x, 7, F.lit("0")))).alias(n)
        each = own.select("x_id", "y_id", split("x_id", "a")).select("*", split("y_id", "b"))
        p = parents.select("child", "parent").distinct()
        down = each.join(p, (p.parent == each.a) & (p.child == each.b)).select("x_id", "y_id").distinct().withColumn("_down", F.lit(True))
        up = each.join(p, (p.parent == each.b) & (p.child == each.a)).select("x_id", "y_id").distinct().withColumn("_up", F.lit(True))
        rows = rows.join(down, ["x_id", "y_id"], "left").join(up, ["x_id", "y_id"], "left")
        both = (first == "disease") & (second == "disease")
        way = F.when(both, F.when(F.col("_down"), False).when(F.col("_up"), True)).otherwise(way)
    checked = F.coalesce(way, F.raise_error(F.concat(F.lit("unrecognised types in a row of relation "), F.col("relation"))).cast("boolean"))
    name = lambda c: F.when(checked, F.concat(F.lit("rev-"), c)).otherwise(F.col(c)).alias(c)
    edges = rows.select("x_index", "x_type", name("relation"), name("display_relation"), "y_index", "y_type").distinct()
    return nodes, edges


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an OBO file: id, name, exact synonyms, xrefs, parents, is_obsolete; stanzas are records of the reader."""
    text = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike("^\\s*\\[Term\\]"))
    one = lambda tag: F.regexp_extract("value", f"(?m)^{tag}: (.+?)\\s*$", 1)
    many = lambda pattern: F.regexp_extract_all("value", F.lit(f"(?m)^{pattern}"), F.lit(1))
    return text.select(
        one("id").alias("id"), one("name").alias("name"), many('synonym: "([^"]*)" EXACT').alias("synonyms"), many("xref: (\\S+)").alias("xrefs"),
        many("is_a: (\\S+)").alias("parents"), (one("is_obsolete") == "true").alias("is_obsolete"),
    )


def ontology_edges(terms: DataFrame) -> DataFrame:
    """Both directions of each parent: child_of and parent_of."""
    up = terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    both = F.array(F.struct(F.col("child").alias("x"), F.lit("child_of").alias("relation"), F.col("parent").alias("y")), F.struct(F.col("parent").alias("x"), F.lit("parent_of").alias("relation"), F.col("child").alias("y")))
    return up.select(F.explode(both).alias("e")).select("e.*")


def read_samples(spark: SparkSession, path: str, start: int = 0, count: int | None = None) -> DataFrame:
    """Query samples of JSON lists with the file that they come from, paged in a stable order."""
    df = spark.read.schema(SAMPLE).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    df = df.orderBy("file", "drug_id", "disease_id", "query_type")
    df = df.offset(start) if start else df
    return df.limit(count) if count is not None else df


def write_session(df: DataFrame, path: str, args: dict) -> None:
    """A session's answers as JSON lines by model, and its arguments beside them."""
    df.write.mode("overwrite").partitionBy("model").json(f"{path}/session")
    df.sparkSession.createDataFrame([(json.dumps(args, sort_keys=True),)], "args string").coalesce(1).write.mode("overwrite").text(f"{path}/args")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a local session where it is unset gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="graphspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def write_session_files(df: DataFrame, path: str, dataset: str, model: str, run: str) -> None:
    """Answers as JSON lines under <path>/<dataset>/<model>/run<n>: what a reader needs to know stands in the path.

    Characters of names that paths can't have are escaped by Spark; null models and runs have a folder of their own.
    """
    marked = df.withColumns({"model": F.col(model), "run": F.col(run), "dataset": F.lit(dataset)})
    marked.write.mode("overwrite").partitionBy("dataset", "model", "run").json(path)


def read_session_files(spark: SparkSession, path: str, schema: str, pattern: str = "dataset=([^/]+)/model=([^/]+)/run=([^/]+)/") -> DataFrame:
    """The rows of all session files below ``path``, with ``dataset``, ``model``, ``run`` and ``file`` from each file's path.

    A file whose path doesn't fit has nulls there; a folder without files is an error of Spark.
    """
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    part = lambda k: F.nullif(F.regexp_extract("file", pattern, k), F.lit(""))
    plain = lambda c: F.url_decode(F.replace(F.replace(c, F.lit("%25"), F.lit("%")), F.lit("+"), F.lit("%2B")))  # noqa: E731  # the path is escaped, then made a URI
    return df.withColumns({n: plain(part(k)) for k, n in enumerate(("dataset", "model", "run"), 1)})


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Rows as CSV with a header; ``one_file`` for results that one task can hold."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, typed; a value that doesn't fit is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def _cells(df: DataFrame, rows: int) -> tuple[list[tuple[str, ...]], int]:
    """The first rows as text, and how many there are at all."""
    data = [tuple("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) for r in df.limit(rows + 1).collect()]
    return data[:rows], df.count() if len(data) > rows else len(data)


def render(df: DataFrame, style: str = "markdown", rows: int = 1000, caption: str | None = None) -> str:
    """A small result as a table: "markdown", "tsv" or "fixed" width. Where it has more rows, the last line says how many are left out."""
    data, total = _cells(df, rows)
    head = tuple(df.columns)
    if style == "tsv":
        out = ["\t".join(r) for r in [head, *data]]
    elif style == "fixed":
        width = [max(len(r[k]) for r in [head, *data]) for k in range(len(head))]
        numbers = [bool(data) and all(r[k] == "" or r[k].lstrip("-").replace(".", "", 1).isdigit() for r in data) for k in range(len(head))]
        line = lambda r: "  ".join(v.rjust(w) if n else v.ljust(w) for v, w, n in zip(r, width, numbers)).rstrip()
        out = [line(head), "  ".join("-" * w for w in width), *map(line, data)]
    else:
        line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r) + " |"
        out = [line(head), line(["---"] * len(head)), *map(line, data)]
    if caption:
        out = [caption, "=" * len(caption), *out]
    return "\n".join(out + ([f"... {total - rows} more rows"] if total > rows else []))


def counts_table(df: DataFrame, count: str, order: list | None = None, running: bool = False) -> DataFrame:
    """A small table of counts with ``pct``, on request the running total and ``running_pct``, and a row "SUM".

    Rows come by descending count, then by the other columns, or in ``order``. The first column is text.
    """
    first, others = df.columns[0], [c for c in df.columns[1:] if c != count]
    every = Window.partitionBy()
    by = order or [F.desc(count), *(c for c in df.columns if c != count)]
    share = lambda c: F.round(100.0 * c / F.sum(count).over(every), 6)
    so_far = F.sum(count).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))  # a few rows
    extra = {"pct": share(F.col(count))} | ({"running": so_far, "running_pct": share(so_far)} if running else {})
    body = df.withColumn(first, F.col(first).cast("string")).withColumns(extra)
    total = df.agg(F.sum(count).alias(count))
    last = total.select(F.lit("SUM").alias(first), *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in others), count, F.lit(100.0).alias("pct"), *((F.lit(None).cast(body.schema[c].dataType).alias(c)) for c in extra if c != "pct"))
    return body.select(*last.columns).unionByName(last)


def keyed_rows(rows: dict[str, dict[str, object]], spark: SparkSession, key: str = "key") -> DataFrame:
    """A small dict of dicts as a table: a row for each outer key, a column for each inner one, null where it is missing."""
    columns = sorted({c for r in rows.values() for c in r})
    return spark.createDataFrame([(k, *(None if r.get(c) is None else str(r[c]) for c in columns)) for k, r in rows.items()], ", ".join(f"`{c}` string" for c in (key, *columns)))


def json_rows(df: DataFrame) -> DataFrame:
    """(json): every row as JSON, NaN and nulls kept as they are written by Spark."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def read_options(kind: type, path: str):
    """An options dataclass from a JSON file: unknown names are an error, missing ones take their defaults."""
    with open(path) as f:
        given = json.load(f)
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return kind(**given)


def write_options(options, path: str) -> None:
    with open(path, "w") as f:
        json.dump(asdict(options), f, sort_keys=True, indent=1)
