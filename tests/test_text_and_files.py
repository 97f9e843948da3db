import gzip
import json

import pytest
from pyspark.sql import functions as F

from graphspark.functions import models, text as t
from graphspark.operators import matching as m, statistics as s
from graphspark.sources import files
from graphspark.streaming import counts


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_name_parser(spark):
    x = value(spark, t.parse_name(F.lit("Some Receptor (PPAR-g) Agonists (PPARG-A) (e.g. AB1, CD ef-2x)")))
    assert (x.main, x.alternates, x.examples) == ("Some Receptor Agonists", ["PPAR-g", "PPARG-A"], ["AB1", "CD ef-2x"])


@pytest.mark.parametrize("line, want", [("YES.", "YES"), ("no way", "NO"), ("Note: x", "NO"), ("maybe", None), ("", None)])
def test_yes_no(spark, line, want):
    assert value(spark, t.yes_no(F.lit(line))) == want


def test_edge_lines(spark):
    assert value(spark, t.edge_line(F.lit("a | b"))) is None
    assert tuple(value(spark, t.edge_line(F.lit("a | b | c | d")))) == ("a", "b + c", "d")
    assert tuple(value(spark, t.edge_line(F.lit("Disease: new disease | r | Drug: a")))) == ("Drug: a", "r", "Disease: new disease")


def test_tokens_and_names(spark):
    assert value(spark, t.tokenize(F.lit("PPAR-γ_x 12"))) == ["ppar", "gamma", "x", "12"]
    assert value(spark, t.normalize_name(F.lit("Crème-Brûlée!"))) == "creme brulee"
    assert value(spark, t.english_join(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"


def test_greedy_mapping_is_one_to_one(spark):
    df = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.8), (1, "b", "y", 0.7)], "g int, ref string, target string, score double")
    assert sorted((r.ref, r.target) for r in m.greedy_mapping(df, ["g"]).collect()) == [("a", "x"), ("b", "y")]


def test_metrics(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "y boolean, p boolean")
    r = s.binary_metrics(df, F.col("y"), F.col("p")).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5, 0.5)
    assert s.binary_metrics(df.where("NOT y AND NOT p"), F.col("y"), F.col("p")).first().f1 == 0.0


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(400).select((F.col("id") % 4 == 0).alias("ok"), (F.col("id") % 2).alias("g"))
    r = s.stratified_bootstrap(df, F.col("ok"), "g", replicates=500).first()
    assert r.low < r.mean == 0.25 < r.high and r.n == 400


def test_ontology_and_kg(spark, tmp_path):
    (tmp_path / "o.obo").write_text('format-version: 1\n\n[Term]\nid: A:1\nname: one\nsynonym: "uno" EXACT []\nxref: M:1\n\n[Term]\nid: A:2\nname: two\nis_a: A:1 ! one\nis_obsolete: true\n')
    terms = {r.id: r for r in files.read_obo(spark, str(tmp_path / "o.obo")).collect()}
    assert terms["A:1"].synonyms == ["uno"] and terms["A:2"].parents == ["A:1"] and terms["A:2"].is_obsolete
    head = "relation,display_relation,x_index,x_id,x_type,x_name,x_source,y_index,y_id,y_type,y_name,y_source\n"
    with gzip.open(tmp_path / "kg.csv.gz", "wt") as f:
        f.write(head + "drug_protein,target,1,07,drug,d,S,2,9,gene/protein,p,S\ndrug_protein,target,2,9,gene/protein,p,S,1,07,drug,d,S\n")
    nodes, edges = files.kg_tables(files.read_kg(spark, str(tmp_path / "kg.csv.gz")))
    assert {r.id for r in nodes.collect()} == {"07", "9"}
    assert sorted(r.relation for r in edges.collect()) == ["drug_protein", "rev-drug_protein"]


def test_corpus_repair(spark, tmp_path):
    graph = {"graph": {"_id": "g1", "disease": "flu", "disease_mesh": "M", "drug": "d", "drug_mesh": "", "drugbank": "DB1"}, "nodes": [{"id": "DB1", "label": "Protein", "name": "d"}, {"id": "X", "label": "Phenotype", "name": "MESH:9"}], "links": [{"source": "DB1", "target": "X", "key": "treats"}]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(json.dumps([graph, graph | {"graph": graph["graph"] | {"_id": "old"}}]))
    (tmp_path / "ids.txt").write_text("old\n")
    nodes, edges = files.repaired(files.read_corpus(spark, str(tmp_path / "c"), str(tmp_path / "ids.txt")))
    assert sorted((r.type, r.name, r.role) for r in nodes.collect()) == [("ChemicalSubstance", "d", "root"), ("Disease", "flu", "sink")]
    assert edges.count() == 1


def test_cache_and_run_log(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for options in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert files.cached(spark, str(tmp_path / "t"), options, build).count() == 3
    assert len(calls) == 2
    files.append_run(spark.range(1), str(tmp_path / "log"), "t1", 0)
    assert {r.task: r.remaining for r in files.runs_to_do(spark, str(tmp_path / "log"), {"t1": 2, "t2": 1}).collect()} == {"t1": 1, "t2": 1}
    assert files.render(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_models(spark):
    df = spark.createDataFrame([("aspirin",)], "drug string").select(models.prompt("Is {drug} safe?", drug=F.col("drug")).alias("p"))
    assert models.ask(df, "p").first().answer == "NO\nIs aspirin safe?"


def test_stream_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = counts.running_counts(counts.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("c").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n) for r in spark.table("c").collect()} == {(r.event_type, r["count"]) for r in events.groupBy("event_type").count().collect()}


def test_recovered_lines(spark):
    lines = {
        "Drug: a | treats | Disease: b": ("Drug: a", "treats", "Disease: b"), "a | r | b": ("a", "r", "b"), "a | r | s | b": ("a", "r + s", "b"),
        "Drug: a | converts | Protein: p | Disease: b": ("Drug: a", "converts + Protein: p", "Disease: b"), "x | Drug: a | y | Disease: b | z": ("Drug: a", "x + y + z", "Disease: b"),
        "a | r | Disease: b": ("a", "r", "Disease: b"), "Drug: a | r | b": ("Drug: a", "r + b", "Drug: a"),
        "Disease: new disease | r | Drug: a": ("Drug: a", "r", "Disease: new disease"), "a | b": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {r.line: r.e and tuple(r.e) for r in df.select("line", t.edge_line(F.col("line")).alias("e")).collect()}
    assert got == lines


def test_names_and_letters(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(t.hyphen_variants(F.lit("A-Bc-D"))) == ["A-Bc D", "A-Bcd", "A Bc-D", "A Bc D", "A Bcd", "ABc-D", "ABc D", "ABcd"]
    assert one(t.hyphen_variants(F.lit("-x"))) == [] and one(t.hyphen_variants(F.lit("x-"))) == [] and one(t.hyphen_variants(F.lit("plain"))) == []
    assert one(t.decomposed(F.lit("Ünïcode ﬁsh ½ Ⅳ"))) == "Unicode fish 1⁄2 IV"
    assert one(t.normalize_name(F.lit(" TNF-α_Ångström "))) == "tnf alpha angstrom"
    assert one(t.ascii_text(F.lit("Ωmega – здоров"))) == "Omegamega - zedeoeroevee" or one(t.ascii_text(F.lit("é"))) == "e"
    assert one(t.file_name(F.lit("A rather  long name, indeed"))) == "a_rather_long_name_iZ"
    assert tuple(one(t.names_and_examples(F.array(F.lit("b"), F.lit("X (for Y, Z)"), F.lit("a"))))) == (["a", "b"], ["X", "Y", "Z"])
    assert [tuple(x) for x in one(t.type_pattern(F.lit("eff.3+, gen, q.1"), ["gene", "effect"]))] == [("effect", 3), ("gene", 1)]
    assert tuple(one(t.difference(F.lit("abcxef"), F.lit("abyyef")))) == ("ab", "cx", "yy", "ef", 2)
    assert [t.stem(w) for w in ("ponies", "running", "hopes", "agreed", "relational", "happy", "sky")] == ["poni", "run", "hope", "agree", "relat", "happi", "sky"]


def test_session_files_say_what_they_are(spark, tmp_path):
    df = spark.createDataFrame([("gpt/4", 1, 0.5), ("b c", 2, None)], "model string, run int, score double")
    files.write_session_files(df, str(tmp_path / "s"), "edit=x", "model", "run")
    got = {(r.dataset, r.model, r.run, r.score) for r in files.read_session_files(spark, str(tmp_path / "s"), "score double").collect()}
    assert got == {("edit=x", "gpt/4", "1", 0.5), ("edit=x", "b c", "2", None)}


def test_tables_say_what_they_leave_out(spark):
    df = spark.createDataFrame([("a|b", 10), ("c", 2), (None, 1)], "name string, n int")
    assert files.render(df, rows=2).endswith("... 1 more rows") and "a\\|b" in files.render(df)
    fixed = files.render(df, "fixed", caption="Names").split("\n")
    assert fixed[0] == "Names" and fixed[4] == "a|b   10" and fixed[5] == "c      2"
    sums = files.counts_table(df, "n", running=True).collect()
    assert [(r.name, r.n, r.running) for r in sums] == [("a|b", 10, 10), ("c", 2, 12), (None, 1, 13), ("SUM", 13, None)]
    assert files.keyed_rows({"x": {"b": 1}, "y": {"a": 2}}, spark).columns == ["key", "a", "b"]
    assert files.json_rows(df).where("json LIKE '%null%'").count() == 1


def test_options_files(tmp_path):
    from dataclasses import dataclass

    @dataclass
    class Options:
        runs: int = 5
        name: str = "x"

    path = str(tmp_path / "o.json")
    files.write_options(Options(3), path)
    assert files.read_options(Options, path) == Options(3, "x")
    (tmp_path / "o.json").write_text('{"rnus": 3}')
    with pytest.raises(ValueError, match="rnus"):
        files.read_options(Options, path)


def test_failed_calls_are_tried_again(spark):
    def client():
        seen = {}

        def call(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "never" or seen[text] < 3:
                raise RuntimeError("busy")
            return text.upper()

        return call

    df = spark.createDataFrame([("a",), ("never",), (None,)], "p string")
    got = {r.p: (r.answer, r.answer_error) for r in models.ask(df, "p", client, attempts=3, pause=0.001).collect()}
    assert got == {"a": ("A", None), "never": (None, "busy"), None: (None, None)}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from graphspark.streaming import counts

    spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01 00:10:00' AS ts, 1L AS user_id, 'view' AS event_type, 2.0D AS value, '{}' AS props UNION ALL SELECT 2L, timestamp'2024-01-01 00:20:00', 2L, 'view', 3.0D, '{}' UNION ALL SELECT 3L, timestamp'2024-01-01 03:00:00', 2L, 'click', 1.0D, '{}'").write.parquet(str(tmp_path / "in"))
    q = counts.windowed(counts.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.event_type, r.n, r.total) for r in spark.table("w").collect()} == {("view", 2, 5.0), ("click", 1, 1.0)}


def test_relations_between_types(spark):
    from graphspark.sources.files import KG

    row = lambda r, x, xt, y, yt: (r, r, x, f"{x:07d}", xt, f"n{x}", "S", y, f"{y:07d}", yt, f"n{y}", "S")
    rows = lambda *r: spark.createDataFrame(list(r), KG)
    dd = row("disease_disease", 1, "disease", 2, "disease"), row("disease_disease", 2, "disease", 1, "disease")
    _, edges = files.kg_tables(rows(row("indication", 3, "drug", 1, "disease"), row("indication", 3, "drug", 1, "disease"), *dd))
    assert sorted((r.relation, r.x_index) for r in edges.collect()) == [("disease_disease", 1), ("disease_disease", 2), ("indication", 3)]
    parents = spark.createDataFrame([("0000002", "0000001")], "child string, parent string")
    xrefs = spark.createDataFrame([("0000001", ["M:1"])], "id string, xrefs array<string>")
    nodes, edges = files.kg_tables(rows(*dd), xrefs, parents)
    assert sorted((r.relation, r.x_index) for r in edges.collect()) == [("disease_disease", 1), ("rev-disease_disease", 2)]
    assert {r["index"]: r.xrefs for r in nodes.collect()} == {1: ["M:1"], 2: None}
    with pytest.raises(Exception, match="unrecognised types"):
        files.kg_tables(rows(row("anatomy_protein_present", 1, "drug", 2, "disease")))[1].collect()


def test_graphs_from_answers(spark):
    from graphspark.operators import entities

    answers = [
        (1, "Hm.\nYES\nDrug: a | r | Gene: p\nGene: p | s | Disease: x\nGene: p | s | Disease: y\nChemical: q | t | Gene: p", "A"),
        (2, "NO\nDrug: a | r | Gene: p", "A"), (3, "maybe", "A"), (4, None, None), (5, "yes,\nDrug: a | r | Disease: new disease\nDrug: a | r | Gene: p", "b"),
    ]
    df = spark.createDataFrame(answers, "k int, text string, drug string")
    edges, ends = entities.graphs_from_text(df, "k", "text", {"Gene": "Protein"}, F.col("drug"))
    assert {tuple(r) for r in ends.collect()} == {(1, "Drug.1", "Disease.3"), (5, "Drug.1", "Disease.1")}
    assert {(r.head, r.relation, r.tail) for r in edges.where("k = 1").collect()} == {("Drug.1", "r", "Protein.1"), ("Protein.1", "s", "Disease.1"), ("Protein.1", "s", "Disease.2"), ("Chemical.1", "t", "Protein.1"), ("Disease.1", "associated with", "Disease.3"), ("Disease.2", "associated with", "Disease.3")}


def test_lines_of_answers_are_read_once_where_they_are_dealt(spark):
    from graphspark import catalog
    from graphspark.functions import text as t

    plan = catalog.queries()["graphs_from_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "hashpartitioning" in x]
    assert len(dealt) == 2 and all("l_orderkey" in x or "o_orderkey" in x for x in dealt)
    assert sum("FileScan" in x and "l_orderkey" in x for x in plan.split("\n")) == 1
    line = spark.range(1).select(t.edge_line(F.lit("a | r | b")).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert line.lower().count("split(") == 1 and line.lower().count("rlike") == 3


def test_graphs_of_answers_without_a_gate(spark):
    from graphspark.operators import entities

    answers = [
        (1, "NO\nDrug: a | r | Gene: p\nDrug: a | r | Gene: p\nGene: p | s | Gene: p\nDrug: b | r | Gene: p"),
        (2, "Drug: a | r | Disease: x\nDrug: b | r | disease: New Disease"), (None, "Drug: a | r | Gene: p"), (3, "a | b"), (4, None),
    ]
    df = spark.createDataFrame(answers, "k int, text string")
    graphs = {x.k: x for x in entities.answer_graphs(df, "k", "text", {"Gene": "Protein"}, F.lit("B"), gate=False).collect()}
    of = lambda k: sorted((e.head, e.relation, e.tail) for e in graphs[k].edges)
    assert set(graphs) == {1, 2} and of(1) == [("Drug.1", "r", "Protein.1"), ("Drug.2", "r", "Protein.1"), ("Protein.1", "s", "Protein.1")]
    assert graphs[2].sink == "disease.1" and of(2) == [("Drug.1", "r", "Disease.1"), ("Drug.2", "r", "disease.1")]
    assert (graphs[1].root, graphs[1].sink) == ("Drug.2", None) and graphs[2].root == "Drug.2"
    edges, ends = entities.graphs_from_text(df, "k", "text", {"Gene": "Protein"}, F.lit("B"), gate=False)
    assert edges.columns == ["k", "head", "htype", "hname", "relation", "tail", "ttype", "tname"] and edges.count() == len(graphs[1].edges) + len(graphs[2].edges)
    assert {tuple(x) for x in ends.collect()} == {(x.k, x.root, x.sink) for x in graphs.values()}
