from graphspark.operators import entities


def test_resolve_follows_chains_of_any_length(spark):
    """Records 0-1-2-...-40 share one name each with the next; two others stand alone."""
    n = 40
    rows = [(k, [f"n{k}", f"n{k + 1}"]) for k in range(n)] + [(100, ["x"]), (101, [""]), (102, ["y", "x"])]
    got = {r.id: r.entity for r in entities.resolve(spark.createDataFrame(rows, "id long, names array<string>").repartition(3), "id", "names").collect()}
    assert got == {k: 0 for k in range(n)} | {100: 100, 101: 101, 102: 100}


FAMILIES = [
    (1, "Statins (STN) (e.g. Simvastatin, Lovastatin)", ["HMG-CoA inhibitors", "Old name (for Rosuvastatin, Pravastatin)"], ["simvastatin", "Atorvastatin (ATV)"]),
    (2, "Lipitor", ["ATORVASTATIN"], []),
    (3, "Aspirin", None, None),
]
SCHEMA = "id long, name string, alternates array<string>, examples array<string>"


def test_families_become_drugs_that_merge(spark):
    drugs, origin = entities.expand_families(spark.createDataFrame(FAMILIES, SCHEMA), "id", "name", "alternates", "examples")
    rows = {r.entity: r for r in drugs.collect()}
    own = ["HMG-CoA inhibitors", "STN", "Statins"]
    names = {frozenset([r.name, *r.alternates]): r.families for r in rows.values()}
    assert names == {
        frozenset(["Atorvastatin", "ATV", "ATORVASTATIN", "Lipitor"]): own, frozenset(["Simvastatin"]): own, frozenset(["Lovastatin"]): own,
        frozenset(["Old name"]): own, frozenset(["Rosuvastatin"]): own, frozenset(["Pravastatin"]): own, frozenset(["Aspirin"]): [],
    }
    ixn = spark.createDataFrame([(1, 3)], "x long, y long")
    assert entities.rewired(ixn, origin, "id", "x", "y").count() == 6


def test_lookup_by_name_alternate_and_family(spark):
    e = spark.createDataFrame([(1, "Crème Statin", ["ATV-1"], ["Lipid drugs"]), (2, "Other", [], ["Lipid drugs"])], "id long, name string, alternates array<string>, families array<string>")
    asked = spark.createDataFrame([("creme statin",), ("atv 1",), ("statin",), ("lipid-drugs",), ("absent",)], "mention string")
    get = lambda **k: sorted((r.mention, r.id) for r in entities.lookup(asked, "mention", e, "id", "name", "alternates", **k).collect())
    exact = [("atv 1", 1), ("creme statin", 1)]
    assert get() == exact
    assert get(substring=True) == sorted([*exact, ("statin", 1)])
    assert get(families="families") == sorted([*exact, ("lipid-drugs", 1), ("lipid-drugs", 2)])


def test_numbers_within_a_value(spark):
    from graphspark.operators import knowledge

    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), (None, 5), (None, 4), ("a", 2)], "k string, v int").repartition(4)
    got = {(r.k, r.v, r.at) for r in knowledge.numbered(df, "k", ["v"], "at").collect()}
    assert got == {("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 9, 1), (None, 4, 1), (None, 5, 2)}
    assert knowledge.numbered(df.limit(0), "k", ["v"], "at").count() == 0


def test_paths_in_a_large_graph(spark):
    from graphspark.operators import knowledge

    e = spark.createDataFrame([("a", "T", "r", "b", "T"), ("b", "T", "r", "c", "U"), ("a", "T", "s", "d", "T"), ("d", "T", "r", "c", "U"), ("c", "U", "r", "a", "T"), (None, "T", "r", "a", "T")], "x string, xtype string, relation string, y string, ytype string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r.path) for r in knowledge.paths_from(e, start).collect()} == {("a", "b"), ("a", "d"), ("a", "b", "c")}
    assert {tuple(r.path) for r in knowledge.paths_from(e, start, every=True).where("node = 'c'").collect()} == {("a", "b", "c"), ("a", "d", "c")}
    assert {tuple(r.path) for r in knowledge.paths_from(e, start, most=1, back=True).where("size(path) > 1").collect()} == {("c", "a")}
    assert knowledge.paths_from(e.limit(0), start).count() == 0
