"""YAML corpora read by byte ranges: the records are those of the whole file, wherever ranges begin."""

import pytest
import yaml

from graphspark.sources import files


def record(k):
    text = ["plain", "two: parts - here", "- looks like a record\n- in a block", "it's \"quoted\"\n\n- x", "é日本" * (k % 7)][k % 5]
    return {
        "directed": True,
        "graph": {"_id": f"g{k}", "disease": text, "disease_mesh": "M", "drug": "d", "drug_mesh": "", "drugbank": f"DB{k}"},
        "nodes": [{"id": f"n{j}", "label": "Protein", "name": f"name {j} " * (j % 9)} for j in range(k % 11)],
        "links": [{"source": "n0", "target": f"n{j}", "key": "treats"} for j in range(k % 4)],
    }


def ids(df):
    return sorted((r.graph._id, r.graph.disease, len(r.nodes), len(r.links)) for r in df.select("graph", "nodes", "links").collect())


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("style", [{"default_flow_style": False}, {"default_flow_style": None, "width": 60}])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges, style):
    records = [record(k) for k in range(160)]
    path = tmp_path / "corpus.yaml"
    path.write_text("---\n# a comment\n" + yaml.safe_dump(records, allow_unicode=True, **style))
    df = files.read_corpus(spark, str(path))
    want = sorted((r["graph"]["_id"], r["graph"]["disease"], len(r["nodes"]), len(r["links"])) for r in records)
    assert ids(df) == want
    ranges = spark.read.option("lineSep", "\n- ").text(str(path))
    assert ranges.rdd.getNumPartitions() > 10


def test_files_of_both_kinds(spark, tmp_path):
    import json

    (tmp_path / "a.yaml").write_text(yaml.safe_dump([record(1), record(2)]))
    (tmp_path / "b.json").write_text(json.dumps([record(3)]))
    (tmp_path / "c.yml").write_text("")
    assert [r[0] for r in ids(files.read_corpus(spark, str(tmp_path)))] == ["g1", "g2", "g3"]
    (tmp_path / "gone").mkdir()
    (tmp_path / "gone" / "ids.txt").write_text("g2\n")
    assert [r[0] for r in ids(files.read_corpus(spark, str(tmp_path / "a.yaml"), str(tmp_path / "gone" / "ids.txt")))] == ["g1"]
