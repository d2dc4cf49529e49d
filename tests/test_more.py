"""Readers, stores, deep trees, widths: what the queries don't reach."""

import warnings

import pytest
from pyspark.sql import functions as F

from tessella.operators import cache, graph, prose_tree, relate, tree, vectors
from tessella.sources import files, logs


def test_globs_and_discovery(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.md", "a/y.TXT", "z.rs", "b.md"):
        (tmp_path / name).write_text("t")
    names = lambda found: [f.rsplit("/", 1)[-1] for f in found]
    assert names(files.discover(spark, str(tmp_path))) == ["x.md", "y.TXT", "b.md"]
    assert names(files.expand_globs(spark, [f"{tmp_path}/*.md", f"{tmp_path}/b*"])) == ["b.md"]
    with pytest.raises(files.InputError):
        files.expand_globs(spark, f"{tmp_path}/*.none")
    with pytest.raises(files.InputError):
        files.discover(spark, f"{tmp_path}/missing")


def test_json_rows(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a":1}\n\n{"a":2}\nnot json\n')
    (tmp_path / "array.json").write_text('[\n {"a":1},\n {"a":2}\n]\n')
    (tmp_path / "one.json").write_text('{\n "a": 7\n}')
    (tmp_path / "flat.json").write_text('[{"a":3},{"a":4}]')
    read = lambda name, **how: [r.value for r in files.read_json_rows(spark, f"{tmp_path}/{name}", **how).orderBy("ord").collect()]
    assert read("lines.json") == ['{"a":1}', '{"a":2}', None]
    assert read("array.json") == ['{"a":1}', '{"a":2}'] and read("one.json") == ['{"a":7}'] and read("flat.json") == ['{"a":3}', '{"a":4}']
    with pytest.raises(Exception, match="not JSON"):
        read("lines.json", strict=True)


def test_pretty_output(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert files.as_text(df, "pretty").first().line.count("\n") >= 3
    with pytest.raises(ValueError):
        files.as_text(df, "yaml")


def test_deep_trees_and_cycles(spark):
    rows = [("t", str(i), str(i - 1) if i else None, None, "n", str(i), i) for i in range(12)]
    schema = "tree_id string, id string, parent string, field string, node_type string, text string, sort int"
    nodes = tree.number_nodes(spark.createDataFrame([*rows, ("t", "x", "3", None, "n", "x", 0)], schema))
    got = sorted((r.node_id, r.parent_id, r.last, r.depth, r.text) for r in nodes.collect())
    assert got[3:6] == [(3, 2, 12, 3, "3"), (4, 3, 4, 4, "x"), (5, 3, 12, 4, "4")] and got[-1][3] == 11


@pytest.mark.parametrize("block", [2, 4096])
def test_axes_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(tree, "BLOCK", block)
    docs = spark.createDataFrame([("a.json", '{"a": [1, {"b": [2, 3]}], "c": "x"}'), ("b.json", "[[[]]]")], "path string, content string")
    nodes = tree.build(docs)
    rows = [r.asDict() for r in nodes.collect()]
    inside = {(x["tree_id"], x["node_id"], y["node_id"]) for x in rows for y in rows if x["tree_id"] == y["tree_id"] and x["node_id"] < y["node_id"] <= x["last"]}
    down = tree.descendants(nodes.withColumn("__from", F.col("node_id")), nodes)
    up = tree.ancestors(nodes.withColumn("__from", F.col("node_id")), nodes)
    assert {(r.tree_id, r["__from"], r.node_id) for r in down.collect()} == inside == {(r.tree_id, r.node_id, r["__from"]) for r in up.collect()}
    assert down.count() == len(inside)


def test_bare_levels(spark):
    lines = spark.createDataFrame([("f", 1, "ERROR api: disk full"), ("f", 2, "WARN low space"), ("f", 3, "Error in prose: no level")], "file string, line_no int, raw string")
    got = {r.line_no: (r.level_rank, r.source, r.message) for r in logs.parse_lines(lines, "bracket").collect()}
    assert got == {1: (4, "api", "disk full"), 2: (3, None, "low space"), 3: (None, None, "Error in prose: no level")}
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        logs.parse_lines(lines, "nonesuch")
    assert any("nonesuch" in str(w.message) for w in said)


def test_vector_widths(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0])], "key int, embedding array<double>")
    b = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "key int, embedding array<double>")
    with pytest.raises(Exception, match="different widths"):
        vectors.fuzzy_join(a, b, 0.1).collect()


def test_store_path(tmp_path):
    (tmp_path / graph.STORE_NAME).mkdir(parents=True)
    (tmp_path / "x/y").mkdir(parents=True)
    assert graph.store_path(str(tmp_path / "x/y"), {}) == str(tmp_path / graph.STORE_NAME)
    assert graph.store_path("/", {graph.STORE_VARIABLE: "/data/g"}) == "/data/g"
    assert graph.store_path("/", {}) is None


def test_modes():
    assert cache.mode_function("skeleton") is tree.skeleton
    with pytest.raises(ValueError):
        cache.mode_function("none")


def test_diff_of_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "p", 3), (2, "q", 4)], "k int, v string, n int")
    got = sorted((r.side, r.row_left and r.row_left.v, r.row_right and r.row_right.v) for r in relate.diff(left, right, "k", "k", ["n"]).collect())
    assert got == [("both", "a", "y"), ("both", "b", "y"), ("only_left", "c", None), ("only_right", None, "p"), ("only_right", None, "q")]


def test_document_tree_groups(spark):
    sentences = spark.createDataFrame([("d", 0, 0, "One."), ("d", 1, 1, "Two."), ("short", 0, 0, "Three.")], "doc_id string, para int, sent int, text string")
    scenes = spark.createDataFrame([("d", 0, ["Ann", "Bob"]), ("short", 0, ["Eve"])], "doc_id string, scene int, names array<string>")
    nodes = prose_tree.document_trees(sentences, scenes=scenes)
    found = tree.compile("desc:scene | {who: .names | @text}", nodes).collect()
    assert [(r.tree_id, r.who) for r in found] == [("d", "Ann, Bob")]
    assert sorted(r.text for r in tree.compile("desc:sentence", nodes).collect()) == ["One.", "Three.", "Two."]
