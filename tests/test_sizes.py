"""Steps that once held a whole group, run or tree, or compared all with all."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella import queries, queries_text  # noqa: F401  it registers into queries
from tessella.operators import drain, prose, relate, tree
from tessella.plans import tree_query as tq
from tessella.sources import test_output


@pytest.mark.parametrize(("few", "indexed"), [(0, 0), (0, 10**9), (10**9, 0)])
def test_clusters_by_table_and_index_are_those_by_loops(monkeypatch, few, indexed):
    """Clusters found word by word, by the table of templates and by the index of rare words are the same."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(["head", *(vocabulary[min(39, int(r.expovariate(0.15)))] for _ in range(r.choice((1, 4, 9))))]) for _ in range(600)]

    def plain(messages):
        templates, counts = {}, {}
        for m in messages:
            words = m.split()
            mine = templates.setdefault(len(words), [])
            likeness = [sum(t in (None, w) for t, w in zip(x, words)) / len(words) for x in mine]
            best = max(range(len(mine)), key=lambda i: (likeness[i], -i), default=None)
            if best is None or likeness[best] < drain.THRESHOLD:
                mine.append(words)
                best = len(mine) - 1
            else:
                mine[best] = [t if t == w else None for t, w in zip(mine[best], words)]
            counts[len(words), best] = counts.get((len(words), best), 0) + 1
        return sorted((" ".join("<*>" if t is None else t for t in templates[n][i]), k) for (n, i), k in counts.items())

    monkeypatch.setattr(drain, "FEW", few)
    monkeypatch.setattr(drain, "INDEXED", indexed)
    assert sorted((t, n) for t, n, _ in drain.mine(texts)) == plain(texts)


def test_mining_streams_groups(spark):
    """No group is a call of its own, and rows leave in batches of bounded size."""
    lines = spark.range(3000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.concat_ws(" ", F.concat(F.lit("h"), F.col("id") % 1000), F.lit("a"), "id").alias("message"))
    out = drain.mine_patterns(lines)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert {(r["count"], len(r.samples)) for r in out.collect()} == {(3, 3)} and out.count() == 1000
    batch = pa.RecordBatch.from_pydict({"length": [1] * 50, "head": [f"h{i}" for i in range(50)], "message": [f"h{i}" for i in range(50)], "n": [1] * 50})
    assert [b.num_rows for b in drain._clustered([batch], rows=20)] == [20, 20, 10]


def test_evaluation_gathers_only_what_a_query_looks_at(spark):
    """A tree of 3 levels: the query's depth says which nodes come together; what is counted deeper is the same."""
    root = tq.Node("a", children=[tq.Node("b", str(i), children=[tq.Node("c", children=[tq.Node("b")] * (i % 2)) for _ in range(i)]) for i in range(4)])
    rows = tree.flatten(root, "t")
    nodes = spark.createDataFrame(rows, tree.NODES)
    for text, depth in (
        ('count_desc("b")', 0), ('[children | count_desc("b")]', 1), ('[children | @text | ascii_downcase]', 1), ('[children | length]', 2), ('{n: count_desc("c"), k: [children | children[0] | count_desc("b")]}', 2), ("[children] | map(first | @type)", 2),
        ("[desc | @type]", math.inf), ('[children | select(has("x") | not) | siblings | @text]', 2), ('"\\(count_desc("b")) \\(length)"', 1), ("match(a > b)", math.inf), ("[desc(2)] | length", 3), ('if children[1] | has("x") then desc else [parent] end', math.inf),
    ):
        e = tq.parse(text)
        assert tree._reach(e, 0, set())[1] == depth, text
        want = [tq.dumps(v) for v in tq.run(e, tree.rebuild([dict(zip(tree.NAMES, x)) for x in rows]))]
        assert [r.value for r in tree.evaluate(text, nodes).orderBy("ord").collect()] == want, text
    assert tree._within(nodes, 0, {"b"}).count() == 1


def _pieces(text: str, n: int, fmt: str) -> list[pa.RecordBatch]:
    lines = text.split("\n")
    return [pa.RecordBatch.from_pydict({"run_id": ["r"] * len(x), "first": [k + i == 0 for i in range(len(x))], "format": [fmt] * len(x), "line": x}) for k in range(0, len(lines), n) if (x := lines[k : k + n])]


def test_runs_are_parsed_line_by_line(monkeypatch):
    """What later lines say reaches results that are packed already; results leave in batches of bounded size."""
    monkeypatch.setattr(test_output, "PACK", 2)
    names = [f"t{i}" for i in range(5)]
    text = "\n".join([*(f"test {n} ... FAILED" for n in names), "---- t1 stdout ----", "why", "test result: FAILED"])
    for n in (1, 3, 100):
        got = list(test_output._parsed(_pieces(text, n, "libtest")))
        assert [b.num_rows for b in got] == [2, 2, 1]
        assert [(r["ord"], r["name"], r["message"]) for b in got for r in b.to_pylist()] == [(i, n, "why" if i == 1 else None) for i, n in enumerate(names)]
    text = "\n".join([*(f"--- PASS: {n} (0.00s)" for n in names), "ok  \tp\t0.1s", "--- PASS: u (0.00s)"])
    assert [r["suite"] for b in test_output._parsed(_pieces(text, 2, "gotest")) for r in b.to_pylist()] == ["p"] * 5 + [None]
    text = "\n".join(["m.py::a PASSED", "m.py::b FAILED", "m.py::c PASSED", "FAILED m.py::b - no", "FAILED m.py::d - never"])
    assert [(r["name"], r["message"]) for b in test_output._parsed(_pieces(text, 2, "pytest")) for r in b.to_pylist()] == [("m.py::a", None), ("m.py::b", "no"), ("m.py::c", None), ("m.py::d", "never")]
    cases = "\n".join(f'<testcase name="{n}"/>' for n in names)
    for end, want in (("</testsuite>", 5), ("</wrong>", 0)):  # a text that is refused at its end has no results
        assert sum(b.num_rows for b in test_output._parsed(_pieces(f'\n<!DOCTYPE\nx><testsuite name="s">\n{cases}\n{end}', 2, "junit"))) == want


def test_lines_of_runs_are_not_gathered(spark):
    """Runs come as sorted lines, no text of a run is made, and results are those of the texts."""
    lines = spark.range(300).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), (-F.col("id")).alias("ord"), F.concat(F.lit("ok 1 - case "), "id").alias("line"))
    out = test_output.parse_lines(lines)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert "collect_list" not in queries.QUERIES["src_tap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    texts = lines.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("content"))
    rows = lambda df: sorted(tuple(r) for r in df.select("run_id", "format", "ord", "name", "status").collect())
    assert rows(out) == rows(test_output.parse(texts)) == rows(test_output.parse_lines(lines, "tap")) and out.count() == 300


def test_budget_sums_up_only_what_can_be_kept(spark):
    """The running total goes over the first rows that could be kept, not over all in one task."""
    rows = spark.range(5000).select(F.col("id").alias("i"))
    out = relate.budget_rows(rows, 20, ["i"])
    assert [r.json for r in out.collect()] == ['{"i":0}', '{"i":1}', '{"i":2}', '{"i":3}', '{"i":4}', '{"i":5}', '{"i":6}', '{"i":7}', '{"i":8}', '{"i":9}', '{"_truncated":true,"shown":10,"total":5000}']
    assert "Limit" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.json for r in relate.budget_rows(rows, 0, ["i"]).collect()] == ['{"i":0}', '{"_truncated":true,"shown":1,"total":5000}']
    assert relate.budget_rows(rows.limit(3), 1000, ["i"]).count() == 3


def test_trees_leave_python_in_bounded_batches():
    """Rows of many small texts and of one large text leave `size` at a time; none is lost."""
    texts = ["<p>a</p>" * 3, None, "<p>b</p>" * 100, "<i>", "{"]
    docs = pa.RecordBatch.from_pydict({"path": ["a.html", "b.html", "c.html", "d.html", "e.json"], "content": texts})
    got = list(tree._built([docs, docs], size=50))
    want = [x for p, t in zip(docs.column("path").to_pylist(), texts) if t is not None and p != "e.json" for x in tree.flatten(tree.html_tree(t, p), p)]
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert [b.num_rows for b in got[:-1]] == [50] * (len(got) - 1) and rows[: len(want)] == want and len(rows) == 2 * (len(want) + 2)
    assert [r[8] for r in rows[len(want) : len(want) + 2]] == ["document", "error"]


def test_scenes_stream_documents(spark):
    """No document is a call of its own; scenes leave in batches of bounded size."""
    paras = [{"doc_id": f"d{i // 4}", "para": i % 4, "names": ["x"] if i % 2 else [], "places": None if i % 3 else [f"p{i}"], "times": None, "__b": False} for i in range(40)]
    want = [(f"d{k}", i, s["start"], s["end"], s["place"], s["names"], s["signals"]) for k in range(10) for i, s in enumerate(prose.find_scenes([{c: r[c] or [] for c in ("names", "places", "times")} for r in paras[4 * k : 4 * k + 4]], set()))]
    got = list(prose._scenes([pa.RecordBatch.from_pylist(paras[:17]), pa.RecordBatch.from_pylist(paras[17:])], size=7))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want and max(b.num_rows for b in got) == 7
    df = spark.createDataFrame([(r["doc_id"], r["para"], r["names"], r["places"], r["times"]) for r in paras], "doc_id string, para int, names array<string>, places array<string>, times array<string>")
    out = prose.scenes(df)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))


def test_small_trees_are_numbered_where_their_links_meet(spark, monkeypatch):
    """As level by level, with one shuffle of the links; large trees and those with an id twice go level by level."""
    r = random.Random(8)
    rows = [(f"t{t}", f"n{i}", f"n{r.randint(0, i - 1)}" if i else None, None, "n", str(i), r.random()) for t in range(9) for i in range(r.randint(1, 12))]
    rows += [("t0", "lost", "nowhere", None, "n", "x", 0.0), ("rootless", "a", "b", None, "n", "x", 0.0), ("twice", "r", None, None, "n", "x", 0.0), ("twice", "a", "r", "f", "n", "y", 0.1), ("twice", "a", "r", "f", "n", "z", 0.2)]
    links = spark.createDataFrame(rows, "tree_id string, id string, parent string, field string, node_type string, text string, sort double")
    monkeypatch.setattr(tree, "WHOLE", 10)
    small = tree.number_trees(links.where("tree_id <> 'twice'"))
    cells = lambda df: sorted(map(repr, (tuple(x) for x in df.select(*tree.NAMES).collect())))
    assert cells(small) == cells(tree.number_nodes(links.where("tree_id <> 'twice'")))
    assert cells(tree.number_trees(links)) == cells(tree.number_nodes(links))
    one = [pa.RecordBatch.from_pylist([dict(zip(("tree_id", "id", "parent", "field", "node_type", "text"), x)) for x in sorted((x for x in rows if x[0] == t), key=lambda x: x[6])]) for t in ("t1", "twice")]
    assert [x["node_id"] for b in tree._numbered(one) for x in b.to_pylist()][-1] is None


def test_steps_from_roots_need_no_join(spark):
    nodes = spark.createDataFrame([x for t in "ab" for x in tree.flatten(tq.Node("r", children=[tq.Node("x", children=[tq.Node("x")]), tq.Node("y")]), t)], tree.NODES)
    for text, n in (("desc:x", 4), ("children", 4), ("desc(2)", 6), ("children:x", 2), ("desc", 6)):
        out = tree.compile(text, nodes)
        assert "Join" not in out._jdf.queryExecution().toString() and out.count() == n
