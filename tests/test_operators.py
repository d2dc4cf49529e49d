"""Semantics of the operators on literal fixtures."""

import itertools
import random
import subprocess
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessella.operators import cache, drain, graph, prose, relate, testruns, tree, vcs, vectors
from tessella.plans import log_pipeline as lp
from tessella.plans import tree_query as tq
from tessella.sources import logs, test_output
from tessella.streaming import tail

NOW = datetime(2026, 3, 11, 12, tzinfo=UTC)


# The log language


def test_parse_pipeline():
    p = lp.parse('level:WARN source:api "two words" loud | rate 5m | nonsense | count by source', NOW)
    assert [(f.kind, f.value) for f in p.filters] == [("level", 3), ("source", "api"), ("text", "two words"), ("text", "loud")]
    assert [s.kind for s in p.stages] == ["rate", "count"] and p.stages[0].value == ("5m", 300)
    with pytest.raises(ValueError):
        lp.parse("| nonsense", NOW, strict=True)
    with pytest.raises(ValueError):
        lp.parse("| rate 0s", NOW)


def test_times():
    assert lp.parse_time("90m", NOW) == datetime(2026, 3, 11, 10, 30, tzinfo=UTC)
    assert lp.parse_time("2026-03-10", NOW) == datetime(2026, 3, 10, tzinfo=UTC)
    assert lp.parse_time("2026-03-10T01:00:00+01:00", NOW) == datetime(2026, 3, 10, tzinfo=UTC)
    assert lp.parse_time("2026-03-10T01:00:00", NOW) is None and lp.parse_time("soon", NOW) is None
    assert lp.parse("since:soon level:loud", NOW).filters == [lp.Filter("text", "since:soon"), lp.Filter("text", "level:loud")]


LINES = {
    "json": ['{"timestamp":"2026-03-11T10:00:00Z","level":"error","msg":"refused","service":"api","port":80}', '{"time":1773223200000,"level":30,"fields":{"message":"inner"},"name":"n"}', '{"a":1}', "{broken"],
    "logfmt": ['ts=2026-03-11T10:00:00Z level=warn msg="a \\"b\\" c" port=1 port=2', "level=info msg=up x=1"],
    "bracket": ["[2026-03-11 10:00:00] ERROR api: connection refused", "2026-03-11T10:00:00.5Z [fs] [info] started", "[WARN] 2026-03-11 10:00:00 slow"],
    "syslog": ["<11>1 2026-03-11T10:00:00Z host app 42 - - it broke", "<14>Mar 11 10:00:00 host app[7]: fine"],
    "access": ['1.2.3.4 - - [11/Mar/2026:10:00:00 +0000] "GET /x HTTP/1.1" 503 12 "http://r"', '1.2.3.4 - - [11/Mar/2026:11:00:00 +0100] "GET / HTTP/1.1" 404 -'],
    "cri": ["2026-03-11T10:00:00.000000000Z stderr F it broke", "2026-03-11T10:00:00.000000000Z stdout F WARN slow"],
    "build": ["error[E0308]: mismatched types", "  --> src/main.rs:10:5", "warning: unused", "a.c:3:1: error: no"],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(f, i, x) for f, ls in LINES.items() for i, x in enumerate(ls)] + [("plain", 0, "\x1b[31mhello\x1b[0m"), ("plain", 1, "  ")]
    return {(r.file, r.line_no): r for r in logs.parse_lines(spark.createDataFrame(rows, "file string, line_no bigint, raw string")).collect()}


def test_formats(parsed):
    got = {k: (r.level, r.source, r.message) for k, r in parsed.items()}
    assert got["json", 0] == ("error", None, "refused") and got["json", 1] == ("info", "n", "inner") and got["json", 2][2] == '{"a":1}' and got["json", 3] == (None, None, "{broken")
    assert got["logfmt", 0] == ("warn", None, 'a "b" c') and got["bracket", 0] == ("error", "api", "connection refused")
    assert got["bracket", 1] == ("info", "fs", "started") and got["bracket", 2] == ("warn", None, "slow")
    assert got["syslog", 0] == ("error", "app", "it broke") and got["syslog", 1] == ("info", "app", "fine")
    assert got["access", 0][0] == "error" and got["access", 1][0] == "warn" and got["access", 0][2] == "GET /x HTTP/1.1"
    assert got["cri", 0] == ("error", None, "it broke") and got["cri", 1][0] == "warn"
    assert got["build", 0] == ("error", "cargo", "mismatched types") and got["build", 3] == ("error", "xcodebuild", "no")
    assert got["plain", 0] == (None, None, "hello") and ("plain", 1) not in got


def test_fields_and_times(parsed):
    assert parsed["json", 0].fields == {"service": '"api"', "port": "80"} and parsed["json", 1].fields == {}
    assert parsed["logfmt", 0].fields == {"port": '"2"'} and parsed["access", 0].fields["status"] == "503" and parsed["build", 1].fields == {"location": '"src/main.rs:10:5"'}
    for k in (("json", 0), ("json", 1), ("logfmt", 0), ("bracket", 0), ("syslog", 0), ("access", 0), ("access", 1), ("cri", 0)):
        assert parsed[k].timestamp is not None, k
    assert parsed["syslog", 1].timestamp is None


def entries(spark, rows):
    df = spark.createDataFrame(rows, "line_no bigint, us bigint, level string, source string, message string, raw string")
    return df.select("line_no", F.lit("f").alias("file"), F.timestamp_micros("us").alias("timestamp"), "level", lp.level_rank(F.col("level")).alias("level_rank"), "source", "message", F.expr("map('n', '\"x\"', 'k', '3')").alias("fields"), "raw")


def test_rate_fills_gaps_from_the_first_entry(spark):
    e = entries(spark, [(i, us, "error", None, "m", "r") for i, us in enumerate([30_000_000, 89_999_999, 90_000_000, 250_000_000, None])])
    assert [(r.bucket[14:19], r["count"]) for r in lp.run(e, "| rate 1m", NOW).orderBy("bucket").collect()] == [("00:30", 2), ("01:30", 1), ("02:30", 0), ("03:30", 1)]
    assert lp.run(e.where("timestamp is null"), "| rate 1m", NOW).count() == 0


def test_context_matches_equal_raw_lines(spark):
    e = entries(spark, [(i, None, "error" if i == 5 else None, None, "m", "same" if i in (5, 15) else f"r{i}") for i in range(20)])
    assert sorted(r.line_no for r in lp.run(e, "level:error | context 1", NOW).collect()) == [4, 5, 6, 14, 15, 16]


def test_first_aggregation_wins_and_counts(spark):
    e = entries(spark, [(0, None, None, "a", "m", "r"), (1, None, "info", None, "m", "r")])
    out = {r.group: r["count"] for r in lp.run(e, "| context 2 | count by source | rate 1m", NOW).collect()}
    assert out == {"a": 1, "unknown": 1}
    assert {r.group for r in lp.run(e, "| count by n", NOW).collect()} == {"x"}
    assert lp.count_object(e, "k").first().groups == {"3": 2}
    assert lp.summary(e.limit(0)).first().error_rate == "0.0%"


def test_drain(spark):
    r = random.Random(1)
    texts = [f"user {r.randint(0, 9)} logged in from {r.choice('abc')}" for _ in range(50)] + ["disk full", "disk gone", "", "one"]
    distinct = list(dict.fromkeys(t for t in texts))
    e = entries(spark, [(i, None, None, None, t, t) for i, t in enumerate(distinct)])
    assert [tuple(x) for x in drain.mine_patterns(e).collect()] == [(t, n, list(s)) for t, n, s in drain.mine(distinct)]
    assert "user <*> logged in from <*>" in {t for t, _, _ in drain.mine(texts)}


def test_streaming_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES["bracket"] * 3))
    stream = tail.read_stream(spark, str(tmp_path / "in"), "bracket")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(tail.follow(stream, "level:error"), "s1", "append").count() == 3
    assert {(str(r.start)[11:16], r["count"]) for r in run(tail.windowed_rate(stream, "1 hour"), "s2", "complete").collect()} == {("10:00", 9)}
    with pytest.raises(ValueError):
        tail.follow(stream, "| rate 1m")


# Relations


def test_joins_with_odd_keys(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("null", 4.0)], "name string, v double")
    right = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("d", 1, 3), (None, 9, 4)], "id string, x int, at int")
    out = relate.join(left, right, ".name", ".id", ["at"])
    assert sorted((r._left.v, r._right.x) for r in out.collect()) == [(1.0, 2), (3.0, 9), (4.0, 9)]
    assert relate.join(left, right, ".name", ".id", ["at"], "left").count() == 4
    assert [r.v for r in relate.join(left, right, ".name", ".id", ["at"], "anti").collect()] == [2.0]
    assert relate.join(left, right, ".name", ".id", ["at"], "semi").count() == 3
    number = spark.createDataFrame([("1",), ("2",)], "id string").withColumn("at", F.lit(1))
    assert relate.join(left, number, "v", "id", ["at"]).count() == 2
    assert relate.join(left, number, ".absent", "id", ["at"]).count() == 0
    looked = relate.lookup(left, right, "name", "id", ["at"], F.struct(F.lit("z").alias("id"), F.lit(0).alias("x"), F.lit(0).alias("at")))
    assert {r.v: r._lookup.x for r in looked.collect()} == {1.0: 2, 2.0: 0, 3.0: 9, 4.0: 9}
    sides = {}
    for r in relate.diff(left, right, "name", "id", ["at"]).collect():
        sides[r.side] = sides.get(r.side, 0) + 1
    assert sides == {"only_left": 1, "only_right": 1, "both": 3}


def test_group_and_budget(spark):
    rows = spark.createDataFrame([(i, i % 2 if i else None) for i in range(5)], "i int, k int")
    assert [(r.key, r["count"], [x.i for x in r["items"]]) for r in relate.group(rows, "k", ["i"]).collect()] == [("0", 2, [2, 4]), ("1", 2, [1, 3]), ("null", 1, [0])]
    stop = [r.json for r in relate.budget_rows(rows, 8, ["i"]).collect()]
    assert stop[-1] == '{"_truncated":true,"shown":2,"total":5}' and len(stop) == 3
    assert len(relate.budget_rows(rows, 1, ["i"]).collect()) == 2
    assert relate.budget_rows(rows, 4, ["i"], "cut").count() == 2
    assert relate.budget_rows(rows, 9, ["i"], "skip").count() >= 2


# Vectors


def test_vector_blocks_equal_broadcast(spark, monkeypatch):
    r = random.Random(0)
    items = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)], "key bigint, embedding array<float>")
    want = sorted((tuple(x) for x in vectors.fuzzy_join(items, items, 0.4).collect()))
    monkeypatch.setattr(vectors, "SMALL_BYTES", -1)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert sorted((tuple(x) for x in vectors.fuzzy_join(items, items, 0.4).collect())) == want
    assert not any(60 in x[:2] for x in want)


def test_collection(spark, tmp_path):
    c = vectors.Collection(spark, str(tmp_path), "c", dims=16)
    assert not c.exists()
    row = lambda *kv: spark.createDataFrame(kv, "key string, text string")
    c.index(row(("a", "one two"), ("b", "three"), ("b", "four")))
    c.index(row(("a", "changed"), ("c", "five")))
    assert {r.key: r.text for r in c.load().collect()} == {"a": "one two", "b": "four", "c": "five"} or c.load().count() == 3
    c.index(row(("a", "changed")), upsert=True)
    assert {r.key: r.text for r in c.load().collect()}["a"] == "changed"
    assert c.invalidate(row(("b", ""), ("zz", ""))) == {"removed": 1, "remaining": 2}
    assert c.stats().first()["items"] == 2 and c.exists()


# The work graph


def brute_depths(edges, start, most):
    out, walk = {}, {start}
    for depth in range(1, max(1, most) + 1):
        walk = {b for a, b in edges if a in walk}
        for x in walk:
            out.setdefault(x, depth)
    return out


def test_traverse(spark):
    r = random.Random(3)
    edges = [(f"n{r.randint(0, 12)}", f"n{r.randint(0, 12)}") for _ in range(22)]
    df = spark.createDataFrame([(*e, "k") for e in edges] + [("n0", "n99", "other")], "from_id string, to_id string, kind string")
    for depth in (0, 1, 4):
        assert {x.id: x.depth for x in graph.traverse(df, "n0", "k", depth).collect()} == brute_depths(edges, "n0", depth)
    cycle = spark.createDataFrame([("a", "b", "k"), ("b", "a", "k")], "from_id string, to_id string, kind string")
    assert {x.id: x.depth for x in graph.traverse(cycle, "a", "k", 5).collect()} == {"a": 2, "b": 1}


def test_graph_upkeep(spark):
    nodes, vecs = spark.createDataFrame([], graph.NODE), spark.createDataFrame([], "node_id string, embedding array<float>")
    nodes, vecs = graph.create_nodes(nodes, vecs, spark.createDataFrame([("x", "task", "one", "body"), ("y", "task", "two", None)], "id string, type string, title string, body string"))
    assert vecs.count() == 2 and graph.get_node(nodes, "x").title == "one"
    with pytest.raises(graph.NodeNotFound):
        graph.get_node(nodes, "q")
    changed = graph.update_nodes(nodes, spark.createDataFrame([("x", None, "done")], "id string, title string, status string"))
    assert [(r.id, r.title, r.status) for r in graph.list_nodes(changed, "task").orderBy("id").collect()] == [("x", "one", "done"), ("y", "two", "open")]
    edges = spark.createDataFrame([], graph.EDGE)
    new = lambda a, b: spark.createDataFrame([(a, b, "k")], "from_id string, to_id string, kind string")
    assert graph.create_edges(edges, new("x", "y"), nodes).first().weight == 1.0
    with pytest.raises(graph.NodeNotFound):
        graph.create_edges(edges, new("x", "gone"), nodes)
    bad = new("x", "gone").withColumn("id", F.lit("e")).withColumn("weight", F.lit(1.0)).withColumn("created_at", F.lit(""))
    orphan = vecs.where("node_id = 'x'").withColumn("node_id", F.lit("o"))
    assert {r.finding: r["count"] for r in graph.doctor(nodes, bad, orphan).collect()} == {"unindexed_nodes": 2, "orphan_embeddings": 1, "dangling_edges": 1}
    assert graph.reindex(nodes, orphan).count() == 3 and graph.unindexed(nodes, orphan).count() == 2


def test_rollup_and_sql(spark):
    def read(path):
        if path == "/c":
            raise FileNotFoundError(path)
        kids = {"/a": ["/b", "/c"], "/b": ["/a"]}[path]
        return spark.createDataFrame([(path,)], "id string"), spark.createDataFrame([("p", k, None, None) for k in kids], graph.REGISTRY)

    df, warnings = graph.rollup(spark, "/a", read)
    assert sorted(r.id for r in df.collect()) == ["/a", "/b"] and len(warnings) == 1
    assert graph.query_json(spark, "SELECT ';' AS a, null AS b").first().json == '{"a":";","b":null}'
    with pytest.raises(ValueError):
        graph.query_json(spark, "SELECT 1; SELECT 2")


# Test output


OUTPUT = {
    "libtest": "running 3 tests\n     Running unittests src/lib.rs (target/debug/deps/my_crate-0123456789abcdef)\ntest a::b ... ok\ntest a::c ... FAILED\ntest d ... ignored\n\nfailures:\n\n---- a::c stdout ----\nthread 'a::c' panicked at src/x.rs:1:2:\nassertion failed\n\nfailures:\n    a::c\n\ntest result: FAILED. 1 passed",
    "pytest": "t.py::test_a PASSED\nt.py::TestX::test_b FAILED\nt.py::test_c SKIPPED\n=== FAILURES ===\n____ TestX.test_b ____\n\n    assert 1 == 2\nE   assert 1 == 2\n=== short test summary info ===\nFAILED t.py::TestX::test_b - assert 1 == 2\n=== 1 failed, 1 passed ===",
    "jest": "PASS src/m.test.js\n  Math\n    ✓ adds (2 ms)\n    ✕ multiplies (3 ms)\n    ○ skipped divides\n\n  ● Math › multiplies\n\n    expect(received).toBe(expected)\n\nTests:       1 failed, 1 skipped, 1 passed, 3 total",
    "gotest": "=== RUN   TestA\n--- PASS: TestA (0.01s)\n=== RUN   TestB\n    b_test.go:12: expected 6\n--- FAIL: TestB (0.00s)\n--- SKIP: TestC (0.00s)\nFAIL\nFAIL\texample.com/m\t0.02s",
    "tap": "TAP version 13\n1..3\nok 1 - adds\nnot ok 2 - broken\n  ---\n  message: expected 6\n  ...\nok 3 - divides # SKIP slow",
    "flutter": "00:00 +0: loading /x.dart\n00:02 +1: counts\n00:04 +1 -1: renders\n00:05 +1 -1: waits\n00:05 +1 -1: Some tests failed.",
    "junit": '<testsuites><testsuite name="s"><testcase classname="c" name="a" time="0.5"/><testcase name="b" classname="c"><failure message="no">x</failure></testcase><testcase classname="c" name="d"><skipped/></testcase></testsuite></testsuites>',
    "libtest_json": '{ "type": "suite", "event": "started" }\n{ "type": "test", "event": "ok", "name": "a", "exec_time": 0.25 }\n{"type":"test","event":"failed","name":"b","stdout":"x\\nboom"}\n{"type":"test","event":"ignored","name":"c"}',
    "gotest_json": '{"Action":"run","Test":"A"}\n{"Action":"pass","Test":"A","Elapsed":0.5}\n{"Action":"output","Test":"B","Output":"b.go:1: bad\\n"}\n{"Action":"fail","Test":"B"}\n{"Action":"skip","Test":"C"}',
}


def test_test_output(spark):
    runs = spark.createDataFrame([*OUTPUT.items(), ("junk", "nothing here"), ("broken", "<testsuites><testcase ")], "run_id string, content string")
    assert {r.run_id: r.format for r in test_output.detect(runs).collect() if r.run_id not in ("junk", "broken")} == {k: k for k in OUTPUT}
    found = {}
    for r in test_output.parse(runs).orderBy("run_id", "ord").collect():
        found.setdefault(r.run_id, []).append(r)
    assert {k: [r.status for r in v] for k, v in found.items()} == {k: ["passed", "failed", "skipped"] for k in OUTPUT}
    said = {k: v[1].message for k, v in found.items()}
    assert said["libtest"] == "assertion failed" and said["pytest"] == "assert 1 == 2" and said["jest"].startswith("expect(") and "expected 6" in said["gotest"] and "expected 6" in said["tap"]
    assert said["junit"] == "no" and said["libtest_json"] == "boom" and said["gotest_json"] == "b.go:1: bad"
    assert found["libtest"][0].suite == "my_crate" and found["jest"][0].duration_ms == 2 and found["junit"][0].name == "c::a" and found["gotest"][0].suite == "example.com/m"


def test_go_runs_without_a_pass_or_failure(spark):
    """Go's line of a package begins with ok, as a TAP result does; a skipped test tells the format too."""
    skips = "=== RUN   TestA\n--- SKIP: TestA (0.00s)\n"
    texts = {"package": skips + "PASS\nok  \texample.com/m\t0.010s", "cut": skips, "quiet": "ok  \texample.com/m\t0.010s\nok  \texample.com/n\t(cached)"}
    runs = spark.createDataFrame([*texts.items(), ("tap", "ok 1 - adds\nok 2")], "run_id string, content string")
    assert {tuple(r) for r in test_output.detect(runs).collect()} == {(k, "tap" if k == "tap" else "gotest") for k in [*texts, "tap"]}
    found = {(r.run_id, r.name, r.status, r.suite) for r in test_output.parse(runs).collect()}
    assert found == {("package", "TestA", "skipped", "example.com/m"), ("cut", "TestA", "skipped", None), ("tap", "adds", "passed", None), ("tap", "test 2", "passed", None)}


def test_reports(spark):
    rows = [("1", 0, "a", "passed"), ("1", 1, "b", "failed"), ("1", 2, "c", "failed"), ("2", 0, "a", "failed"), ("2", 1, "b", "failed"), ("2", 2, "d", "failed"), ("2", 3, "c", "skipped")]
    df = spark.createDataFrame(rows, "run_id string, ord int, name string, status string").withColumns({"duration_ms": F.lit(None).cast("bigint"), "message": F.lit("m"), "suite": F.lit(None).cast("string")})
    r = testruns.flaky_report(df).first()
    assert r.total_runs == 2 and [x.name for x in r.flaky_tests] == ["a", "c"] and r.always_failing == ["b", "d"]
    d = testruns.diff_report(df.where("run_id = 1"), df.where("run_id = 2")).first()
    assert (d.new_failures, d.new_passes, d.still_failing, d.added, d.removed) == (["a"], ["c"], ["b"], ["d"], [])
    assert testruns.totals(df).where("run_id = 1").first().duration_ms is None
    rec = testruns.records(df.withColumn("name", F.lit("x::y::z")), "libtest").first()
    assert (rec.suite, rec.name, rec.language) == ("x/y", "z", "rust")


# History


def test_git(spark, tmp_path):
    repo = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=A B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "f.txt").write_text("1\n2\n")
    git("add", ".")
    git("commit", "-qm", "first\n\nbody")
    (tmp_path / "f.txt").write_text("1\n3\n4\n")
    (tmp_path / "g.txt").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "second")
    commits, files = vcs.read_history(spark, repo)
    assert [(r.author, r.summary, [(f.status, f.path) for f in r.files]) for r in vcs.log(commits, files).collect()] == [("A B", "second", [("M", "f.txt"), ("A", "g.txt")]), ("A B", "first", [("A", "f.txt")])]
    assert [tuple(r) for r in vcs.churn(commits, files).collect()] == [("f.txt", 2, 4, 1), ("g.txt", 1, 1, 0)]
    assert [tuple(r) for r in vcs.diff(spark, repo, "HEAD~1").collect()] == [("f.txt", 2, 1), ("g.txt", 1, 0)]
    first = commits.where("ord = 1").first().hash
    assert {r.path for r in vcs.changed_since(commits, files, first[:8]).collect()} == {"f.txt", "g.txt"}
    assert [r.content for r in vcs.blame(spark, repo, "f.txt").collect()] == ["1", "3", "4"] and vcs.content_at(repo, "HEAD~1", "f.txt") == "1\n2\n"
    assert vcs.parse_date("3 days", NOW) == int(NOW.timestamp()) - 3 * 86400
    with pytest.raises(ValueError):
        vcs.parse_date("whenever")


# Trees


def random_tree(r, depth=0):
    kids = [random_tree(r, depth + 1) for _ in range(r.randint(0, 3))] if depth < 4 else []
    return tq.Node(r.choice("abc"), r.choice(["x", "y", None]), r.randint(1, 9), 9, r.choice(["name", "body", None]), "sub", "f", kids)


QUERIES = [
    "desc", "children", "desc:a", "desc:(a | b)", "children[-1]", "desc(2)", "desc(0):c", "desc:a | parent", "desc:b | ancestors", "desc | siblings", "desc:a | next_sibling", "desc:a | prev_sibling", ".:a", "desc:b[@line > 4]", ".name", "children | .body",
    'desc | select(@text == "x" and @line <= 5)', 'desc | select(@type =~ "^[ab]$" or not (@depth < 2))', 'desc:a | @line + 1', "match(a > b)", "match(a b)", 'match(a(name: b))', 'match(b[@line >= "3"])', ".[]", 'desc | select(@text | startswith("x"))', "desc | @depth",
]


def test_compiled_equals_evaluated(spark):
    r = random.Random(7)
    rows = [x for i in range(6) for x in tree.flatten(random_tree(r), f"t{i}")]
    nodes = spark.createDataFrame(rows, tree.NODES).cache()
    trees = {i: tree.rebuild([dict(zip(tree.NAMES, x)) for x in rows if x[0] == i]) for i in {x[0] for x in rows}}
    for q in QUERIES:
        e = tq.parse(q)
        want = sorted((i, v.id if isinstance(v, tq.Node) else v) for i, t in trees.items() for v in tq.run(e, t))
        out = tree.compile(q, nodes)
        got = sorted((x.tree_id, x.value if "value" in out.columns else x.node_id) for x in out.collect())
        assert got == want, q
    q = "desc:a | {line: @line, up: parent | @type, n: .name | @text}"
    want = sorted((i, v["line"], v["up"] or "", v["n"] or "") for i, t in trees.items() for v in tq.run(tq.parse(q), t))
    assert sorted((x.tree_id, x.line, x.up or "", x.n or "") for x in tree.compile(q, nodes).collect()) == want
    assert tree.evaluate("[desc | @type]", nodes).count() == 6


VALUES = [
    ('[3, 1, 2] | sort_by(.) | .[0]', [1.0]), ('[1, null, 2] | add', [3.0]), ('["a", "b"] | add', ["ab"]), ("[] | add", [None]), ("null // 5", [5.0]), ("false // 5", [False]), ("empty // 5", [5.0]),
    ('"é" | length', [2]), ("[1, 2] | .[5]", [None]), ("[1, 2] | .[-1]", [2.0]), ('{a: 1} | .b', []), ('{a: 1} | has("a")', [True]), ('"a,b" | split(",") | reverse | join("-")', ["b-a"]), ("if null then 1 else 2 end", [2.0]), ("if false then 1 end", [None]),
    ('"x\\(1 + 1)y\\(null)"', ["x2y"]), ('["a b", "c"] | @csv', ['"a b",c']), ('["a\tb", null] | @tsv', ["a\\tb\t"]), ("[1, [2]] | flatten", [[1.0, 2.0]]), ("[null, 1] | any", [True]), ("[] | all", [True]), ('"3.5" | to_number', [3.5]), ("null | tostring", ["null"]),
    ('[{k: 1, v: 2}, {k: 1, v: 3}, {k: 2}] | group_by(.k) | map(length)', [[2, 1]]), ("[1, 1, 2] | unique_by(.) | @json", ["[1,2]"]), ("[1, 2, 3] | limit(2)", [[1.0, 2.0]]), ("[4, 5] | last", [5.0]), ("1 - -2 * 3", [7.0]), ("1 < 2 and 2 < 1", [False]), ('"ÀB" | ascii_downcase', ["àb"]),
    ('[true, null, "s", 1, [], {}] | sort_by(.) | map(type) | join(" ")', ["null boolean number string array object"]), ('{b: 1, a: 2} | keys', [["a", "b"]]), ("1 | test(\"a\")", [False]),
]


@pytest.mark.parametrize("q,want", VALUES)
def test_values(q, want):
    assert tq.run(tq.parse(q), None) == want


@pytest.mark.parametrize("q", ['1 / 0', '"a" < "b"', "nothing(1)", '"x" | to_number', '"a" =~ "(?=b)"', "{} | @csv"])
def test_value_errors(q):
    with pytest.raises(tq.QueryError):
        tq.run(tq.parse(q), None)


@pytest.mark.parametrize("q,at", [("desc:", 5), ("(1", 2), ("@nope", 1), ('"open', 0), ("1 ? 2", 2), ("if 1 then", 9)])
def test_parse_errors_point_at_the_place(q, at):
    with pytest.raises(tq.QueryError) as e:
        tq.parse(q)
    assert e.value.at == at and e.value.shown().split("\n")[1].index("^") == at


def test_json_queries_and_explain():
    assert tq.from_json({"type": ["a", "b"], "traverse": "children", "select": "@line > 1", "project": ["@type", "@line"], "limit": 2}) == "[children:(a | b) | select(@line > 1) | [@type, @line]] | limit(2) | .[]"
    with pytest.raises(tq.QueryError):
        tq.from_json({})
    assert "axis desc" in tq.explain(tq.parse("desc:a | @line"))


def test_builders_skeleton_signatures(spark):
    source = 'import os\n\n\nclass A:\n    def f(self, x):\n        return x\n\n\ndef g():\n    pass\n'
    docs = spark.createDataFrame([("m.py", source), ("d.json", '{"a": [1, "x"]}'), ("h.html", "<div id=k><p>hi<br>you</div>"), ("r.rs", "use std;\nfn main() {\n    let x = 1;\n}\nstruct S {\n}\n"), ("bad.json", "{"), ("bad.py", "def ("), ("none.md", None)], "path string, content string")
    nodes = tree.build(docs).cache()
    assert nodes.select("tree_id").distinct().count() == 6
    s = {r.tree_id: r for r in tree.skeleton(nodes).collect()}
    assert s["m.py"].imports == ["import os"] and [(d.type, d.name, d.line) for d in s["m.py"].declarations] == [("class_def", "A", 4), ("function_def", "g", 9)]
    assert [d.name for d in s["r.rs"].declarations] == ["main", "S"] and s["r.rs"].imports == ["use std;"]
    assert {(r.tree_id, r.name) for r in tree.signatures(nodes).collect()} >= {("m.py", "f"), ("m.py", "g"), ("r.rs", "main")}
    m = {r.tree_id: r.confidence for r in tree.parse_metrics(nodes).collect()}
    assert m["m.py"] == 1.0 and m["bad.json"] == 0.5
    assert {r.text for r in tree.compile("desc:text", nodes).collect()} == {"hi", "you"}
    assert tree.language_of("a/b.TS") == "typescript" and tree.language_of("x") is None


# The cache


def test_cache(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "bad")], "path string, content string")
    compute = lambda s: s.select("key", F.when(F.col("content") != "bad", F.concat("content", F.lit("!"))).alias("data"))
    results, kept = cache.get_or_compute(spark.createDataFrame([], cache.CACHE), docs, "m@1", compute)
    assert {r.path: (r.status, r.data) for r in results.collect()} == {"a": ("computed", "1!"), "b": ("computed", "2!"), "c": ("skipped", None), "d": ("error", None)}
    again, _ = cache.get_or_compute(kept, docs.withColumn("content", F.when(F.col("path") == "b", "3").otherwise(F.col("content"))), "m@1", compute)
    assert {r.path: r.status for r in again.collect()} == {"a": "cached", "b": "computed", "c": "skipped", "d": "error"}
    assert {r.path: r.status for r in cache.index_status(kept, docs.where("content is not null"), "m", "2").collect()} == {"a": "stale", "b": "stale", "d": "miss"}
    assert cache.prune(kept, docs.where("path = 'a'")).count() == 1 and cache.clear(kept).count() == 0 and cache.stats(kept).first().entries == 2


# Prose


def tokens(*words):
    return [dict(idx=i, text=t, lemma=l, pos=p, dep=d, head=h) for i, (t, l, p, d, h) in enumerate(words)]


def test_interactions(spark):
    s = tokens(("The", "the", "DET", "det", 1), ("dog", "dog", "NOUN", "nsubj", 2), ("chased", "chase", "VERB", "ROOT", 2), ("Ann", "Ann", "PROPN", "dobj", 2), ("and", "and", "CCONJ", "cc", 3), ("Bo", "Bo", "PROPN", "conj", 3))
    r = prose.sentence_interactions(s)[0]
    assert (r["agent"], r["patient"], r["verb_class"], r["agent_role"]) == ("The dog", "Ann and Bo", "motion", "theme")
    passive = tokens(("Ann", "Ann", "PROPN", "nsubjpass", 2), ("was", "be", "AUX", "auxpass", 2), ("hit", "hit", "VERB", "ROOT", 2), ("by", "by", "ADP", "agent", 2), ("Bo", "Bo", "PROPN", "pobj", 3))
    r = prose.sentence_interactions(passive)[0]
    assert (r["agent"], r["patient"], r["passive"], r["patient_role"]) == ("Bo", "Ann", True, "patient")
    melted = prose.sentence_interactions(tokens(("Ice", "ice", "NOUN", "nsubj", 1), ("melted", "melt", "VERB", "ROOT", 1)))[0]
    assert melted["agent_role"] == "patient"
    df = spark.createDataFrame([("d", 0, 0, *t.values()) for t in s], "doc_id string, para int, sent int, idx int, text string, lemma string, pos string, dep string, head int")
    assert prose.interactions(df).first().agent == "The dog" and prose.distinct_interactions(prose.interactions(df)).first().times == 1


def test_pronouns():
    e = lambda t, i, label="PERSON", dep="nsubj": {"text": t, "label": label, "idx": i, "dep": dep}
    p = lambda t, i: {"text": t, "label": None, "idx": i, "dep": "nsubj"}
    out = prose.resolve_pronouns([[e("Ann", 0), p("she", 3)], [p("She", 0)], [e("Bo", 0), e("Cy", 2, dep="dobj")], [p("he", 0)]], [0, 0, 0, 0])
    assert [x[2:4] for x in out] == [("Ann", 0.90), ("Ann", 0.80), ("Bo", 0.65)]
    assert prose.resolve_pronouns([[e("Ann", 0)], [p("she", 0)]], [0, 1]) == []


def test_discourse_requirements_questions(spark):
    text = "It rained. However, we left. As a result of this, we slept. Howeverness is no word.\n\nThen it must stop. Who knows? Is it so? You should go. We may rest."
    s = prose.plain_sentences(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"))
    got = [(r.sent, r.connective, r.relation, r.scope) for r in prose.discourse(s).orderBy("sent").collect()]
    assert got == [(1, "however", "contrast", "intra_paragraph"), (2, "as a result of", "cause", "intra_paragraph"), (4, "then", "sequence", "cross_paragraph")]
    assert {r.sent: r.strength for r in prose.requirements(s).collect()} == {4: "mandatory", 7: "recommended", 8: "optional"}
    assert {r.sent: r.kind for r in prose.questions(s).collect()} == {5: "who", 6: "yes_no"}
    md = spark.range(1).select(prose.clean_markdown(F.lit("---\na: 1\n---\n# Title\n**bold** and [[x|y]] `c`\n```\ncode\n```\nend")).alias("t")).first().t
    assert md.split() == ["Title", "bold", "and", "y", "c", "end"]


def test_scenes(spark):
    para = lambda names, places=(), times=(): {"names": list(names), "places": list(places), "times": list(times)}
    found = prose.find_scenes([para("ab", ["x"]), para("ab"), para("cd", (), ["noon"]), para("cd", ["y"])], set())
    assert [(s["start"], s["end"], s["place"]) for s in found] == [(0, 1, "x"), (2, 2, None), (3, 3, "y")]
    assert len(prose.find_scenes([para(""), para("")], set())) == 2 and prose.find_scenes([], set()) == []
    df = spark.createDataFrame([("d", i, ["a"], ["x" if i < 2 else "y"], []) for i in range(4)], "doc_id string, para int, names array<string>, places array<string>, times array<string>")
    sc = prose.scenes(df)
    assert [(r.start_para, r.end_para) for r in sc.orderBy("scene").collect()] == [(0, 1), (2, 3)]
    still = spark.createDataFrame([("d", 0, "sit")], "doc_id string, para int, lemma string")
    assert prose.consistency(sc, still).count() == 1 and prose.consistency(sc, still.withColumn("lemma", F.lit("walk")).withColumn("para", F.lit(2))).count() == 0


def test_arcs_and_conflicts(spark):
    life = [("d", "up", 0.1, "agent")] + [("d", "up", 0.9, "agent")] * 4 + [("d", "once", 0.5, "agent")] + [("d", "turn", 0.1, "agent"), ("d", "turn", 0.9, "patient")]
    got = {r.name: (r.shape, r.confidence) for r in prose.arcs(spark.createDataFrame(life, "doc_id string, name string, position double, role string")).collect()}
    assert got == {"up": ("rising", 0.8), "once": ("flat", 0.4), "turn": ("transformative", 0.75)}
    deeds = [("d", "Ann", "Bo", v, p) for v, p in (("hit", 0.1), ("kick", 0.6), ("push", 0.9))] + [("d", "he", "Bo", "hit", 0.2), ("d", "Bo", "Cy", "see", 0.1)]
    c = {(r.a, r.b): (r.times, r.verbs, r.trend) for r in prose.conflicts(spark.createDataFrame(deeds, "doc_id string, agent string, patient string, lemma string, position double")).collect()}
    assert c == {("ann", "bo"): (3, ["hit", "kick", "push"], "escalating"), ("bo", "cy"): (1, ["see"], "brief")}


def test_entities(spark):
    e = spark.createDataFrame([("d", 0, "Ann", "PERSON"), ("d", 1, "ann", "PERSON"), ("d", 2, "Paris", "GPE"), ("d", 3, "paris", "PERSON"), ("d", 4, "Rome", "GPE")], "doc_id string, sent int, text string, label string")
    assert {(r.name, r.mentions) for r in prose.distinct_entities(e).collect()} == {("Ann", 2), ("Paris", 1), ("paris", 1), ("Rome", 1)}
    assert sorted(r.sent for r in prose.characters(e).collect()) == [0, 1, 2, 3]
    assert {r.name: r.labels for r in prose.merge_entities(e).collect()}["Paris"] == ["GPE", "PERSON"]


def test_number_nodes(spark):
    links = spark.createDataFrame([("t", "r", None, 0), ("t", "a", "r", 1), ("t", "b", "r", 2), ("t", "c", "a", 1), ("u", "r", None, 0)], "tree_id string, id string, parent string, sort int")
    nodes = tree.number_nodes(links.withColumns({"field": F.lit(None).cast("string"), "node_type": F.lit("n"), "text": F.col("id")}))
    got = {(r.tree_id, r.text): (r.node_id, r.parent_id, r["last"], r.depth, r.sib_pos, r.n_sib) for r in nodes.collect()}
    assert got == {("t", "r"): (0, None, 3, 0, 0, 1), ("t", "a"): (1, 0, 2, 1, 0, 2), ("t", "c"): (2, 1, 2, 2, 0, 1), ("t", "b"): (3, 0, 3, 1, 1, 2), ("u", "r"): (0, None, 0, 0, 0, 1)}


def test_no_pairs_lost():
    assert list(itertools.pairwise(lp.LEVELS))[0] == ("trace", "debug")


def test_appositions_and_prepositions(spark):
    s = tokens(("Ann", "Ann", "PROPN", "nsubj", 3), ("the", "the", "DET", "det", 2), ("pilot", "pilot", "NOUN", "appos", 0), ("flew", "fly", "VERB", "ROOT", 3), ("to", "to", "ADP", "prep", 3), ("Rome", "Rome", "PROPN", "pobj", 4))
    df = spark.createDataFrame([("d", 0, *t.values()) for t in s], "doc_id string, sent int, idx int, text string, lemma string, pos string, dep string, head int")
    assert sorted((r.kind, r.text, r.of) for r in prose.sides(df).collect()) == [("alias", "the pilot", "Ann"), ("goal", "Rome", "fly")]
