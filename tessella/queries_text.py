"""Queries over trees, parsed formats and prose; they register beside those of tessella.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import prose, tree
from tessella.plans import log_pipeline
from tessella.queries import query
from tessella.session import table
from tessella.sources import logs, test_output

# The relational tree: a region is a tree of nations, customers and orders


def relational_nodes(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, o = (table(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    none = F.lit(None).cast("string")
    key = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    on = o.join(cn, o.o_custkey == c.c_custkey)
    tree_id = F.col("n_regionkey").cast("string")
    links = r.select(F.col("r_regionkey").cast("string").alias("tree_id"), key("r", "r_regionkey").alias("id"), none.alias("parent"), none.alias("field"), F.lit("region").alias("node_type"), F.col("r_name").alias("text"), F.col("r_regionkey").alias("sort"))
    for part in (
        n.select(tree_id, key("n", "n_nationkey"), key("r", "n_regionkey"), none, F.lit("nation"), F.col("n_name"), F.col("n_nationkey")),
        cn.select(tree_id, key("c", "c_custkey"), key("n", "c_nationkey"), F.lower("c_mktsegment"), F.lit("customer"), F.col("c_name"), F.col("c_custkey")),
        on.select(tree_id, key("o", "o_orderkey"), key("c", "o_custkey"), F.lower("o_orderstatus"), F.lit("order"), F.col("o_orderpriority"), F.col("o_orderkey")),
    ):
        links = links.unionAll(part)
    return tree.number_nodes(links)


_R = """WITH n AS (SELECT n_nationkey, n_name, n_regionkey, CAST(n_regionkey AS VARCHAR) AS tree_id FROM nation), c AS (SELECT * FROM customer JOIN n ON c_nationkey = n_nationkey), o AS (SELECT * FROM orders JOIN c ON o_custkey = c_custkey)
"""


@query(_R + "SELECT tree_id, c_name AS text FROM c WHERE c_name LIKE '%7'")
def aq_desc_select(spark, d):
    return tree.compile('desc:customer | select(@text =~ "7$")', relational_nodes(spark, d)).select("tree_id", "text")


@query(_R + "SELECT tree_id, n_name AS text FROM n")
def aq_children(spark, d):
    return tree.compile("children", relational_nodes(spark, d)).select("tree_id", "text")


@query(_R + "SELECT tree_id, count(*) AS count FROM (SELECT tree_id FROM n UNION ALL SELECT tree_id FROM c) t GROUP BY tree_id")
def aq_desc_depth_2(spark, d):
    return tree.compile("desc(2)", relational_nodes(spark, d)).groupBy("tree_id").agg(F.count("*").alias("count"))


@query(_R + "SELECT tree_id, n_name, c_name, o_orderpriority AS priority, 3 AS depth FROM o WHERE o_orderstatus = 'F'")
def aq_object(spark, d):
    nodes = relational_nodes(spark, d)
    found = tree.compile('desc:order[@depth >= 3] | {c_name: parent | @text, n_name: parent | @text, priority: @text, depth: @depth}', nodes)
    # the field tells the status; the nation is the parent's parent
    own = nodes.where("field = 'f' and node_type = 'order'").select("tree_id", "node_id", "parent_id")
    above = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("up"))
    nations = nodes.where("node_type = 'nation'").select("tree_id", F.col("node_id").alias("up"), F.col("text").alias("n_name"))
    return found.drop("n_name").join(own, ["tree_id", "node_id"]).join(above, ["tree_id", "parent_id"]).join(nations, ["tree_id", "up"]).select("tree_id", "n_name", "c_name", "priority", F.col("depth").cast("bigint").alias("depth"))


@query(_R + "SELECT tree_id, n_name AS text, count(*) AS times FROM c GROUP BY ALL")
def aq_parent(spark, d):
    return tree.compile("desc:customer | parent", relational_nodes(spark, d)).groupBy("tree_id", "text").agg(F.count("*").alias("times"))


@query(_R + "SELECT node_type, count(*) AS times FROM (SELECT unnest(['customer', 'nation', 'region']) AS node_type FROM o) t GROUP BY node_type")
def aq_ancestors(spark, d):
    return tree.compile("desc:order | ancestors", relational_nodes(spark, d)).groupBy("node_type").agg(F.count("*").alias("times"))


@query(_R + "SELECT a.tree_id, a.n_name AS text, count(*) AS times FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY ALL")
def aq_siblings(spark, d):
    return tree.compile("children | siblings", relational_nodes(spark, d)).groupBy("tree_id", "text").agg(F.count("*").alias("times"))


@query(_R + "SELECT tree_id, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS text FROM n QUALIFY text IS NOT NULL")
def aq_next_sibling(spark, d):
    return tree.compile("children | next_sibling", relational_nodes(spark, d)).select("tree_id", "text")


@query(_R + "SELECT tree_id, c_name AS text FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1")
def aq_nth_child(spark, d):
    return tree.compile("children | children[-1]", relational_nodes(spark, d)).select("tree_id", "text")


@query(_R + "SELECT tree_id, c_name AS text FROM c WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def aq_field(spark, d):
    return tree.compile("children | .building", relational_nodes(spark, d)).select("tree_id", "text")


@query(_R + "SELECT tree_id, count(*) AS matches FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY tree_id")
def aq_match(spark, d):
    return tree.compile('match(nation > customer order[@text == "1-URGENT"])', relational_nodes(spark, d)).groupBy("tree_id").agg(F.count("*").alias("matches"))


@query(_R + "SELECT tree_id, '[' || string_agg('\"' || lower(n_name) || '\"', ',' ORDER BY n_nationkey) || ']' AS value FROM n GROUP BY tree_id")
def aq_array(spark, d):
    return tree.query("[children | @text | ascii_downcase]", relational_nodes(spark, d)).select("tree_id", "value")


@query(_R + "SELECT tree_id, CAST(count(*) AS VARCHAR) AS value FROM o GROUP BY tree_id")
def aq_count_desc(spark, d):
    return tree.query('count_desc("order")', relational_nodes(spark, d)).select("tree_id", "value")


@query("SELECT tree_id, string_agg(k || '=' || n, ';' ORDER BY k) AS value FROM (SELECT CAST(n_regionkey AS VARCHAR) AS tree_id, substr(n_name, 1, 1) AS k, count(*) AS n FROM nation GROUP BY ALL) t GROUP BY tree_id")
def aq_group_by(spark, d):
    q = r'[children | @text] | group_by(split("") | .[1]) | map({k: .[0] | split("") | .[1], n: length}) | sort_by(.k) | map("\(.k)=\(.n)") | join(";")'
    return tree.query(q, relational_nodes(spark, d)).select("tree_id", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias("value"))


@query()
def aq_pages(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return tree.compile("desc:a | {text: children | @text, line: @line}", tree.build(pages, "html"))


def _page_nodes(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return tree.build(pages)


@query()
def aq_parse_metrics(spark, d):
    return tree.parse_metrics(_page_nodes(spark, d))


@query()
def aq_skeleton(spark, d):
    return tree.skeleton(_page_nodes(spark, d))


@query()
def aq_signatures(spark, d):
    return tree.signatures(_page_nodes(spark, d))


# Formats: events written as lines of each format and read back


def _lines(spark: SparkSession, d: str, line) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), line.alias("raw"))


def _level():
    return F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")


def _stamp():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_BACK = "SELECT event_id AS line_no, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS level_rank, 'user' || user_id AS source, event_type AS message FROM events"


def _back(entries: DataFrame) -> DataFrame:
    return entries.select("line_no", F.unix_micros("timestamp").alias("us"), F.col("level_rank").cast("int").alias("level_rank"), "source", "message")


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@query(_BACK)
def src_json_lines(spark, d):
    _utc(spark)
    line = F.to_json(F.struct(_stamp().alias("timestamp"), F.lower(_level()).alias("level"), F.concat(F.lit("user"), "user_id").alias("source"), F.col("event_type").alias("msg"), F.lit(7).alias("port")))
    return _back(logs.parse_lines(_lines(spark, d, line)))


@query(_BACK)
def src_logfmt_lines(spark, d):
    _utc(spark)
    line = F.concat(F.lit("ts="), _stamp(), F.lit(" level="), F.lower(_level()), F.lit(" source=user"), "user_id", F.lit(' msg="'), "event_type", F.lit('" port=7'))
    return _back(logs.parse_lines(_lines(spark, d, line)))


@query("""SELECT event_id AS line_no, CASE WHEN event_id % 4 < 3 THEN epoch_us(ts) END AS us, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS level_rank,
CASE WHEN event_id % 4 <> 2 THEN 'user' || user_id END AS source, event_type AS message FROM events""")
def src_bracket_lines(spark, d):
    """The four patterns in turn: stamp, level, source; stamp, source, level; level, stamp; level, source."""
    _utc(spark)
    user = F.concat(F.lit("user"), "user_id")
    forms = [
        F.concat(F.lit("["), _stamp(), F.lit("] "), _level(), F.lit(" "), user, F.lit(": "), "event_type"),
        F.concat(_stamp(), F.lit(" ["), user, F.lit("] ["), F.lower(_level()), F.lit("] "), "event_type"),
        F.concat(F.lit("["), _level(), F.lit("] "), _stamp(), F.lit(" "), "event_type"),
        F.concat(_level(), F.lit(" "), user, F.lit(": "), "event_type"),
    ]
    k = F.col("event_id") % 4
    return _back(logs.parse_lines(_lines(spark, d, F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)]))))


@query("SELECT event_id AS line_no, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS level_rank, 'user' || user_id AS source, event_type AS message FROM events")
def src_syslog_lines(spark, d):
    _utc(spark)
    severity = F.when(_level() == "ERROR", 11).when(_level() == "WARN", 12).otherwise(14)
    line = F.concat(F.lit("<"), severity, F.lit(">1 "), _stamp(), F.lit(" host user"), "user_id", F.lit(" 42 - - "), "event_type")
    return _back(logs.parse_lines(_lines(spark, d, line)))


@query("SELECT event_id AS line_no, epoch_us(date_trunc('second', ts)) AS us, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS level_rank, CAST(NULL AS VARCHAR) AS source, 'GET /' || user_id || ' HTTP/1.1' AS message FROM events")
def src_access_lines(spark, d):
    _utc(spark)
    status = F.when(_level() == "ERROR", 503).when(_level() == "WARN", 404).otherwise(200)
    line = F.concat(F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "user_id", F.lit(' HTTP/1.1" '), status, F.lit(' 12 "-"'))
    return _back(logs.parse_lines(_lines(spark, d, line)))


@query("SELECT event_id AS line_no, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 4 ELSE 2 END AS level_rank, CAST(NULL AS VARCHAR) AS source, 'info ' || event_type || ' ' || user_id AS message FROM events")
def src_cri_lines(spark, d):
    _utc(spark)
    line = F.concat(_stamp(), F.when(_level() == "ERROR", " stderr F info ").otherwise(" stdout F info "), "event_type", F.lit(" "), "user_id")
    return _back(logs.parse_lines(_lines(spark, d, line)))


@query("SELECT event_id AS line_no, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS level_rank, 'app' || user_id AS source, event_type || ' [x]' AS message, '\"' || 'h' || (user_id % 3) || '\"' AS host, '\"' || user_id || '\"' AS pid FROM events")
def src_syslog_old_lines(spark, d):
    severity = F.when(_level() == "ERROR", 11).when(_level() == "WARN", 12).otherwise(14)
    line = F.concat(F.lit("<"), severity, F.lit(">Oct  1 12:00:00 h"), F.col("user_id") % 3, F.lit(" app"), "user_id", F.lit("["), "user_id", F.lit("]: "), "event_type", F.lit(" [x]"))
    return logs.parse_lines(_lines(spark, d, line)).select("line_no", F.col("level_rank").cast("int").alias("level_rank"), "source", "message", F.col("fields")["hostname"].alias("host"), F.col("fields")["pid"].alias("pid"))


@query("""SELECT event_id AS line_no, CASE WHEN k = 1 THEN NULL WHEN event_type = 'error' THEN 4 WHEN event_type = 'purchase' AND k <> 3 THEN 3 ELSE 2 END AS level_rank, ['cargo', 'cargo', 'xcodebuild', 'gradle'][k + 1] AS source,
CASE k WHEN 0 THEN 'bad ' || user_id WHEN 1 THEN '--> src/m' || user_id || '.rs:3:7' WHEN 2 THEN 'cannot: ' || user_id ELSE '> Task :t' || user_id || CASE event_type WHEN 'error' THEN ' FAILED' ELSE ' UP-TO-DATE' END END AS message,
CASE k WHEN 1 THEN '"src/m' || user_id || '.rs:3:7"' WHEN 2 THEN '"App/V' || user_id || '.swift:1:2"' END AS location FROM (SELECT *, event_id % 4 AS k FROM events) t""")
def src_build_lines(spark, d):
    word = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("note")
    forms = [
        F.concat(word, F.lit("[E0308]: bad "), "user_id"), F.concat(F.lit("  --> src/m"), "user_id", F.lit(".rs:3:7")), F.concat(F.lit("App/V"), "user_id", F.lit(".swift:1:2: "), word, F.lit(": cannot: "), "user_id"),
        F.concat(F.lit("> Task :t"), "user_id", F.when(F.col("event_type") == "error", " FAILED").otherwise(" UP-TO-DATE")),
    ]
    k = F.col("event_id") % 4
    out = logs.parse_lines(_lines(spark, d, F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)])), "cargo")
    return out.select("line_no", F.col("level_rank").cast("int").alias("level_rank"), "source", "message", F.col("fields")["location"].alias("location"))


@query("SELECT event_id AS line_no, CAST(NULL AS INTEGER) AS level_rank, event_type || ' ' || user_id AS message FROM events")
def src_unknown_ansi_lines(spark, d):
    """No format fits; colour codes go from the message and stay in the raw line."""
    line = F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m "), "user_id")
    out = logs.parse_lines(_lines(spark, d, line))
    return out.where(F.col("raw").contains("\x1b[31m")).select("line_no", F.col("level_rank").cast("int").alias("level_rank"), "message")


@query("SELECT event_id AS line_no, 'f' || (event_id % 2) AS file, epoch_us(ts) AS us, event_type AS message, coalesce(CASE WHEN event_id % 2 = 0 THEN 'user' || user_id END, 'f' || (event_id % 2)) AS source, row_number() OVER (ORDER BY ts, event_id % 2, event_id) AS place FROM events")
def src_merged_timeline(spark, d):
    """Two files of different formats, detected one by one and merged by time."""
    _utc(spark)
    as_json = F.to_json(F.struct(_stamp().alias("time"), F.concat(F.lit("user"), "user_id").alias("logger"), F.col("event_type").alias("message")))
    as_bracket = F.concat(F.lit("["), _level(), F.lit("] "), _stamp(), F.lit(" "), "event_type")
    even = F.col("event_id") % 2 == 0
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("event_id") % 2).alias("file"), F.col("event_id").alias("line_no"), F.when(even, as_json).otherwise(as_bracket).alias("raw"))
    from pyspark.sql.window import Window

    merged = logs.merged_timeline(logs.parse_lines(e)).withColumn("__at", F.monotonically_increasing_id())  # in the order that the operator gives
    return merged.select("line_no", "file", F.unix_micros("timestamp").alias("us"), "message", "source", F.row_number().over(Window.orderBy("__at")).cast("bigint").alias("place"))


@query("SELECT 'bracket' AS format, 1 AS files UNION ALL SELECT 'json', 1 UNION ALL SELECT 'unknown', 1")
def src_detect(spark, d):
    e = table(spark, d, "events")
    raw = [("a", F.to_json(F.struct("event_id", "event_type"))), ("b", F.concat(F.lit("["), _level(), F.lit("] "), "event_type")), ("c", F.col("user_id").cast("string"))]
    lines = None
    for name, line in raw:
        part = e.select(F.lit(name).alias("file"), F.col("event_id").alias("line_no"), line.alias("raw"))
        lines = part if lines is None else lines.unionAll(part)
    return logs.detect_formats(lines).groupBy("format").agg(F.count("*").alias("files"))


_TEST_LINES = """SELECT strftime(o_orderdate, '%Y-%m') AS run_id, 't::case_' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'skipped' ELSE 'passed' END AS status FROM orders"""


def _runs(spark: SparkSession, d: str, line) -> DataFrame:
    """Lines (run_id, ord, line): a run a month, an order a line."""
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderkey").alias("ord"), line.alias("line"))


def _framed(runs: DataFrame, head: str, tail: str) -> DataFrame:
    """Runs between the lines that a runner prints first and last; so their format is detected."""
    ends = runs.select("run_id").distinct()
    for at, line in ((-(2**63), head), (2**63 - 1, tail)):
        runs = runs.unionAll(ends.select("run_id", F.lit(at).cast("bigint"), F.lit(line)))
    return runs


def _status(ok, bad, skip):
    return F.when(F.col("o_orderstatus") == "F", bad).when(F.col("o_orderstatus") == "P", skip).otherwise(ok)


def _case():
    return F.concat(F.lit("t::case_"), "o_orderkey")


@query(_TEST_LINES)
def src_libtest(spark, d):
    return test_output.parse_lines(_framed(_runs(spark, d, F.concat(F.lit("test "), _case(), F.lit(" ... "), _status("ok", "FAILED", "ignored"))), "running 2 tests", "test result: ok. 1 passed; 0 failed; 0 ignored")).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_libtest_json(spark, d):
    line = F.to_json(F.struct(F.lit("test").alias("type"), _status("ok", "failed", "ignored").alias("event"), _case().alias("name")))
    return test_output.parse_lines(_runs(spark, d, line)).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_pytest(spark, d):
    return test_output.parse_lines(_framed(_runs(spark, d, F.concat(_case(), F.lit(" "), _status("PASSED", "FAILED", "SKIPPED"))), "============================= test session starts ==============================", "========================= 1 passed in 0.10s =========================")).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_gotest(spark, d):
    return test_output.parse_lines(_framed(_runs(spark, d, F.concat(F.lit("--- "), _status("PASS", "FAIL", "SKIP"), F.lit(": "), _case(), F.lit(" (0.00s)"))), "=== RUN   TestAll", "ok  \tpkg\t0.010s")).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_gotest_json(spark, d):
    line = F.to_json(F.struct(_status("pass", "fail", "skip").alias("Action"), F.lit("p").alias("Package"), _case().alias("Test"), F.lit(0.5).alias("Elapsed")))
    return test_output.parse_lines(_runs(spark, d, line)).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_tap(spark, d):
    return test_output.parse_lines(_runs(spark, d, F.concat(_status("ok", "not ok", "ok"), F.lit(" 1 - "), _case(), _status("", "", " # SKIP slow")))).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_jest(spark, d):
    return test_output.parse_lines(_framed(_runs(spark, d, F.concat(F.lit("  "), _status("✓ ", "✕ ", "○ skipped "), _case())), "PASS src/a.test.js", "Tests:       1 passed, 1 total")).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_flutter(spark, d):
    """Running totals of passed, failed and skipped before each name; the format is detected."""
    from pyspark.sql.window import Window

    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), "o_orderkey", "o_orderstatus")
    w = Window.partitionBy("run_id").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).over(w) for s in "OFP"]
    line = F.concat(F.lit("00:01 +"), sums[0], F.lit(" -"), sums[1], F.lit(" ~"), sums[2], F.lit(": "), _case())
    return test_output.parse_lines(o.select("run_id", F.col("o_orderkey").alias("ord"), line.alias("line"))).select("run_id", "name", "status")


@query(_TEST_LINES)
def src_junit(spark, d):
    case = F.concat(F.lit('<testcase classname="t" name="case_'), "o_orderkey", F.lit('" time="0.1">'), _status("", '<failure message="no"/>', "<skipped/>"), F.lit("</testcase>"))
    return test_output.parse_lines(_framed(_runs(spark, d, case), '<testsuite name="s">', "</testsuite>")).select("run_id", "name", "status")


# Prose: the lines of documents as sentences


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return prose.plain_sentences(table(spark, d, "documents").select("doc_id", "text"))


_LEX = ", ".join(f"('{c}', '{r}', {p})" for c, (r, p) in sorted(prose.CONNECTIVES.items()))
_LINES = r"""WITH l AS (SELECT doc_id, trim(line, ' ') AS line, pos FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(10), 'g'), '\n')) AS line, generate_subscripts(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(10), 'g'), '\n'), 1) AS pos FROM documents) t WHERE regexp_matches(line, '[^ \t\n\r\f\v]')),
s AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS sent FROM l)
"""


@query(_LINES + f""", x(c, relation, confidence) AS (VALUES {_LEX}), m AS (
  SELECT doc_id, sent, c AS connective, relation, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY doc_id, sent ORDER BY length(c) DESC) AS k
  FROM s JOIN x ON starts_with(lower(line), c) AND NOT regexp_matches(substr(lower(line), length(c) + 1, 1), '[\\p{{L}}\\p{{N}}]') WHERE sent > 0)
SELECT doc_id, sent, connective, relation, confidence FROM m WHERE k = 1""")
def nq_discourse(spark, d):
    return prose.discourse(_sentences(spark, d)).select("doc_id", "sent", "connective", "relation", "confidence")


@query("SELECT o_custkey AS doc_id, count(DISTINCT o_orderpriority) AS paragraphs, count(*) AS sentences, 3 * count(*) AS words FROM orders GROUP BY o_custkey")
def nq_statistics(spark, d):
    """A customer's orders as sentences, in paragraphs by priority."""
    o = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("Order "), "o_orderkey", F.lit(" came.")).alias("s"), "o_orderpriority")
    paras = o.groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list("s")), " ").alias("p"))
    docs = paras.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list("p")), "\n\n").alias("text"))
    return prose.statistics(prose.plain_sentences(docs)).select("doc_id", "paragraphs", "sentences", "words")


@query("""WITH w AS (SELECT a.doc_id AS x, b.doc_id AS y, list_distinct(string_split(a.text, ' ')) AS p, list_distinct(string_split(b.text, ' ')) AS q FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT x AS doc_id, round(len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))), 6) AS jaccard FROM w""")
def nq_jaccard(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id").select("doc_id", F.round(prose.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'mandatory' WHEN 'O' THEN 'recommended' ELSE 'optional' END AS strength FROM orders WHERE o_orderpriority <> '1-URGENT'")
def nq_requirements(spark, d):
    """Orders as requirements: their status says how strong, and the urgent ones say nothing that binds."""
    word = F.when(F.col("o_orderpriority") == "1-URGENT", "mustard").when(F.col("o_orderstatus") == "F", "MUST").when(F.col("o_orderstatus") == "O", "should").otherwise("may")
    text = F.concat(F.lit("Order "), "o_orderkey", F.lit(" "), word, F.lit(" leave."))
    return prose.requirements(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("sent"), text.alias("text"))).select("doc_id", "strength")


def _deeds(spark: SparkSession, d: str) -> DataFrame:
    """Orders as deeds: the customer acts on the clerk's number; a customer's life is its orders in turn."""
    from pyspark.sql.window import Window

    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    place, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("o_custkey"))
    return o.select(F.lit("all").alias("doc_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), (place / n).alias("position"), F.when(F.col("o_orderstatus") == "F", "patient").otherwise("agent").alias("role"), F.col("o_orderpriority").alias("lemma"))


@query("""WITH o AS (SELECT 'c' || o_custkey AS name, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY o_custkey) AS p, CASE o_orderstatus WHEN 'F' THEN 'patient' ELSE 'agent' END AS role FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT name, count(*) AS total, list_sort(list(p))[len(list(p)) // 2 + 1] AS peak, count(*) FILTER (WHERE p < 0.33) AS b, count(*) FILTER (WHERE p >= 0.33 AND p < 0.67) AS m, count(*) FILTER (WHERE p >= 0.67) AS e FROM o GROUP BY name),
r AS (SELECT name, role, count(*) FILTER (WHERE p < 0.5) AS h1, count(*) FILTER (WHERE p >= 0.5) AS h2 FROM o GROUP BY name, role),
t AS (SELECT name, max(CASE WHEN h1 > 0 THEN {'n': h1, 'r': role} END).r AS r1, max(CASE WHEN h2 > 0 THEN {'n': h2, 'r': role} END).r AS r2 FROM r GROUP BY name)
SELECT name, total, round(peak, 6) AS peak, CASE WHEN total < 2 THEN 'flat' WHEN r1 <> r2 THEN 'transformative' WHEN e > b * 1.5 AND e > m THEN 'rising' WHEN b > e * 1.5 AND b > m THEN 'falling' WHEN m > b * 1.5 AND m > e * 1.5 THEN 'peak' ELSE 'flat' END AS shape FROM g JOIN t USING (name)""")
def nq_arcs(spark, d):
    return prose.arcs(_deeds(spark, d)).select("name", "total", F.round("peak", 6).alias("peak"), "shape")


@query("""WITH o AS (SELECT 'c' || o_custkey AS name, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 2500.0 AS p FROM orders)
SELECT name, count(*) FILTER (WHERE p < 0.5) AS early, count(*) FILTER (WHERE p >= 0.5) AS late FROM o GROUP BY name HAVING count(*) FILTER (WHERE p < 0.5) BETWEEN 1 AND 2 AND count(*) FILTER (WHERE p >= 0.5) >= 4""")
def nq_foreshadowing(spark, d):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    mentions = table(spark, d, "orders").select(F.lit("all").alias("doc_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), (days / 2500.0).alias("position"))
    return prose.foreshadowing(mentions).select("name", "early", "late")


@query("""WITH o AS (SELECT o_orderkey AS k, 'c' || o_custkey AS x, lower('c' || (o_custkey % 7)) AS y, o_orderpriority AS lemma, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 2500.0 AS p FROM orders),
n AS (SELECT least(x, y) AS a, greatest(x, y) AS b, p FROM o WHERE x <> y)
SELECT a, b, count(*) AS times, CASE WHEN count(*) < 3 THEN 'brief' WHEN max(p) < 0.8 THEN 'resolving' WHEN count(*) FILTER (WHERE p >= 0.5) > count(*) FILTER (WHERE p < 0.5) THEN 'escalating' ELSE 'stable' END AS trend FROM n GROUP BY a, b""")
def nq_conflicts(spark, d):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    deeds = table(spark, d, "orders").select(F.lit("all").alias("doc_id"), name(F.col("o_custkey")).alias("agent"), name(F.col("o_custkey") % 7).alias("patient"), F.col("o_orderpriority").alias("lemma"), (days / 2500.0).alias("position"))
    return prose.conflicts(deeds).select("a", "b", "times", "trend")


@query()
def nq_scenes(spark, d):
    lines = _sentences(spark, d)
    words = F.split("text", r"\s+")
    paras = lines.select("doc_id", F.col("sent").alias("para"), F.filter(words, lambda w: w.rlike("^[A-Z]")).alias("names"), F.array().cast("array<string>").alias("places"), F.filter(words, lambda w: w.rlike(r"^\d{4}$")).alias("times"))
    return prose.scenes(paras.withColumn("doc_id", F.col("doc_id").cast("string")))


@query("SELECT 'lines' AS kind, CAST(sum(n) AS BIGINT) AS total FROM (SELECT len(string_split(text, chr(10))) AS n FROM documents) t UNION ALL SELECT 'files', count(*) FROM documents")
def nq_corpus(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("ord"), F.size(F.split("text", "\n")).alias("lines"), F.lit(1).alias("paras"))
    last = prose.corpus_offsets(files).join(files.select("file", "lines"), "file").agg(F.max(F.col("line_offset") + F.col("lines")).alias("lines"), F.max("para_hi").alias("files"))
    return last.select(F.expr("stack(2, 'lines', cast(lines AS bigint), 'files', cast(files AS bigint)) AS (kind, total)"))
