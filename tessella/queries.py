"""Queries over the driver's tables, one or more an operator, with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cache, graph, relate, testruns, vcs, vectors
from tessella.plans import log_pipeline
from tessella.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Logs: events are entries; errors, purchases (warn) and the rest (info); the user is the source.

_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def event_log(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 3).otherwise(2).cast("tinyint")
    e = table(spark, d, "events").select(
        F.col("event_id").alias("line_no"), F.lit("events").alias("file"), F.expr(f"timestamp_micros({_US})").alias("timestamp"), rank.alias("level_rank"),
        F.col("user_id").cast("string").alias("source"), F.concat_ws(" ", "event_type", F.lit("by"), "user_id").alias("message"),
        F.from_json("props", "map<string,string>").alias("fields"), F.concat_ws(" ", "event_type", "user_id").alias("raw"),
    )
    return e.withColumn("level", log_pipeline.level_name(F.col("level_rank")))


_NOW = datetime(2024, 1, 1, tzinfo=UTC)
_LOG = """WITH log AS (
  SELECT event_id AS line_no, ts, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS level_rank,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' ELSE 'info' END AS level, CAST(user_id AS VARCHAR) AS source,
    event_type || ' by ' || user_id AS message, props, event_type || ' ' || user_id AS raw FROM events)
"""


def run_log(spark: SparkSession, d: str, text: str) -> DataFrame:
    return log_pipeline.run(event_log(spark, d), text, _NOW)


@query(_LOG + """, e AS (SELECT us FROM log WHERE level_rank >= 4), m AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
b AS (SELECT lo, unnest(range(0, (hi - lo) // 3600000000 + 1)) AS k FROM m WHERE lo IS NOT NULL),
c AS (SELECT (us - lo) // 3600000000 AS k, count(*) AS n FROM e, m GROUP BY ALL)
SELECT strftime(make_timestamp(lo + b.k * 3600000000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS bucket, coalesce(n, 0) AS count, '1h' AS "window"
FROM b LEFT JOIN c ON b.k = c.k""")
def log_rate_1h(spark, d):
    return run_log(spark, d, "level:error | rate 1h")


@query(_LOG + "SELECT 'count' AS aggregation, 'level' AS field, level AS \"group\", count(*) AS count FROM log GROUP BY level")
def log_count_by_level(spark, d):
    return run_log(spark, d, "| count by level")


@query(_LOG + "SELECT 'count' AS aggregation, 'source' AS field, source AS \"group\", count(*) AS count FROM log WHERE level_rank >= 3 GROUP BY source")
def log_count_by_source(spark, d):
    return run_log(spark, d, "level:warn | count by source | rate 1m")


@query(_LOG + "SELECT 'count' AS aggregation, 'k' AS field, coalesce(props->>'$.k', 'unknown') AS \"group\", count(*) AS count FROM log GROUP BY ALL")
def log_count_by_field(spark, d):
    return run_log(spark, d, "| count by k")


@query(_LOG + "SELECT 'count' AS aggregation, 'absent' AS field, 'unknown' AS \"group\", count(*) AS count FROM log")
def log_count_by_missing_field(spark, d):
    return run_log(spark, d, "| count by absent")


@query(_LOG + "SELECT line_no, level, source, message FROM log WHERE level_rank >= 3")
def log_level_filter(spark, d):
    return run_log(spark, d, "level:warning").select("line_no", "level", "source", "message")


@query(_LOG + "SELECT line_no, level, source, message FROM log WHERE contains(source, '17')")
def log_source_filter(spark, d):
    return run_log(spark, d, "source:17").select("line_no", "level", "source", "message")


@query(_LOG + "SELECT line_no, source FROM log WHERE contains(lower(message), 'click') AND contains(lower(message), 'by 1')")
def log_text_filter(spark, d):
    return run_log(spark, d, 'CLICK "by 1"').select("line_no", "source")


@query(_LOG + "SELECT line_no, source FROM log WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:30:00'")
def log_since_until(spark, d):
    return run_log(spark, d, "since:2024-01-05 until:2024-01-20T12:30:00Z").select("line_no", "source")


@query(_LOG + "SELECT line_no, source FROM log WHERE contains(lower(message), 'level:loud')")
def log_unreadable_filter_is_text(spark, d):
    return run_log(spark, d, "level:loud | nonsense 3").select("line_no", "source")


@query(_LOG + """, hit AS (SELECT line_no FROM log WHERE raw IN (SELECT raw FROM log WHERE level_rank >= 4 AND contains(source, '11')))
SELECT DISTINCT l.line_no, l.raw FROM log l JOIN hit h ON l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2""")
def log_context_2(spark, d):
    return run_log(spark, d, "level:error source:11 | context 2").select("line_no", "raw")


@query(_LOG + "SELECT line_no, source, row_number() OVER (ORDER BY ts NULLS FIRST, line_no) AS place FROM log")
def log_timeline(spark, d):
    from pyspark.sql.window import Window

    return run_log(spark, d, "| timeline").select("line_no", "source", F.row_number().over(Window.orderBy(F.col("timestamp").asc_nulls_first(), "line_no")).alias("place"))


@query(_LOG + """, t AS (SELECT message, count(*) AS n FROM log WHERE level_rank >= 4 GROUP BY message ORDER BY n DESC, message LIMIT 5)
SELECT count(*) AS lines, count(*) FILTER (WHERE level = 'info') AS info, count(*) FILTER (WHERE level = 'warn') AS warn,
  count(*) FILTER (WHERE level = 'error') AS error, printf('%.1f%%', 100.0 * count(*) FILTER (WHERE level_rank >= 4) / count(*)) AS error_rate,
  (SELECT string_agg(message || '=' || n, ';' ORDER BY n DESC, message) FROM t) AS top_errors, count(DISTINCT source) AS n_sources FROM log""")
def log_summary(spark, d):
    s = log_pipeline.summary(event_log(spark, d))
    top = F.array_join(F.transform("top_errors", lambda x: F.concat(x["message"], F.lit("="), x["count"].cast("string"))), ";")
    return s.select("lines", *[F.col("by_level")[k].alias(k) for k in ("info", "warn", "error")], "error_rate", top.alias("top_errors"), F.size("sources").cast("bigint").alias("n_sources"))


@query("""WITH j AS (SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events),
u AS (SELECT json, sum(strlen(json) // 4 + 1) OVER (ORDER BY event_id) AS used, strlen(json) // 4 + 1 AS cost FROM j),
k AS (SELECT json FROM u WHERE used <= 5000 OR used = cost)
SELECT json FROM k UNION ALL SELECT '{"_truncated":true,"shown":' || (SELECT count(*) FROM k) || ',"total":' || (SELECT count(*) FROM j) || '}' WHERE (SELECT count(*) FROM k) < (SELECT count(*) FROM j)""")
def log_budget(spark, d):
    return relate.budget_rows(table(spark, d, "events").select("event_id", "event_type"), 5000, ["event_id"])


@query()
def log_patterns(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "message"))
    return log_pipeline.run(lines.select(F.col("doc_id").cast("string").alias("file"), F.col("pos").alias("line_no"), "message", F.lit(None).cast("tinyint").alias("level_rank")), "| patterns", _NOW)


# Relations. Lineitem rows with one key are in order of all columns, as no shorter key is unique.

_L = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _lineitem(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    df = table(spark, d, "lineitem")
    return df, df.columns


def _last_item(key: str, order: list[str]) -> str:
    return f"(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(f'{c} DESC' for c in order)}) = 1)"


_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_PICK = "l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity"


def _order_join(spark, d, how):
    items, _ = _lineitem(spark, d)
    order = [c for c in _ORDER if c in items.columns]
    return relate.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), items, ".o_orderkey", ".l_orderkey", order, how)


def _flat(df: DataFrame) -> DataFrame:
    """Columns of both sides; -1 where the right side is absent."""
    return df.select("_left.o_orderkey", "_left.o_custkey", *[F.coalesce(F.col(f"_right.{c.split('.')[1]}"), F.lit(-1)).alias(c.split(".")[1]) for c in _PICK.split(", ")])


@query(f"SELECT o_orderkey, o_custkey, {_PICK} FROM orders JOIN {_last_item('l_orderkey', _ORDER)} l ON o_orderkey = l_orderkey")
def cq_join_inner(spark, d):
    return _flat(_order_join(spark, d, "inner"))


_PICK_OR = ", ".join(f"coalesce({c}, -1) AS {c.split('.')[1]}" for c in _PICK.split(", "))


@query(f"SELECT o_orderkey, o_custkey, {_PICK_OR} FROM orders LEFT JOIN {_last_item('l_orderkey', _ORDER)} l ON o_orderkey = l_orderkey")
def cq_join_left(spark, d):
    return _flat(_order_join(spark, d, "left"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def cq_join_anti(spark, d):
    return _order_join(spark, d, "anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def cq_join_semi(spark, d):
    return _order_join(spark, d, "semi")


@query(f"SELECT p_partkey, p_name, coalesce(l.l_orderkey, -1) AS last_order FROM part LEFT JOIN {_last_item('l_partkey', _ORDER)} l ON p_partkey = l_partkey")
def cq_lookup(spark, d):
    items, _ = _lineitem(spark, d)
    order = [c for c in _ORDER if c in items.columns]
    out = relate.lookup(table(spark, d, "part").select("p_partkey", "p_name"), items, "p_partkey", "l_partkey", order)
    return out.select("p_partkey", "p_name", F.coalesce(F.col("_lookup.l_orderkey"), F.lit(-1)).alias("last_order"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS count, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def cq_group(spark, d):
    out = relate.group(table(spark, d, "events").select("event_id", "user_id"), "user_id", ["event_id"])
    return out.select("key", "count", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT event_type AS key, count(*) AS count, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS users FROM events GROUP BY event_type")
def cq_group_values(spark, d):
    out = relate.group(table(spark, d, "events"), "event_type", ["event_id"], F.col("user_id"))
    return out.select("key", "count", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("users"))


@query("""WITH a AS (SELECT doc_id, n_chars FROM documents), b AS (SELECT doc_id, quality FROM labels)
SELECT CASE WHEN b.doc_id IS NULL THEN 'only_left' WHEN a.doc_id IS NULL THEN 'only_right' ELSE 'both' END AS side, coalesce(a.doc_id, -1) AS left_id, coalesce(b.doc_id, -1) AS right_id, coalesce(quality, -1) AS quality FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def cq_diff(spark, d):
    out = relate.diff(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "doc_id", ["doc_id"])
    or_none = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return out.select("side", or_none("row_left.doc_id").alias("left_id"), or_none("row_right.doc_id").alias("right_id"), or_none("row_right.quality").alias("quality"))


# Vectors


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 3)"
_RAW = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT b.vec_id AS key, round({_RAW}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id = 0) a, embeddings b WHERE {_RAW} >= 0 ORDER BY score DESC, key LIMIT 10")
def mq_search(spark, d):
    items = _items(spark, d)
    q = items.where("key = 0").select("embedding").first()[0]
    return vectors.search(items, list(q), 10, 0.0)


@query(f"SELECT b.vec_id AS key, round({_RAW}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id = 3) a, embeddings b WHERE b.vec_id <> 3 ORDER BY score DESC, key LIMIT 5")
def mq_similar(spark, d):
    return vectors.similar(_items(spark, d), 3, 5, -1.0)


@query(f"SELECT a.vec_id AS left_key, b.vec_id AS right_key, {_COS} AS score FROM embeddings a, embeddings b WHERE {_RAW} >= 0.3")
def mq_match(spark, d):
    items = _items(spark, d)
    return vectors.fuzzy_join(items, items, 0.3)


@query(f"""WITH s AS (SELECT a.vec_id AS k, b.vec_id AS m, {_RAW} AS s FROM embeddings a, embeddings b WHERE {_RAW} >= 0.1),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, m) AS place FROM s)
SELECT k AS left_key, string_agg(CAST(m AS VARCHAR), ',' ORDER BY place) AS matches FROM t WHERE place <= 3 GROUP BY k""")
def mq_relate(spark, d):
    items = _items(spark, d)
    out = vectors.relate(items, items, 3, 0.1)
    return out.select("left_key", F.array_join(F.transform("matches", lambda x: x["key"].cast("string")), ",").alias("matches"))


@query(f"""WITH c AS (SELECT vec_id, embedding, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT a.vec_id AS key, b.label AS category, {_RAW} AS s FROM embeddings a, c b)
SELECT key, category, round(s, 3) AS score FROM s WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, category) = 1""")
def mq_classify(spark, d):
    items = _items(spark, d)
    first = items.groupBy("label").agg(F.min_by("embedding", "key").alias("embedding")).select(F.col("label").alias("key"), "embedding")
    return vectors.classify(items, first, 0.1)


@query("SELECT 'events' AS collection, count(*) AS items, 'given' AS model, max(len(embedding)) AS dims, round(count(*) * max(len(embedding)) * 4 / 1048576.0, 2) AS size_mb FROM embeddings")
def mq_stats(spark, d):
    return vectors.collection_stats(_items(spark, d), "events", "given")


@query("SELECT b.vec_id AS key, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) ** 2))), 4) AS distance FROM (SELECT * FROM embeddings WHERE vec_id = 1) a, embeddings b ORDER BY distance, key LIMIT 8")
def wq_knn(spark, d):
    items = _items(spark, d)
    q = items.where("key = 1").select("embedding").first()[0]
    return vectors.knn(items, list(q), 8).withColumn("distance", F.round("distance", 4))


# The work graph: region -> nation -> customer -> order, and the turns of conversations


def _edges(spark: SparkSession, d: str) -> DataFrame:
    n, c, o = (table(spark, d, x) for x in ("nation", "customer", "orders"))
    name = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    down = n.select(name("r", "n_regionkey").alias("from_id"), name("n", "n_nationkey").alias("to_id"))
    down = down.unionAll(c.select(name("n", "c_nationkey"), name("c", "c_custkey"))).unionAll(o.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    return down.withColumn("kind", F.lit("contains"))


_EDGES = """WITH RECURSIVE edges AS (
  SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
"""


@query(_EDGES + """walk AS (SELECT b AS id, 1 AS depth FROM edges WHERE a = 'r0' UNION ALL SELECT e.b, w.depth + 1 FROM walk w JOIN edges e ON e.a = w.id WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM walk GROUP BY id""")
def wq_traverse(spark, d):
    return graph.traverse(_edges(spark, d), "r0", "contains", 3)


@query("SELECT 't' || (turn + 1) AS id, turn + 1 AS depth FROM (SELECT DISTINCT turn FROM conversations) t WHERE turn < (SELECT max(turn) FROM conversations) AND turn + 1 <= 5")
def wq_traverse_turns(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn")
    pairs = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("from_id"), F.concat(F.lit("t"), (F.col("turn") + 1).cast("string")).alias("to_id"))
    out = graph.traverse(pairs.distinct().withColumn("kind", F.lit("next")), "t0", "next", 5)
    return out.withColumn("depth", F.col("depth").cast("bigint"))


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_mktsegment = 'BUILDING'")
def wq_list_nodes(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("title"), F.lit("open").alias("status"), F.col("c_custkey").alias("created_at"))
    return graph.list_nodes(nodes, "BUILDING", "open").select("id", "title")


@query("""SELECT 'unindexed_nodes' AS finding, count(*) AS count FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)
UNION ALL SELECT 'orphan_embeddings', count(*) FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE e.vec_id = d.doc_id)
UNION ALL SELECT 'dangling_edges', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = o.o_custkey) OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = o.o_orderkey)""")
def wq_doctor(spark, d):
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id"))
    return graph.doctor(nodes, edges, table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def wq_unindexed(spark, d):
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"))
    return graph.unindexed(nodes, table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"))).select("id")


@query("""SELECT n_nationkey AS id, n_name AS title, CASE WHEN s.n >= 1 THEN 'supplied' ELSE 'open' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey""")
def wq_update(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("open").alias("status"))
    changes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("supplied").alias("status"), F.lit(None).cast("string").alias("title"))
    return graph.update_nodes(nodes, changes)


@query("SELECT '{\"n_name\":\"' || n_name || '\",\"n\":' || count(c_custkey) || '}' AS json FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def wq_sql(spark, d):
    for t in ("nation", "customer"):
        table(spark, d, t).createOrReplaceTempView(f"wq_{t}")
    return graph.query_json(spark, "SELECT n_name, count(c_custkey) AS n FROM wq_nation LEFT JOIN wq_customer ON c_nationkey = n_nationkey GROUP BY n_name;")


# Test runs: a run a month of orders, a test a customer


def _results(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("passed")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("name"),
        status.alias("status"), F.round("o_totalprice").cast("bigint").alias("duration_ms"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"), F.lit(None).cast("string").alias("suite"),
    )


_RUNS = """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS name,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'skipped' ELSE 'passed' END AS status, CAST(round(o_totalprice) AS BIGINT) AS duration_ms, 'order ' || o_orderkey AS message FROM orders)
"""


@query(_RUNS + """SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed,
count(*) FILTER (WHERE status = 'skipped') AS skipped, 0 AS errored, CAST(nullif(sum(duration_ms), 0) AS BIGINT) AS duration_ms FROM r GROUP BY run_id""")
def tq_totals(spark, d):
    return testruns.totals(_results(spark, d))


@query(_RUNS + "SELECT run_id, name, message FROM r WHERE status = 'failed'")
def tq_failures(spark, d):
    return testruns.failures(_results(spark, d)).select("run_id", "name", "message")


@query(_RUNS + "SELECT run_id, count(*) AS total, coalesce(string_agg(message, ',' ORDER BY ord) FILTER (WHERE status = 'failed'), '') AS failures FROM r GROUP BY run_id")
def tq_summary(spark, d):
    return testruns.summary(_results(spark, d)).select("run_id", "total", F.array_join(F.transform("failures", lambda x: x["message"]), ",").alias("failures"))


@query(_RUNS + ", f AS (SELECT name, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failures FROM r GROUP BY name) SELECT name, runs, failures, failures / runs AS fail_rate FROM f WHERE failures > 0 AND failures < runs")
def tq_flaky(spark, d):
    return testruns.flaky(_results(spark, d))


@query(_RUNS + "SELECT name FROM r GROUP BY name HAVING count(*) = count(*) FILTER (WHERE status = 'failed')")
def tq_always_failing(spark, d):
    return testruns.always_failing(_results(spark, d))


@query(_RUNS + """, m AS (SELECT min(run_id) AS a, max(run_id) AS b FROM r),
x AS (SELECT name, arg_max(status, ord) AS s FROM r, m WHERE run_id < '1996-01' GROUP BY name), y AS (SELECT name, arg_max(status, ord) AS s FROM r, m WHERE run_id >= '1996-01' GROUP BY name)
SELECT name, change FROM (SELECT coalesce(x.name, y.name) AS name, CASE WHEN x.name IS NULL THEN 'added' WHEN y.name IS NULL THEN 'removed' WHEN x.s = 'failed' AND y.s = 'failed' THEN 'still_failing'
  WHEN y.s = 'failed' THEN 'new_failures' WHEN x.s = 'failed' THEN 'new_passes' END AS change FROM x FULL JOIN y ON x.name = y.name) t WHERE change IS NOT NULL""")
def tq_diff(spark, d):
    r = _results(spark, d)
    return testruns.diff(r.where("run_id < '1996-01'"), r.where("run_id >= '1996-01'"))


@query(_RUNS + "SELECT 2 AS schema_version, 'python' AS language, name, CASE status WHEN 'passed' THEN 'ok' WHEN 'skipped' THEN 'ignored' ELSE status END AS status, ord FROM r")
def tq_record(spark, d):
    r = _results(spark, d).withColumn("duration_ms", F.col("ord"))
    return testruns.records(r, "pytest").select("schema_version", "language", "name", "status", F.col("duration_ms").alias("ord"))


# History: an order is a commit, its items are files


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    o, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    ts = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))")
    commits = o.select(F.format_string("%040x", "o_orderkey").alias("hash"), (F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))) - 1).alias("ord"), F.col("o_custkey").cast("string").alias("author"), ts.alias("ts"), F.col("o_orderstatus").alias("message"))
    files = items.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("insertions"), F.sum("l_linenumber").cast("bigint").alias("deletions"))
    files = files.select(F.format_string("%040x", "l_orderkey").alias("hash"), F.lit("M").alias("status"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), "insertions", "deletions")
    return commits, files


_HIST = """WITH c AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ord, o_orderdate AS ts, CAST(o_custkey AS VARCHAR) AS author FROM orders),
f AS (SELECT l_orderkey AS k, 'part/' || l_partkey AS path, CAST(sum(l_quantity) AS BIGINT) AS ins, CAST(sum(l_linenumber) AS BIGINT) AS del FROM lineitem GROUP BY l_orderkey, l_partkey)
"""


@query(_HIST + "SELECT path, count(*) AS commits, CAST(sum(ins) AS BIGINT) AS insertions, CAST(sum(del) AS BIGINT) AS deletions FROM f GROUP BY path")
def gq_churn(spark, d):
    return vcs.churn(*_history(spark, d))


@query(_HIST + ", s AS (SELECT min(ord) AS stop FROM c WHERE ts < TIMESTAMP '1997-06-01') SELECT path, count(*) AS commits, CAST(sum(ins) AS BIGINT) AS insertions, CAST(sum(del) AS BIGINT) AS deletions FROM f JOIN c ON c.k = f.k, s WHERE stop IS NULL OR ord < stop GROUP BY path")
def gq_churn_since(spark, d):
    return vcs.churn(*_history(spark, d), since=vcs.parse_date("1997-06-01"))


@query(_HIST + ", s AS (SELECT min(ord) AS stop FROM c WHERE ts < TIMESTAMP '1998-01-01') SELECT path, count(*) AS change_count FROM f JOIN c ON c.k = f.k, s WHERE stop IS NULL OR ord < stop GROUP BY path")
def gq_changed_since(spark, d):
    return vcs.changed_since(*_history(spark, d), "1998-01-01")


@query(_HIST + "SELECT substr(printf('%040x', c.k), 1, 8) AS hash, author, (SELECT coalesce(string_agg(path, ',' ORDER BY path), '') FROM f WHERE f.k = c.k) AS files FROM c WHERE c.k IN (SELECT k FROM f WHERE path = 'part/7') ORDER BY ord LIMIT 20")
def gq_log(spark, d):
    out = vcs.log(*_history(spark, d), 20, ["part/7"])
    return out.select("hash", "author", F.array_join(F.transform("files", lambda x: x["path"]), ",").alias("files"))


# The cache: documents by content


@query("SELECT doc_id, sha256(text) AS blob_hash, sha256('doc/' || doc_id || '|' || sha256(text) || '|skeleton') AS key FROM documents")
def oq_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return cache.keyed(docs, "skeleton").select("doc_id", "blob_hash", "key")


@query("SELECT CASE source WHEN (SELECT min(source) FROM documents) THEN 'cached' ELSE 'computed' END AS status, count(*) AS count FROM documents GROUP BY ALL")
def oq_warm(spark, d):
    """The cache holds what it has of one source; the rest is computed, whatever its length."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "source")
    size = lambda s: s.select("key", F.length("content").cast("string").alias("data"))
    held = docs.join(F.broadcast(docs.agg(F.min("source").alias("source"))), "source").select(docs.columns)
    held = cache.keyed(held, "size").select("key", F.col("path").alias("source_path"), "blob_hash", F.lit("size").alias("mode"), F.lit("").alias("data"))
    return cache.warm(cache.get_or_compute(held, docs, "size", size)[0])
