"""Queries of readers, sinks, the store, the cache and prose trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cache, graph, prose, prose_tree, tree
from tessella.queries import query
from tessella.session import shared_folder, table
from tessella.sources import files


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


# Readers and sinks


@query("SELECT event_id, user_id, event_type, 1 AS kinds FROM events")
def cq_ndjson_rows(spark, d):
    """Events as JSON lines in several files, found by a glob and read in splits."""
    at = _place(spark, "ndjson")
    table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type"))).repartition(4).write.text(at)
    rows = files.read_json_rows(spark, f"{at}/part-*", strict=True)
    v = F.from_json("value", "event_id bigint, user_id bigint, event_type string").alias("v")
    return rows.select(v).select("v.*", F.lit(1).alias("kinds"))


@query("SELECT n_nationkey, n_name, n_nationkey AS place FROM nation")
def cq_json_array_rows(spark, d):
    """Nations as one array over several lines; their order stays."""
    at = _place(spark, "array")
    items = table(spark, d, "nation").select(F.struct("n_nationkey", "n_name").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("a"))
    items.select(F.concat(F.lit("[\n"), F.array_join(F.transform("a", lambda x: F.to_json(x)), ",\n"), F.lit("\n]"))).coalesce(1).write.text(at)
    rows = files.read_json_rows(spark, f"{at}/part-*").select(F.from_json("value", "n_nationkey bigint, n_name string").alias("v"), F.col("ord.k").cast("bigint").alias("place"))
    return rows.select("v.*", "place")


@query("SELECT 'part' AS kind, count(*) AS found FROM region")
def src_discover(spark, d):
    """A file a region below a folder of folders, found by suffix."""
    at = _place(spark, "folders")
    table(spark, d, "region").select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("k"), (F.col("r_regionkey") % 2).alias("half")).repartition(8, "k").write.partitionBy("half", "k").text(at)
    found = files.discover(spark, at, ("txt",))
    again = [x for f in found for x in files.expand_globs(spark, f)]
    return spark.createDataFrame([(f,) for f in again], "file string").groupBy(F.lit("part").alias("kind")).agg(F.count("*").alias("found"))


@query("SELECT 'c' || n_nationkey AS id, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation UNION ALL SELECT 't' || n_nationkey, n_name FROM nation")
def snk_forms(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    compact = files.as_text(n, "compact").select(F.concat(F.lit("c"), F.get_json_object("line", "$.n_nationkey")).alias("id"), "line")
    text = files.as_text(n, "text", "n_name").select(F.concat(F.lit("t"), F.regexp_extract("line", r"(\d+)$", 1)).alias("id"), "line")
    return compact.unionAll(text)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY ALL")
def tq_saved_run(spark, d):
    """Results saved and read again."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.concat(F.lit("case_"), "o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed").alias("status"))
    at = _place(spark, "run")
    files.save_run(o, at)
    back = files.saved_run(spark, at, "run_id string, name string, status string")
    return back.groupBy("run_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))


# The store and the cache


@query("SELECT 'nodes' AS name, 0 AS n UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'node_embeddings', 0 UNION ALL SELECT 'registry', 0 UNION ALL SELECT 'nodes again', count(*) FROM nation")
def wq_store(spark, d):
    """A new store has its tables, empty; opened again it has what was written."""
    at = _place(spark, "store")
    rows = [(name, t.count()) for name, t in graph.open_store(spark, at).items()]
    none = F.lit(None).cast("string")
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("title"), none.alias("body"), F.lit("open").alias("status"), none.alias("metadata_json"), none.alias("created_at"), none.alias("updated_at"))
    n.write.mode("append").parquet(f"{at}/nodes")
    rows.append(("nodes again", graph.open_store(spark, at)["nodes"].count()))
    return spark.createDataFrame(rows, "name string, n int")


@query("SELECT 'edge' AS kind, 'c' || o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY ALL")
def wq_references(spark, d):
    """Ends of edges that no node has: customers of one segment are missing among the nodes."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    name = lambda kind, k: F.concat(F.lit(kind), F.col(k).cast("string"))
    nodes = c.where("c_mktsegment <> 'BUILDING'").select(name("c", "c_custkey").alias("id")).unionAll(o.select(name("o", "o_orderkey")))
    edges = o.select(name("c", "o_custkey").alias("from_id"), name("o", "o_orderkey").alias("to_id"))
    return graph.broken_references(nodes, edges, nodes.limit(0).select(F.col("id").alias("node_id")))


@query("SELECT 'doc/' || doc_id AS path, 1 + CAST(doc_id % 3 = 0 AS INTEGER) AS entries FROM documents WHERE doc_id % 2 = 0")
def oq_invalidated(spark, d):
    """Of the files that changed, those that the cache holds something of."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_path"))
    held = docs.where("doc_id % 2 = 0").select("source_path").unionAll(docs.where("doc_id % 6 = 0").select("source_path"))
    out = cache.invalidated(held, docs.select(F.col("source_path").alias("path")))
    return out.select("path", F.col("entries").cast("int").alias("entries"))


@query("SELECT source AS mode, count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def oq_stats(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("mode"), F.col("text").alias("data"), F.sha2("text", 256).alias("key"))
    return cache.stats(docs).select("mode", "entries", "bytes")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents")
def oq_modes(spark, d):
    """The operator that a mode names, over all documents."""
    found = cache.mode_function("build")(table(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")))
    roots = found.where("parent_id is null")
    return roots.select(F.split("tree_id", r"\.")[0].cast("bigint").alias("doc_id"), F.col("end_line").cast("bigint").alias("lines"))


# Prose trees and narratives: an order's lines are sentences, its ship years paragraphs


def _order_sentences(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("doc_id"), F.year("l_shipdate").alias("para"), F.col("l_linenumber").alias("sent"), F.col("l_returnflag").alias("text"))


_ORDER = "WITH s AS (SELECT l_orderkey AS doc_id, year(l_shipdate) AS para, l_linenumber AS sent, l_returnflag AS text FROM lineitem), two AS (SELECT doc_id FROM s GROUP BY doc_id HAVING count(DISTINCT para) >= 2)\n"


def _order_arcs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("c"), "o_custkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "falling").otherwise("rising").alias("shape"))


@query(_ORDER + "SELECT CAST(doc_id AS VARCHAR) AS tree_id, text, count(*) AS n FROM s GROUP BY ALL")
def nq_tree_sentences(spark, d):
    """Sentences under paragraphs under documents, by the tree language."""
    nodes = prose_tree.document_trees(_order_sentences(spark, d))
    return tree.compile("children:paragraph | children:sentence", nodes).groupBy("tree_id", "text").agg(F.count("*").alias("n"))


@query(_ORDER + "SELECT CAST(o_orderkey AS VARCHAR) AS tree_id, 'c' || o_custkey AS name, CASE o_orderstatus WHEN 'F' THEN 'falling' ELSE 'rising' END AS shape FROM orders WHERE o_orderkey IN (SELECT doc_id FROM two)")
def nq_tree_arcs(spark, d):
    """Arcs as nodes with their columns as leaves; only documents of two paragraphs have them."""
    nodes = prose_tree.document_trees(_order_sentences(spark, d), arcs=_order_arcs(spark, d))
    return tree.compile("desc:arc | {name: .name | @text, shape: .shape | @text}", nodes).select("tree_id", "name", "shape")


@query(_ORDER + "SELECT CAST(doc_id AS VARCHAR) AS tree_id, 'grafted' AS shape, count(*) AS n FROM two GROUP BY ALL")
def nq_graft(spark, d):
    """Arcs of the corpus take the place of the documents' own."""
    sentences = _order_sentences(spark, d)
    links = prose_tree.document_links(sentences, arcs=_order_arcs(spark, d))
    two = sentences.groupBy("doc_id").agg(F.count_distinct("para").alias("n")).where("n >= 2")
    nodes = tree.number_trees(prose_tree.graft(links, arcs=two.select("doc_id", F.lit("all").alias("name"), F.lit("grafted").alias("shape"))))
    return tree.compile("desc:arc | {shape: .shape | @text}", nodes).groupBy("tree_id", "shape").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_nationkey AS doc_id, count(*) AS n FROM customer GROUP BY ALL), sh AS (SELECT doc_id, list(s ORDER BY s) AS shapes FROM (SELECT c_nationkey AS doc_id, lower(c_mktsegment) || '=' || count(*) AS s FROM customer GROUP BY c_nationkey, c_mktsegment) t GROUP BY doc_id),
f AS (SELECT s_nationkey AS doc_id, count(*) AS conflicts, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS unresolved, arg_min('a' || s_suppkey || ' / b', (-(s_suppkey % 5), 'a' || s_suppkey)) AS central FROM supplier GROUP BY ALL),
i AS (SELECT s_nationkey AS doc_id, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY ALL)
SELECT n_nationkey AS doc_id, CAST(1 AS BIGINT) AS scenes, CAST(coalesce(a.n, 0) AS BIGINT) AS characters, coalesce(conflicts, 0) AS conflicts, coalesce(unresolved, 0) AS unresolved, central, coalesce(i.n, 0) AS issues, array_to_string(coalesce(shapes, []), ',') AS shapes
FROM nation LEFT JOIN a ON a.doc_id = n_nationkey LEFT JOIN f ON f.doc_id = n_nationkey LEFT JOIN i ON i.doc_id = n_nationkey LEFT JOIN sh ON sh.doc_id = n_nationkey""")
def nq_summary(spark, d):
    n, c, s = (table(spark, d, x) for x in ("nation", "customer", "supplier"))
    fights = s.select(F.col("s_nationkey").alias("doc_id"), F.concat(F.lit("a"), "s_suppkey").alias("a"), F.lit("b").alias("b"), (F.col("s_suppkey") % 5).alias("times"), F.when(F.col("s_suppkey") % 2 == 0, "escalating").otherwise("brief").alias("trend"))
    out = prose_tree.narrative_summary(n.select(F.col("n_nationkey").alias("doc_id")), c.select(F.col("c_nationkey").alias("doc_id"), F.lower("c_mktsegment").alias("shape")), fights, s.where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("doc_id")))
    return out.withColumn("shapes", F.array_join("shapes", ","))


_CORPUS = """WITH f AS (SELECT n_nationkey AS ord, 'n' || n_nationkey AS file, count(c_custkey) + 1 AS lines FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
o AS (SELECT file, lines, coalesce(sum(lines) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_offset, sum(lines) OVER () AS total FROM f),
d AS (SELECT 'n' || c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line, 's' || (c_custkey % 11) AS agent, 't' || (c_custkey % 7) AS patient, c_mktsegment AS lemma FROM customer),
p AS (SELECT agent, patient, lemma, (line_offset + line) / total AS p FROM d JOIN o USING (file))
"""


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    name = F.concat(F.lit("n"), F.col("k").cast("string"))
    sizes = n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy(F.col("n_nationkey").alias("k")).agg((F.count("c_custkey") + 1).alias("lines")).select(name.alias("file"), F.col("k").alias("ord"), "lines", F.lit(1).alias("paras"))
    deeds = c.select(F.col("c_nationkey").alias("k"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("line"), F.concat(F.lit("s"), F.col("c_custkey") % 11).alias("agent"), F.concat(F.lit("t"), F.col("c_custkey") % 7).alias("patient"), F.col("c_mktsegment").alias("lemma"))
    return deeds.select(name.alias("file"), "line", "agent", "patient", "lemma"), prose.corpus_offsets(sizes), sizes.agg(F.sum("lines").alias("lines"))


@query(_CORPUS + """SELECT agent AS a, patient AS b, count(*) AS times, CASE WHEN count(*) < 3 THEN 'brief' WHEN max(p) < 0.8 THEN 'resolving' WHEN count(*) FILTER (WHERE p >= 0.5) > count(*) FILTER (WHERE p < 0.5) THEN 'escalating' ELSE 'stable' END AS trend FROM p GROUP BY ALL""")
def nq_corpus_conflicts(spark, d):
    return prose_tree.corpus_narrative(*_corpus(spark, d))[1].select("a", "b", "times", "trend")


@query(_CORPUS + ", m AS (SELECT agent AS name, p FROM p UNION ALL SELECT patient, p FROM p) SELECT name, count(*) AS total, round(list_sort(list(p))[count(*) // 2 + 1], 6) AS peak FROM m GROUP BY name")
def nq_corpus_arcs(spark, d):
    return prose_tree.corpus_narrative(*_corpus(spark, d))[0].select("name", "total", F.round("peak", 6).alias("peak"))


_CHAINS = """WITH c AS (SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS canonical, ['x' || (c_custkey % 4), lower(c_mktsegment)] AS aliases, c_custkey % 3 + 1 AS mentions FROM customer),
m AS (SELECT lower(canonical) AS k, arg_min(canonical, (doc_id, canonical)) AS canonical, CAST(sum(mentions) AS BIGINT) AS mentions, count(DISTINCT doc_id) AS files FROM c GROUP BY k),
a AS (SELECT lower(canonical) AS k, unnest(aliases) AS a FROM c)
"""


def _merged_chains(spark: SparkSession, d: str) -> DataFrame:
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.when(k % 2 == 0, F.upper(seg)).otherwise(F.lower(seg)).alias("canonical"), F.array(F.concat(F.lit("x"), k % 4), F.lower(seg)).alias("aliases"), (k % 3 + 1).alias("mentions"))
    return prose_tree.merge_chains(c)


@query(_CHAINS + "SELECT m.canonical, string_agg(DISTINCT a, ',' ORDER BY a) AS aliases, mentions, files FROM m JOIN a USING (k) GROUP BY ALL")
def nq_merge_chains(spark, d):
    return _merged_chains(spark, d).withColumn("aliases", F.array_join("aliases", ","))


@query(_CHAINS + "SELECT lower(a) AS alias, max(canonical) AS canonical FROM m JOIN a USING (k) WHERE lower(a) <> k GROUP BY ALL")
def nq_rescue_map(spark, d):
    return prose_tree.rescue_map(_merged_chains(spark, d))


# What earlier queries didn't reach


@query("SELECT o_custkey AS doc_id, o_orderkey AS sent, CASE o_orderstatus WHEN 'F' THEN 'Who ordered ' ELSE 'Why was it ' END || o_orderkey || '?' AS text FROM orders WHERE o_orderstatus <> 'P'")
def nq_questions(spark, d):
    """Orders as questions; those in progress are statements."""
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Who ordered "), "o_orderkey", F.lit("?"))).when(F.col("o_orderstatus") == "P", "It is in progress.").otherwise(F.concat(F.lit("Why was it "), "o_orderkey", F.lit("?")))
    return prose.questions(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("sent"), text.alias("text"))).select("doc_id", "sent", "text")


@query("SELECT lower(c_mktsegment) AS name, c_nationkey AS doc_id, count(*) AS mentions FROM customer GROUP BY ALL")
def nq_entities(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("sent"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("text"), F.lit("ORG").alias("label"))
    return prose.distinct_entities(c).select(F.lower("name").alias("name"), "doc_id", "mentions")


@query("SELECT lower(c_mktsegment) AS name, count(DISTINCT c_nationkey) AS files, count(*) AS mentions FROM customer GROUP BY ALL")
def nq_corpus_entities(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("text"), F.when(F.col("c_custkey") % 2 == 0, "ORG").otherwise("PERSON").alias("label"))
    return prose.merge_entities(c).select(F.lower("name").alias("name"), "files", "mentions")


@query("SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'third' WHEN o_orderkey % 2 = 0 THEN 'second' ELSE o_orderstatus END AS status FROM orders")
def wq_update_order(spark, d):
    """Several changes to one node: the last in order counts; a null keeps what was there."""
    o = table(spark, d, "orders")
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    change = lambda n, k, v: o.where(f"o_orderkey % {n} = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit(v).cast("string").alias("status"), F.lit(k).alias("at"))
    return graph.update_nodes(nodes, change(2, 1, "second").unionAll(change(3, 2, "third")).unionAll(change(1, 3, None)), "at").select("id", "status")
