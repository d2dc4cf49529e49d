"""Queries through the tree language's interpreter: every built-in over trees of nations and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import tree
from tessella.plans import tree_query
from tessella.queries import query
from tessella.session import table


def supplier_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree a nation, its suppliers as children in order of key; a supplier's field is odd or even."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    none, key = F.lit(None).cast("string"), F.col("s_nationkey").cast("string")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    place = F.row_number().over(w)
    count = s.groupBy("s_nationkey").agg(F.count("*").alias("c"))
    roots = n.join(count, n.n_nationkey == count.s_nationkey, "left").select(
        F.col("n_nationkey").cast("string").alias("tree_id"), F.lit(0).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.coalesce("c", F.lit(0)).cast("bigint").alias("last"), F.lit(0).alias("depth"), F.lit(0).alias("sib_pos"), F.lit(1).alias("n_sib"),
        none.alias("field"), F.lit("nation").alias("node_type"), F.col("n_name").alias("text"), none.alias("subtree_text"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), none.alias("source_file"),
    )
    at = F.col("s_suppkey").cast("int")
    kids = s.select(
        key, place.cast("bigint"), F.lit(0).cast("bigint"), place.cast("bigint"), F.lit(1), (place - 1).cast("int"), F.count("*").over(Window.partitionBy("s_nationkey")).cast("int"),
        F.when(at % 2 == 1, "odd").otherwise("even"), F.lit("supplier"), F.col("s_name"), none, at, at + at % 3, none,
    )
    return roots.unionAll(kids)


def _values(spark: SparkSession, d: str, text: str, schema: str) -> DataFrame:
    """The objects that a query gives, as columns."""
    out = tree.evaluate(text, supplier_nodes(spark, d))
    return out.select("tree_id", F.from_json("value", schema).alias("v")).select("tree_id", "v.*")


_S = "SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, CAST(s_suppkey AS BIGINT) AS id, "
_L = "WITH b AS (SELECT CAST(n_nationkey AS VARCHAR) AS tree_id, n_name, coalesce(list(CAST(s_suppkey AS BIGINT) ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), []) AS l FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)\n"


@query(_S + """CAST(length(s_name) AS BIGINT) AS len, upper(s_name) AS up, lower(s_name) AS down, reverse(s_name) AS back, starts_with(s_name, 'Sup') AS starts, ends_with(s_name, '7') AS ends, contains(s_name, '9') AS nine,
NOT ends_with(s_name, '7') AS other, regexp_matches(s_name, '0[1-5]$') AS rx, string_split(s_name, '#')[2] AS part, CAST(string_split(s_name, '#')[2] AS DOUBLE) AS num, CAST(s_suppkey AS VARCHAR) AS str, 's-' || s_suppkey || '!' AS interp FROM supplier""")
def aq_text_builtins(spark, d):
    """length, letter case, reverse, startswith, endswith, contains, not, test, split, index, to_number, to_string, interpolation."""
    q = r"""desc:supplier | {id: @start, len: @text | length, up: @text | ascii_upcase, down: @text | ascii_downcase, back: @text | reverse, starts: @text | startswith("Sup"), ends: @text | endswith("7"),
      nine: @text | contains("9"), other: @text | endswith("7") | not, rx: @text | test("0[1-5]$"), part: @text | split("#") | .[1], num: @text | split("#") | .[1] | to_number, str: @start | to_string, interp: "s-\(@start)!"}"""
    return _values(spark, d, q, "id bigint, len bigint, up string, down string, back string, starts boolean, ends boolean, nine boolean, other boolean, rx boolean, part string, num double, str string, interp string")


@query(_S + """CASE WHEN s_suppkey > 5 THEN 'big' ELSE 'small' END AS size, s_suppkey > 3 AND s_suppkey < 50 AS both, s_suppkey < 3 OR s_suppkey > 70 AS either, NOT (s_suppkey = 4) AS neither, 'none' AS alt, 'supplier' AS kept,
CAST((s_suppkey + 2) * 3 - (s_suppkey + s_suppkey % 3) / 2.0 AS DOUBLE) AS calc, s_suppkey <> 4 AS ne, regexp_matches(s_name, '1$') AS re, s_suppkey <= 9 AS le, s_suppkey >= 9 AS ge, 'number' AS kind, 'null' AS nothing FROM supplier""")
def aq_logic_builtins(spark, d):
    """Conditionals, and, or, not, the alternative, arithmetic with precedence, all comparisons, type."""
    q = r"""desc:supplier | {id: @start, size: if @start > 5 then "big" else "small" end, both: @start > 3 and @start < 50, either: @start < 3 or @start > 70, neither: not (@start == 4), alt: .nothing // "none", kept: @type // "none",
      calc: (@start + 2) * 3 - @end / 2, ne: @start != 4, re: @text =~ "1$", le: @start <= 9, ge: @start >= 9, kind: @start | type, nothing: null | type}"""
    return _values(spark, d, q, "id bigint, size string, both boolean, either boolean, neither boolean, alt string, kept string, calc double, ne boolean, re boolean, le boolean, ge boolean, kind string, nothing string")


@query(_L + """SELECT tree_id, CAST(len(l) AS BIGINT) AS n, CAST(len(l) AS BIGINT) AS kids, len(list_filter(l, lambda x: x % 2 = 1)) > 0 AS odd, 'a,b' AS keys, 'node' AS kind, CAST(len(l) AS BIGINT) AS below, CASE WHEN len(l) > 0 THEN 'nation/supplier' END AS path,
len(list_filter(l, lambda x: x > 5)) > 0 AS some, len(list_filter(l, lambda x: x <= 5)) = 0 AS every, CASE WHEN len(l) > 0 THEN CAST(list_sum(l) AS DOUBLE) END AS total, CAST(len(l) + 1 AS BIGINT) AS flat, CAST(len(list_distinct(list_transform(l, lambda x: x > 5))) AS BIGINT) AS uniq,
CAST(least(2, len(l)) AS BIGINT) AS lim, l[1] AS one, l[-1] AS final, l[-1] AS back, CAST(len(l) AS BIGINT) AS each_, CAST(len(list_filter(l, lambda x: x > 5)) AS BIGINT) AS sel, CAST(0 AS BIGINT) AS none, CAST(len(l) AS BIGINT) AS seen, CASE WHEN len(l) > 0 THEN CAST(list_sum(l) + len(l) AS DOUBLE) END AS more,
CAST(len(list_distinct(list_transform(l, lambda x: x % 2))) AS BIGINT) AS parities, l[-1] AS largest FROM b""")
def aq_array_builtins(spark, d):
    """length, has, keys, type, count_desc, path, any, all, add, flatten, unique_by, limit, first, last, reverse, iterate, select in map, empty, debug, map, group_by, sort_by."""
    q = r"""{n: [children] | length, kids: length, odd: has("odd"), keys: {b: 1, a: 2} | keys | join(","), kind: type, below: count_desc("supplier"), path: children[0] | @path | join("/"), some: [children | @start > 5] | any,
      every: [children | @start > 5] | all, total: [children | @start] | add, flat: [[children | @start], [0]] | flatten | length, uniq: [children | @start > 5] | unique_by(.) | length, lim: [children | @start] | limit(2) | length,
      one: [children | @start] | first, final: [children | @start] | last, back: [children | @start] | reverse | first, each_: [[children | @start] | .[]] | length, sel: [children | @start] | map(select(. > 5)) | length, none: [children | empty] | length,
      seen: [children | @start | debug] | length, more: [children | @start] | map(. + 1) | add, parities: [children] | group_by(@text | test("[13579]$")) | length,
      largest: [children | @start] | sort_by(0 - .) | .[0]}"""
    return _values(spark, d, q, "n bigint, kids bigint, odd boolean, keys string, kind string, below bigint, path string, some boolean, every boolean, total double, flat bigint, uniq bigint, lim bigint, one bigint, final bigint, back bigint, each_ bigint, sel bigint, none bigint, seen bigint, more double, parities bigint, largest bigint")


@query(_L + """SELECT tree_id, array_to_string(l, ',') AS csv, array_to_string(list_transform(l, lambda x: 't' || x), chr(9)) AS tsv, '[' || array_to_string(l, ',') || ']' AS json, '"' || n_name || ' ""x"", y",' || len(l) AS quoted FROM b""")
def aq_formats(spark, d):
    """@csv with quoting, @tsv, @json."""
    q = r"""{csv: [children | @start] | @csv, tsv: [children | "t\(@start)"] | @tsv, json: [children | @start] | @json, quoted: ["\(@text) \"x\", y", [children] | length] | @csv}"""
    return _values(spark, d, q, "csv string, tsv string, json string, quoted string")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, '{\"@type\":\"supplier\",\"@start\":' || s_suppkey || ',\"@end\":' || (s_suppkey + s_suppkey % 3) || ',\"@text\":\"' || s_name || '\"}' AS value FROM supplier")
def aq_node_json(spark, d):
    """Nodes as results, described."""
    return tree.evaluate("children:supplier", supplier_nodes(spark, d)).select("tree_id", "value")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, CAST(s_suppkey AS BIGINT) AS id, s_name AS text, CAST(s_suppkey AS INTEGER) AS start, CAST(s_suppkey + s_suppkey % 3 AS INTEGER) AS \"end\", 'supplier' AS type, 1 AS depth FROM supplier WHERE s_suppkey % 2 = 1")
def aq_meta_accessors(spark, d):
    """The metas of a node by the plan of joins."""
    found = tree.compile("children:supplier[@text =~ \"[13579]$\"] | {id: @start, text: @text, start: @start, end: @end, type: @type, depth: @depth}", supplier_nodes(spark, d))
    return found.select("tree_id", F.col("id").cast("bigint").alias("id"), "text", "start", "end", "type", "depth")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, count(*) AS n FROM supplier WHERE s_suppkey > 5 GROUP BY ALL")
def aq_json_spec(spark, d):
    """A query given as a JSON specification."""
    e = tree_query.from_json({"type": "supplier", "select": "@start > 5"})
    return tree.compile(e, supplier_nodes(spark, d)).groupBy("tree_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS tree_id, count(s_suppkey) + 1 AS named, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS missing, CAST(1 AS DOUBLE) AS confidence FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def aq_metrics(spark, d):
    return tree.parse_metrics(supplier_nodes(spark, d))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, a.s_name AS text, b.s_name AS before FROM (SELECT *, lag(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS p FROM supplier) a JOIN supplier b USING (s_nationkey) WHERE b.s_name = a.p")
def aq_prev_sibling(spark, d):
    nodes = supplier_nodes(spark, d)
    return tree.compile("children | {text: @text, before: prev_sibling | @text}", nodes).where("before IS NOT NULL").select("tree_id", "text", "before")
