"""Every registered query that has SQL, against it, over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tessella import queries, queries_more, queries_text, queries_tree  # noqa: F401  they register into queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = round(float(v), 6)
        return int(v) if v == int(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in got.collect()]
    if name in queries.ORACLE:
        want = duck.execute(queries.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert table(got.columns, rows) == table(columns, want.fetchall())


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["bucket", "count", "window"]


def test_detection_reads_the_whole_table(spark, tmp_path):
    """Ids that don't begin at 0: an id subset would find no lines."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.withColumn("event_id", events["event_id"] + 1000).write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in queries.QUERIES["src_detect"](spark, str(tmp_path)).collect()} == {("bracket", 1), ("json", 1), ("unknown", 1)}


def test_skeleton_queries_return_what_they_are_named_after(spark):
    got = {x: queries.QUERIES[x](spark, FOLDER) for x in ("aq_skeleton", "aq_signatures", "aq_parse_metrics")}
    assert got["aq_skeleton"].columns == ["tree_id", "imports", "declarations"]
    assert got["aq_signatures"].columns == ["tree_id", "node_id", "type", "name", "params", "return_type", "line", "lines"]
    assert got["aq_parse_metrics"].columns == ["tree_id", "named", "errors", "missing", "confidence"]
    assert got["aq_skeleton"].count() == spark.read.parquet(f"{FOLDER}/pages.parquet").where("html is not null").count()


def test_go_months_with_skips_only(spark, tmp_path):
    """Months whose orders are all pending: Go runs without a pass or failure."""
    spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderstatus = 'P'").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["src_gotest"])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES["src_gotest"](spark, str(tmp_path))
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(columns, want.fetchall())
