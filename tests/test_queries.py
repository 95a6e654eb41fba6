import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, found):
    at = [names.index(c) for c in sorted(names)]
    return sorted(str(tuple(tuple(v) if isinstance(v, list) else v for v in (r[k] for k in at))) for r in found)


from inkfold.plans import catalogue  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = duck.sql(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(sql.columns, sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names(spark):
    from inkfold.functions import udfs

    udfs.register(spark)
    assert spark.sql("SELECT md_to_html('*a*') h").first().h == "<p><em>a</em></p>"
    assert spark.sql("SELECT n.type FROM (SELECT '# a' AS t) d, LATERAL md_nodes(d.t) n").count() == 2
    assert spark.sql("SELECT md_to_html('# a', map('force_inline', 'true')) h").first().h == "<span># a</span>"
    assert [tuple(r) for r in spark.sql("SELECT u.label, u.resolved FROM (SELECT '[a][b] [c][d]\\n\\n[b]: /x' AS t) d, LATERAL md_uses(d.t) u").collect()] == [("b", True), ("d", False)]
    assert [r.tag for r in spark.sql("SELECT u.tag FROM (SELECT '<!-- <i> --><b x=1><script><u></script>' AS t) d, LATERAL html_tags(d.t) u").collect()] == ["b", "script", "script"]
    assert spark.sql("SELECT safe_attributes(map('onclick', 'x', 'id', 'y')) a").first().a == {"id": "y"}


def test_overrides_drop_no_row(spark):
    from inkfold.operators.analysis import with_overrides

    tags = spark.range(30_000).selectExpr("concat('t', id) AS tag")
    names = spark.range(30_000).selectExpr("concat('t', id) AS tag", "concat('n', id) AS new_tag")
    for most in (10, 100_000):
        assert with_overrides(tags, names, broadcast_rows=most).where("tag LIKE 'n%'").count() == 30_000


def test_texts_are_strings(spark):
    from inkfold.operators import parse

    with pytest.raises(TypeError):
        parse.nodes(spark.range(1).selectExpr("id AS doc_id", "id AS md"))


def test_windows_of_a_stream(spark, tmp_path):
    from inkfold.streaming.windows import node_counts

    rows = [("2024-01-01 10:05:00", "`a`"), ("2024-01-01 10:50:00", "`b` `c`"), ("2024-01-01 12:30:00", "`d`"), ("2024-01-01 15:00:00", "x")]
    spark.createDataFrame(rows, "ts string, md string").selectExpr("cast(ts AS timestamp) ts", "md").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, md string").parquet(str(tmp_path / "in"))
    q = node_counts(stream, "md", "ts", kinds=["codeInline"]).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    assert {(r.begin.hour, r.n) for r in spark.table("counts").collect()} == {(10, 3), (12, 1)}


def test_stored_nodes_compile(spark, tmp_path):
    from inkfold.operators import compile as compile_
    from inkfold.operators import parse
    from inkfold.sources.files import write_nodes

    docs = spark.createDataFrame([(1, "# a *b*\n\n- x"), (2, "c[^1]\n\n[^1]: d")], "doc_id long, md string")
    write_nodes(parse.nodes(docs), str(tmp_path / "nodes"))
    stored = spark.read.parquet(str(tmp_path / "nodes"))
    found = {r.doc_id: r.html for r in compile_.to_html(stored, parse.refs(docs)).collect()}
    assert found == {1: '<div><h1 id="a-b">a <em>b</em></h1><ul><li>x</li></ul></div>', 2: '<div><p>c<a href="#1"><sup>1</sup></a></p><footer><div id="1">1: d</div></footer></div>'}


def test_live_prefixes(spark, tmp_path):
    from inkfold.streaming.prefixes import live_html

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([(1, 1, "a **b"), (1, 2, "** c"), (2, 1, "x")], "id long, ord long, piece string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ord long, piece string").parquet(str(tmp_path / "in"))
    q = live_html(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("update").start()
    q.awaitTermination()
    assert {(r.id, r.html) for r in spark.table("live").collect()} == {(1, "<p>a <strong>b</strong> c</p>"), (2, "<p>x</p>")}
