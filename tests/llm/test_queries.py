import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from inkfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    ours = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert ours == sorted(str(tuple(r[sql.columns.index(c)] for c in columns)) for r in sql.fetchall())


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.written(out, "test")
    kept = docs.count()
    assert 0.7 * before < kept < before
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for i, t in text.items():
        assert sum(r.n_tokens for r in packed if r.doc_id == i) == len((t or "").split())
