import duckdb

import corpus_pipeline
from corpuskiln.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        assert 0 < docs.count() <= rows
        rows = docs.count()
    pieces = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLE.items():
        found = QUERIES[name](spark, SF).toPandas()
        want = con.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(found.columns) == columns
        a, b = (x[columns].sort_values(columns, ignore_index=True).astype(str) for x in (found, want))
        assert a.equals(b), name


def test_only_numbered_queries_and_the_pipeline():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
