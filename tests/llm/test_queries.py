"""Registered training-data queries next to their SQL, and the pipeline's stages one by one."""

import pytest

import corpus_pipeline
from contestry.llm import queries
from contestry.session import Stage
from tools.check_oracle import connect, rows_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    df = queries.Q[name](spark, sf)
    cur = connect(sf).execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage, columns, counts = Stage(spark, "pipeline-test"), docs.columns, [docs.count()]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage.write(step(spark, docs, sf), str(i))
        counts.append(docs.count())
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 100
    assert docs.selectExpr("sum(length)").first()[0] == docs.groupBy("sequence_id").agg({"length": "sum"}).selectExpr("sum(`sum(length)`)").first()[0]
