"""Registered queries of the subpackage against their SQL, and the plans of the native ones."""

import duckdb
import pytest

import corpus_pipeline
from dwellstat.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", ["op1_mixing", "op6_quality_rules", "op10_line_dedup"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_keeps_columns_and_takes_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns
        path = queries.table.__globals__["scratch_path"](spark, "test-stage")
        out.write.parquet(path)
        held = spark.read.parquet(path)
        sizes.append(held.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] >= sizes[4] > 0
    assert {"mix_shard", "mix_epoch"} <= set(held.columns)
