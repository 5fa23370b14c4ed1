"""Registered queries against their SQL, and what their plans must not contain."""

import math
import re

import duckdb
import pytest

from dwellstat.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 5) + 0.0
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
    assert got == want


NO_PAIRS = ["agreement_all", "radius_counts", "asof_lot_version", "pick_model", "quantile_bins", "two_pass_sample", "next_unrated",
            "quota_prefix", "pending_tasks", "blends", "clean_sales", "circle_requests", "outlier_raters"]


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cross_products(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["bin_sample", "stratified_sample", "first_n_per_group", "lot_fields", "rating_subset", "largest_gaps"])
def test_group_limits_act_before_the_shuffle(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_scan_reads_only_what_is_used(spark, sf_dir):
    plan = catalog.queries()["semi_exclude"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schema = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_orderkey" in s)
    assert schema == "l_orderkey:bigint,l_quantity:double"
    assert "GreaterThan(l_quantity,45.0)" in plan
