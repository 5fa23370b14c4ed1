"""Prefix lengths at sizes where a product with the similarity is no whole number by rounding only."""

import numpy as np
from pyspark.sql import functions as F

from dwellstat.llm import near_dedup


def test_pair_that_shares_its_last_prefix_element_only(spark, monkeypatch):
    n, shared = 63, 56
    rest = [f"s{i}" for i in range(shared)]
    texts = {0: [f"a{i}" for i in range(n - shared)] + rest, 1: [f"b{i}" for i in range(n - shared)] + rest,
             2: [f"a{i}" for i in range(n - shared)], 3: [f"b{i}" for i in range(n - shared)]}
    # own elements repeat in short rows, so that all have the same frequency and stand first by their number
    number = {w: k for k, w in enumerate(sorted({w for t in texts.values() for w in t}))}
    monkeypatch.setattr(near_dedup, "_elements", lambda column: [np.array([number[w] for w in t.split()], np.uint64) for t in column.to_pylist()])
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "row long, text string")
    members = rows.select("row", F.col("row").alias("component"))
    pairs = {tuple(sorted((r.a, r.b))) for r in near_dedup._rare_pairs(members, rows, 0.8).collect()}
    assert (0, 1) in pairs
