import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dwellstat.operators import agreement, joins, ordering


def as_of_plain(left, right, first_before):
    """Newest (since, value) of the key at or before each time."""
    known = {}
    for key, since, value in right:
        if key is not None and since is not None:
            known.setdefault(key, {}).setdefault(since, []).append(value)
    out = []
    for number, key, time in left:
        days = sorted(known.get(key, {}))
        at = bisect.bisect_right(days, time) - 1 if time is not None and days else None
        if at == -1:
            at = 0 if first_before else None
        out.append((number, None, None) if at is None else (number, days[at], max(known[key][days[at]])))
    return out


@pytest.mark.parametrize("first_before", [False, True])
def test_as_of_against_plain_python(spark, first_before):
    """One key has most rows and one of its days a third of all; keys, times and beginnings may be missing."""
    rng = random.Random(5)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(900))
    left = [(i, "hot" if i % 3 else f"k{rng.randrange(40)}", dt.date(2001, 5, 5) if i % 3 == 1 else day()) for i in range(900)]
    left += [(900, None, day()), (901, "hot", None), (902, "nobody", day())]
    right = [("hot" if i % 2 else f"k{rng.randrange(40)}", day(), float(i)) for i in range(300)]
    right += [right[1][:2] + (9999.0,), ("hot", None, 1.0), (None, day(), 2.0)]
    a = spark.createDataFrame(left, "n long, key string, time date").repartition(6)
    b = spark.createDataFrame(right, "key string, since date, value double").repartition(5)
    got = joins.as_of(a, b, ["key"], "time", "since", first_before)
    assert got.columns == ["n", "key", "time", "since", "value"]
    assert sorted((r.n, r.since, r.value) for r in got.collect()) == sorted(as_of_plain(left, right, first_before))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_empty_sides(spark):
    a = spark.createDataFrame([(1, "x", 5.0)], "n long, key string, time double")
    b = spark.createDataFrame([], "key string, since double, value double")
    assert [tuple(r) for r in joins.as_of(a, b, ["key"], "time", "since").collect()] == [(1, "x", 5.0, None, None)]
    assert joins.as_of(a.where("false"), b, ["key"], "time", "since").count() == 0


def test_blocks_pair_every_two_raters_once(spark):
    rows = [("hot", f"r{i:03d}", float(i % 7)) for i in range(120)] + [("cold", f"r{i:03d}", 1.0) for i in range(3)] + [("alone", "r000", 2.0)]
    rated = spark.createDataFrame(rows, "item string, rater string, _s double")
    pairs = [tuple(r) for r in agreement._blocked_pairs(rated, "rater", "item", 10).collect()]
    assert len(pairs) == len(set(pairs)) == 120 * 119 // 2 + 3
    score = {(i, r): s for i, r, s in rows}
    assert all(a < b and score[i, a] == x and score[i, b] == y for i, a, x, b, y in pairs)


def test_one_item_with_ten_thousand_raters_spreads(spark):
    """The pairs of such an item are never made here; what counts is how many join keys they are dealt to."""
    n, block = 10_000, 256
    blocks = -(-n // block)
    rated = spark.range(n).select(F.lit("hot").alias("item"), F.col("id").alias("rater"), F.lit(1.0).alias("_s"))
    sizes = rated.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("n")).first().n
    own = rated.groupBy(F.pmod(F.xxhash64("rater"), F.lit(sizes)).alias("own")).count()
    assert sizes == blocks and own.count() == blocks and own.agg(F.max("count")).first()[0] < 2 * block
    assert blocks * (blocks + 1) // 2 > 700
