"""Leaks of short items, and of items and documents that share an id."""

import random

from pyspark.sql import functions as F

from dwellstat.llm import decontamination


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**7)}" for _ in range(n))


def test_no_short_item_is_overlooked(spark):
    items = [(i, prose(i, 5 + i % 8)) for i in range(240)]
    docs = [(i, f"{prose(1000 + i, 60 + i)} {t} {prose(3000 + i, 60)}") for i, t in items]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got) == [(i, i, 1 + i % 8, 1 + i % 8) for i in range(240)]


def test_rows_that_share_an_id(spark):
    item, other = prose(1, 20), prose(2, 30)
    items = spark.createDataFrame([(1, item), (1, other), (1, item), (None, prose(3, 15))], "item_id long, text string")
    rows = [(None, f"x {item} y"), (None, prose(7, 50)), (None, None), (5, f"{item} z"), (5, prose(8, 50)), (6, f"a {prose(3, 15)} b"),
            (7, " ".join(other.split()[:10])), (5, f"{item} z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    got = decontamination.leaks(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got), key=str) == [
        (5, 1, 16, 16), (6, None, 11, 11), (None, 1, 16, 16)]
    kept = decontamination.cleaned(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[i][:2] for i in (1, 2, 4, 6)], key=str)
