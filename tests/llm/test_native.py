"""The operators made of DataFrame functions only: mixing, quality rules, line deduplication."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from dwellstat.llm import line_dedup, mixing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def water_filled(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def mixed_case(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", ["a", "b", "c", None][min(3, i % 11)]) for i in range(3000)]
    return docs_of(spark, rows + [(9001, None, None, "a"), (9002, "", "en", None), (None, "x y", "en", "b"), (5, "w " * 36, "en", None)])


def test_mixing_reaches_targets(spark):
    docs = mixed_case(spark)
    got = mixing.shares(docs).collect()
    assert len(got) == docs.count()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len((r.text or "").split())
    want = water_filled(size)
    taken, sources = collections.Counter(), {}
    by_size = {v: k for k, v in size.items()}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert (r.shards.count(",") + 1 if r.shards else 0) == (r.taken // r.size if r.size else 0)
        source = by_size[r.source_size]
        taken[source] += r.taken
        sources[source] = r.target
    for s, target in sources.items():
        assert target == pytest.approx(want[s])
        assert abs(taken[s] - target) <= 90
    assert sorted(map(tuple, mixing.shares(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_rows_match_shares(spark):
    docs = mixed_case(spark).withColumn("block", F.lit(1)).withColumn("size", F.lit("x"))
    rows = mixing.mixed(docs).collect()
    want = collections.Counter()
    for r in mixing.shares(docs).collect():
        want[r.doc_id, r.size] += r.taken // max(r.size, 1)
    assert +want == collections.Counter((r.doc_id, len(r.text.split())) for r in rows)
    per_shard = collections.Counter(r.mix_shard for r in rows)
    assert set(per_shard) <= set(range(2 ** mixing.TREE_DEPTH)) and max(per_shard.values()) < 3 * min(per_shard.values())


def test_hypergeometric_has_the_right_mean(spark):
    draws = spark.range(4000).select(mixing._hypergeometric(
        F.lit(100).cast("long"), F.lit(30).cast("long"), F.lit(40).cast("long"), mixing._unit(F.col("id"), 1)).alias("k"))
    stats = draws.agg(F.avg("k"), F.variance("k"), F.min("k"), F.max("k")).first()
    assert stats[0] == pytest.approx(12.0, abs=0.2)
    assert stats[1] == pytest.approx(40 * .3 * .7 * 60 / 99, rel=0.12)
    assert stats[2] >= 0 and stats[3] <= 30


def test_mixing_empty(spark):
    assert mixing.shares(docs_of(spark, [])).count() == 0
    assert mixing.mixed(docs_of(spark, [])).count() == 0
    assert mixing.shares(docs_of(spark, [(1, None, None, None), (2, " \n", "en", "a")])).agg(F.sum("taken")).first()[0] == 0


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i:i + 8])].append(i)
    covered = {i + o for at in windows.values() if len(at) > 1 for i in at for o in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


ODD = ["", None, " \t\n", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x" * 50_000, "a\n\na\n \na", "é# ü\x0b|b\x0cc", "w " * 5000,
       "one two three four five six seven eight nine one two three four five six seven eight", "  b c"]


def test_quality_measures(spark):
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] * 2
    got = quality_rules.judged(docs_of(spark, rows).withColumn("n_words", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, rep = measures(ODD[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), ODD[r.doc_id]
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_quality_thresholds_follow_the_group(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    marked = " ".join(f"w{i}#%" for i in range(40))
    rows = [(i, plain + f" x{i}", "en", "news") for i in range(100)] + [(100 + i, marked + f" x{i}", "en", "code") for i in range(100)]
    rows += [(300, marked, "en", "news"), (301, marked, "en", "code"), (302, plain, "xx", None)]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs_of(spark, rows)).collect()}
    assert kept[0] and kept[100] and kept[301] and not kept[300] and kept[302]
    assert quality_rules.judged(docs_of(spark, [])).count() == 0


def test_quality_buckets(spark):
    values = spark.range(0, 5000).select("id", quality_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(b <= v < b + max(1, b / 31) for v, b in values)


def test_line_report_against_plain_python(spark):
    """Counts, runs and digests; the texts themselves are compared in test_passages."""
    import hashlib

    passage = [f"passage line number {i}" for i in range(30)]
    texts = {i: "\n".join([f"own {i} {j}" for j in range(i % 5)] + (passage if i % 3 else []) + [f"end {i}"] + (passage[3:5] if i % 4 == 0 else [])) for i in range(40)}
    texts |= {40: None, 41: "", 42: "\n\n\n", 43: texts[7], 44: "one line", 45: "one line"}
    rows = [(i, t, "en", "a") for i, t in texts.items()] + [(7, texts[7], "en", "a"), (None, texts[7], "en", "a")]
    seen, want = set(), {}
    for i in [*sorted(texts), None]:
        lines = (texts[7 if i is None else i] or "").split("\n")
        full = [j for j, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in zip(full, full[1:]):
            gone |= set(range(a, b + 1)) if (lines[a], lines[b]) in seen else set()
            seen.add((lines[a], lines[b]))
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        want[i] = (len(lines), len(gone), sum(j - 1 not in gone for j in gone), hashlib.md5(kept.encode()).hexdigest())
    got = line_dedup.report(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_removed_lines, r.n_removed_runs, r.kept_md5) == want[r.doc_id], r
    assert sum(w[1] for w in want.values()) > 700
    assert line_dedup.report(docs_of(spark, [])).count() == 0
