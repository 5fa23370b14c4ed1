"""Pipeline stages on columns, ids and texts that might clash with what the operators add."""

import corpus_pipeline
from dwellstat.llm import decontamination, line_dedup, mixing, near_dedup, toxicity

CLASHES = ("__size", "mix_shard", "a.b", "__gone", "__body", "__cut", "__n", "__digest", "__was_blank", "row", "row_key", "text_id", "digest", "cut", "gone", "h", "block",
           "plan", "size", "n", "body", "copies", "shard", "order", "_1", "p_toxic")


def docs_of(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", s, 0, *range(100 + n, 100 + n + len(CLASHES))) for n, (i, t, s) in enumerate(rows)], schema)


def words_of(n, seed):
    return " ".join(f"w{seed}x{i}" for i in range(n))


ROWS = [(i, words_of(30, i), "ab"[i % 2]) for i in range(12)] + [(None, words_of(30, 50), "a"), (None, words_of(30, 51), None), (None, None, "a"), (None, None, "b"), (7, None, "a"), (3, "", "a")]


def kept_whole(docs, out):
    before = {tuple(r) for r in docs.collect()}
    return [r for r in out.collect() if tuple(r) not in before]


def test_no_column_is_lost_or_changed(spark):
    docs = docs_of(spark, ROWS)
    bench = spark.createDataFrame([(1, words_of(30, 4)), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for out in (line_dedup.without_passages(docs), near_dedup.deduplicated(docs), decontamination.cleaned(docs, bench), toxicity.filtered(docs, labels),
                corpus_pipeline.drop_repeated_passages(spark, docs, "")):
        assert out.columns == docs.columns
        assert kept_whole(docs, out) == []
    mixed = mixing.mixed(docs)
    assert mixed.columns == [c for c in docs.columns if c != "mix_shard"] + ["mix_shard", "mix_epoch"]
    rest = docs.drop("mix_shard")
    assert kept_whole(rest, mixed.select(*[f"`{c}`" for c in rest.columns])) == []


def test_rows_without_ids_or_texts_are_told_apart(spark):
    docs = docs_of(spark, ROWS)
    assert near_dedup.deduplicated(docs).count() == len(ROWS)
    assert near_dedup.deduplicated(docs.union(docs)).count() == len(ROWS)
    leak = spark.createDataFrame([(1, words_of(30, 50))], "item_id long, text string")
    assert decontamination.cleaned(docs, leak).count() == len(ROWS) - 1


def test_of_equal_texts_the_same_row_stays(spark):
    rows = [(1, words_of(30, 1), s) for s in "abcdef"]
    first = near_dedup.deduplicated(docs_of(spark, rows)).collect()
    again = near_dedup.deduplicated(docs_of(spark, rows).repartition(5)).collect()
    assert len(first) == 1 and first == again


def test_mixing_reaches_targets_without_ids(spark):
    rows = [(None, words_of(10, i), "a") for i in range(400)] + [(5, words_of(10, 1000 + i), "b") for i in range(400)]
    got = mixing.shares(docs_of(spark, rows)).collect()
    for size in {r.target for r in got}:
        taken = sum(r.taken for r in got if r.target == size)
        assert abs(taken - size) <= 10
