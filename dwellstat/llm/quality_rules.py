"""Quality rules with thresholds learned from the corpus itself, per language and source.

Every document is measured once. The measures, as whole numbers, go into quantile sketches: counts
per bucket, with buckets whose width is at most a thirty-second of their value. Such sketches merge
by adding counts, so they are built by a partial aggregate per task, and the sketch of a language
is the sum of those of its sources. Each sketch yields fences around its middle half; a document is
kept when it lies inside the fences of its own language and source.

An upper fence is the largest of three places, all read from the sketch: ``REACH`` interquartile
ranges above the third quartile; an eighth of that quartile above it, so that a group of nearly equal
values keeps them; and just below the median of the values above the quartile, so that a measure
which is zero nearly everywhere is judged by the values of those documents where it is not. A fence
therefore rejects an eighth of its group at most. Lower fences mirror this.

Only DataFrame functions are used. Cases: a null or blank text has no words and fails the base
rules; null languages and sources form groups of their own; a group with fewer than ``MIN_DOCS``
documents uses its language's sketch, and a language with fewer uses that of the whole corpus; an
empty table gives no rows; other columns of the input are ignored, whatever their names. Repeated
rows are measured and returned each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellstat.llm.common import SPACE_PATTERN, joined_on, let, words, written

WINDOW = 8
MIN_WORDS = 20
#: A document fails when more than this per cent of its words lie in repeated windows.
MAX_REPEAT_PCT = 30
#: Fewest documents for thresholds of their own.
MIN_DOCS = 50
#: Fences lie this many interquartile ranges beyond the middle half.
REACH = 3
MEASURES = ("chars_per_100_words", "symbols_per_1000_words", "dup_per_1000_lines", "repeats_per_1000_words")
#: Measures that are also suspicious when low.
TWO_SIDED = ("chars_per_100_words",)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Number of words lying in a window of ``window`` words that occurs twice or more.

    Windows are compared by a 64-bit hash. Without a repeat one pass suffices; otherwise the
    hashes are sorted with their positions, and the stretches of equal neighbours are added up.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            let(placed, positions), start,
            lambda a, p: F.struct((p + window).alias("end"), (a["total"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("total")),
            lambda a: a["total"])

    hashes = F.transform(F.sequence(F.lit(1), F.size(tokens) - (window - 1)), lambda i: F.xxhash64(F.slice(tokens, i, window)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(tokens) <= window, F.lit(0).cast("long")).otherwise(found)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Word and line measures of each whole text, with the verdict of the base rules."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n_symbols = F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long")
    one_row = let(F.struct(by_words.alias("w"), by_lines.alias("l"), n_symbols.alias("n_symbols")), lambda s: s)
    out = docs.select(*keep, one_row.alias("m")).select(
        *keep, "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def _measure_columns() -> dict[str, Column]:
    return {"chars_per_100_words": F.expr("word_chars * 100 div greatest(n_words, 1)"),
            "symbols_per_1000_words": F.expr("n_symbols * 1000 div greatest(n_words, 1)"),
            "dup_per_1000_lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
            "repeats_per_1000_words": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)")}


def bucket(value: Column) -> Column:
    """Lower end of the bucket of a whole number: exact below 64, then 32 buckets to a doubling."""
    width = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return let(F.struct(value.alias("v"), F.pow(F.lit(2), width).cast("long").alias("w")), lambda s: s["v"] - s["v"] % s["w"])


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, level, measure, bucket, n): one sketch per group, per language and overall.

    ``level`` is 0 for a group, 1 for a language and 2 for the corpus. Documents failing the base
    rules are left out.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _measure_columns().items()]))
    groups = (measures.where(~F.col("base_failed")).select("lang", "source", cells.alias("c"))
              .groupBy("lang", "source", "c.measure", "c.bucket").agg(F.count("*").alias("n")))
    levels = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    raised = groups.select("*", levels.alias("level")).select(
        F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"),
        "level", "measure", "bucket", "n")
    return raised.groupBy("lang", "source", "level", "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences per group and level (see above): ``n_docs`` and a lower and upper end for every measure."""
    group = ["lang", "source", "level", "measure"]
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.select("*", F.sum("n").over(running).alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("n_docs"))
    whole = Window.partitionBy(*group)
    quarters = ranked.select(
        "*", F.min(F.when(4 * F.col("upto") >= F.col("n_docs"), F.col("bucket"))).over(whole).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("n_docs"), F.col("bucket"))).over(whole).alias("q3"))
    beside = quarters.select(
        "*", F.sum(F.when(F.col("bucket") <= F.col("q3"), F.col("n"))).over(whole).alias("to_q3"),
        F.coalesce(F.sum(F.when(F.col("bucket") < F.col("q1"), F.col("n"))).over(whole), F.lit(0)).alias("below"))
    above = (F.col("bucket") > F.col("q3")) & (2 * (F.col("upto") - F.col("to_q3")) >= F.col("n_docs") - F.col("to_q3"))
    under = (F.col("bucket") < F.col("q1")) & (2 * (F.col("upto") - F.col("n")) <= F.col("below"))
    found = beside.groupBy(*group).agg(
        F.max("n_docs").alias("n_docs"), F.max("q1").alias("q1"), F.max("q3").alias("q3"),
        F.min(F.when(above, F.col("bucket"))).alias("m_high"), F.max(F.when(under, F.col("bucket"))).alias("m_low"))
    reach = REACH * (F.col("q3") - F.col("q1"))
    low = F.least(F.col("q1") - reach, F.expr("q1 - q1 div 8"), F.col("m_low") + 1)  # nulls are left out
    high = F.greatest(F.col("q3") + reach, F.expr("q3 + q3 div 8"), F.col("m_high") - 1)
    fenced = found.select(*group, "n_docs", low.alias("low"), high.alias("high"))
    ends = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in MEASURES for e in ("low", "high")]
    return fenced.groupBy("lang", "source", "level").agg(F.max("n_docs").alias("n_docs"), *ends)


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measures, base verdict and final verdict ``kept`` per document."""
    measures = written(measured(docs, text, (key, "lang", "source")), "quality-measures")
    levels = thresholds(sketches(measures))
    ends = [f"{m}_{e}" for m in MEASURES for e in ("low", "high")]
    facts = F.struct("n_docs", *ends)
    steps = measures.select("lang", "source").distinct().select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("level"))
    steps = steps.select("g_lang", "g_source", "level", F.when(F.col("level") < 2, F.col("g_lang")).alias("lang"),
                         F.when(F.col("level") < 1, F.col("g_source")).alias("source"))
    found = joined_on(steps, levels.select("lang", "source", "level", facts.alias("facts")), ("lang", "source", "level"), "inner")
    limits = (found.where((F.col("facts.n_docs") >= MIN_DOCS) | (F.col("level") == 2)).groupBy("g_lang", "g_source")
              .agg(F.min_by("facts", "level").alias("limits")).select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), "limits"))
    inside = F.lit(True)
    for name, value in _measure_columns().items():
        inside = inside & (value <= F.col(f"limits.{name}_high"))
        if name in TWO_SIDED:
            inside = inside & (value >= F.col(f"limits.{name}_low"))
    joined = joined_on(measures, limits, ("lang", "source"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
