"""Mixing sources to target weights through a splitting tree of block quotas.

1. A source's target in words is its weighted share of all words, at most ``MAX_EPOCHS`` times its
   own size; what lies above is shared again by weight among the others.
2. Each source is cut into at most ``BLOCKS`` blocks by a hash of its rows, and the blocks are
   permuted by another hash. The quota of a source is a whole number of block copies: every block
   once per whole epoch, then the first blocks of the permutation up to the target. The block that
   crosses the target is cut at the row nearest to it.
3. The quotas are divided among the output shards by a binary tree. At every node the left half
   draws its blocks from the node's blocks by a multivariate hypergeometric distribution, so each
   shard holds a fair random share of every source and the shares add up exactly.
4. A shard's blocks are consecutive in the permutation, hence disjoint between shards; its rows are
   ordered by a hash inside the shard.

Only DataFrame functions are used. All random numbers are hashes, so reruns and retries agree. The
tree's table has one row per node with one number per source; the block table has ``BLOCKS`` rows
per source however many documents there are.

Cases: a null text has size 0 and is never taken; null sources form one source, ordered last;
rows with the same id, source and text are all taken or all left when they straddle the target; empty
tables give no rows; other columns are kept untouched by ``mixed`` and ignored by ``shares``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellstat.llm.common import joined_on, let, packed, unpacked, words, written

BLOCKS = 1024
MAX_EPOCHS = 3
WEIGHT_CYCLE = 3
#: Output shards are two to this power.
TREE_DEPTH = 4
SEED = 20_24


def _hashed(*parts: Column | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def _unit(*parts: Column | int) -> Column:
    """A number strictly between 0 and 1 from the hash of its arguments."""
    return (F.pmod(_hashed(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Words per row with the row's block and its place ``h`` inside the block."""
    size = F.size(words(F.col(text))).cast("long")
    return placed(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("body")))


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``block`` and ``h`` from doc_id, source and the text's hash ``body``."""
    return rows.withColumns({"block": F.pmod(_hashed("doc_id", "source", "body", SEED), F.lit(BLOCKS)).cast("int"),
                             "h": _hashed("doc_id", "source", "body", SEED + 1)})


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target): water-filling of all words by weight under the cap."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source, so a window without partitions holds the list of sources only
    listed = sizes.withColumn("weight", 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHT_CYCLE)
    listed = listed.withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = listed.withColumn("capped", F.col("cap") <= rest / open_weight * F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    weights = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    share = left.cast("double") / weights * F.col("weight")
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def block_plan(rows: DataFrame) -> DataFrame:
    """One row per source and block: its place in the permutation, how often it is taken whole, and
    for the block that crosses the target the largest ``h`` still taken."""
    wanted = targets(rows).select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
                                  .cast("long").alias("whole"))
    wanted = wanted.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    permuted = Window.partitionBy("source").orderBy(_hashed("block", "source", SEED + 2), "block")
    blocks = blocks.select(
        "source", "block", "words", F.row_number().over(permuted).cast("long").alias("place"),
        F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.count("*").over(Window.partitionBy("source")).alias("n_blocks"))
    plan = joined_on(blocks, wanted, ("source",), "inner")
    plan = plan.withColumn("room", F.col("part") - (F.col("upto") - F.col("words")))
    plan = plan.withColumn("drawn", F.when(F.col("upto") <= F.col("part"), "all").when(F.col("room") > 0, "cut").otherwise("none"))
    edge = joined_on(rows.where("size > 0"), plan.where("drawn = 'cut'").select("source", "block", "room"), ("source", "block"), "inner")
    edge = edge.groupBy("source", "block", "h").agg(F.sum("size").alias("size"), F.max("room").alias("room"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.select("source", "block", "h", (upto - F.col("size") / 2 <= F.col("room")).alias("taken"))
    cuts = edge.where("taken").groupBy("source", "block").agg(F.max("h").alias("cut"))
    return joined_on(plan, cuts, ("source", "block"), "left")


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` items fall into ``draws`` draws, by inverting the
    distribution function at ``u``. Log ratios of neighbouring probabilities are summed, so nothing
    underflows."""
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    high = F.least(draws, good)

    def ratio(k: Column) -> Column:
        return F.log((good - k + 1) * (draws - k + 1)) - F.log(k * (total - good - draws + k))

    steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0.0)
    peak = F.aggregate(steps, F.struct(zero.alias("at"), zero.alias("top")),
                       lambda a, k: F.struct((a["at"] + ratio(k)).alias("at"), F.greatest(a["top"], a["at"] + ratio(k)).alias("top")),
                       lambda a: a["top"])

    def mass(top: Column) -> Column:
        return F.aggregate(steps, F.struct(zero.alias("at"), F.exp(-top).alias("sum")),
                           lambda a, k: F.struct((a["at"] + ratio(k)).alias("at"), (a["sum"] + F.exp(a["at"] + ratio(k) - top)).alias("sum")),
                           lambda a: a["sum"])

    def invert(top: Column, goal: Column) -> Column:
        return F.aggregate(
            steps, F.struct(zero.alias("at"), F.exp(-top).alias("sum"), low.alias("k")),
            lambda a, k: F.struct(
                (a["at"] + ratio(k)).alias("at"), (a["sum"] + F.exp(a["at"] + ratio(k) - top)).alias("sum"),
                F.when(a["sum"] < goal, k).otherwise(a["k"]).alias("k")),
            lambda a: a["k"])

    return let(peak, lambda top: let(mass(top) * u, lambda goal: invert(top, goal)))


def _left_half(quotas: Column, node: Column, draws: Column) -> Column:
    """The left child's share of each quota: one hypergeometric draw per source, given the earlier ones."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(total.alias("total"), draws.alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, q: Column) -> Column:
        u = _unit(node, F.size(a["out"]), SEED + 3)
        return let(_hypergeometric(a["total"], q, a["draws"], u), lambda k: F.struct(
            (a["total"] - q).alias("total"), (a["draws"] - k).alias("draws"), F.concat(a["out"], F.array(k)).alias("out")))

    return F.aggregate(quotas, start, step, lambda a: a["out"])


def shard_quotas(quotas: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(source, ends): for each source the running total of its block copies over the shards.

    ``quotas`` has one row per source with its number of block copies.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.xxhash64("source").alias("o"), "source", "quota")))
    tree = quotas.agg(ordered.alias("s")).select(
        F.lit(1).cast("long").alias("node"), F.col("s.source").alias("sources"), F.col("s.quota").alias("quotas"))
    for _ in range(depth):
        draws = F.expr("aggregate(quotas, 0L, (a, q) -> a + q) div 2")
        split = tree.select("node", "sources", "quotas", _left_half(F.col("quotas"), F.col("node"), draws).alias("left"))
        halves = F.explode(F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quotas")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("quotas", "left", lambda q, k: q - k).alias("quotas"))))
        tree = split.select("sources", halves.alias("h")).select("h.node", "sources", "h.quotas")
    leaves = tree.select("node", F.explode(F.arrays_zip("sources", "quotas")).alias("x")).select("node", "x.sources", "x.quotas")
    upto = F.sum("quotas").over(Window.partitionBy("sources").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    ends = leaves.select(F.col("sources").alias("source"), "node", upto.alias("end")).groupBy("source").agg(
        F.sort_array(F.collect_list("end")).alias("ends"))
    return ends


def mixing_plan(rows: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """The written block plan with, per source, the ends of the shards' block ranges."""
    blocks = written(block_plan(rows), "mix-blocks")
    quota = F.max(F.col("whole") * F.col("n_blocks")) + F.sum(F.when(F.col("drawn") != "none", 1).otherwise(0))
    quotas = blocks.groupBy("source").agg(quota.alias("quota"))
    return joined_on(blocks, shard_quotas(quotas, depth), ("source",), "inner")


def _copies(whole: Column, drawn: Column, cut: Column, h: Column, size: Column) -> Column:
    extra = (drawn == "all") | ((drawn == "cut") & F.coalesce(h <= cut, F.lit(False)))
    return F.when(size > 0, whole + extra.cast("long")).otherwise(0)


def shares(docs: DataFrame, text: str = "text", depth: int = TREE_DEPTH) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken words, and the shards its copies go to."""
    rows = written(sized(docs, text), "mix-sizes")
    joined = joined_on(rows, mixing_plan(rows, depth), ("source", "block"), "inner")
    joined = joined.withColumn("copies", _copies(F.col("whole"), F.col("drawn"), F.col("cut"), F.col("h"), F.col("size")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                         F.array_join(_shards(), ",").alias("shards"))


def _shards() -> Column:
    """The shard of each copy: the first range whose end is not before the copy's number."""
    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda e: F.size(F.filter("ends", lambda x: x < e * F.col("n_blocks") + F.col("place"))))


def mixed(docs: DataFrame, text: str = "text", depth: int = TREE_DEPTH) -> DataFrame:
    """The mix itself: every taken row once per copy, dealt to its shard and ordered by hash inside it.

    Keeps the columns of ``docs`` and adds ``mix_shard`` and ``mix_epoch``, in place of columns of these names.
    """
    rows = written(sized(docs, text), "mix-sizes")
    plan = mixing_plan(rows, depth)
    plan = plan.select("source", "block", F.struct(*[c for c in plan.columns if c != "source"]).alias("plan"))
    tagged = placed(packed(docs, doc_id=F.col("`doc_id`"), source=F.col("`source`"), size=F.size(words(F.col(f"`{text}`"))).cast("long"),
                           body=F.xxhash64(F.col(f"`{text}`"))))
    joined = joined_on(tagged, plan, ("source", "block"), "inner")
    copies = _copies(F.col("plan.whole"), F.col("plan.drawn"), F.col("plan.cut"), F.col("h"), F.col("size"))
    out = joined.withColumn("copies", copies).where("copies > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    shard = F.size(F.filter("plan.ends", lambda x: x < F.col("epoch") * F.col("plan.n_blocks") + F.col("plan.place")))
    out = out.withColumn("shard", shard).withColumn("order", _hashed("h", "epoch", SEED + 4))
    kept = [column for c, column in zip(docs.columns, unpacked(docs.columns)) if c.lower() not in ("mix_shard", "mix_epoch")]
    return out.repartition("shard", F.pmod("order", F.lit(64))).sortWithinPartitions("shard", "order").select(
        *kept, F.col("shard").alias("mix_shard"), F.col("epoch").alias("mix_epoch"))
