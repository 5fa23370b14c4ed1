"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

1. A vector is rotated by three rounds of random signs and a Hadamard transform; the axis of its
   largest component, with sign, is one hash. A bucket of a table is the same ``hashes`` values. Every
   vector is entered in its own bucket and, per table, in the ``PROBES`` buckets it most nearly fell
   into, with one value replaced by its second or third choice.
2. A bucket's centre is its least member by row. A vector joins the least centre it meets within half
   the largest linking angle. Any two members of such a group are linked, by the triangle inequality
   of angles, so copies by the million cost one verified comparison each.
3. Groups that share a bucket are compared by their centres, in blocks of bounded size inside the
   tasks; only pairs that can hold a link come out. Their angle and both radii may decide for all
   members at once; the other pairs are verified member by member, again in blocks. A vector without
   a group is a group of its own.

All cosines are taken in double precision; bounds leave ``MARGIN`` for rounding, so every counted link
has the cosine asked for, and no pair of a shared bucket is missed. ``hashes`` and ``tables`` follow
from the number of vectors (see ``sized``): buckets keep about the same load and pairs of exactly the
least cosine about the same chance (0.92 measured on uniform directions; 0.99 and more from 0.97 on).

Cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing,
as do vectors of different lengths; equal vectors link, repeated rows included; null ids come last
when the least is chosen and a component of null ids only has none; all of several rows with the
least id are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common
from dwellstat.llm.common import written
from dwellstat.llm.graph import components

COSINE = 0.9
PROBES = 2
SEED = 20
#: Vectors a bucket of random directions holds at most, on average.
LOAD = 64
#: Groups or members compared with each other in one block.
BLOCK = 256
#: Longest run whose pairs are listed instead of multiplied out.
SHORT = 24
#: Angle left for rounding, in radians.
MARGIN = 1e-6

common.by_value(__name__)


def sized(n: int, width: int) -> tuple[int, int]:
    """(hashes per bucket, tables) for ``n`` vectors of ``width`` components.

    A hash has ``2 * width`` values. A further hash leaves about half the chance to meet per table.
    """
    hashes = max(3, math.ceil(math.log(max(n, 1) / LOAD + 1) / math.log(2 * max(width, 2))))
    return hashes, math.ceil(8 * 2.25 ** (hashes - 3))


def _width(length: int) -> int:
    return 1 << max(1, (length - 1).bit_length())


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one in double precision, filled with zeros to a power of two; their own lengths)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = _width(int(sizes.max())) if len(sizes) else 2
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    out /= np.sqrt(np.einsum("nd,nd->n", out, out))[:, None]
    return out, sizes


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis, not scaled."""
    shape, half = x.shape, 1
    while half < shape[-1]:
        pairs = x.reshape(-1, shape[-1] // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(shape)


def buckets(units: np.ndarray, signs: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Buckets of every vector as (vectors, tables, 1 + probes), its own first.

    ``signs`` has the shape (tables, hashes, 3, width).
    """
    tables, hashes, rounds, width = signs.shape
    turned = np.repeat(units[:, None, :width], tables * hashes, axis=1)
    for r in range(rounds):
        turned = hadamard(turned * signs[:, :, r].reshape(1, tables * hashes, width))
    turned = turned.reshape(len(units), tables, hashes, width)
    size = np.abs(turned)
    choices = min(3, width)
    axes = np.argsort(-size, axis=-1, kind="stable")[..., :choices]
    values = 2 * axes + (np.take_along_axis(turned, axes, -1) < 0)
    heights = np.take_along_axis(size, axes, -1)
    scale = np.array([(2 * width + 1) ** k % (1 << 62) for k in range(hashes + 1)], np.int64)
    own = (values[..., 0] * scale[:hashes]).sum(-1) + np.arange(tables) * scale[hashes]
    # replacing one value changes the bucket by a multiple of its scale
    steps = ((values[..., 1:] - values[..., :1]) * scale[:hashes, None]).reshape(len(units), tables, -1)
    cost = ((heights[..., :1] - heights[..., 1:]) ** 2).reshape(len(units), tables, -1)
    near = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
    return np.concatenate([own[..., None], own[..., None] + np.take_along_axis(steps, near, -1)], axis=-1)


def _entries(rows: DataFrame, length: int, n: int) -> DataFrame:
    """(bucket, member): member is the row in its own bucket and -1 - row where it was a probe."""
    hashes, tables = sized(n, _width(length))
    signs: dict[int, np.ndarray] = {}

    def drawn(width: int) -> np.ndarray:
        # the usual width is drawn here and shipped; others, if there are any, are drawn from the same seed in the tasks
        if width not in signs:
            signs[width] = np.random.default_rng(SEED).integers(0, 2, (tables, hashes, 3, width)).astype(np.int8) * 2 - 1
        return signs[width]

    drawn(_width(length))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                units, sizes = _units(batch.column("vector"))
                number = batch.column("row").to_numpy()
                for size in np.unique(sizes):
                    here = np.flatnonzero(sizes == size)
                    found = buckets(units[here], drawn(_width(int(size))))
                    member = np.repeat(number[here], found.shape[1] * found.shape[2]).reshape(found.shape).copy()
                    member[..., 1:] = -1 - member[..., 1:]
                    yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(member.reshape(-1))], names=["bucket", "member"])

    return rows.select("row", "vector").mapInArrow(enter, "bucket long, member long")


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Cosine of the vectors side by side; -1 where their lengths differ."""
    (units_a, sizes_a), (units_b, sizes_b) = _units(a), _units(b)
    width = min(units_a.shape[1], units_b.shape[1])
    return np.where(sizes_a == sizes_b, np.einsum("nd,nd->n", units_a[:, :width], units_b[:, :width]), -1.0)


def _assigned(rows: DataFrame, stars: DataFrame, half: float) -> DataFrame:
    """(row, id, hub, angle): each row with the least centre within ``half``, or itself."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = np.arccos(np.clip(_cosines(batch.column("vector"), batch.column("other")), -1, 1))
                near = pa.array(angle <= half)
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(near), batch.column("centre").filter(near), pa.array(angle).filter(near)],
                                                 names=["row", "centre", "angle"])

    sided = stars.join(rows.select("row", "vector"), "row").join(rows.select(F.col("row").alias("centre"), F.col("vector").alias("other")), "centre")
    near = sided.select("row", "centre", "vector", "other").mapInArrow(measure, "row long, centre long, angle double")
    hubs = near.groupBy("row").agg(F.min(F.struct("centre", "angle")).alias("hub"))
    return rows.select("row", "id").join(hubs, "row", "left").select(
        "row", "id", F.coalesce("hub.centre", "row").alias("hub"), F.coalesce("hub.angle", F.lit(0.0)).alias("angle"))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, edges): batches that hold all rows of each of their keys, from rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = _joined([*held, batch])
        values = np.stack([whole.column(k).to_numpy() for k in keys])
        edges = np.append(0, np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1)
        if len(edges) > 1:
            yield whole.slice(0, int(edges[-1])), edges
        held = [whole.slice(int(edges[-1]))]
    if held:
        yield held[0], np.array([0, held[0].num_rows])


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK)


def _group_pairs(members: DataFrame, assigned: DataFrame, groups: DataFrame, rows: DataFrame, limit: float) -> DataFrame:
    """(a, b, angle, cosine): pairs of groups that share a bucket and are near enough for a link, ``a`` below ``b``."""
    cells = written(members.join(assigned.select("row", "hub"), "row").select("bucket", "hub").distinct(), "vectors-cells")
    mixed = written(cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "vectors-mixed")
    placed = cells.join(mixed, "bucket").join(groups.select("hub", "radius"), "hub").join(
        rows.select(F.col("row").alias("hub"), "vector"), "hub")
    # block i of a bucket meets block j once: a row goes to every pair of blocks that its own is part of
    own = F.pmod(F.xxhash64("hub"), _blocks(F.col("n")))
    dealt = placed.withColumn("own", own).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), _blocks(F.col("n")) - 1)))
    dealt = dealt.select("bucket", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"), "own", "hub", "radius", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in _whole_runs(batches, ["bucket", "low", "high"]):
            units, sizes = _units(part.column("vector"))
            hub, radius, own = (part.column(c).to_numpy() for c in ("hub", "radius", "own"))
            same_block = part.column("low").to_numpy() == part.column("high").to_numpy()
            firsts, seconds = [], []
            length = np.diff(edges)
            run = np.repeat(np.arange(len(length)), length)
            # short runs together, each row with the one so many places on; long ones by a product of matrices
            short = length[run] <= SHORT
            for step in range(1, int(min(SHORT, length.max()))):
                i = np.flatnonzero((run[:-step] == run[step:]) & short[:-step])
                firsts.append(i)
                seconds.append(i + step)
            for r in np.flatnonzero(length > SHORT):
                i, j = np.triu_indices(int(length[r]), 1)
                angle = np.arccos(np.clip(units[edges[r]:edges[r + 1]] @ units[edges[r]:edges[r + 1]].T, -1, 1))[i, j]
                near = angle <= limit + 2 * MARGIN + radius[edges[r] + i] + radius[edges[r] + j]
                firsts.append(edges[r] + i[near])
                seconds.append(edges[r] + j[near])
            i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (firsts, seconds))
            use = (same_block[i] | (own[i] != own[j])) & (sizes[i] == sizes[j]) & (hub[i] != hub[j])
            i, j = i[use], j[use]
            swap = hub[i] > hub[j]  # products in one fixed order, so that a pair has one cosine wherever it meets
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            cosine = np.concatenate([np.zeros(0), *[np.einsum("nd,nd->n", units[i[k:k + 4096]], units[j[k:k + 4096]]) for k in range(0, len(i), 4096)]])
            angle = np.arccos(np.clip(cosine, -1, 1))
            near = angle <= limit + MARGIN + radius[i] + radius[j]
            yield pa.RecordBatch.from_arrays([pa.array(hub[i[near]]), pa.array(hub[j[near]]), pa.array(angle[near]), pa.array(cosine[near])],
                                             names=["a", "b", "angle", "cosine"])

    found = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(
        compare, "a long, b long, angle double, cosine double")
    return found.groupBy("a", "b").agg(F.min("angle").alias("angle"), F.max("cosine").alias("cosine"))


def _member_links(pairs: DataFrame, assigned: DataFrame, groups: DataFrame, rows: DataFrame, cosine: float) -> DataFrame:
    """(row, hub, other, n): links of a row into another group, for pairs (owner, partner) that need every member compared."""
    vectors = rows.select("row", "vector")
    sizes = groups.select("hub", "size")
    partners = pairs.join(sizes.select(F.col("hub").alias("partner"), "size"), "partner")
    spread = written(partners.groupBy("owner").agg(_blocks(F.sum("size")).alias("columns")).join(
        sizes.select(F.col("hub").alias("owner"), _blocks(F.col("size")).alias("lines")), "owner"), "vectors-spread")

    def each(upto: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), upto - 1))

    members = assigned.select("row", "hub")
    left = members.join(spread, members.hub == spread.owner).select(
        "owner", F.pmod(F.xxhash64("row"), F.col("lines")).alias("line"), each(F.col("columns")).alias("column"), F.lit(0).alias("side"), "row", "hub")
    right = members.join(pairs, members.hub == pairs.partner).join(spread, "owner").select(
        "owner", each(F.col("lines")).alias("line"), F.pmod(F.xxhash64("row"), F.col("columns")).alias("column"), F.lit(1).alias("side"), "row", "hub")
    dealt = left.unionByName(right).join(vectors, "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in (part.slice(int(a), int(b - a)) for part, edges in _whole_runs(batches, ["owner", "line", "column"])
                    for a, b in zip(edges[:-1], edges[1:])):
            side = run.column("side").to_numpy()
            i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(i) or not len(j):
                continue
            units, sizes = _units(run.column("vector"))
            row, hub = run.column("row").to_numpy(), run.column("hub").to_numpy()
            linked = (units[i] @ units[j].T >= cosine) & (sizes[i][:, None] == sizes[j][None, :])
            out = []
            for other in np.unique(hub[j]):
                n = linked[:, hub[j] == other].sum(1)
                out += [(row[i[k]], hub[i[k]], other, n[k]) for k in np.flatnonzero(n)]
            n = linked.sum(0)
            out += [(row[j[k]], hub[j[k]], hub[i[0]], n[k]) for k in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x[c] for x in out], np.int64)) for c in range(4)], names=["row", "hub", "other", "n"])

    return dealt.repartition("owner", "line", "column").sortWithinPartitions("owner", "line", "column").select(
        "owner", "line", "column", "side", "row", "hub", "vector").mapInArrow(compare, "row long, hub long, other long, n long")


def linked(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept): one row per vector."""
    limit = math.acos(cosine)
    found = F.col(f"`{vector}`")
    bad = found.isNull() | F.exists(found, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(found, lambda x: x != 0)
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.when(~F.coalesce(bad, F.lit(True)), found).alias("vector"))
    table = written(numbered, "vectors-rows")
    rows = table.where("vector is not null")
    n, length = rows.agg(F.count("*"), F.max(F.size("vector"))).first()

    entries = _entries(rows, length or 2, n)
    full = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.when(F.col("member") >= 0, F.col("member"))).alias("centre"))
    full = written(full.where("n > 1 and centre is not null").select("bucket", "centre"), "vectors-buckets")
    row = F.when(F.col("member") >= 0, F.col("member")).otherwise(-1 - F.col("member"))
    members = written(entries.join(full, "bucket").select("bucket", "centre", row.alias("row")), "vectors-members")
    stars = members.where("row <> centre").select("row", "centre").distinct()
    assigned = written(_assigned(rows, stars, limit / 2 - MARGIN), "vectors-assigned")
    # nulls of an id are left out of the least
    groups = written(assigned.groupBy("hub").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("id").alias("least")), "vectors-groups")

    pairs = _group_pairs(members, assigned, groups, rows, limit)
    info_a = groups.select(F.col("hub").alias("a"), F.col("size").alias("size_a"), F.col("radius").alias("radius_a"))
    info_b = groups.select(F.col("hub").alias("b"), F.col("size").alias("size_b"), F.col("radius").alias("radius_b"))
    reach = F.col("radius_a") + F.col("radius_b")
    verdict = (F.when((F.col("size_a") == 1) & (F.col("size_b") == 1) & (reach == 0), F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
               .when(F.col("angle") + reach <= limit - MARGIN, "all").otherwise("some"))
    judged = written(pairs.join(info_a, "a").join(info_b, "b").withColumn("verdict", verdict).where("verdict <> 'none'"), "vectors-pairs")
    whole = judged.where("verdict = 'all'")
    larger = F.col("size_a") >= F.col("size_b")
    open_pairs = judged.where("verdict = 'some'").select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("owner"),
                                                         F.when(larger, F.col("b")).otherwise(F.col("a")).alias("partner"))
    single = written(_member_links(open_pairs, assigned, groups, rows, cosine), "vectors-links")

    edges = whole.select("a", "b").union(single.select(F.col("hub").alias("a"), F.col("other").alias("b")).distinct())
    joined = components(edges, "vectors-components")
    gains = whole.select(F.col("a").alias("hub"), F.col("size_b").alias("more")).union(whole.select(F.col("b").alias("hub"), F.col("size_a").alias("more")))
    gains = gains.groupBy("hub").agg(F.sum("more").alias("more"))
    placed = groups.join(joined.select(F.col("node").alias("hub"), "component"), "hub", "left").join(gains, "hub", "left").select(
        "hub", "least", F.coalesce("component", "hub").alias("component"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    placed = written(placed, "vectors-placed")
    least = written(placed.groupBy("component").agg(F.min("least").alias("component_id")), "vectors-least")
    named = written(placed.join(least, "component").select("hub", "n_links", "component_id"), "vectors-named")
    extra = single.groupBy("row").agg(F.sum("n").alias("extra"))
    linked_rows = assigned.join(named, "hub").join(extra, "row", "left").select(
        "id", (F.col("n_links") + F.coalesce("extra", F.lit(0))).alias("n_links"), "component_id")
    alone = table.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
