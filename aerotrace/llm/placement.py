"""Placement of archived flights on shards by a weighted hash tree: region, rack, shard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.operators.slicing import row_number_sliced
from aerotrace.session import stored

LAW = "key"
RECORD_BYTES = 8
# Rows of one (shard, slice) window; the number of slices follows from it and the row count.
SLICE_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shards. ``weights[shard]`` is a shard's share, 1 if absent.

    ``initial`` shards are dealt over ``regions`` x ``racks``. Each shard added later stands in
    a region of its own, so that only the draw of that new region can change: a row either stays
    where it was or goes to the new shard. (A new shard in an old rack would raise the weights
    of that rack and region, and rows drawn into them could then land on its old shards.)
    """

    shards: int
    initial: int = 24
    regions: int = 2
    racks: int = 3
    weights: tuple[tuple[int, float], ...] = ()

    def path(self, shard: int) -> tuple[int, int]:
        if shard >= self.initial:
            return self.regions + shard - self.initial, 0
        region = shard % self.regions
        return region, (shard // self.regions) % self.racks

    def layout(self) -> dict[int, dict[int, dict[int, float]]]:
        """region -> rack -> shard -> weight."""
        weight, out = dict(self.weights), {}
        for shard in range(self.shards):
            region, rack = self.path(shard)
            out.setdefault(region, {}).setdefault(rack, {})[shard] = float(weight.get(shard, 1.0))
        return out


def _choose(key: Column, node: list[Column], weights: Column) -> Column:
    """Number of the child that wins: exponential draws of rate weight, the smallest is taken."""

    def draw(weight: Column, child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, *node, child), 11)
        uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        time = F.when(weight > 0, -F.ln(uniform) / weight).otherwise(F.lit(float("inf")))
        return F.struct(time.alias("time"), child.alias("child"))

    return F.array_min(F.transform(weights, draw))["child"]


def _literal(x: list | float) -> Column:
    return F.array(*map(_literal, x)) if isinstance(x, list) else F.lit(x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tree_shard(key: Column, tree: Tree) -> Column:
    """Shard of a key: descend region, rack, shard, at each level by a weighted hash draw.

    A node weighs what its shards weigh, so when weights change, rows move only between the
    children of nodes whose subtrees changed.
    """
    layout = tree.layout()
    numbers = [[sorted(layout[g].get(k, {})) for k in range(max(layout[g]) + 1)] for g in range(len(layout))]
    leaf = [[[layout[g][k][s] for s in n] for k, n in enumerate(racks)] for g, racks in enumerate(numbers)]
    rack = [[sum(w) for w in racks] for racks in leaf]
    region = [sum(w) for w in rack]

    def in_region(g: Column) -> Column:
        def in_rack(k: Column) -> Column:
            n = _choose(key, [g, k], F.get(F.get(_literal(leaf), g), k))
            return F.get(F.get(F.get(_literal(numbers), g), k), n)

        return _let(_choose(key, [g], F.get(_literal(rack), g)), in_rack)

    return _let(_choose(key, [], _literal(region)), in_region).cast("int")


def place_flights(
    flights: DataFrame,
    shards: int = 24,
    tree: Tree | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Shard and slot of every archived flight.

    ``flights`` has ``flight_id`` and ``payload`` (text); other columns are ignored. Returns
    ``flight_id, size, payload_crc32, law, shard, slot, grown_shard``: ``size`` is the payload's
    UTF-8 bytes plus 8; ``law`` is ``key`` (the flight id and the number of shards decide, so
    repeated ids and rows without an id each share one shard); ``slot`` counts the rows of a
    shard from 0 without gaps; ``grown_shard`` is the shard if there were one more, which differs
    from ``shard`` only where it is the new one.

    A null payload has no bytes (size 8, crc32 0). Equal rows get different slots. An empty table
    gives an empty result.

    Slots are numbered by (shard, hash slice) windows plus the counts of the slices before, so
    no window holds a whole shard; slices grow in number with the rows. Expressions only.
    """
    tree = tree or Tree(shards)
    more = Tree(tree.shards + 1, tree.initial, tree.regions, tree.racks, tree.weights)
    key = F.col("flight_id").cast("string")
    rows = flights.select(
        "flight_id",
        (F.coalesce(F.octet_length("payload"), F.lit(0)) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(F.coalesce("payload", F.lit(""))).alias("payload_crc32"),
        F.xxhash64("flight_id", "payload").alias("_mix"),
        tree_shard(key, tree).alias("shard"),
        tree_shard(key, more).alias("grown_shard"),
    )
    rows = stored(flights.sparkSession, rows, "placed")
    slices = max(1, -(-2 * rows.count() // (slice_rows * tree.shards)))
    rows = rows.withColumn("_slice", F.pmod("_mix", F.lit(slices)))
    order = ["_mix", "flight_id", "payload_crc32"]
    numbered = row_number_sliced(rows, ["shard"], order, "_n", "_slice")
    return numbered.select(
        "flight_id", "size", "payload_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("_n") - 1).cast("long").alias("slot"), "grown_shard",
    )
