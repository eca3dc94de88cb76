"""Merkle manifest of an archive: leaves, incremental witnesses, proofs folded back to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.session import stored
from aerotrace.sources.archive import ARCHIVE_COLUMNS

ARITY = 8
PROVED = ("leaf", "subroot", "proof_sha256", "folded_root")
HEIGHT = 4  # levels of a block, which is the unit of work: ARITY ** HEIGHT nodes


def digest(nodes: Sequence[bytes]) -> bytes:
    """Parent of a run of nodes: sha256 of their hexadecimal digests one after the other."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


class Witnesses:
    """Nodes are appended from left to right; every open subtree carries the witness of its leaves.

    A run of a level collects up to ``arity`` siblings. A new sibling starts with those before it
    as its left witness and extends the right witness of each of them. A full run is replaced by its
    parent, which is appended one level up. As runs are aligned, the leaves below a node share
    its step, so a step is kept once per node and not once per leaf.
    """

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        self.open: list[list[bytes]] = [[]]
        self.steps: list[list[tuple[tuple[bytes, ...], list[bytes]]]] = [[]]

    def append(self, node: bytes) -> None:
        level = 0
        while node is not None:
            run, steps = self.open[level], self.steps[level]
            for _, right in steps[len(steps) - len(run) :]:
                right.append(node)
            steps.append((tuple(run), []))
            run.append(node)
            node = self._close(level) if len(run) == self.arity else None
            level += 1

    def _close(self, level: int) -> bytes:
        parent = digest(self.open[level])
        self.open[level] = []
        if level + 1 == len(self.open):
            self.open.append([])
            self.steps.append([])
        return parent

    def finish(self, height: int | None = None) -> bytes:
        """Close the runs that are not full and return the root.

        Without ``height`` up to the level at which one node remains; with it up to just that level,
        because the nodes are one block of a larger tree.
        """
        level = 0
        while level < height if height is not None else len(self.open[level]) > 1 or any(self.open[level + 1 :]):
            if self.open[level]:
                node, up = self._close(level), level + 1
                for _, right in self.steps[up][len(self.steps[up]) - len(self.open[up]) :]:
                    right.append(node)
                self.steps[up].append((tuple(self.open[up]), []))
                self.open[up].append(node)
            level += 1
        self.height = level
        return self.open[level][0]

    def path(self, leaf: int) -> list[tuple[tuple[bytes, ...], list[bytes]]]:
        """Left and right siblings of a leaf, level by level."""
        return [self.steps[level][leaf // self.arity**level] for level in range(self.height)]


def _packed(path) -> bytes:
    """Per level the number of left and of right siblings and their digests."""
    return b"".join(bytes([len(a), len(b)]) + b"".join(a) + b"".join(b) for a, b in path)


def _unpacked(data: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    path, at = [], 0
    while at < len(data):
        sides = []
        left, right = data[at], data[at + 1]
        at += 2
        for n in (left, right):
            sides.append([data[i : i + 32] for i in range(at, at + 32 * n, 32)])
            at += 32 * n
        path.append(tuple(sides))
    return path


def _witnessed(nodes: pa.Table, arity: int, height: int) -> tuple[Witnesses, bytes]:
    tree = Witnesses(arity)
    for node in nodes["_node"].to_pylist():
        tree.append(node)
    whole = nodes["_total"][0].as_py() <= arity**height
    return tree, tree.finish(None if whole else height)


def _roots(arity: int, height: int):
    def roots(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("_pos")
        root = _witnessed(nodes, arity, height)[1]
        return nodes.slice(0, 1).select(["_tree", "_block"]).append_column("_node", pa.array([root], pa.binary()))

    return roots


def _extended(arity: int, height: int, name: str):
    """Witnesses of block roots: of their own block, extended by that of the block."""

    def extended(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("_pos")
        tree, _ = _witnessed(nodes, arity, height)
        rest = outer["_path"][0].as_py()
        paths = [_packed(tree.path(i)) + rest for i in range(len(nodes))]
        return pa.table([nodes[name], nodes["_pos"], pa.array(paths, pa.binary())], names=["_tree", "_block", "_path"])

    return extended


def _proved(keys: list[str], arity: int, height: int):
    """Proofs of leaves, and the root folded from the leaf that was received."""

    def proved(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("_pos")
        tree, _ = _witnessed(nodes, arity, height)
        rest, subroot = _unpacked(outer["_path"][0].as_py()), outer["_subroot"][0].as_py().hex()
        proofs, folded, leaves = [], [], nodes["_node"].to_pylist()
        for i, (own, received) in enumerate(zip(leaves, nodes["_received"].to_pylist(), strict=True)):
            proof, node = hashlib.sha256(), own if received is None else received
            for left, right in [*tree.path(i), *rest]:
                proof.update("".join(n.hex() for n in (*left, *right)).encode())
                node = digest((*left, node, *right))
            proofs.append(proof.hexdigest())
            folded.append(node.hex())
        columns = [[n.hex() for n in leaves], [subroot] * len(leaves), proofs, folded]
        return pa.table([*[nodes[k] for k in keys], *columns], names=[*keys, *PROVED])

    return proved


def _numbered(spark: SparkSession, rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``_pos``, the gapless place within ``_tree`` by ``order``, and ``_total``.

    One range shuffle; a tree may spread over any number of ranges, whose row counts are summed up.
    """
    sorted_rows = rows.repartitionByRange("_tree", *order).sortWithinPartitions("_tree", *order)
    placed = stored(spark, sorted_rows.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    ranges = placed.groupBy("_tree", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    all_of, earlier = Window.partitionBy("_tree"), Window.partitionBy("_tree").orderBy("_part")
    starts = ranges.select(
        "_tree", "_part", (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(all_of).alias("_total"),
    )
    return (
        placed.withColumn("_part", part).join(starts, ["_tree", "_part"])
        .withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
    )


def _climb(spark: SparkSession, nodes: DataFrame, size: int, arity: int, height: int) -> list[DataFrame]:
    """Tables of nodes from ``nodes`` upward, each of the block roots of the one before; the last has
    one node per tree."""
    block = F.floor(F.col("_pos") / F.lit(size)).cast("long")
    levels = [stored(spark, nodes.withColumn("_block", block), "nodes")]
    while True:
        roots = levels[-1].groupBy("_tree", "_block").applyInArrow(
            _roots(arity, height), "_tree string, _block long, _node binary"
        )
        blocks = F.ceil(F.col("_total") / F.lit(size)).cast("long")
        totals = levels[-1].where("_pos = 0").select("_tree", blocks.alias("_total"))
        up = roots.join(totals, "_tree").select(
            "_tree", F.col("_block").alias("_pos"), "_total", "_node",
            F.floor(F.col("_block") / F.lit(size)).cast("long").alias("_block"),
        )
        levels.append(stored(spark, up, "nodes"))
        if levels[-1].where("_total > 1").isEmpty():
            return levels


def _descend(spark: SparkSession, levels: list[DataFrame], top: DataFrame, arity: int, height: int) -> DataFrame:
    """``_tree, _block, _path`` for the blocks of the first table; ``top`` has ``_tree, _path``."""
    outer = top.select("_tree", F.lit(0).cast("long").alias("_block"), "_path")
    keys = ["_tree", "_block"]
    for nodes in reversed(levels[1:-1]):
        # block roots are appended like leaves, their witnesses are extended by those above
        outer = stored(
            spark,
            nodes.groupBy(*keys).cogroup(outer.groupBy(*keys)).applyInArrow(
                _extended(arity, height, "_tree"), "_tree string, _block long, _path binary"
            ),
            "paths",
        )
    return outer


def leaf(values: Sequence[Column]) -> Column:
    """Hexadecimal sha256 of the values: ``-`` for null, else the number of UTF-8 bytes, ``:``, the text."""
    text = [v.cast("string") for v in values]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256
    )


def archive_manifest(
    spark: SparkSession,
    reports: DataFrame,
    fields: Sequence[str] = ARCHIVE_COLUMNS,
    folder: str = "dt",
    order: Sequence[str] = ("ts", "icao24"),
    received: dict[str, Column] | None = None,
    arity: int = ARITY,
    height: int = HEIGHT,
) -> DataFrame:
    """Merkle tree over archived reports, a proof for each, and the check of a received copy.

    ``reports`` has the columns ``fields``, ``folder`` and ``order``; others are ignored. By default
    these are position reports as the archive holds them: one subtree per day (``dt``), leaves by
    ``ts`` and ``icao24``. A leaf is the sha256 of the fields in their order (see ``leaf``;
    timestamps count as microseconds, other types as Spark writes them). While a folder has several nodes, each ``arity``
    consecutive ones become their parent, the last run may be shorter; what is left is its
    ``subroot``. The subroots in the order of their folders (null first, then by UTF-8 bytes) give
    ``root`` in the same way.

    ``received`` replaces fields by what a reader of a copy has: the leaf of these values is folded
    with the witness of the original and must give the root.

    Returns the ``order`` columns and ``leaf, subroot, root, proof_sha256`` (sha256 of all siblings,
    from the leaf to the root, left to right), ``folded_root`` and ``verified``, one row per report.
    Null folders, keys and fields count as values, null keys first; equal keys are ordered by their
    leaves, repeated rows are leaves of their own; a single leaf is its subroot, a single subroot
    the root; an empty table gives an empty result.

    Leaves are digested where they are read; only digests and keys are sorted by range. Blocks of ``arity ** height`` leaves are the
    units of work. A first pass appends the leaves of each block and gives its root; block roots are
    appended in the same way in blocks of their own, until one node per folder is left. Then
    witnesses come down: those of a block root extend the witnesses of all leaves of its block.
    """
    received = received or {}
    names = [f"_k{i}" for i in range(len(order))]
    kinds = [reports.schema[c].dataType for c in order]

    def value(name: str) -> Column:
        return F.unix_micros(name) if isinstance(reports.schema[name].dataType, T.TimestampType) else F.col(name)

    own = leaf([value(c) for c in fields])
    copy = leaf([received.get(c, value(c)) for c in fields]) if received else F.lit(None).cast("string")
    leaves = reports.select(
        F.coalesce(F.concat(F.lit("="), F.col(folder).cast("string")), F.lit("")).alias("_tree"),
        *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)],
        F.unhex(own).alias("_node"), F.unhex(copy).alias("_received"),
    ).withColumn("_received", F.when(F.col("_received") != F.col("_node"), F.col("_received")))
    size = arity**height
    leaves = _numbered(spark, stored(spark, leaves, "leaves"), [*names, "_node"], "leaves")
    levels = _climb(spark, leaves, size, arity, height)

    subroots = levels[-1].select(F.col("_tree").alias("_folder"), "_node")
    folders = _numbered(spark, subroots.withColumn("_tree", F.lit("")), ["_folder"], "folders")
    above = _climb(spark, folders, size, arity, height)
    root = above[-1].select(F.lower(F.hex("_node")).alias("root")).first()
    keys = ["_tree", "_block"]
    ends = _descend(spark, above, above[-1].select("_tree", F.lit("").cast("binary").alias("_path")), arity, height)
    tops = above[0].groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(
        _extended(arity, height, "_folder"), "_tree string, _block long, _path binary"
    )
    outer = _descend(spark, levels, stored(spark, tops.select("_tree", "_path"), "paths"), arity, height)
    outer = outer.join(levels[-1].select("_tree", F.col("_node").alias("_subroot")), "_tree")
    out = T.StructType([
        *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)],
        *[T.StructField(c, T.StringType()) for c in PROVED],
    ])
    proved = levels[0].groupBy(*keys).cogroup(outer.groupBy(*keys)).applyInArrow(_proved(names, arity, height), out)
    rows = proved.withColumn("root", F.lit(root["root"] if root else None).cast("string"))
    return rows.select(
        *[F.col(n).alias(c) for n, c in zip(names, order, strict=True)],
        "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
