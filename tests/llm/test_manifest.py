from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from aerotrace.llm.archive_manifest import Witnesses, archive_manifest
from aerotrace.plans import fixtures as fx
from aerotrace.session import configure
from aerotrace.sources.archive import ARCHIVE_COLUMNS, archive_rows

SF_DIR = "/root/testdata/sf0.001"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def climb(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def steps(levels, i, arity):
    for nodes in levels[:-1]:
        run = i // arity * arity
        yield nodes[run:i], nodes[i + 1 : run + arity]
        i //= arity


def manifest(rows, arity=8):
    """``(key, leaf, subroot, root, proof, folded, verified)`` of ``(folder, key, fields, received)`` rows."""
    folders: dict = {}
    for folder, key, own, received in rows:
        folders.setdefault(folder, []).append((key, leaf(own), leaf(received)))
    names = sorted(folders, key=lambda f: (f is not None, (f or "").encode()))
    for name in names:
        folders[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {n: climb([r[1] for r in folders[n]], arity) for n in names}
    top = climb([trees[n][-1][0] for n in names], arity)
    out = []
    for at, name in enumerate(names):
        for i, (key, own, node) in enumerate(folders[name]):
            path = [*steps(trees[name], i, arity), *steps(top, at, arity)]
            for left, right in path:
                node = sha(*left, node, *right)
            proof = sha(*[x for left, right in path for x in (*left, *right)])
            out.append((key, own, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize(("arity", "height"), [(8, 1), (8, 4), (3, 2)])
def test_manifest_equals_plain_trees(spark, arity, height):
    draw = random.Random(3)
    sizes = {None: 1, "a": 8, "b": 9, "ç": 64, "c": 300, "": 3, "z": 65} | {f"d{i}": 1 for i in range(12)}
    rows = []
    for folder, n in sizes.items():
        for i in range(n):
            seq = None if draw.random() < 0.03 else draw.randrange(200)  # nulls and ties
            rows.append((folder, seq, draw.choice([None, "", "Ab ç", "x" * 5_000, f"HELLO {i}"])))
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "source string, seq long, note string").selectExpr(
        "*", "1 AS _pos", "2 AS leaf", "3 AS root", "4 AS _tree", "5 AS verified"
    )
    got = archive_manifest(
        configure(spark), frame, ["seq", "source", "note"], "source", ["seq"], {"note": F.lower("note")}, arity, height
    )
    want = manifest(
        [(f, k, (k, f, t), (k, f, t if t is None else t.lower())) for f, k, t in rows], arity
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_archived_reports(spark):
    reports = archive_rows(fx.reports(spark, SF_DIR))
    later = F.when(F.col("icao24") == "000003", F.col("lat") + 1e-6).otherwise(F.col("lat"))
    got = archive_manifest(configure(spark), reports, received={"lat": later}).collect()
    cells = [
        F.unix_micros(c) if c == "ts" else F.col(c).cast("string").alias(c) for c in ARCHIVE_COLUMNS
    ]
    rows = reports.select("dt", *cells).collect()
    assert len(got) == len(rows) > 500
    assert {r["leaf"] for r in got} == {leaf(r[1:]) for r in rows}
    assert {r["icao24"] for r in got if not r["verified"]} == {"000003"}
    assert len({r["root"] for r in got}) == 1
    assert len({r["subroot"] for r in got}) == len({r["dt"] for r in rows})


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], "dt string, ts timestamp, icao24 string")
    assert archive_manifest(configure(spark), empty, ["ts", "icao24"]).collect() == []
    one = spark.createDataFrame([("x", 7)], "dt string, seq long")
    (row,) = archive_manifest(configure(spark), one, ["seq"], order=["seq"]).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == sha("")


def test_witnesses_grow_with_later_siblings():
    tree = Witnesses(arity=2)
    nodes = [bytes([i]) * 32 for i in range(5)]
    tree.append(nodes[0])
    assert tree.steps[0][0] == ((), [])
    tree.append(nodes[1])
    assert tree.steps[0][0] == ((), [nodes[1]]) and tree.steps[0][1] == ((nodes[0],), [])
    for node in nodes[2:]:
        tree.append(node)
    root = tree.finish()
    levels = climb([n.hex() for n in nodes], 2)
    assert root.hex() == levels[-1][0]
    for i in range(5):
        assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in tree.path(i)] == list(steps(levels, i, 2))
