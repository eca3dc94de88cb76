from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from aerotrace.llm import content_lines as cl
from aerotrace.session import configure

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words, lines = WORDS.findall(text), text.split("\n")
    windows: dict = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    dup = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again))


def texts():
    draw = random.Random(4)
    pool = ["the", "The", "END.", "go!", "##", "a|b", "ñandú", "漢字", "x1", " ", "\x1f", "stop."]
    out = [None, "", " ", "\n\n", "one", "a b c d e a b c d e", "line\nline\n\nline \nline", "w " * 12_000]
    for _ in range(60):
        out.append("".join(draw.choice(pool) + draw.choice([" ", " ", "\n", "\t", "\r\n", "  "]) for _ in range(draw.randrange(90))))
    return out


def test_base_counts_equal_plain_counts():
    lines = cl.read_lines([t or "" for t in texts()], cl.Words())
    assert [tuple(r) for r in lines.base.tolist()] == [base(t or "") for t in texts()]
    assert np.bincount(lines.text).tolist() == [len((t or "").split("\n")) for t in texts()]
    assert lines.words.tolist() == [len(WORDS.findall(x)) for t in texts() for x in (t or "").split("\n")]


def test_windows_stay_within_a_text():
    numbers = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5])
    assert cl._in_windows(numbers, np.zeros(11, dtype=int)).tolist() == [True] * 5 + [False] + [True] * 5
    assert not cl._in_windows(numbers, np.array([0] * 6 + [1] * 5)).any()


def field():
    draw = np.random.default_rng(2)
    width = int(sum(cl.FEATURES.values()))
    return cl.LineField(draw.normal(size=width), draw.normal(size=(2, 2)), draw.normal(size=2))


def score(f, emit, states):
    total = f.start[states[0]] + sum(e for e, s in zip(emit, states, strict=True) if s)
    return total + sum(f.moves[a, b] for a, b in itertools.pairwise(states))


def test_viterbi_finds_the_best_of_all_labellings():
    f = field()
    lines = cl.read_lines([t or "" for t in texts()], cl.Words())
    emit, content = f.emissions(lines.features), f.content(lines)
    checked = 0
    for i in range(len(texts())):
        at = np.flatnonzero(lines.text == i)
        if len(at) <= 12:
            got = score(f, emit[at], content[at].astype(int).tolist())
            best = max(score(f, emit[at], s) for s in itertools.product((0, 1), repeat=len(at)))
            assert got == pytest.approx(best)
            checked += 1
    assert checked > 20


def test_expected_counts_equal_the_sum_over_all_labellings():
    f = field()
    lines = cl.read_lines(["a b\nc d e\n\n## ##", "One.\nTwo.", "x"], cl.Words())
    sizes = np.bincount(lines.text)
    place = (lines.features + cl.OFFSETS).astype(int)
    begin, live = np.cumsum(sizes) - sizes, [3, 2, 1, 1]
    got = cl._expected(f, lines.features, place, begin, live)
    want = np.zeros(len(got))
    width, emit = len(f.weights), f.emissions(lines.features)
    for start, size in zip(begin, sizes, strict=True):
        rows = range(start, start + size)
        ways = list(itertools.product((0, 1), repeat=int(size)))
        weight = np.exp([score(f, emit[list(rows)], s) for s in ways])
        for w, s in zip(weight / weight.sum(), ways, strict=True):
            for row, state in zip(rows, s, strict=True):
                want[place[row]] += w * state
            for a, b in itertools.pairwise(s):
                want[width + 2 * a + b] += w
            want[width + 4 + s[0]] += w
    assert got == pytest.approx(want)


def test_rows_equal_plain_judgement(spark):
    data = [(i if i % 9 else None, t, "c", "d") for i, t in enumerate(texts())] + [(3, "again", "c", "d")]
    frame = spark.createDataFrame(data, "id long, text string, n_words string, label string")
    labels = spark.createDataFrame(
        [(i, int(bool(t) and "##" not in t)) for i, t in enumerate(texts())] + [(None, 1), (3, None)], "id long, quality int"
    )
    configure(spark)
    f = cl.train_field(spark, frame, labels)
    got = sorted(map(tuple, cl.content_lines(spark, frame, labels).collect()), key=str)
    want = []
    for key, text, *_ in data:
        lines = cl.read_lines([text or ""], cl.Words())
        counts = base(text or "")
        content = int(lines.words[f.content(lines)].sum())
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want.append((key, *counts, content, failed, not failed and content >= 0.5 * counts[0]))
    assert got == sorted(want, key=str)


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/documents.parquet").selectExpr("doc_id AS id", "text")
    labels = spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/labels.parquet").selectExpr("doc_id AS id", "quality")
    rows = cl.content_lines(configure(spark), docs, labels).join(labels, "id").where("crc32(CAST(id AS STRING)) % 5 = 0").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.95 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)
    assert len(good) > 20 and len(bad) > 5


def test_no_texts_and_no_labels(spark):
    none = spark.createDataFrame([], "id long, text string")
    labels = spark.createDataFrame([], "id long, quality int")
    configure(spark)
    assert cl.content_lines(spark, none, labels).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i j k")], "id long, text string")
    assert cl.content_lines(spark, some, labels).first()["kept"]
