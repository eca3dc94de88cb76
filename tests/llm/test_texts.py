from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from aerotrace.llm import evidence_quality, pieces, shingle_join, token_store
from aerotrace.llm.chunks import ByteBpe
from aerotrace.session import scratch_dir
from brute import near_duplicates

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = " \n\t aé'sß1,.<|endoftext|> ▁日本🙂\x1c\x85Ab"


def texts(n: int = 300) -> list[str | None]:
    rng = random.Random(4)
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    odd += [None, "", " ", "a ", " a", "a  b", "x<|endoftext|> y", "don't  stop", "a\n b", "a \n b", "\n\n a", "end.\nNew"]
    return odd + ["word " * 30_000, "equal text", "equal text"]


def frame(spark, rows, text="evidence"):
    return spark.createDataFrame(
        [(k, t, "c", "c", "c") for k, t in rows], f"id long, {text} string, name string, n string, tokens string"
    )


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts())] + [(5, "twice"), (5, "twice"), (None, "no id")]
    folder = scratch_dir(spark, "tokens")
    data = frame(spark, rows).repartition(3)
    parts = token_store.write_tokens(spark, data, folder, BPE, parts=4)
    got = token_store.read_tokens(spark, parts, folder, data.schema["id"].dataType).collect()
    got = sorted(((r["id"] if r["id"] is not None else -1, r["start"], r["n_tokens"], bytes(r["ids"])) for r in got), key=lambda r: r[1])
    library = Tokenizer.from_file(BPE)
    want = sorted((k if k is not None else -1, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for k, t in rows)
    assert sorted((k, ids) for k, _, _, ids in got) == want
    assert [k for k, *_ in got] == sorted(k for k, _ in want)
    assert [s for _, s, _, _ in got] == np.cumsum([0, *[n for _, _, n, _ in got]])[:-1].tolist()
    one = next(r for r in got if r[0] == 5)
    part = next(p["part"] for p in parts.collect() if (5,) in [(x,) for x in _keys(folder, p["part"])])
    assert token_store.read_text_tokens(folder, part, 5) == np.frombuffer(one[3], "<u4").tolist()


def _keys(folder, part):
    import pyarrow.parquet as pq

    from aerotrace.llm.files import opened

    store, path = opened(f"{folder}/part-{part:06d}.idx")
    return pq.read_table(path, filesystem=store)["id"].to_pylist()


def test_token_store_of_nothing(spark):
    folder = scratch_dir(spark, "tokens")
    data = frame(spark, [])
    parts = token_store.write_tokens(spark, data, folder, BPE)
    assert token_store.read_tokens(spark, parts, folder, data.schema["id"].dataType).count() == 0


def test_another_dictionary_is_refused(spark):
    folder = scratch_dir(spark, "tokens")
    data = frame(spark, [(i, f"some words {i} " * 9) for i in range(50)])
    parts = token_store.write_tokens(spark, data, folder, BPE, parts=1)
    from aerotrace.llm.files import written

    with written(f"{folder}/dictionary.zst") as out:
        out.write(b"")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_tokens(spark, parts, folder, data.schema["id"].dataType).count()


def test_chunk_table_forgets_and_stays_exact(monkeypatch):
    from aerotrace.llm import chunks

    monkeypatch.setattr(chunks, "LIMIT", 10)
    with open(BPE, "rb") as source:
        coder = ByteBpe(source.read())
    some = [t or "" for t in texts(60)]
    for _ in range(2):
        got = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(some)]
        assert got == [e.ids for e in coder.model.encode_batch(some, add_special_tokens=False)]


def test_plain_words_are_learned_run_by_run_and_stay_exact():
    class Counted:
        def __init__(self, model):
            self.model, self.chars = model, 0

        def encode_batch_fast(self, some, add_special_tokens):
            self.chars += sum(map(len, some))
            return self.model.encode_batch_fast(some, add_special_tokens=add_special_tokens)

    with open(BPE, "rb") as source:
        coder = ByteBpe(source.read())
    library, coder.model = coder.model, Counted(coder.model)
    rng = random.Random(5)
    plain = [" ".join(f"w{rng.randrange(9**9)}é, Über$$$ [x]_{i}\nzwölf.B" for _ in range(90)) for i in range(40)]
    signs = ["a", "É", "ſ", "µ", "×", "23", ".", "$$", "'", "'s", "-", "日", "`", "\\", "²", "½", "😀", "<|endoftext|>", " ", "\n", "\t", "\x85"]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(500)]
    for some in (plain, odd):
        coder.model.chars = 0
        got = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(some)]
        assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        if some is plain:  # only the words that begin texts go through the whole tokenizer
            assert coder.model.chars <= sum(len(t.split(" ")[0]) for t in plain)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    rows = list(enumerate(texts()))
    data = frame(spark, rows).withColumn("ids", F.lit("clash"))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["id"]: r for r in pieces.encode_pieces(spark, data, PIECES).collect()}
    for k, t in rows:
        ids = library.encode(t or "")
        assert list(got[k]["ids"]) == ids and got[k]["decoded"] == library.decode(ids)
        assert got[k]["evidence"] == t and got[k]["name"] == "c"
    assert pieces.encode_pieces(spark, frame(spark, []), PIECES).count() == 0


def near_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(rng.choice((40, 60, 200)))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 9)):
            copy = list(b)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) + (" " + " ".join(passage) if rng.random() < 0.3 else ""))
    rows += [rows[0]] * 5 + [rows[1].upper(), rows[2].replace(" ", "\n")]
    rows += [None, "", "  \t", "one two", "One\x0bTwo", "one two three four five", "one two three four", "É É", "é é"]
    rows += [" ".join(passage + [word() for _ in range(k)]) for k in (8, 9, 10, 11, 12)]
    rng.shuffle(rows)
    return [(1000 - i if i % 17 else 1000 - i + 1, t) for i, t in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = shingle_join.near_duplicate_evidence(spark, frame(spark, rows).repartition(5))
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got.collect())
    assert got == sorted(near_duplicates(rows))
    assert len({c for _, _, c in got}) < len(got) - 20
    assert shingle_join.near_duplicate_evidence(spark, frame(spark, [])).count() == 0


def test_near_duplicates_by_string_id(spark):
    rows = [(f"k{k}", t) for k, t in near_rows()]
    data = spark.createDataFrame(rows, "id string, evidence string")
    got = shingle_join.near_duplicate_evidence(spark, data)
    assert sorted(map(tuple, got.collect())) == sorted(near_duplicates(rows))


def test_prefixes_of_linked_sets_share_enough():
    """Sets at the similarity, as they are and in the worst order, against the prefix rule."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 97, 240, 600]:
        for m in {n, -(-8 * n // 10), (8 * n // 10 + n) // 2}:
            o = shingle_join.needed(n, m)
            if 100 * o < 80 * (n + m - o) or o > min(n, m):
                continue
            shared = rng.permutation(10_000)[:o]
            rest = rng.permutation(np.arange(10_000, 20_000))[: n + m - 2 * o]
            for late in (0, 20_000):  # shared tokens anywhere, or after all others
                x = np.sort(np.r_[shared + late, rest[: n - o]])
                y = np.sort(np.r_[shared + late, rest[n - o :]])
                met = shingle_join.least_met(o)
                both = np.intersect1d(x[: n - o + met], y[: m - o + met])
                assert len(both) >= met
                assert n - o + met <= shingle_join.prefix_length(n)
                assert m - o + met <= shingle_join.prefix_length(m)


def test_large_meetings_keep_whom_the_pairwise_rule_keeps():
    rng = np.random.default_rng(8)
    sizes, places = rng.integers(20, 900, 400), rng.integers(0, 150, 400)
    o = shingle_join.needed(sizes[:, None], sizes[None, :])
    least = o - shingle_join.least_met(o)
    fits = (places[:, None] < sizes[:, None] - least) & (places[None, :] < sizes[None, :] - least)
    np.fill_diagonal(fits, False)
    ratio = 100 * np.minimum(sizes[:, None], sizes) >= 80 * np.maximum(sizes[:, None], sizes)
    kept = shingle_join._partnered(sizes, places)
    assert kept[(fits & ratio).any(axis=1)].all()


def test_word_hashes_do_not_depend_on_pieces():
    raw = " ".join(near_rows()[0][1].split() * 50).encode()
    whole, small = shingle_join.Words().hashes(raw), shingle_join.Words(16).hashes(raw)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()


def test_quality_votes(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [word() for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(w.upper() + "***" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1, "x"))
    rows += [(900, None), (901, ""), (902, "w " * 50_000), (3, rows[3][1]), (None, rows[1][1])]
    labels += [(5, 1, "y"), (None, 0, "z"), (7, None, "z")]
    known = spark.createDataFrame(labels, "id long, quality int, evidence string")
    data = frame(spark, rows)
    got = evidence_quality.classify_evidence(spark, data, known).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["id"] < 400]
    assert sum(r["predicted"] == int(r["id"] % 4 != 0) for r in held) >= 0.97 * len(held)
    assert len({r["score"] for r in got if r["id"] == 3}) == 1
    # held-out labels teach nothing
    flipped = spark.createDataFrame(
        [(k, 1 - q if q is not None and k is not None and zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels],
        "id long, quality int, evidence string",
    )
    again = evidence_quality.classify_evidence(spark, data, flipped).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "id long, quality int")
    got = evidence_quality.classify_evidence(spark, frame(spark, [(1, "a"), (2, None)]), none).collect()
    assert {r["score"] for r in got} == {0.5}
    assert evidence_quality.classify_evidence(spark, frame(spark, []), none).count() == 0


def test_members_of_one_component_never_meet():
    import numpy as np

    rng = np.random.default_rng(3)
    names, n = rng.permutation(2_000).astype(np.int64), rng.integers(80, 120, 2_000)
    parts = np.where(np.arange(2_000) < 1_990, 0, np.arange(2_000))
    got = [p for a, b in shingle_join._apart(names, parts, n) for p in zip(names[a].tolist(), names[b].tolist(), strict=True)]
    x, y = n[:, None], n[None, :]
    fits = (parts[:, None] != parts[None, :]) & (100 * np.minimum(x, y) >= 80 * np.maximum(x, y)) & (names[:, None] < names[None, :])
    want = {(int(names[i]), int(names[j])) for i, j in zip(*np.nonzero(fits), strict=True)}
    assert len(got) == len(want) and set(got) == want


def test_partners_of_many_sets_in_one_token():
    import time

    import numpy as np

    rng = np.random.default_rng(5)
    sizes, places = rng.integers(5, 4_000, 700), rng.integers(0, 300, 700)
    places = np.minimum(places, sizes - 1)
    o = shingle_join.needed(sizes[:, None], sizes[None, :])
    least = o - shingle_join.least_met(o)
    fits = (places[:, None] < sizes[:, None] - least) & (places[None, :] < sizes[None, :] - least)
    np.fill_diagonal(fits, False)
    near = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= 80 * np.maximum(sizes[:, None], sizes[None, :])
    got = shingle_join._partnered(sizes, places)
    assert got[(fits & near).any(axis=1)].all() and not got[~fits.any(axis=1)].any()
    start = time.perf_counter()
    many = 200_000
    shingle_join._partnered(np.full(many, 200), np.zeros(many, dtype=np.int64))
    assert time.perf_counter() - start < 5


def test_links_through_a_row_without_an_id(spark):
    """(1, A), (null, B), (2, C) with A-B and B-C alike, A-C not: one class."""
    words = [f"w{i}" for i in range(100)]
    b = " ".join(words)
    a, c = " ".join(["x", *words[9:]]), " ".join([*words[:91], "y"])
    rows = [(1, a), (None, b), (2, c), (None, "alone and without an id at all"), (7, "alone"), (None, None)]
    rows += [(None, " ".join(f"z{i}" for i in range(60))), (None, " ".join(f"z{i}" for i in range(59)))]
    frame = spark.createDataFrame(rows, "id long, evidence string")
    want = sorted(near_duplicates(rows), key=str)
    assert (2, 88, 1) in want
    got = shingle_join.near_duplicate_evidence(spark, frame).collect()
    assert sorted(map(tuple, got), key=str) == want
