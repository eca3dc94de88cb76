"""Near-duplicate evidence texts: exact Jaccard join on word shingles with two token orders."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.llm.components import connected_components
from aerotrace.session import stored

WORDS = 5
PERCENT = 80
ORDERS = 2
TEXTS = 256
# A shingle of this many texts of one chunk is noted as frequent.
FREQUENT = 4
CHUNK = 4_000_000
LEVEL_BITS = 20  # frequency levels are kept for 2^20 hash cells, one byte each
BLOOM_BITS = 23
POSTINGS = 400_000  # of a bucket, about
SET_BYTES = 6
BLOCK = 1 << 20  # pairs of a meeting looked at together
SALTS = 8
LISTED = 256  # partners in a row, at most
EXTRA = 24  # a set of n tokens must share about n / EXTRA of its prefix

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray, turn: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers; ``turn`` gives different ones."""
    x = x + np.uint64(turn * int(_P) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashes of the words of a byte string: polynomials modulo 2^64, from prefix sums of the bytes.

    Works through the bytes in pieces that end in white space, so memory is a few arrays of one
    piece (or of the longest word) and eight bytes a word.
    """

    def __init__(self, piece: int = 1 << 20) -> None:
        self.piece = piece
        self.up, self.down = _powers(_BASE, piece), _powers(_INVERSE, piece)

    def hashes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word, in order."""
        data, at = np.frombuffer(raw, dtype=np.uint8), 0
        values, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        while at < len(data):
            end = at + self.piece
            if end < len(data):
                gaps = np.flatnonzero(_SPACE[data[at:end]])
                while not len(gaps) and end < len(data):  # a word longer than the piece
                    end += self.piece
                    gaps = np.flatnonzero(_SPACE[data[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) else len(data)
            part = data[at:end]
            if len(part) > len(self.up):
                self.up, self.down = _powers(_BASE, len(part)), _powers(_INVERSE, len(part))
            word = ~_SPACE[part]
            edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=sums[1:])
            values.append((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))
            places.append(first + at)
            at = end
        return mix(np.concatenate(values), 2), np.concatenate(places)


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self) -> None:
        self.words = Words()

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode().lower() for t in texts]
        codes, places = self.words.hashes(b" ".join(raw))
        starts = np.cumsum([0, *[len(r) + 1 for r in raw]])
        bounds = np.searchsorted(places, starts).tolist()
        rolled = np.zeros(0, dtype=np.uint64)
        if len(codes) >= WORDS:
            rolled = codes[: len(codes) - WORDS + 1].copy()
            for i in range(1, WORDS):
                rolled *= _P
                rolled += codes[i : len(codes) - WORDS + 1 + i]
            rolled = mix(rolled)
        out = []
        for start, end in zip(bounds, bounds[1:], strict=False):
            n = end - start
            if n >= WORDS:
                tokens = np.sort(rolled[start : end - WORDS + 1])
                out.append(tokens[np.r_[True, tokens[1:] != tokens[:-1]]])
            elif n:
                whole = n
                for code in codes[start:end].tolist():
                    whole = (whole * int(_P) + code) & 0xFFFFFFFFFFFFFFFF
                out.append(mix(np.array([whole], dtype=np.uint64), 1))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


_WORKER: list[Shingles] = []


def _shingles() -> Shingles:
    if not _WORKER:
        _WORKER.append(Shingles())
    return _WORKER[0]


def needed(n, m):
    """Tokens that sets of sizes ``n`` and ``m`` need to share to reach the similarity."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def least_met(o):
    """Tokens that sets needing ``o`` must share among their first ``n - o + least_met(o)`` ones.

    Any number up to ``o`` would be right (with 1, prefixes are shortest but let most pairs pass).
    """
    return 1 + o // EXTRA


def prefix_length(n: int) -> int:
    """Tokens of a set of size ``n`` that count for some partner: the smallest one needs least."""
    o = -(-PERCENT * n // 100)
    return min(n, n - o + least_met(o))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprint(tokens: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    shingles = _shingles()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield part.column(0).to_pylist(), shingles.sets([t or "" for t in part.column(1).to_pylist()])


def _sketch(kind: pa.DataType):
    """Size and fingerprint of every text, and frequency levels of the shingles of each chunk."""

    def levels(chunk: list[np.ndarray]) -> list[int]:
        tokens, counts = np.unique(np.concatenate(chunk), return_counts=True)
        tokens, counts = tokens[counts >= FREQUENT], counts[counts >= FREQUENT]
        cells = (tokens >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)
        packed = np.unique(cells * 64 + np.log2(counts).astype(np.int64))
        last = np.r_[packed[1:] // 64 != packed[:-1] // 64, True] if len(packed) else np.zeros(0, bool)
        return packed[last].tolist()

    def sketch(batches):
        seen, chunk, held = set(), [], 0
        for ids, sets in _read(batches):
            names = [fingerprint(s) if len(s) else None for s in sets]
            for name, s in zip(names, sets, strict=True):
                if name is not None and name not in seen:
                    seen.add(name)
                    chunk.append(s)
                    held += len(s)
            yield _rows(kind, ids, [len(s) for s in sets], names, [None] * len(ids))
            if held > CHUNK:
                yield _rows(kind, [None], [None], [None], [levels(chunk)])
                chunk, held = [], 0
        if chunk:
            yield _rows(kind, [None], [None], [None], [levels(chunk)])

    return sketch


def _rows(kind: pa.DataType, ids: list, sizes: list, names: list, levels: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
         pa.array(levels, pa.list_(pa.int64()))],
        names=["id", "n", "name", "levels"],
    )


def _postings(levels, buckets: int):
    """Prefix tokens of every set under each order, packed by (order, bucket).

    An order goes by frequency level, then by a hash of its own. With each token goes its place
    in the order, with each set its size and its share of frequent tokens.
    """

    def packed(facts: list[tuple[int, int, int]], prefixes: list[np.ndarray], order: int) -> pa.RecordBatch:
        lengths = [len(p) for p in prefixes]
        owner = np.repeat(np.arange(len(prefixes)), lengths)
        place = np.concatenate([np.arange(n) for n in lengths])
        tokens = np.concatenate(prefixes)
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((owner, bucket))
        owner, place, tokens, bucket = owner[by], place[by], tokens[by], bucket[by]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        names, sizes, shares = (np.array(x) for x in zip(*facts, strict=True))
        out = {c: [] for c in ("turn", "bucket", "names", "sizes", "shares", "counts", "tokens", "places")}
        for start, end in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            who, counts = np.unique(owner[start:end], return_counts=True)
            out["turn"].append(order)
            out["bucket"].append(int(bucket[start]))
            out["names"].append(names[who].astype("<i8").tobytes())
            out["sizes"].append(sizes[who].astype("<u4").tobytes())
            out["shares"].append(shares[who].astype("u1").tobytes())
            out["counts"].append(counts.astype("<u4").tobytes())
            out["tokens"].append((tokens[start:end] >> np.uint64(32)).astype("<u4").tobytes())
            out["places"].append(np.minimum(place[start:end], 65_535).astype("<u2").tobytes())
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    def postings(batches):
        level = levels.value
        seen, facts, prefixes, held = set(), [], [[] for _ in range(ORDERS)], 0
        for _, sets in _read(batches):
            for s in sets:
                if not len(s) or (name := fingerprint(s)) in seen:
                    continue
                seen.add(name)
                p = prefix_length(len(s))
                rank = level[(s >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
                facts.append((name, len(s), int(255 * np.count_nonzero(rank) / len(s))))
                rank = rank.astype(np.uint64) << np.uint64(58)
                for order in range(ORDERS):
                    mixed = mix(s, order + 1)
                    keys = rank | (mixed >> np.uint64(6))
                    least = np.argpartition(keys, p - 1)[:p] if p < len(s) else np.arange(p)
                    prefixes[order].append(mixed[least[np.argsort(keys[least])]])
                held += p
            if held > CHUNK // 2:
                yield from (packed(facts, prefixes[order], order) for order in range(ORDERS))
                facts, prefixes, held = [], [[] for _ in range(ORDERS)], 0
        if facts:
            yield from (packed(facts, prefixes[order], order) for order in range(ORDERS))

    return postings


POSTINGS_SCHEMA = (
    "turn int, bucket int, names binary, sizes binary, shares binary, counts binary, tokens binary, places binary"
)


def _partnered(sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which sets that meet in a token have a partner whose place and size allow the similarity.

    For sets of sizes n and m that need to share o tokens, their first n - o + least_met(o) and
    m - o + least_met(o) tokens count. So for a set of size n with the token at place p, the
    partner must be of at most a certain size, and the same holds the other way round.
    """
    if len(sizes) <= 256:
        o = needed(sizes[:, None], sizes[None, :])
        least = o - least_met(o)
        fits = (places[:, None] < sizes[:, None] - least) & (places[None, :] < sizes[None, :] - least)
        np.fill_diagonal(fits, False)
        return fits.any(axis=1)
    # the largest o with place < n - o + least_met(o), and the largest partner that needs no more
    room = sizes - places
    o = room * EXTRA // (EXTRA - 1) + 1
    o = np.where(o - least_met(o) < room, o, o - 1)
    o = np.where(o - least_met(o) < room, o, o - 1)
    top = (100 + PERCENT) * o // PERCENT - sizes
    by = np.argsort(sizes)
    ordered, reach = sizes[by], top[by]
    start, end = np.searchsorted(ordered, -(-PERCENT * sizes // 100)), np.searchsorted(ordered, top, side="right")
    own = np.empty(len(by), dtype=np.int64)
    own[by] = np.arange(len(by))
    best = _range_max(reach)
    left, right = best(start, np.minimum(end, own)), best(np.maximum(start, own + 1), end)
    return np.maximum(left, right) >= sizes


def _range_max(x: np.ndarray):
    """Largest values of many ranges of ``x``, -1 of an empty one, from those of all powers of two."""
    table = [x]
    while 2 << (len(table) - 1) <= len(x):
        half = 1 << (len(table) - 1)
        table.append(np.maximum(table[-1][:-half], table[-1][half:]))

    def best(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), -1, dtype=x.dtype)
        level = np.frexp(np.maximum(end - start, 1).astype(float))[1] - 1
        for k, largest in enumerate(table):
            rows = np.flatnonzero((end > start) & (level == k))
            out[rows] = np.maximum(largest[start[rows]], largest[end[rows] - (1 << k)])
        return out

    return best


def _lists(rows: pd.DataFrame) -> pd.DataFrame:
    """The distinct sets of names that meet in a token of this bucket, and in how many tokens;
    names with the largest share of frequent tokens first."""
    read = lambda column, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in rows[column]])
    counts = read("counts", "<u4")
    owner, size, share = (
        np.repeat(read(c, k), counts) for c, k in (("names", "<i8"), ("sizes", "<u4"), ("shares", "u1"))
    )
    tokens, place, size = read("tokens", "<u4"), read("places", "<u2").astype(np.int64), size.astype(np.int64)
    by = np.lexsort((owner, 255 - share, tokens))
    owner, size, place, tokens = owner[by], size[by], place[by], tokens[by]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
    owner, size, place, tokens = owner[fresh], size[fresh], place[fresh], tokens[fresh]
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    length = np.diff(np.r_[start, len(tokens)])
    found, times = {}, Counter()
    for at, n in zip(start[length > 1].tolist(), length[length > 1].tolist(), strict=True):
        met = owner[at : at + n][_partnered(size[at : at + n], place[at : at + n])]
        if len(met) > 1:
            key = int(mix(met.view(np.uint64), 7).sum())
            found.setdefault(key, met)
            times[key] += 1
    turn = int(rows["turn"].iloc[0])
    keys = np.array(list(found), dtype=np.uint64)
    return pd.DataFrame({
        "turn": np.full(len(keys), turn, dtype=np.int32), "meeting": _signed(keys),
        "names": pd.Series(list(found.values()), dtype=object),
        "times": np.array([times[k] for k in found], dtype=np.int64),
    })


def mark(name: int, key: object) -> int:
    """``xxhash64(name, key as string)`` as the SQL function gives it; it passes over a null key."""
    seed = xxhash.xxh64_intdigest(struct.pack("<q", name), seed=42)
    return seed if key is None else xxhash.xxh64_intdigest(str(key).encode(), seed=seed)


def _sets(bloom):
    """Sets, cut to six bytes a token, of the texts that the filter lets through."""

    def sets(batches):
        bits, cells = bloom.value, (1 << BLOOM_BITS) - 1
        for ids, found in _read(batches):
            names, tokens = [], []
            for key, s in zip(ids, found, strict=True):
                if len(s):
                    name = fingerprint(s)
                    cell = mark(name, key) & cells
                    if bits[cell >> 3] >> (cell & 7) & 1:
                        names.append(name)
                        tokens.append(s.view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(tokens, pa.binary())], names=["name", "tokens"]
            )

    return sets


def _tokens(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // SET_BYTES, 8), dtype=np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, SET_BYTES)
    return wide.view("<u8").ravel()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = _tokens(x.as_buffer()), _tokens(y.as_buffer())
            both = np.sort(np.concatenate([a, b]))
            shared = int((both[1:] == both[:-1]).sum())
            linked.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
        )


def verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Pairs of names with whether they reach the similarity, from the sets of their texts."""
    pairs = stored(spark, pairs, f"{label}-pairs")
    if pairs.isEmpty():
        return pairs.withColumn("linked", F.lit(False))
    sets = stored(spark, _sets_of(spark, pairs, texts, nodes), f"{label}-sets")
    left = sets.select(F.col("name").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("name").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stored(spark, both.mapInArrow(_verify, "a long, b long, linked boolean").distinct(), label)


def _sets_of(spark: SparkSession, pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of the paired names, made from one text of each.

    A bit table of fixed size keeps other texts out; a text it lets through by chance pairs with
    nothing, or repeats a set, which does no harm.
    """
    ends = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    seal = F.xxhash64("name", F.col("rep").cast("string")).bitwiseAND((1 << BLOOM_BITS) - 1)
    cells = nodes.join(ends, "name").select(seal.alias("cell"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("cell").bitwiseAND(7).cast("int"))
    got = cells.groupBy(F.shiftright("cell", 3).alias("byte")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bloom = np.zeros(1 << (BLOOM_BITS - 3), dtype=np.uint8)  # so at most 2^20 rows
    bloom[got["byte"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return texts.mapInArrow(_sets(spark.sparkContext.broadcast(bloom.tobytes())), "name long, tokens binary")


def near_duplicate_evidence(spark: SparkSession, anomalies: DataFrame) -> DataFrame:
    """``id, n_shingles, component_id`` of every anomaly: classes of near-duplicate evidence texts.

    ``anomalies`` has ``id`` (orderable) and ``evidence`` (text); other columns are ignored. The
    set of a text: its distinct shingles of five words, words being runs of characters other
    than ASCII white space, A-Z in lower case; a shorter text has its whole sequence as its one
    shingle; null and empty texts have none and link with nothing. Texts link when their sets
    have a Jaccard similarity of 0.8 or more; ``component_id`` is the smallest id reachable.
    Repeated rows stay, a null id counts as no id of a class unless it is the only one. An empty
    table gives an empty result. Shingles and sets are told apart by 64-bit hashes.

    Equal sets are one set from the first step on. The others are joined by prefixes: sets that
    reach the similarity share some tokens among about the first fifth of their tokens under
    every order of tokens (how many, and among how many, follows from their sizes). Two orders
    are used; both put frequent
    tokens last (frequencies are counted over all texts into a table of fixed size) and then go
    by hashes of their own. Tokens and the sets that meet in them are packed by buckets, whose
    number grows with the input.

    Pairs are verified in two rounds. First, of the sets that meet in a token only those with
    the most typical one (with the largest share of frequent tokens), if the pair meets so under
    both orders; that joins large groups of copies with as many pairs as members. Then all pairs
    of different components that share enough of their prefixes under both orders. Pairs within
    a component need no check: they change no class.
    """
    from aerotrace.llm.token_store import spark_to_arrow

    kind = spark_to_arrow(anomalies.schema["id"].dataType)
    texts = anomalies.select("id", "evidence")
    schema = T.StructType([
        T.StructField("id", anomalies.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("name", T.LongType()), T.StructField("levels", T.ArrayType(T.LongType())),
    ])
    sketch = stored(spark, texts.mapInArrow(_sketch(kind), schema), "sketch")
    docs = sketch.where(F.col("n").isNotNull()).select("id", "n", "name")
    nodes = stored(
        spark,
        docs.where("n > 0").groupBy("name").agg(F.min("id").alias("rep"), F.first("n").alias("n")),
        "nodes",
    )

    packed = sketch.where("levels is not null").select(F.explode("levels").alias("p"))
    cells = packed.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.max(F.col("p").bitwiseAND(63)).alias("level"))
    level = np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    got = cells.toPandas()  # at most 2^LEVEL_BITS rows
    level[got["cell"].to_numpy(dtype=np.int64)] = np.minimum(got["level"].to_numpy(dtype=np.int64), 62)
    levels = spark.sparkContext.broadcast(level)

    tokens = nodes.agg(F.sum(F.col("n") * (100 - PERCENT) / 100 + 1)).first()[0] or 0
    buckets = max(32, -(-int(tokens) // POSTINGS))
    postings = texts.mapInArrow(_postings(levels, buckets), POSTINGS_SCHEMA)
    lists = stored(
        spark,
        postings.groupBy("turn", "bucket")
        .applyInPandas(_lists, "turn int, meeting long, names array<long>, times long")
        .groupBy("turn", "meeting")
        .agg(F.first("names").alias("names"), F.sum("times").alias("times")),
        "lists",
    )

    members = F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(1)))
    hubs = lists.select("turn", F.get("names", F.lit(0)).alias("a"), F.explode(members).alias("b"))
    first = verified(spark, _under_all_orders(hubs), texts, nodes, "first")
    links = first.where("linked").select("a", "b")
    labelled = stored(
        spark, _with_part(nodes, connected_components(spark, links)).select("name", "n", "part"), "labelled"
    )

    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    open_ = _across(lists, labelled).join(tried, ["a", "b"], "left_anti")
    second = verified(spark, open_, texts, nodes, "second")
    ends = connected_components(spark, links.unionByName(second.where("linked").select("a", "b")))
    classes = _classes(stored(spark, _with_part(nodes, ends).select("name", "rep", "part"), "parts"))
    return docs.join(classes, F.col("name") == F.col("_name"), "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("_class", "id").alias("component_id")
    )


def _with_part(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Sets with the smallest name of their component, which is never null as an id may be."""
    part = F.coalesce("component_id", "name").alias("part")
    return nodes.join(ends.withColumnRenamed("id", "name"), "name", "left").select(*nodes.columns, part)


def _classes(parts: DataFrame) -> DataFrame:
    """``_name, _class``: the smallest id of each set's component, null where it has none.

    Sets that are alone need no look-up; the ids of the others are looked up by component and salt,
    so that a large component is not one key.
    """
    least = parts.groupBy("part").agg(F.min("rep").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    salted = least.select("part", "_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = parts.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["part", "_salt"], "left").select(
        F.col("name").alias("_name"), F.coalesce("_least", "rep").alias("_class")
    )


def _under_all_orders(pairs: DataFrame) -> DataFrame:
    """``a, b`` of pairs that occur with every order."""
    met = pairs.groupBy("a", "b").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("turn"))).alias("met"))
    return met.where(F.col("met") == (1 << ORDERS) - 1).select("a", "b")


def _across(lists: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pairs of different parts that share enough prefix tokens under every order.

    Of every meeting, each set gets the members of other parts with a larger name and a fitting
    size, in arrays of bounded length; members of one part are never put together. The tokens
    shared with each are counted per set; only pairs that pass every filter become rows.
    """
    rows = lists.select("turn", "meeting", "times", F.explode("names").alias("name")).join(labelled, "name")
    met = rows.groupBy("turn", "meeting", "times").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.collect_list(F.struct("name", "part", "n")).alias("members")
    ).where("lo <> hi")
    split = [F.col(f"members.{c}").alias(f"{c}s") for c in ("name", "part", "n")]
    each = met.select("turn", "times", *split).mapInArrow(
        _fitting, "name long, n long, turn int, times long, names array<long>, ns array<long>"
    )
    lined_up = each.repartition("name").sortWithinPartitions("name")
    return lined_up.mapInArrow(_count_met, "a long, b long")


def _apart(names: np.ndarray, parts: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``a, b`` of members of different parts whose sizes allow the similarity.

    Those outside the largest part are compared with all, so the work is about the number of
    pairs of different parts, at most twice that.
    """
    by = np.argsort(n, kind="stable")
    largest = np.bincount(parts).argmax()
    outside = by[parts[by] != largest]
    ordered = n[by]
    step = max(1, BLOCK // len(names))
    for at in range(0, len(outside), step):
        some = outside[at : at + step]
        lo = np.searchsorted(ordered, -(-PERCENT * n[some[0]] // 100))
        hi = np.searchsorted(ordered, 100 * n[some[-1]] // PERCENT, side="right")
        others = by[lo:hi]
        x, y = n[some][:, None], n[others][None, :]
        fits = (parts[some][:, None] != parts[others][None, :]) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y))
        # two members outside are met from both sides
        fits &= (parts[others] == largest)[None, :] | (names[some][:, None] < names[others][None, :])
        r, c = np.nonzero(fits)
        a, b = some[r], others[c]
        swap = names[a] > names[b]
        yield np.where(swap, b, a), np.where(swap, a, b)


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings to rows of one set and its partners there."""
    columns = ["name", "n", "turn", "times", "names", "ns"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        out, held = [[] for _ in columns], 0
        for i in range(batch.num_rows):
            turn, times = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            names, n = batch.column(2)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy()
            parts = pa.compute.dictionary_encode(batch.column(3)[i].values).indices.to_numpy(zero_copy_only=False)
            for a, b in _apart(names, parts, n):
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=int)
                for start, end in zip(new.tolist(), [*new[1:].tolist(), len(a)], strict=False):
                    for cut in range(start, end, LISTED):
                        some = b[cut : min(end, cut + LISTED)]
                        for column, value in zip(out, (names[a[cut]], n[a[cut]], turn, times, names[some], n[some]), strict=True):
                            column.append(value)
                        held += len(some)
                if held > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=columns)
                    out, held = [[] for _ in columns], 0
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=columns)


def _count_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one set lie together; the last set of a batch is held back for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).to_numpy()
        last = int(np.flatnonzero(names == names[-1])[0])
        if last or (held and held[-1].column(0)[0].as_py() != names[0]):
            whole = [*held, batch.slice(0, last)] if last else held
            held = []
            yield _pairs_met(whole)
        held.append(batch.slice(last))
    if held:
        yield _pairs_met(held)


def _pairs_met(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    lists = table["names"].combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    own = lambda c: np.repeat(table[c].to_numpy(), lengths)
    flat = lambda c: table[c].combine_chunks().flatten()
    a, b, n, m = own("name"), flat("names").to_numpy(), own("n"), flat("ns").to_numpy()
    turn, times = own("turn"), own("times")
    by = np.lexsort((b, a))
    a, b, n, m, turn, times = (x[by] for x in (a, b, n, m, turn, times))
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, dtype=int)
    o = needed(n[start], m[start])
    keep = np.ones(len(start), dtype=bool)
    for order in range(ORDERS):
        shared = np.add.reduceat(np.where(turn == order, times, 0), start) if len(start) else start
        keep &= shared >= least_met(o)
    return pa.RecordBatch.from_arrays([pa.array(a[start][keep]), pa.array(b[start][keep])], names=["a", "b"])
