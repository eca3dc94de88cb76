"""Quality rules on texts: a conditional random field over the lines marks content and boilerplate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELLED = 4_000  # labelled texts the field is fitted on, at most
HELD_OUT = 5
KEEP_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
TEXTS = 256
TABLE = 250_000
CHAIN = 64  # lines of one training chain
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
SYMBOLS = "#*$%&|<>"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+|\n")
_SHARES = np.array([0.0, 0.1, 0.3, 0.6])
_COUNTS = np.array([1, 2, 3, 5, 9, 17, 33])
_LENGTHS = np.array([0.5, 3, 4, 5, 7, 10, 15])
#: Features of a line and the number of values of each.
FEATURES = {
    "words": 8, "word_length": 8, "symbols": 5, "capitals": 5, "digits": 5, "exclaimed": 5, "repeated": 5,
    "alternating": 5, "in_windows": 5, "earlier_line": 2, "sentence_end": 2, "capital_start": 2,
}
OFFSETS = np.cumsum([0, *FEATURES.values()])[:-1]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Words:
    """What is asked of a word, worked out once per distinct word of a worker; number 0 is the line break."""

    def __init__(self) -> None:
        self.table = {"\n": 0}
        self.facts = np.zeros((1, 7), dtype=np.int64)

    def numbers(self, tokens: list[list[str]]) -> np.ndarray:
        new = list(set().union(*tokens) - self.table.keys())
        if new:
            self.table.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.facts = np.concatenate([self.facts, np.array(list(map(_facts, new)), dtype=np.int64)])
        return np.fromiter(map(self.table.__getitem__, chain.from_iterable(tokens)), dtype=np.int64)


def _facts(word: str) -> tuple[int, ...]:
    """Length, symbols, and whether it is in capitals, has a digit, is exclaimed, ends a sentence, starts with a capital."""
    symbols = 0 if word.isalpha() else sum(map(word.count, SYMBOLS))
    return (
        len(word), symbols, len(word) > 1 and word.isupper(), not word.isalpha() and any(map(str.isdigit, word)),
        word[-1] == "!", word[-1] in ".!?", word[0].isupper(),
    )


_WORKER: list[Words] = []


def _words() -> Words:
    """The table of this Python worker, shared by its tasks and begun anew when it is full."""
    if not _WORKER or len(_WORKER[0].table) > TABLE:
        _WORKER[:] = [Words()]
    return _WORKER[0]


@dataclass
class Lines:
    """Lines of a block of texts, in order. ``base`` has the columns ``BASE``, one row per text."""

    base: np.ndarray
    text: np.ndarray
    words: np.ndarray
    features: np.ndarray


def _in_windows(numbers: np.ndarray, text: np.ndarray) -> np.ndarray:
    """True for words within a window of ``WINDOW`` words that its text holds twice or more.

    Windows are sorted by a 64-bit hash and neighbours compared word by word; should two different
    windows share a hash, windows are sorted by their words instead.
    """
    out = np.zeros(len(numbers), dtype=bool)
    first = np.flatnonzero(text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :]) if len(text) >= WINDOW else []
    if not len(first):
        return out
    wide = numbers.astype(np.uint64)
    value = (wide + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    mix = text.astype(np.uint64)[first]
    for i in range(WINDOW):
        mix = (mix ^ value[first + i]) * np.uint64(0xBF58476D1CE4E5B9)
        mix ^= mix >> np.uint64(31)
    order = np.argsort(mix)

    def equal(order: np.ndarray) -> np.ndarray:
        a, b = first[order[:-1]], first[order[1:]]
        return (text[a] == text[b]) & np.logical_and.reduce([numbers[a + i] == numbers[b + i] for i in range(WINDOW)])

    twin = equal(order)
    if not twin[mix[order[1:]] == mix[order[:-1]]].all():
        order = np.lexsort([numbers[first + i] for i in range(WINDOW)] + [text[first]])
        twin = equal(order)
    again = np.zeros(len(first), dtype=bool)
    again[order[1:]] |= twin
    again[order[:-1]] |= twin
    for i in range(WINDOW):
        out[first[again] + i] = True
    return out


def read_lines(texts: list[str], words: Words) -> Lines:
    """Lines of whole texts with their features, and the base counts of the texts."""
    n = len(texts)
    tokens = [_TOKEN.findall(t) for t in texts]
    numbers = words.numbers(tokens)
    text = np.repeat(np.arange(n), [len(t) for t in tokens])
    breaks = numbers == 0
    line_counts = np.bincount(text[breaks], minlength=n) + 1
    line = np.cumsum(breaks) + text  # every text begins a line
    lines = int(line_counts.sum())
    numbers, text, line = numbers[~breaks], text[~breaks], line[~breaks]
    f = words.facts[numbers]

    per_line = np.bincount(line, minlength=lines)
    total = lambda x: np.bincount(line, weights=x, minlength=lines)
    share = lambda x: np.searchsorted(_SHARES, total(x) / np.maximum(per_line, 1))
    inside = _in_windows(numbers, text)
    back = lambda k: np.r_[np.zeros(min(k, len(line)), bool), (numbers[k:] == numbers[:-k]) & (line[k:] == line[:-k])]
    earlier = np.zeros(lines, dtype=bool)
    at = 0
    for t in texts:
        seen: set[str] = set()
        for own in t.split("\n"):
            if per_line[at]:
                earlier[at] = own in seen
                seen.add(own)
            at += 1
    last = np.flatnonzero(np.r_[line[1:] != line[:-1], True]) if len(line) else np.zeros(0, dtype=np.int64)
    first = np.r_[0, last[:-1] + 1] if len(line) else last
    ends, starts = np.zeros(lines, dtype=bool), np.zeros(lines, dtype=bool)
    ends[line[last]], starts[line[first]] = f[last, 5] > 0, f[first, 6] > 0

    features = np.stack([
        np.searchsorted(_COUNTS, per_line, side="right"),
        np.searchsorted(_LENGTHS, total(f[:, 0]) / np.maximum(per_line, 1), side="right"),
        share(f[:, 1] > 0), share(f[:, 2]), share(f[:, 3]), share(f[:, 4]), share(back(1)), share(back(2)),
        share(inside), earlier, ends, starts,
    ], axis=1).astype(np.uint8)
    line_text = np.repeat(np.arange(n), line_counts)
    whole = lambda x, at: np.bincount(at, weights=x, minlength=n).astype(np.int64)
    base = np.stack([
        np.bincount(text, minlength=n), whole(f[:, 0], text), whole(f[:, 1], text), whole(earlier, line_text),
        whole(inside, text),
    ], axis=1)
    return Lines(base, line_text, per_line, features)


@dataclass
class LineField:
    """A linear-chain conditional random field with the states boilerplate (0) and content (1).

    ``weights`` speak for content, one per value of every feature; ``moves`` scores a state after
    another, ``start`` the first state.
    """

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features + OFFSETS].sum(axis=1)

    def content(self, lines: Lines) -> np.ndarray:
        """True for lines that the most likely labelling of their text calls content (Viterbi).

        All texts of the block advance together, longest first, so those that have ended drop off
        the end. Of equally likely labellings content wins.
        """
        emit = self.emissions(lines.features)
        sizes = np.bincount(lines.text)
        begins = np.cumsum(sizes) - sizes
        by = np.argsort(-sizes, kind="stable")
        begin, size = begins[by], sizes[by]
        out = np.zeros(len(emit), dtype=bool)
        score = np.stack([np.full(len(by), self.start[0]), self.start[1] + emit[begin]], axis=1)
        came: list[np.ndarray] = []
        for t in range(1, int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            way = score[:live, :, None] + self.moves[None]
            from_content = way[:, 1, :] >= way[:, 0, :]
            came.append(from_content)
            score[:live] = np.where(from_content, way[:, 1, :], way[:, 0, :])
            score[:live, 1] += emit[begin[:live] + t]
        state = (score[:, 1] >= score[:, 0]).astype(np.int64)
        for t in range(len(came), -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            out[begin[:live] + t] = state[:live] == 1
            if t:
                state[:live] = came[t - 1][np.arange(live), state[:live]]
        return out


def _chains(features: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, line labels and chain sizes; long texts give several chains.

    Lines of a good text are content, but for those it repeats; lines of a bad text are boilerplate.
    """
    rows = np.concatenate(features)
    earlier = rows[:, list(FEATURES).index("earlier_line")] > 0
    good = np.repeat(np.array(labels, dtype=bool), [len(x) for x in features]) & ~earlier
    sizes = [min(CHAIN, len(x) - at) for x in features for at in range(0, len(x), CHAIN)]
    return rows, good.astype(np.int64), np.array(sizes)


def fit_field(features: list[np.ndarray], labels: list[int]) -> LineField:
    """Fit by the penalised conditional likelihood of the line labels (forward-backward, Adam).

    Without texts of both kinds every line is content.
    """
    width = int(sum(FEATURES.values()))
    if len(set(labels)) < 2:
        return LineField(np.zeros(width), np.zeros((2, 2)), np.array([0.0, 1.0]))
    rows, good, sizes = _chains(features, labels)
    by = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[by], sizes[by]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]
    place = (rows + OFFSETS).astype(np.int64)
    seen = np.bincount(place.ravel(), np.repeat(good, place.shape[1]), width)
    starts = np.bincount(good[begin], minlength=2)
    inner = np.ones(len(good), dtype=bool)
    inner[begin] = False
    after = np.flatnonzero(inner)
    pairs = np.bincount(good[after - 1] * 2 + good[after], minlength=4)
    observed = np.r_[seen, pairs, starts].astype(float)

    x, mean, square = np.zeros(width + 6), np.zeros(width + 6), np.zeros(width + 6)
    for step in range(1, STEPS + 1):
        field = LineField(x[:width], x[width : width + 4].reshape(2, 2), x[width + 4 :])
        expected = _expected(field, rows, place, begin, live)
        gradient = (observed - expected) / len(good) - PENALTY * x
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return LineField(x[:width], x[width : width + 4].reshape(2, 2), x[width + 4 :])


def _expected(field: LineField, rows: np.ndarray, place: np.ndarray, begin: np.ndarray, live: list[int]) -> np.ndarray:
    """Expected counts of features, moves and starts under the field."""
    emit = np.zeros((len(rows), 2))
    emit[:, 1] = field.emissions(rows)
    chains = len(begin)
    forward = np.zeros((len(live), chains, 2))
    forward[0] = field.start + emit[begin]
    for t, n in enumerate(live[1:], 1):
        way = forward[t - 1, :n, :, None] + field.moves[None]
        forward[t, :n] = np.logaddexp(way[:, 0], way[:, 1]) + emit[begin[:n] + t]
    backward = np.zeros((chains, 2))
    share = np.zeros(len(rows))
    moves = np.zeros((2, 2))
    ends = np.array([*live[1:], 0])
    norm = np.zeros(chains)
    for t in range(len(live) - 1, -1, -1):
        n, on = live[t], ends[t]
        norm[on:n] = np.logaddexp(forward[t, on:n, 0], forward[t, on:n, 1])
        if on:
            ahead = emit[begin[:on] + t + 1] + backward[:on]
            both = forward[t, :on, :, None] + field.moves[None] + ahead[:, None, :] - norm[:on, None, None]
            moves += np.exp(both).sum(axis=0)
            way = field.moves[None] + ahead[:, None, :]
            backward[:on] = np.logaddexp(way[:, :, 0], way[:, :, 1])
        share[begin[:n] + t] = np.exp(forward[t, :n, 1] + backward[:n, 1] - norm[:n])
    first = share[begin]
    counts = np.bincount(place.ravel(), np.repeat(share, place.shape[1]), len(field.weights))
    return np.r_[counts, moves.ravel(), chains - first.sum(), first.sum()]


def _teaches(key: str) -> Column:
    """Four of five rows, by the crc32 of the id as text; the others stay for measuring."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % HELD_OUT != 0, F.lit(True))


def train_field(spark: SparkSession, texts: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LineField:
    """Fit on at most ``max_labelled`` labelled texts, those whose ids hash lowest.

    Every line of a chosen text counts; a dozen bytes a line come to the driver. Of several labels
    or texts of an id the smallest counts; null ids and labels are ignored.
    """
    known = (
        labels.where(F.col("id").isNotNull() & F.col("quality").isNotNull() & _teaches("id"))
        .groupBy("id").agg(F.min(F.col("quality").cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    rows = texts.select("id", "text").join(F.broadcast(known), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                lines = read_lines([t or "" for t in part.column(1).to_pylist()], _words())
                cuts = np.flatnonzero(np.diff(lines.text)) + 1
                packed = [x.tobytes() for x in np.split(lines.features, cuts)]
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0).cast(pa.string()), "label": part.column(2), "lines": packed,
                })

    got = rows.select("id", "text", "label").mapInArrow(read, "id string, label int, lines binary").collect()
    got = sorted((r["id"], r["label"], bytes(r["lines"])) for r in got)
    features = [np.frombuffer(x, dtype=np.uint8).reshape(-1, len(FEATURES)) for _, _, x in got]
    return fit_field(features, [label for _, label, _ in got])


def content_lines(
    spark: SparkSession,
    texts: DataFrame,
    labels: DataFrame,
    keep_share: float = KEEP_SHARE,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """Quality rules and line labels of every text.

    General: the project keeps no texts of several lines. ``texts`` has ``id`` and ``text`` (null is
    empty), ``labels`` has ``id`` and ``quality`` (0 or 1) for some of them; other columns are ignored.
    Words are runs of anything but space and the characters 9 to 13.

    Returns ``id``, the base counts ``n_words, word_chars`` (code points in words), ``n_symbols``
    (``#*$%&|<>``), ``n_dup_lines`` (lines with a word, equal to an earlier line), ``n_repeat_words`` (words
    in windows of five that the text holds twice or more), ``base_failed`` (fewer than ten words, or
    more than a fifth of them in such windows), ``content_words`` (words in lines marked as content) and ``kept``: not
    failed and at least ``keep_share`` of the words are content. Repeated rows stay, equal texts are judged
    alike, empty texts fail; an empty table gives an empty result. Without labels of both kinds all
    lines are content.

    The field is fitted on a bounded sample of labelled texts (``train_field``); texts are read whole
    where they lie, without a shuffle. A task holds a block of texts and a bounded table of words.
    """
    field = spark.sparkContext.broadcast(train_field(spark, texts, labels, max_labelled))

    def judge(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                lines = read_lines([t or "" for t in part.column(1).to_pylist()], _words())
                content = np.bincount(
                    lines.text, lines.words * field.value.content(lines), len(part)
                ).astype(np.int64)
                columns = [*lines.base.T, content]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                    names=["id", *BASE, "content_words"],
                )

    counts = [T.StructField(c, T.LongType()) for c in (*BASE, "content_words")]
    rows = texts.select("id", "text").mapInArrow(judge, T.StructType([texts.select("id").schema["id"], *counts]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("content_words") >= F.lit(float(keep_share)) * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", kept)
