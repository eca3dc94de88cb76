"""Quality of evidence texts: similarity-weighted votes of labelled neighbours in a latent space."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELLED = 4_000  # labelled texts the space is fitted on and that vote, at most
FOLDS = 5
WORDS, SHAPES, GAPS = 768, 192, 12
LATENT = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
TEXTS = 256
TABLE = 250_000
_SHAPE = re.compile(r"(?P<U>[^\W\d_a-z]*[A-Z][^\W\d_a-z]*)|(?P<L>[^\W\d_]+)|(?P<N>\d+)|(?P<D>[.,;:?!'\"-]+)|(?P<S>[\W_]+)")


def held_out(key: str) -> Column:
    """Rows that never teach: every fifth, by the crc32 of the id as text; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


class Terms:
    """Term weights of texts: hashed words, word shapes, and gaps to a word's last use.

    A shape is the run of character classes of a word, such as capitals, letters, symbols; a gap
    is the logarithm of the number of words since the same word. Each of the three blocks is the
    root of its relative frequencies. Words are looked up once per worker.
    """

    def __init__(self) -> None:
        self.table: dict[str, int] = {}
        self.word: list[int] = []
        self.shape: list[int] = []

    def _add(self, word: str) -> None:
        self.table[word] = len(self.word)
        self.word.append(zlib.crc32(word.lower().encode()) % WORDS)
        shape = "".join(m.lastgroup for m in _SHAPE.finditer(word))
        shape = shape if len(shape) <= 4 else f"{shape[:2]}-{shape[-2:]}"
        self.shape.append(zlib.crc32(shape.encode()) % SHAPES)

    def weights(self, texts: list[str]) -> np.ndarray:
        if len(self.table) > TABLE:
            self.__init__()
        split = [t.split() for t in texts]
        for word in set().union(*split) - self.table.keys():
            self._add(word)
        n = len(texts)
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        total = int(sizes.sum())
        look = self.table.__getitem__
        ids = np.array(list(map(look, chain.from_iterable(split))), dtype=np.int64)
        doc = np.repeat(np.arange(n), sizes)
        key = doc * len(self.word) + ids
        order = np.argsort(key, kind="stable")
        same = np.zeros(total, dtype=bool)
        same[1:] = key[order][1:] == key[order][:-1]
        gap = np.full(total, GAPS - 1)
        steps = np.diff(order, prepend=0)
        gap[order[same]] = np.minimum(np.log2(steps[same]).astype(np.int64), GAPS - 2)
        blocks = []
        for value, width in (
            (np.array(self.word, dtype=np.int64)[ids] if total else ids, WORDS),
            (np.array(self.shape, dtype=np.int64)[ids] if total else ids, SHAPES),
            (gap, GAPS),
        ):
            counts = np.bincount(doc * width + value, minlength=n * width).reshape(n, width)
            blocks.append(np.sqrt(counts / np.maximum(sizes, 1)[:, None]))
        return np.hstack(blocks).astype(np.float32)


_WORKER: list[Terms] = []


def _terms() -> Terms:
    """The table of this Python worker, shared by its tasks."""
    if not _WORKER:
        _WORKER.append(Terms())
    return _WORKER[0]


@dataclass
class Votes:
    """A fitted latent space and the labelled vectors in it."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, weights: np.ndarray) -> np.ndarray:
        v = (weights - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Labels of the nearest vectors, weighted by cosine; the prior if none is similar."""
        if not len(self.labels):
            return np.full(len(weights), self.prior)
        cosine = self.latent(weights) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(np.float64), 0.0)
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1.0), self.prior)


def fit_votes(weights: np.ndarray, labels: np.ndarray) -> Votes:
    """Latent axes by the spectrum of the centred term weights, largest first."""
    if not len(labels):
        return Votes(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), labels, 0.5)
    mean = weights.mean(axis=0)
    centred = (weights - mean).astype(np.float64)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :LATENT], dtype=np.float32)
    model = Votes(mean, axes, np.zeros((0, 0)), labels.astype(np.float64), float(labels.mean()))
    model.vectors = np.ascontiguousarray(model.latent(weights), dtype=np.float32)
    return model


def train_votes(
    spark: SparkSession, anomalies: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED
) -> Votes:
    """Fit on at most ``max_labelled`` labelled rows that are not held out, those whose ids hash lowest.

    Only their term weights come to the driver, a matrix of fixed width and bounded length. Of
    several labels of an id the smallest counts; null ids and labels are ignored.
    """
    known = (
        labels.where(F.col("id").isNotNull() & F.col("quality").isNotNull() & ~held_out("id"))
        .groupBy("id").agg(F.min(F.col("quality").cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )

    def weigh(batches):
        terms = _terms()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                w = terms.weights([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0).cast(pa.string()), "label": part.column(2), "w": [r.tobytes() for r in w],
                })

    rows = anomalies.select("id", "evidence").join(F.broadcast(known), "id").select("id", "evidence", "label")
    got = rows.mapInArrow(weigh, "id string, label int, w binary").limit(2 * max_labelled).collect()
    got = sorted((r["id"], r["label"], bytes(r["w"])) for r in got)
    weights = np.array([np.frombuffer(w, dtype=np.float32) for _, _, w in got])
    return fit_votes(weights, np.array([label for _, label, _ in got], dtype=np.float64))


def with_score(spark: SparkSession, rows: DataFrame, text: str, model: Votes, out: str) -> DataFrame:
    """Every row with its quality score in a column ``out``; a scan without a shuffle."""
    shared = spark.sparkContext.broadcast(model)
    at = rows.columns.index(text)

    def score(batches):
        terms = _terms()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                scores = shared.value.score(terms.weights([t or "" for t in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, out]
                )

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def classify_evidence(
    spark: SparkSession,
    anomalies: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """Quality of the evidence text of every anomaly: ``id, held_out, score, predicted``.

    ``anomalies`` has ``id`` and ``evidence`` (text, null is empty), ``labels`` has ``id`` and
    ``quality`` (0 or 1); other columns are ignored and nothing but the text enters a score.
    ``score`` is between 0 and 1, ``predicted`` is 1 from ``threshold`` on. Equal texts get equal
    scores, empty ones too; without labelled rows all scores are 0.5. Repeated rows stay; an
    empty table gives an empty result.

    Whole texts are turned into term weights and latent vectors; the labelled vectors (bounded
    by ``max_labelled``) are broadcast, and each block of texts is multiplied with all of them.
    """
    model = train_votes(spark, anomalies, labels, max_labelled)
    rows = anomalies.select("id", held_out("id").alias("held_out"), "evidence")
    scored = with_score(spark, rows, "evidence", model, "score")
    return scored.select("id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    spark: SparkSession, rows: DataFrame, key: str, text: str, labels: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns.

    ``rows`` has an id and a text column, ``labels`` as for ``classify_evidence``. The rows are
    scored where they are read, so nothing is joined or shuffled.
    """
    evidence = rows.select(F.col(key).alias("id"), F.col(text).alias("evidence"))
    model = train_votes(spark, evidence, labels)
    out = "_score"
    while out in rows.columns:
        out = f"_{out}"
    return with_score(spark, rows, text, model, out).where(F.col(out) >= threshold).drop(out)
