"""Binary token store of evidence texts: zstandard frames per text with a shared dictionary."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.llm.chunks import ByteBpe, for_worker
from aerotrace.llm.files import opened, read_bytes, written
from aerotrace.session import stored

MAGIC = b"ATOK1\n"
SAMPLE_ROWS = 1_000  # texts the dictionary is trained on, at most
SAMPLE_BYTES = 4_096  # of each, at most
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
TEXTS = 256  # read together
ENCODED = 1_024  # texts encoded together


def _in_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int = TEXTS) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield tuple(part.column(c).to_pylist() for c in columns)


def train_dictionary(spark: SparkSession, evidence: DataFrame, model) -> bytes:
    """A zstandard dictionary trained on the serialized ids of at most ``SAMPLE_ROWS`` texts.

    The sample is the texts whose keys have the smallest hashes, so it does not depend on the
    partitioning. Too few or too small texts give an empty dictionary.
    """

    def serialize(batches):
        encoder = for_worker(ByteBpe, model.value)
        for (texts,) in _in_groups(batches, ("text",)):
            raw = encoder.encode([t or "" for t in texts])
            yield pa.RecordBatch.from_pydict({"raw": [r[:SAMPLE_BYTES] for r in raw]})

    chosen = evidence.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    texts = evidence.join(F.broadcast(chosen.distinct()), "id", "left_semi").select("text").limit(2 * SAMPLE_ROWS)
    raw = sorted(bytes(r[0]) for r in texts.mapInArrow(serialize, "raw binary").collect())
    raw = [r for r in raw if r]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compression(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_tokens(
    spark: SparkSession, evidence: DataFrame, folder: str, tokenizer: str, end_id: int = 2, parts: int | None = None
) -> DataFrame:
    """Write the ids of every evidence text to ``folder``, in ascending order of the ids' keys.

    ``evidence`` has ``id`` (orderable) and ``evidence`` (text, null is empty); other columns are
    ignored. ``tokenizer`` is a byte-level BPE file of the tokenizers library, read on the driver
    and broadcast (a vocabulary, so of fixed size). ``end_id`` is appended to every text.

    Files, per range of keys: ``part-N.tok`` has a head line (magic, dictionary hash, width of an
    id) and one zstandard frame per text; ``part-N.idx`` is a Parquet table with ``id``,
    ``offset``, ``length``, ``n_tokens``. ``dictionary.zst`` is shared by all frames. Returns one
    row per file: ``part, n_texts, n_tokens``.

    Rows with a null key come first, repeated keys keep all their rows. An empty table gives no
    texts. Texts are dealt by ranges of the key before they are encoded, so a task holds one
    range, written through a stream; files appear only when complete.
    """
    rows = evidence.select("id", F.coalesce("evidence", F.lit("")).alias("text"))
    with open(tokenizer, "rb") as source:
        model = spark.sparkContext.broadcast(source.read())
    dictionary = train_dictionary(spark, rows, model)
    with written(f"{folder}/dictionary.zst") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)
    kind = spark_to_arrow(rows.schema["id"].dataType)

    def write(batches):
        part = TaskContext.get().partitionId()
        encoder = for_worker(ByteBpe, model.value)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, **_compression(shared.value))
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        head = {"dictionary": hashlib.sha256(shared.value).hexdigest(), "width": encoder.kind.itemsize}
        keys, offsets, lengths, counts = [], [], [], []
        name = f"{folder}/part-{part:06d}"
        with written(f"{name}.tok") as out:
            first = MAGIC + json.dumps(head).encode() + b"\n"
            out.write(first)
            offset = len(first)
            for ids, texts in _in_groups(batches, ("id", "text"), ENCODED):
                for key, raw in zip(ids, encoder.encode(texts), strict=True):
                    raw += end
                    frame = zip_.compress(raw)
                    out.write(frame)
                    keys.append(key)
                    offsets.append(offset)
                    lengths.append(len(frame))
                    counts.append(len(raw) // encoder.kind.itemsize)
                    offset += len(frame)
        index = pa.table({
            "id": pa.array(keys, kind), "offset": pa.array(offsets, pa.int64()),
            "length": pa.array(lengths, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
        })
        with written(f"{name}.idx") as out:
            pq.write_table(index, out)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_texts": [len(keys)], "n_tokens": [sum(counts)]})

    parts = parts or max(8, 2 * rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.xxhash64("text")
    )
    return stored(spark, dealt.mapInArrow(write, "part long, n_texts long, n_tokens long"), "parts")


def spark_to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_tokens(spark: SparkSession, parts: DataFrame, folder: str, key: T.DataType) -> DataFrame:
    """The texts of a token store, from its files: ``id, start, n_tokens, ids``.

    ``start`` is the number of ids of all texts before, ``ids`` the ids as little-endian unsigned
    32-bit integers. ``parts`` is what ``write_tokens`` returned. A file is read by one task,
    frame by frame; a dictionary that is not the one the file was written with is an error.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = parts.where("n_texts > 0").select(
        "part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base")
    )
    kind = spark_to_arrow(key)

    def read(batches):
        for numbers, bases in _in_groups(batches, ("part", "base")):
            for part, base in zip(numbers, bases, strict=True):
                yield from _read_part(f"{folder}/part-{part:06d}", base, kind, read_bytes(f"{folder}/dictionary.zst"))

    schema = T.StructType([
        T.StructField("id", key), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


def _read_part(name: str, base: int, kind: pa.DataType, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    store, path = opened(f"{name}.idx")
    index = pq.read_table(path, filesystem=store)
    unzip = zstandard.ZstdDecompressor(**_compression(dictionary))
    store, path = opened(f"{name}.tok")
    with store.open_input_file(path) as source:
        head = source.read_at(256, 0)
        if not head.startswith(MAGIC):
            raise ValueError(f"{name} is no token file")
        head = json.loads(head[len(MAGIC) :].split(b"\n", 1)[0])
        if head["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{name} was written with another dictionary")
        width = np.dtype(f"<u{head['width']}")
        for batch in index.to_batches(max_chunksize=TEXTS):
            cols = batch.to_pydict()
            out, starts = [], []
            first, last = cols["offset"][0], cols["offset"][-1] + cols["length"][-1]
            data = memoryview(source.read_at(last - first, first))
            for offset, length, n in zip(cols["offset"], cols["length"], cols["n_tokens"], strict=True):
                raw = unzip.decompress(data[offset - first : offset - first + length])
                out.append(np.frombuffer(raw, dtype=width).astype("<u4").tobytes())
                starts.append(base)
                base += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["id"], kind), pa.array(starts, pa.int64()), pa.array(cols["n_tokens"], pa.int64()),
                 pa.array(out, pa.binary())],
                names=["id", "start", "n_tokens", "ids"],
            )


def read_text_tokens(folder: str, part: int, key: object) -> list[int]:
    """Ids of one text, by the index: reads the index and the bytes of one frame."""
    name = f"{folder}/part-{part:06d}"
    store, path = opened(f"{name}.idx")
    row = pq.read_table(path, filesystem=store, filters=[("id", "=", key)]).to_pylist()[0]
    store, path = opened(f"{name}.tok")
    with store.open_input_file(path) as source:
        head = json.loads(source.read_at(256, 0)[len(MAGIC) :].split(b"\n", 1)[0])
        frame = source.read_at(row["length"], row["offset"])
    unzip = zstandard.ZstdDecompressor(**_compression(read_bytes(f"{folder}/dictionary.zst")))
    return np.frombuffer(unzip.decompress(frame), dtype=f"<u{head['width']}").tolist()
