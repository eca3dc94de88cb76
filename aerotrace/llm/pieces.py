"""SentencePiece ids of evidence texts, and the texts they decode to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.llm.chunks import Pieces, for_worker

TEXTS = 256


def encode_pieces(spark: SparkSession, evidence: DataFrame, model_file: str, text: str = "evidence") -> DataFrame:
    """Every row with ``ids`` (array of int) and ``decoded`` (the text that the ids decode to).

    ``evidence`` has a text column, null is empty; all its columns are kept, and columns named
    ``ids`` or ``decoded`` are replaced. ``model_file`` is a SentencePiece model, read on the
    driver and broadcast (a vocabulary, so of fixed size). Ids are those of the library's
    ``encode`` without begin or end ids and without sampling, the text is that of its
    ``decode``. Empty texts have no ids and decode to the empty text. Repeated rows stay.

    A distinct-chunk table per worker: pieces of such models never cross a white space marker,
    so each distinct marked word is segmented and decoded once and its ids are put back by
    position. The table is kept per worker, not in one shuffled table for all: exploding each
    word of the corpus and joining ids back would move every word twice, many times the input.
    A scan without a shuffle; memory is one batch and a table of bounded size.
    """
    with open(model_file, "rb") as source:
        model = spark.sparkContext.broadcast(source.read())
    kept = [c for c in evidence.columns if c not in ("ids", "decoded")]
    rows = evidence.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def encode(batches):
        encoder = for_worker(Pieces, model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                ids, decoded = encoder.encode([t or "" for t in part.column(at).to_pylist()])
                ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists, pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"]
                )

    schema = T.StructType([
        *rows.schema.fields,
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
    ])
    return rows.mapInArrow(encode, schema)
