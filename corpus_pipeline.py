"""Corpus pipeline: quality, near duplicates, mix of sources, pieces.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the ``docs`` of the next one. All but the
last return the columns of ``docs``. ``run`` applies them to the documents table.

Rows may have null ids, null texts and repeated ids: stages tell rows apart by id and text, and
rows that agree in both are one document for the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerotrace.llm import evidence_quality, feed_mix, pieces, shingle_join
from aerotrace.llm.queries import WORD, piece_digests, ready
from aerotrace.session import stored


def _packed(docs: DataFrame) -> DataFrame:
    """``key, doc``: the row as one struct, so that no column name can clash, and its id and text
    as one string that sorts by id, null last."""
    number = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~"))
    key = F.concat_ws("-", number, F.hex(F.xxhash64("doc_id", "text")))
    return docs.select(key.alias("key"), F.struct("*").alias("doc"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour votes do not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    return evidence_quality.keep_good(ready(spark), docs, "doc_id", "text", labels, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    rows = _packed(docs)
    classes = shingle_join.near_duplicate_evidence(
        ready(spark), rows.select(F.col("key").alias("id"), F.col("doc.text").alias("evidence"))
    )
    kept = classes.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("key")).distinct()
    # repeated rows of a key lie together after the join; of rows that differ in other columns
    # a digest decides, so reruns keep the same one
    digest = F.xxhash64(*[F.col("doc")[c] for c in docs.columns])
    first = F.row_number().over(Window.partitionBy("key").orderBy(digest))
    return rows.join(kept, "key", "left_semi").withColumn("n", first).where("n = 1").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document cut in the middle counts from half on."""
    rows = _packed(docs)
    size = F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long")
    taken = feed_mix.mix_feeds(
        ready(spark), rows.select(F.col("key").alias("flight_id"), F.col("doc.source").alias("source"), size.alias("n_reports"))
    )
    times = F.when(F.col("n_reports") > 0, F.floor(F.col("taken") / F.col("n_reports") + F.lit(0.5))).otherwise(F.lit(0))
    times = taken.groupBy(F.col("flight_id").alias("key")).agg(F.max(times).cast("int").alias("times")).where("times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    return rows.join(times, "key").select("doc", copies.alias("copy")).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, their number, and digests of ids and decoded text."""
    coded = pieces.encode_pieces(
        ready(spark), docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), text="text"
    )
    return coded.select("doc_id", "ids", *piece_digests())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

# The votes, the hashes and the pieces are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
