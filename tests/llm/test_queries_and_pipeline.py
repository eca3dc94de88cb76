from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from aerotrace.llm import queries
from brute import WORDS, fill_targets, near_duplicates

SF_DIR = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    from oracle_check import compare, connect

    result = compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLE[name])
    assert result.startswith("ok"), result


def test_archives_equal_sql(spark):
    from oracle_check import connect

    got = queries.QUERIES["op7_snapshot_warc"](spark, SF_DIR)
    want = connect(SF_DIR).sql(queries.ARCHIVE_SQL)
    order = [got.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[i] for i in order) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = docs.limit(60)
    data = docs.unionByName(first).unionByName(
        docs.limit(1).selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "lang", "CAST(NULL AS STRING) source", "n_chars")
    ).selectExpr("*", "'c' AS _score", "'c' AS key", "'c' AS doc", "'c' AS times")
    held = data
    results = []
    for name, stage in corpus_pipeline.STAGES:
        held_out = stage(spark, held, SF_DIR)
        folder = f"{corpus_pipeline.stored(spark, held_out, name).inputFiles()[0].rsplit('/', 1)[0]}"
        held_out = spark.read.parquet(folder)
        results.append(held_out.collect())
        if name != "encode":
            assert held_out.columns == data.columns
        held = held_out
    good, kept, mixed, coded = results

    scores = queries.evidence_quality.classify_evidence(
        spark, data.selectExpr("doc_id AS id", "text AS evidence"),
        spark.read.parquet(f"{SF_DIR}/labels.parquet").selectExpr("doc_id AS id", "quality"),
    )
    want = sorted(str(r["id"]) for r in scores.collect() if r["predicted"] == 1)
    assert sorted(str(r["doc_id"]) for r in good) == want

    # rows that agree in id and text are one; a null id sorts last
    distinct = {(r["doc_id"] if r["doc_id"] is not None else 10**9, r["text"]) for r in good}
    classes = near_duplicates(sorted(distinct, key=lambda r: (r[0], r[1] or "")))
    assert len(kept) == sum(k == c for k, _, c in classes)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else 10**9 for r in kept) == sorted(
        k for k, _, c in classes if k == c
    )

    words = lambda t: len(WORDS.findall(t or ""))
    sizes: dict = {}
    for r in kept:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    target, took = fill_targets(sizes, (3, 1, 2), 1.5, 2), dict.fromkeys(sizes, 0)
    largest = max((words(r["text"]) for r in kept), default=0)
    for r in mixed:
        took[r["source"]] += words(r["text"])
    assert all(abs(took[s] - target[s]) <= largest for s in sizes)
    assert max(sum(r["doc_id"] == k["doc_id"] for r in mixed) for k in kept) <= 2

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [library.encode(r["text"] or "") for r in mixed]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in coded) == sorted(
        (len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for i in ids
    )


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
