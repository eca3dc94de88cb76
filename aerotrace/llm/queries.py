"""Registered queries of the corpus operators: the given tables mapped to each operator and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.llm import (
    archive_manifest,
    content_lines,
    evidence_quality,
    feed_mix,
    hard_negatives,
    licences,
    near_trajectories,
    pieces,
    placement,
    shingle_join,
    snapshot_warc,
    token_store,
    trajectory_search,
)
from aerotrace.session import configure, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Batches of few rows: whole texts and pages can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return configure(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_near_trajectories",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
    l AS (
      SELECT a.vec_id AS a, b.vec_id AS b
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    c AS (
      SELECT vec_id, vec_id AS root FROM embeddings
      UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.vec_id),
    m AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY vec_id),
    n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
    SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
    FROM m LEFT JOIN n USING (vec_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("flight_id"), "embedding")
    return near_trajectories.near_trajectories(spark, rows).withColumnRenamed("flight_id", "vec_id")


@query("op2_evidence_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return evidence_quality.classify_evidence(
        spark,
        docs.select(F.col("doc_id").alias("id"), F.col("text").alias("evidence")),
        labels.select(F.col("doc_id").alias("id"), "quality"),
        threshold=0.3,
    ).withColumnRenamed("id", "doc_id")


@query("op3_token_store")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("evidence"))
    folder = scratch_dir(spark, "tokens")
    parts = token_store.write_tokens(
        spark, evidence, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return token_store.read_tokens(spark, parts, folder, docs.schema["doc_id"].dataType).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query(
    "op4_shingle_join",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, row_number() OVER () AS r,
             coalesce(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{WORD}'), []) AS w
      FROM documents),
    s AS (
      SELECT r, unnest(list_distinct(CASE
               WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
      FROM w),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
    l AS (
      SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    c AS (
      SELECT r, doc_id AS root FROM w
      UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.r)
    SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.root) AS component_id
    FROM w LEFT JOIN n USING (r) JOIN c USING (r) GROUP BY w.r, w.doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    anomalies = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("evidence"))
    return shingle_join.near_duplicate_evidence(spark, anomalies).withColumnRenamed("id", "doc_id")


@query("op5_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("evidence"))
    coded = pieces.encode_pieces(spark, evidence, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(F.col("id").alias("doc_id"), *piece_digests())


def piece_digests() -> list:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


@query(
    "op6_feed_mix",
    r"""
    WITH d AS (
      SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
      FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (
      SELECT source, source_size, source_size * 2 AS lim,
             CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
      FROM s),
    f AS (
      SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget,
             coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM w),
    l AS (
      SELECT *, CASE WHEN (budget - filled) / rest * weight <= lim THEN (budget - filled) / rest END AS lev
      FROM f),
    t AS (
      SELECT source, source_size,
             CAST(coalesce(CASE WHEN max(lev) OVER () * weight <= lim THEN max(lev) OVER () * weight
                           ELSE lim END, lim) AS DOUBLE) AS target
      FROM l),
    b AS (
      SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
      FROM t),
    c AS (
      SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs,
             CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size
               - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                    ROWS UNBOUNDED PRECEDING) - d.size) AS open_
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(epochs * size + greatest(0, least(size, open_)) AS BIGINT) AS taken
    FROM c
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    tracks = docs.select(F.col("doc_id").alias("flight_id"), "source", words.cast("long").alias("n_reports"))
    return feed_mix.mix_feeds(spark, tracks).select(
        F.col("flight_id").alias("doc_id"), F.col("n_reports").alias("size"),
        F.col("source_reports").alias("source_size"), "target", "taken",
    )


# Not registered: whole numbers with nulls are shown in two ways by the engines' tables; a test compares the values.
ARCHIVE_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (
      SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last
      FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(flatten([
             [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT) >> (15 - 5 * j) & 31) + 1, 1)
              FOR j IN range(4)] FOR g IN range(8)]), '') AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM d
"""


@query("op7_snapshot_warc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    snapshots = pages.select(
        F.col("page_id").alias("snapshot_id"), F.col("url").alias("blob_uri"), F.col("html").alias("payload")
    )
    folder = scratch_dir(spark, "warc")
    whole = snapshot_warc.write_archives(spark, snapshots, folder, revisit_bytes=0)
    members = snapshot_warc.normalise_archives(spark, whole, folder)
    return snapshot_warc.read_archives(spark, members, pages.schema["page_id"].dataType).select(
        F.col("snapshot_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(
    "op8_trajectory_search",
    """
    WITH v AS (
      SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    p AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
      WHERE q.vec_id % 50 = 0),
    r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("flight_id"), "embedding")
    asked = rows.where(F.col("flight_id") % 50 == 0)
    return trajectory_search.top_trajectories(spark, rows, asked, k=5, scale=256.0).withColumnRenamed(
        "flight_id", "vec_id"
    )


@query("op9_flight_placement")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    flights = docs.select(F.col("doc_id").alias("flight_id"), F.col("text").alias("payload"))
    return placement.place_flights(flights, shards=24).select(
        F.col("flight_id").alias("doc_id"), "size", F.col("payload_crc32").alias("text_crc32"),
        "law", "shard", "slot", "grown_shard",
    )


@query("op10_licences")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_content_lines")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return content_lines.content_lines(
        spark, texts, labels.select(F.col("doc_id").alias("id"), "quality")
    ).withColumnRenamed("id", "doc_id")


def _manifest_sql(levels: int) -> str:
    """Trees of up to ``8 ** levels`` nodes: leaves ``m``, their levels ``c``, the folders' levels ``g``."""
    upper, lower = UPPER, UPPER.lower()
    # the sixteen remainders of a nibble under the polynomial of crc32
    table = "[" + ", ".join(str(_nibble(i)) for i in range(16)) + "]"
    crc = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(
        [[CAST(ascii(x) & 15 AS BIGINT), CAST(ascii(x) >> 4 AS BIGINT)] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')])),
        lambda a, x: xor(a >> 4, {table}[(xor(a, x) & 15) + 1])), 4294967295)"""
    field = "coalesce(strlen({0}) || ':' || {0}, '-')"
    cells = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    own = " || ".join(field.format(c) for c in [*cells, "text"])
    copy = " || ".join(field.format(c) for c in [*cells, f"translate(text, '{upper}', '{lower}')"])
    sql = f"""WITH m0 AS (
      SELECT doc_id, lang, sha256({own}) AS leaf,
             CASE WHEN coalesce(({crc}) % 3 = 0, FALSE) THEN sha256({copy}) ELSE sha256({own}) END AS got
      FROM documents),
    m AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM m0),
    c0 AS (SELECT lang, pos, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM m)"""

    def climb(name: str, key: str) -> str:
        out = ""
        for k in range(levels):
            out += f""",
    {name}{k + 1} AS (
      SELECT {key}, pos // w AS pos, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d,
             (n + 7) // 8 AS n
      FROM (SELECT *, CASE WHEN n > 1 THEN 8 ELSE 1 END AS w FROM {name}{k}) GROUP BY {key}, pos // w, n)"""
        return out

    def rise(name: str, nodes: str, key: str, first: str) -> str:
        """Witness and folded node, one level after the other; ``p`` all siblings so far."""
        out, last = "", first
        for k in range(levels):
            out += f""",
    {name}{k + 1} AS (
      SELECT any_value(u.doc_id) AS doc_id, any_value(u.leaf) AS leaf, u.lang, any_value(u.place // 8) AS place, any_value(u.p)
               || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos <> u.place), '') AS p,
             CASE WHEN any_value(s.n) > 1 THEN sha256(
               coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos < u.place), '') || any_value(u.got)
               || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos > u.place), '')) ELSE any_value(u.got) END AS got,
             u.id
      FROM {last} u JOIN {nodes}{k} s ON {key} AND s.pos // 8 = u.place // 8
      GROUP BY u.id, u.lang)"""
            last = f"{name}{k + 1}"
        return out

    sql += climb("c", "lang")
    sql += f""",
    g0 AS (SELECT 1 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, d,
                  count(*) OVER () AS n FROM c{levels})"""
    sql += climb("g", "one")
    sql += """,
    u0 AS (SELECT doc_id, leaf, lang, pos AS place, '' AS p, got, row_number() OVER () AS id FROM m)"""
    sql += rise("u", "c", "s.lang IS NOT DISTINCT FROM u.lang", "u0")
    sql += f""",
    v0 AS (SELECT u.* REPLACE (g.pos AS place) FROM u{levels} u JOIN g0 g ON g.lang IS NOT DISTINCT FROM u.lang)"""
    sql += rise("v", "g", "s.one = 1", "v0")
    return sql + f"""
    SELECT v.doc_id, v.leaf, c.d AS subroot, r.d AS root, sha256(v.p) AS proof_sha256, v.got AS folded_root,
           v.got = r.d AS verified
    FROM v{levels} v JOIN c{levels} c ON c.lang IS NOT DISTINCT FROM v.lang JOIN g{levels} r ON r.one = 1"""


def _nibble(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


@query("op12_archive_manifest", _manifest_sql(6))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    reports = docs.select(
        F.col("doc_id").alias("seq"), "source", F.col("lang").alias("feed"), "n_chars", F.col("text").alias("raw")
    )
    altered = F.crc32(F.col("seq").cast("string")) % 3 == 0
    copy = F.when(altered, F.translate("raw", UPPER, UPPER.lower())).otherwise(F.col("raw"))
    return archive_manifest.archive_manifest(
        spark, reports, ("seq", "source", "feed", "n_chars", "raw"), "feed", ("seq",), {"raw": copy}
    ).withColumnRenamed("seq", "doc_id")


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e)
      WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "flight_id")
    moved = F.when(F.col("flight_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    flights = rows.select("flight_id", "embedding", moved.alias("dest_icao"))
    return hard_negatives.hard_negatives(
        spark, flights, flights.where(F.col("flight_id") % 100 == 0), label="dest_icao", positives=5, negatives=10
    )
