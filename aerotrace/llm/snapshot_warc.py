"""Web archives of fetched snapshots: written whole, normalised to one member per record, read back."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.llm.files import opened, written
from aerotrace.session import stored

URN = "urn:aerotrace:snapshot:"
DATE = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
ROWS = 64


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(key: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record with an HTTP response block; a revisit has the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <{URN}{quote(key, safe='')}>")
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{URN}{quote(refers_to, safe='')}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    unzip = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    yield unzip.flush()


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record of a stream; memory is one record."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            held.extend(piece)
            if piece:
                return True
        return False

    while held or more():
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record's head is cut off")
                return
        head = bytes(held[:cut])
        length = int(fields(head)["content-length"])
        end = cut + 4 + length
        while len(held) < end + 4:
            if not more():
                raise ValueError("a record is cut off")
        block = bytes(held[cut + 4 : end])
        del held[: end + 4]
        yield head, block


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS).to_pydict()


def write_archives(spark: SparkSession, snapshots: DataFrame, folder: str, revisit_bytes: int = 0) -> DataFrame:
    """Write one record per snapshot to archives that are single gzip streams; returns their ``archive`` names.

    ``snapshots`` has ``snapshot_id``, ``blob_uri`` and ``payload`` (text, null is empty); other
    columns are ignored. Of rows with equal payloads of at least ``revisit_bytes`` bytes, the one
    with the largest id is a response, the others revisit it; rows with that same id, and rows
    without an id, are responses too. An empty table gives no archive.

    One archive per partition. The largest id of each digest is an aggregate of digests, joined
    back, so copies of one payload are not gathered.
    """
    rows = snapshots.select(
        F.col("snapshot_id"), "blob_uri", F.encode(F.coalesce("payload", F.lit("")), "utf-8").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.length("payload") >= revisit_bytes).groupBy("sha1").agg(F.max("snapshot_id").alias("first"))
    rows = rows.join(first, "sha1", "left").select(
        F.coalesce(F.col("snapshot_id").cast("string"), F.lit("")).alias("key"), "blob_uri", "payload", "sha1",
        F.when(F.col("snapshot_id") != F.col("first"), F.col("first").cast("string")).alias("refers_to"),
    )

    def write(batches):
        name = f"{folder}/whole/archive-{TaskContext.get().partitionId():06d}.warc.gz"
        batches = _columns(batches)
        cols = next(batches, None)
        if cols is None:
            return
        zip_ = zlib.compressobj(1, zlib.DEFLATED, 31)
        with written(name) as out:
            while cols is not None:
                for key, uri, payload, sha1, refers in zip(*cols.values(), strict=True):
                    out.write(zip_.compress(record(key, uri, payload, base32_sha1(sha1), refers)))
                cols = next(batches, None)
            out.write(zip_.flush())
        yield pa.RecordBatch.from_pydict({"archive": [name]})

    return stored(spark, rows.mapInArrow(write, "archive string"), "archives")


def normalise_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives with one gzip member per record and a sidecar index; returns the new ``archive`` names.

    ``archives`` has ``archive``, a uri or path of a ``.warc.gz`` file that may be one single
    gzip stream. Each file is inflated once, piece by piece, in one task. The sidecar
    ``<name>.idx`` has a JSON line per record: offset, length, type, record id, payload digest.
    Files are written under ``folder`` by their own names and appear when complete.
    """

    def normalise(batches):
        for cols in _columns(batches):
            for archive in cols["archive"]:
                name = f"{folder}/members/{archive.rpartition('/')[2]}"
                store, path = opened(archive)
                with store.open_input_stream(path, compression=None) as source, written(name) as out, written(
                    f"{name}.idx"
                ) as index:
                    offset = 0
                    for head, block in records(inflated(source)):
                        zip_ = zlib.compressobj(5, zlib.DEFLATED, 31)
                        member = zip_.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + zip_.flush()
                        out.write(member)
                        f = fields(head)
                        line = {
                            "offset": offset, "length": len(member), "type": f["warc-type"],
                            "id": f["warc-record-id"], "digest": f.get("warc-payload-digest"),
                        }
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                yield pa.RecordBatch.from_pydict({"archive": [name]})

    files = archives.select("archive")
    return stored(spark, files.repartition(max(1, files.count())).mapInArrow(normalise, "archive string"), "members")


def read_member(store, path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of the record whose member stands at ``offset``."""
    with store.open_input_file(path) as source:
        raw = zlib.decompress(source.read_at(length, offset), 31)
    head, block = next(records(iter([raw])))
    return fields(head), block


def read_archives(spark: SparkSession, archives: DataFrame, key: T.DataType) -> DataFrame:
    """Records of normalised archives, by their index.

    Returns ``snapshot_id, blob_uri, payload`` (bytes, null for a revisit), ``payload_bytes``
    and ``payload_digest`` (base32 SHA-1) of the full payload, ``record_type``, ``refers_to``.
    """

    def read(batches):
        for cols in _columns(batches):
            for archive in cols["archive"]:
                yield from _read_archive(archive)

    schema = (
        "snapshot_id string, blob_uri string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to string"
    )
    rows = archives.repartition(max(1, archives.count())).mapInArrow(read, schema)
    return rows.withColumns({
        "snapshot_id": F.when(F.col("snapshot_id") != "", F.col("snapshot_id").cast(key)),
        "refers_to": F.col("refers_to").cast(key),
    })


def _read_archive(archive: str) -> Iterator[pa.RecordBatch]:
    store, path = opened(archive)
    with store.open_input_stream(f"{path}.idx", compression=None) as source:
        index = [json.loads(x) for x in source.read().splitlines()]
    out: list[tuple] = []
    with store.open_input_file(path) as source:
        for line in index:
            raw = zlib.decompress(source.read_at(line["length"], line["offset"]), 31)
            head, block = next(records(iter([raw])))
            out.append(_row(fields(head), block))
            if len(out) == ROWS:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


def _name(urn: str) -> str:
    return unquote(urn.strip("<>")[len(URN) :])


def _row(f: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = f["warc-type"]
    uri, refers = f.get("warc-target-uri"), f.get("warc-refers-to")
    return (
        _name(f["warc-record-id"]), None if uri is None else unquote(uri),
        payload if kind == "response" else None, int(fields(http)["content-length"]),
        f["warc-payload-digest"].removeprefix("sha1:"), kind, None if refers is None else _name(refers),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["snapshot_id", "blob_uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
    )
