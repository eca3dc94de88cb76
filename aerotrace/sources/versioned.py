"""Tables of hourly folders with versions: readers see one whole version or the next, never a mixture.

Data files are written once, into a folder of their version, and never changed. A version is made by
the last step of a write: one small manifest file that names, for every hour, the folders holding
its rows. Readers list the manifests, take the newest, and read the files it names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = {"version": 0, "batch": -1, "hours": {}}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _file_system(spark, f"{path}/_manifests")
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest manifest, or that of a version; an empty one before the first write."""
    known = _versions(spark, path)
    if not known:
        return dict(EMPTY)
    name = f"{path}/_manifests/{version if version is not None else known[-1]:012d}.json"
    return json.loads(spark.read.text(name, wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, entry: dict) -> None:
    """Write the manifest under another name and rename it: it is there as a whole or not at all."""
    name = f"{path}/_manifests/{entry['version']:012d}.json"
    files, at = _file_system(spark, name)
    draft = _file_system(spark, f"{path}/_manifests/_{entry['version']:012d}.draft")[1]
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    if not files.rename(draft, at):
        raise RuntimeError(f"version {entry['version']} of {path} was written by another writer")


def with_hours(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """``rows`` with the folder columns ``dt`` and ``hour`` of a time."""
    return rows.withColumn("dt", F.date_format(ts, "yyyy-MM-dd")).withColumn("hour", F.date_format(ts, "HH"))


def _hours(rows: DataFrame) -> list[str]:
    """Folders that rows fall into; one value per hour of the batch comes to the driver."""
    return sorted(f"dt={r['dt']}/hour={r['hour']}" for r in rows.select("dt", "hour").distinct().collect())


def _read(spark: SparkSession, path: str, entry: dict, schema: str, ts: str, hours: list[str]) -> DataFrame:
    folders = [f"{path}/data/{folder}/{hour}" for hour in hours for folder in entry["hours"].get(hour, [])]
    if not folders:
        return with_hours(spark.createDataFrame([], schema), ts)
    return with_hours(spark.read.schema(schema).parquet(*folders), ts)


def read_table(
    spark: SparkSession, path: str, schema: str, ts: str = "ts", since: str | None = None, until: str | None = None,
    version: int | None = None,
) -> DataFrame:
    """The rows of the newest version, or of an older one that is still kept.

    ``since`` and ``until`` (``yyyy-MM-dd HH``) leave out hours by the manifest, before any file is listed.
    """
    entry = manifest(spark, path, version)
    low, high = (None if t is None else f"dt={t[:10]}/hour={t[11:13]}" for t in (since, until))
    hours = [h for h in sorted(entry["hours"]) if (low is None or h >= low) and (high is None or h <= high)]
    return _read(spark, path, entry, schema, ts, hours)


def _write(spark: SparkSession, rows: DataFrame, path: str, entry: dict, batch: int) -> tuple[str, int]:
    version = entry["version"] + 1
    folder = f"v{version:012d}"
    # a batch that failed before its manifest leaves files here; they are not named anywhere
    rows.write.mode("overwrite").partitionBy("dt", "hour").parquet(f"{path}/data/{folder}")
    return folder, version


def append(rows: DataFrame, path: str, batch: int, ts: str = "ts") -> bool:
    """Add the rows of a batch; False if this batch was added before. ``rows`` may have clustering."""
    spark = rows.sparkSession
    entry = manifest(spark, path)
    if batch <= entry["batch"]:
        return False
    rows = with_hours(rows, ts)
    touched = _hours(rows)
    hours = dict(entry["hours"])
    folder, version = _write(spark, rows, path, entry, batch)
    for hour in touched:
        hours[hour] = [*hours.get(hour, []), folder]
    _publish(spark, path, {"version": version, "batch": batch, "hours": hours})
    return True


def merge(
    rows: DataFrame, path: str, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame], ts: str = "ts"
) -> bool:
    """Merge the rows of a batch into the hours they touch; False if this batch was merged before.

    ``combine(old, new)`` gives the rows of those hours. They are written once; other hours keep their files.
    """
    spark = rows.sparkSession
    entry = manifest(spark, path)
    if batch <= entry["batch"]:
        return False
    rows = with_hours(rows, ts)
    touched = _hours(rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("dt", "hour").schema)
    old = _read(spark, path, entry, schema, ts, touched)
    folder, version = _write(spark, combine(old, rows), path, entry, batch)
    hours = dict(entry["hours"]) | {hour: [folder] for hour in touched}
    _publish(spark, path, {"version": version, "batch": batch, "hours": hours})
    return True


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove manifests but the newest ``keep`` and the hours of data only they name; their number.

    Readers that began on an older version must have ended.
    """
    known = _versions(spark, path)
    gone, kept = known[:-keep], known[-keep:]
    live = {(f, h) for v in kept for h, fs in manifest(spark, path, v)["hours"].items() for f in fs}
    named = {(f, h) for v in gone for h, fs in manifest(spark, path, v)["hours"].items() for f in fs}
    files, _ = _file_system(spark, path)
    for version in gone:
        files.delete(_file_system(spark, f"{path}/_manifests/{version:012d}.json")[1], False)
    for folder, hour in named - live:
        files.delete(_file_system(spark, f"{path}/data/{folder}/{hour}")[1], True)
    return len(named - live)
