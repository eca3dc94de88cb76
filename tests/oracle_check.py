"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python tests/oracle_check.py [--sf sf0.01] [name-part ...]``
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


SAME = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(sorted(df.columns), axis=1)

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (float, np.floating)):
            return repr(float(v))
        if isinstance(v, (int, np.integer)):
            return str(int(v))
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(t) for c, t in df.dtypes.items()}


def compare(spark_df, con, sql: str) -> str:
    got = spark_df.toPandas()
    rel = con.sql(sql)
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    ours = {f.name: SAME.get(f.dataType.simpleString(), "?") for f in spark_df.schema.fields}
    odd = {c: (ours[c], theirs.get(c)) for c in ours if ours[c] != theirs.get(c)}
    want = rel.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return f"ok {len(a)} rows" + (f" TYPES {odd}" if odd else "")
    # integers against doubles with equal value are told apart here on purpose
    in_a, in_b = set(a), set(b)
    only_a = [x for x in a if x not in in_b][:3]
    only_b = [x for x in b if x not in in_a][:3]
    return (
        f"DIFFER {len(a)} vs {len(b)} rows; cols {sorted(got.columns)}\n"
        f"   spark only {only_a}\n   sql only   {only_b}\n   types {kinds(got)} vs {kinds(want)}"
    )


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from aerotrace.session import local_session

    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{args.sf}"
    con = connect(sf_dir)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        t = time.time()
        try:
            if name in oracle:
                result = compare(fn(spark, sf_dir), con, oracle[name])
            else:
                result = f"rows only {fn(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            result = f"ERROR {str(exc)[:1500]}"
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:40s} {time.time() - t:6.2f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
