"""Local twin of the driver's correctness check: run a registered Spark query
and its DuckDB oracle on the same parquet tables and compare row count,
column names/types and an order-insensitive multiset of rounded values."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "smallint": "SMALLINT", "timestamp": "TIMESTAMP WITH TIME ZONE",
                  "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "tinyint": "TINYINT"}


def compare(spark_df, sql: str, con) -> dict:
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = [str(t) for t in rel.types]
    drows = rel.fetchall()
    scols = spark_df.columns
    stypes = [t for _, t in spark_df.dtypes]
    srows = [tuple(r) for r in spark_df.collect()]
    out = {"spark_rows": len(srows), "oracle_rows": len(drows)}
    out["names_ok"] = sorted(scols) == sorted(dcols)
    if not out["names_ok"]:
        out["names_diff"] = (sorted(set(scols) - set(dcols)), sorted(set(dcols) - set(scols)))
        return out
    sidx = sorted(range(len(scols)), key=lambda i: scols[i])
    didx = sorted(range(len(dcols)), key=lambda i: dcols[i])
    tmis = []
    for i, j in zip(sidx, didx):
        st = _SPARK_TO_DUCK.get(stypes[i], stypes[i])
        if st != dtypes[j] and not (stypes[i].startswith("array") and dtypes[j].endswith("[]")):
            tmis.append((scols[i], stypes[i], dtypes[j]))
    out["types_ok"] = not tmis
    if tmis:
        out["type_diff"] = tmis
    s = sorted((tuple(_norm(r[i]) for i in sidx) for r in srows), key=repr)
    d = sorted((tuple(_norm(r[j]) for j in didx) for r in drows), key=repr)
    out["values_ok"] = s == d
    if not out["values_ok"]:
        ss, dd = set(map(repr, s)), set(map(repr, d))
        out["only_spark"] = sorted(ss - dd)[:3]
        out["only_oracle"] = sorted(dd - ss)[:3]
    out["ok"] = out["names_ok"] and out["types_ok"] and out["values_ok"] and len(srows) == len(drows)
    return out
