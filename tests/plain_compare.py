"""Compare a registered query with its SQL in DuckDB."""

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def differences(spark, sf_dir: str, query, sql: str) -> list:
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = query(spark, sf_dir)
    got = sorted([str([plain(r[c]) for c in sorted(found.columns)]) for r in found.collect()])
    told = con.sql(sql)
    names = sorted(told.columns)
    assert names == sorted(found.columns)
    at = [told.columns.index(c) for c in names]
    want = sorted([str([plain(r[k]) for k in at]) for r in told.fetchall()])
    return [(g, w) for g, w in zip(got, want, strict=False) if g != w] or ([] if len(got) == len(want) else [len(got), len(want)])
