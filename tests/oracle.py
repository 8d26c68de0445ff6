"""Side-by-side comparison of a Spark query and its SQL in DuckDB."""

import math
import os
from collections import Counter


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(x) for x in r) for r in df.select(*cols).collect())


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    at = [names.index(x) for x in sorted(names)]
    return sorted(names), Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
