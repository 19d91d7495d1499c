"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and the multiset of rows (floats to 6 significant digits).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from corpuskit.session import DRIVER_TABLES, build_session  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return float(f"{v:.6g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/") and not a.startswith("--")]
    import __spark_entry__ as E
    import os
    extra = {"spark.ui.showConsoleProgress": "false"}
    if os.environ.get("ORACLE_TZ"):  # check zone independence of the queries
        extra["spark.sql.session.timeZone"] = os.environ["ORACLE_TZ"]
    if os.environ.get("ORACLE_PLAIN"):  # a session like the driver's, without corpuskit defaults
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8") \
            .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = build_session("local[8]", shuffle_partitions=8, extra=extra)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            s_cols = df.columns
            s_types = dict(df.dtypes)
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(s_rows)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_types = {c[0]: str(c[1]) for c in cur.description}
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(s_cols) != sorted(d_cols):
            print(f"FAIL {name}: columns spark={s_cols} duck={d_cols}")
            bad += 1
            continue
        spark2duck = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                      "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}
        tdiff = [(c, s_types[c], d_types[c]) for c in s_cols
                 if spark2duck.get(s_types[c], s_types[c]).upper() != d_types[c].upper()]
        if tdiff and "--types" in sys.argv:
            print(f"TYPE {name}: {tdiff}")
        a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
        if a != b:
            bad += 1
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)}")
            sa, sb = set(a), set(b)
            for x in list(sa - sb)[:2]:
                print("   spark only:", repr(x)[:300])
            for x in list(sb - sa)[:2]:
                print("   duck only: ", repr(x)[:300])
        else:
            print(f"ok   {name}: {len(a)} rows {dt:.1f}s")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
