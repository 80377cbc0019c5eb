"""Compare registered queries with their SQL twins: check.py [sf] [name-prefix ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype(str)
        elif str(pdf[c].dtype).startswith("Int"):
            # nullable integers: as pandas holds them when they come from Spark
            pdf[c] = pdf[c].astype("float64" if pdf[c].isna().any() else "int64")
        elif pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return pdf.sort_values(list(pdf.columns), kind="stable").reset_index(drop=True)


def kinds(pdf):
    return {c: pdf[c].dtype.kind for c in pdf.columns}


def compare(spark_df, con, sql):
    mine, theirs = normal(spark_df.toPandas()), normal(con.sql(sql).df())
    if list(mine.columns) != list(theirs.columns):
        return f"columns {list(mine.columns)} vs {list(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    if kinds(mine) != kinds(theirs):
        return f"types {mine.dtypes.to_dict()} vs {theirs.dtypes.to_dict()}"
    for c in mine.columns:
        a, b = mine[c], theirs[c]
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values differ in {c}, e.g.\n   {mine.loc[i].to_dict()}\n   {theirs.loc[i].to_dict()}"
    return None if len(mine) else "EMPTY"


def main():
    from recquarry.plans import registry
    from recquarry.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    spark, con = local_session(), connect(f"/root/testdata/sf{sf}")
    failed = []
    for name, fn in registry.QUERIES.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            df = fn(spark, f"/root/testdata/sf{sf}")
            if name in registry.SQL:
                problem = compare(df, con, registry.SQL[name])
            else:
                problem = None if df.count() else "EMPTY"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "ok" if problem is None else "FAIL"
        oracle = "" if name in registry.SQL else " (no sql)"
        print(f"{mark:5}{time.time() - t:6.1f}s {name}{oracle} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
