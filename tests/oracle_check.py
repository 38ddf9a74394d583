"""Compare registered queries with their SQL on DuckDB: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def canonical_rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else v
    as_key = lambda v: (v is None, repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v))
    rows = [tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted((tuple(as_key(v) for v in row) for row in rows))


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} vs {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}"
    left, right = canonical_rows(spark_rows), canonical_rows(sql_rows)
    if left != right:
        a, b = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        return f"values of {sorted(spark_rows.columns)}: spark {a} sql {b}"
    kinds = lambda f: {c: ("num" if pd.api.types.is_numeric_dtype(f[c]) and not pd.api.types.is_bool_dtype(f[c]) else "other") for c in sorted(f.columns)}
    return None if len(left) == 0 or kinds(spark_rows) == kinds(sql_rows) or spark_rows.isna().any().any() else f"kinds {kinds(spark_rows)} vs {kinds(sql_rows)}"


def main() -> None:
    root, names = sys.argv[1], sys.argv[2:]
    import __spark_entry__ as entry
    from marketflow.session import get_session

    spark = get_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(root), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, root).toPandas()
            spent = time.time() - start
            problem = difference(got, con.execute(oracle[name]).fetchdf()) if name in oracle else None
            note = f"{len(got)} rows" + ("" if name in oracle else ", no SQL")
        except Exception as error:  # noqa: BLE001
            problem, spent, note = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, ""
        print(f"{'BAD ' if problem else 'ok  '}{name} {spent:.1f}s {note} {problem or ''}", flush=True)
        bad += [name] if problem else []
    print("failed:", bad)


if __name__ == "__main__":
    main()
