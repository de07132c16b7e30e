"""python compare.py [sf] [name...]: each query against its SQL in DuckDB, rows sorted, columns by name."""

import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

from emberlens.session import get_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b or (math.isnan(a) and math.isnan(b))
    return str(a) == str(b) if not isinstance(a, (int, str, type(None))) else a == b


def main(sf: str, names: list[str]) -> int:
    entry = importlib.import_module("__spark_entry__")
    spark, d, bad = get_session("compare", 8), f"/root/testdata/{sf}", 0
    db = duckdb.connect()
    for t in TABLES:
        path = Path(f"{d}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = f(spark, d)
            columns = sorted(df.columns)
            got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
            s = time.time() - t
            sql = entry.oracle_sql().get(name)
            if not sql:
                print(f"{name}: {len(got)} rows, {s:.1f} s, no SQL", flush=True)
                continue
            t = time.time()
            rel = db.sql(f"SELECT {', '.join(columns)} FROM ({sql.strip().rstrip(';')})")
            want = sorted((tuple(r) for r in rel.fetchall()), key=str)
            wrong = [(x, y) for x, y in zip(got, want) if len(x) != len(y) or not all(map(same, x, y))]
            ok = len(got) == len(want) and not wrong
            bad += not ok
            print(f"{name}: {'same' if ok else 'DIFFERENT'}, {len(got)} and {len(want)} rows, {s:.1f} and {time.time() - t:.1f} s, {df.dtypes if not ok else ''} {wrong[:2] if not ok else ''}"[:1500], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(e)[:1200]}", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "sf0.01", sys.argv[2:]))
