"""Compare registered queries with their SQL in DuckDB.

    python tests/check.py sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT else str(list(v)) if isinstance(v, (list, np.ndarray)) else v)
    if len(df.columns):
        order = df.apply(lambda s: s.astype(str))
        df = df.loc[order.sort_values(list(df.columns)).index].reset_index(drop=True)
    return df


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    kinds = [(c, a[c].dtype.kind, b[c].dtype.kind) for c in a.columns if len(a) and a[c].dtype.kind != b[c].dtype.kind]
    a, b = _norm(a), _norm(b)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = list(same[~same].index[:3])
            return f"{c}: {(~same).sum()} differ, e.g. {[(x[j], y[j]) for j in i]} at {a.loc[i[0]].to_dict()} vs {b.loc[i[0]].to_dict()}"
    return f"types {kinds}" if kinds else None


def main() -> int:
    import __spark_entry__ as entry
    from skyfold.session import local_session

    sf, want = str(DATA / sys.argv[1]), sys.argv[2:]
    spark, con = local_session(), duck(sf)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf).toPandas()
            t1 = time.time()
            msg = compare(got, con.execute(sql[name]).df()) if name in sql else None
        except Exception as err:  # noqa: BLE001
            t1, got, msg = time.time(), [], f"{type(err).__name__}: {str(err)[:700]}"
        bad += bool(msg) or not len(got)
        print(f"{'FAIL' if msg else 'ok  ' if name in sql else 'rows'} {name} rows={len(got)} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s {msg or ('EMPTY' if not len(got) else '')}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
