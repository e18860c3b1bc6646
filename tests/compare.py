"""Run registered queries beside their SQL oracles and compare whole results."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind == "f" or (kind == "O" and df[c].map(lambda v: isinstance(v, float)).any()):
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else repr(float(v)))
        elif kind in "iu":
            df[c] = df[c].astype("int64").astype(str)
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v))
                              else str(v).replace(" 00:00:00", ""))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame, limit: int = 3) -> list[str]:
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind and len(got):
            out.append(f"type {c}: {got[c].dtype} != {want[c].dtype}")
    a, b = canon(got), canon(want)
    if not out and not a.equals(b):
        only_a = a.merge(b, how="outer", indicator=True)
        bad = only_a[only_a["_merge"] != "both"]
        out.append(f"{len(bad)} differing rows\n{bad.head(2 * limit).to_string()}")
    return out


def main() -> int:
    sys.path.insert(0, ".")
    from areaflow.catalog import registry
    from areaflow.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = registry.queries(), registry.oracles()
    bad = 0
    for key, fn in queries.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if key in oracle:
                want = con.execute(oracle[key]).fetchdf()
                diff = differences(got, want)
            else:
                diff = [] if len(got) else ["no rows"]
        except Exception as e:  # noqa: BLE001
            diff, t1, got = [f"{type(e).__name__}: {str(e)[:1500]}"], time.time(), []
        bad += bool(diff)
        print(f"{'BAD' if diff else 'ok '} {key} rows={len(got)} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s"
              + ("" if key in oracle else " (no oracle)"), flush=True)
        for d in diff:
            print("    " + d, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
