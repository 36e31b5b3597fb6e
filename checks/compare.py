"""Run queries next to their SQL counterpart: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame, digits: int = 8) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return f"{float(v):.{digits}g}" if v else "0"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    cols = sorted(pdf.columns)
    return sorted(tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))


def differences(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)} rows differ, e.g. {bad[0]}"


def main(argv: list[str]) -> int:
    from checks.registry import oracle_sql, queries
    from flowarden.session import local_session, owned_intermediates

    sf_dir, names = argv[0], argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = duck(sf_dir), queries(), oracle_sql()
    failed = []
    for name in names or qs:
        start = time.time()
        try:
            with owned_intermediates(spark):
                got = qs[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in sql:
                problem = differences(got, con.execute(sql[name]).df())
            else:
                problem = None
            note = "ok" if name in sql else "rows only"
        except Exception as e:  # noqa: BLE001 - report and go on
            took, problem, got, note = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}", [], ""
        if problem:
            failed.append(name)
        print(f"{name:34s} {took:6.2f}s {len(got):7d} {problem or note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
