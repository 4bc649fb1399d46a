"""Shared comparison used by the tests and scripts/check_oracle.py."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import TABLES, digest  # noqa: E402

#: The smallest table set.
SF001 = "/root/testdata/sf0.001"


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name):
    import __spark_entry__ as e
    df = e.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    rel = con.execute(e.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    h1, _ = digest(df.columns, rows)
    h2, _ = digest(ocols, orows)
    ok = sorted(df.columns) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
    return ok, (df.columns, ocols, len(rows), len(orows))
