"""Compare a query with its SQL twin, columns by name and rows in any order."""

from pathlib import Path

import duckdb


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
    ran = con.execute(sql)
    theirs = [c[0] for c in ran.description]
    assert sorted(theirs) == names
    order = [theirs.index(c) for c in names]
    want = sorted((tuple(norm(r[k]) for k in order) for r in ran.fetchall()), key=str)
    assert got == want
    return len(got)
