"""Comparison of a Spark result with a DuckDB relation: columns by name, rows in any order."""

from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(con, folder):
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return tuple(v) if isinstance(v, list) else v


def compared(df, relation):
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs
