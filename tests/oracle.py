"""Compare a registered query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())


def sql_rows(c, sql):
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
