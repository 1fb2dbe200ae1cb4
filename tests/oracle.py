"""Side-by-side runs of a query and its SQL."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def both(spark, db, query, sql, sf_dir):
    """(columns, rows) of Spark and of DuckDB, each with columns and rows sorted."""
    df = query(spark, sf_dir)
    got = sorted(df.columns), rows(df.columns, map(tuple, df.collect()))
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    return got, (sorted(names), rows(names, cursor.fetchall()))
