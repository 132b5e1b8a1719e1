"""Compares a query with its SQL, as rows without order."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


def database(sf_dir):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return db


def same(spark, query, sql, sf_dir):
    found = query(spark, sf_dir)
    wanted = database(sf_dir).sql(sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(wanted.columns, wanted.fetchall())
