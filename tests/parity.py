"""Compare a registered query with its DuckDB text on one folder of tables."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """None if equal, else a text saying what differs."""
    cur = con.execute(sql)
    duck_names = [d[0] for d in cur.description]
    duck_rows = rows_of(duck_names, cur.fetchall())
    names = spark_df.columns
    if sorted(names) != sorted(duck_names):
        return f"columns {sorted(names)} vs {sorted(duck_names)}"
    got = rows_of(names, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(duck_rows):
        return f"{len(got)} rows vs {len(duck_rows)}"
    for a, b in zip(got, duck_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference {sorted(names)}\n   spark {a}\n   duck  {b}"
    return None
