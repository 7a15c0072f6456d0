"""Rows of a Spark query against rows of DuckDB SQL over the same files."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


def rows(dicts, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in dicts)


def assert_same(df, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.sql(sql).to_arrow_table(), df.toArrow()
    columns = sorted(df.columns)
    assert columns == sorted(want.column_names)
    assert rows(got.to_pylist(), columns) == rows(want.to_pylist(), columns)
