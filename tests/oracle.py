"""Runs a query and its SQL over the same tables, for the tests of registered queries."""

from pathlib import Path

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def database(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def canonical(rows, columns, order):
    at = [columns.index(c) for c in order]
    out = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(df, connection, sql: str) -> int:
    """Names, kinds and rows agree; the number of rows."""
    cursor = connection.execute(sql)
    want, names = cursor.fetchall(), [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(df.columns) == sorted(names)
    assert all(KINDS.get(k, kinds[c]) == kinds[c] or k.startswith("timestamp") for c, k in df.dtypes), (df.dtypes, kinds)
    order = sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns, order) == canonical(want, names, order)
    return len(want)
