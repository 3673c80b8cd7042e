"""Comparison of rows from Spark and DuckDB."""

DATA = "/root/testdata/sf0.001"


def plain(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(plain, v)) + "]"
    return str(v)


def same_rows(df, con, sql: str) -> None:
    """The DataFrame's rows are those of the SQL, columns by name, in any order."""
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
