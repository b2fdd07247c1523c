"""Rows of Spark and DuckDB results in a form that can be compared."""


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, text):
    cur = con.execute(text)
    names = [x[0] for x in cur.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
