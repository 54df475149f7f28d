"""Rows of a frame as plain tuples."""


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
