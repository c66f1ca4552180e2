"""Comparison of small tables in tests."""


def rows(df, *columns):
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
