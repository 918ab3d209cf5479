"""Shared by the tests."""

DATA = "/root/testdata/sf0.001"


def same_rows(df, relation):
    """Rows of a DataFrame and a DuckDB relation, by column name and without order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    key = lambda r: tuple(repr(round(x, 9) if isinstance(x, float) else x) for x in r)
    left = sorted(map(key, df.select(*columns).collect()))
    right = sorted(map(key, relation.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert left == right
