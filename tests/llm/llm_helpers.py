"""Comparison of result rows."""


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
