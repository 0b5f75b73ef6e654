"""Compares tables as bags of rows."""

from collections import Counter


def _plain(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    return value


def bag(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    frame = frame.where(frame.notna(), None)
    return Counter(tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None))


def assert_same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    a, b = bag(left), bag(right)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
