"""Rows of a Spark query and of its SQL counterpart, by column name and without order."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(frame, relation):
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    left = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=str)
    right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    assert len(left) == len(right)
    assert [p for p in zip(left, right) if p[0] != p[1]][:3] == []
