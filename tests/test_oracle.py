"""Every registered evidence query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import math

import pytest

from tracewell.registry import ORACLE_SQL, QUERIES


def table(columns, rows):
    def shown(x):
        return ("nan" if math.isnan(x) else f"{x:.9g}") if isinstance(x, float) else str(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in ORACLE_SQL:
        again = QUERIES[name](spark, small).collect()
        assert rows and sorted(map(str, again)) == sorted(map(str, rows))
        return
    got = duck.execute(ORACLE_SQL[name])
    assert table(df.columns, [tuple(r) for r in rows]) == table([d[0] for d in got.description], got.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
