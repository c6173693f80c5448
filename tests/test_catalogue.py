"""Every query with SQL gives the SQL's rows."""

import pytest
from helpers import SF, rows_of

from quillmere.plans.oracles import ORACLES
from quillmere.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    cols, got = rows_of(QUERIES[name](spark, SF))
    r = duck.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(round(x[i], 6) if isinstance(x[i], float) else x[i] for i in at) for x in r.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
