"""Every engine query against its SQL, and the others for rows and a stable schema."""

import pytest
from conftest import SF
from oracle import compare

from gristmill import queries as q

ORACLE = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert compare(spark, SF, q.queries()[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(ORACLE)))
def test_rows(spark, name):
    assert q.queries()[name](spark, SF).count() > 0
