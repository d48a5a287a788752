import pytest

from pagemill.plans import details  # noqa: F401
from pagemill.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLE_SQL:
        compare(spark, sf, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, sf).count() > 0
