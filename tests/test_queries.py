import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import check

from rowsmith.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    check(spark, QUERIES, SQL, name)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
