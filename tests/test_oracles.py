"""Every query of the library on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import pytest
from compare import same
from conftest import SMALL

from scanforge.plans.library import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        same(spark, name, QUERIES, ORACLES, SMALL)
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
