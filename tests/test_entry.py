import os

import __spark_entry__ as entry
import pytest


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(sum(r.share for r in rows) - 1) < 1e-4 and all(r.low <= r.share <= r.high for r in rows)
