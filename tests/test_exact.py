"""Every query with a SQL counterpart, on the smallest tables."""

import os

import pytest

from checks.compare import differences, duck
from checks.registry import oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


# Each trains detectors at full size for minutes; ``python -m checks.compare`` runs them, with TEST_ALL=1 so does this file.
SLOW = {"m5_planted_rule", "m7_planted_rule", "m10_folds_hold_every_row", "s10_round_trip", "q2_offline_store", "q3_online_store"}


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if os.environ.get("TEST_ALL") or n not in SLOW))
def test_matches_sql(spark, sf_dir, con, name):
    got = queries()[name](spark, sf_dir).toPandas()
    assert differences(got, con.execute(oracle_sql()[name]).df()) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
