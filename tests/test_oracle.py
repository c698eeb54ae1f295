"""Every registered query against its DuckDB oracle, on the smallest tables."""

import os

import pytest

from riverlens.plans import registry

from . import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Model fits; the other rows-only queries take little time.
SLOW = {"m4_train_pixel_classifier", "m5_loyo_oof", "m6_hindcast", "m7_ablation_runs", "m8_permutation_importance", "m10_score_live"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL)))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_rows_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).collect()
