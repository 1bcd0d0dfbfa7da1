"""Every sky query against its SQL, at the smallest scale."""

import pytest

from celestrum.plans import geometry, more, registry  # noqa: F401
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_no_cartesian_products(spark):
    for name in ("e4_pair_counts", "e5_l19_binned_pairs", "e8_e10_l20_k_nearest", "f3_difference", "e13_l18_g22_pixel_correlation"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["bin", "wtheta", "error"]
    assert set(e.oracle_sql()) <= set(e.queries())
