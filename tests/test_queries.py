import pytest

from skein.plans import registry
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def sf():
    """Large enough for roundings and ties that 6,000 rows do not show."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert_same(registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLE_SQL[name]))


def test_sketches_stay_within_their_error(spark, sf, duck):
    exact = {f: (n, m) for f, n, m in duck.sql("select l_returnflag, count(distinct l_partkey), median(l_extendedprice) from lineitem group by 1").fetchall()}
    for r in registry.QUERIES["agg5_sketches"](spark, sf).collect():
        parts, median = exact[r["l_returnflag"]]
        for k in ("approx_parts", "hll_parts", "theta_parts"):
            assert abs(r[k] - parts) <= 0.1 * parts + 1
        for k in ("approx_median", "kll_median"):
            assert abs(r[k] - median) <= 0.05 * median


def test_sample_is_a_subset_of_about_the_fraction(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = registry.QUERIES["scan4_sample"](spark, sf)
    assert part.subtract(rows).count() == 0
    assert 0.05 * rows.count() < part.count() < 0.15 * rows.count()


def test_the_entry_works_without_optional_parts(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
