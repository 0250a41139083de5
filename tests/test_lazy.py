"""Nothing stays cached once a query has been built."""
import pytest

from delayspark import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mean_delay_by_hour", "processed_table", "correlation_matrix", "describe_target", "enrich",
                                  "fill_median", "category_codes"])
def test_no_persistent_data_is_left(spark, name):
    registry.load_all()
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before = set(kept())
    registry.QUERIES[name](spark, SF)
    assert set(kept()) <= before
