"""Every query that has an oracle text gives its rows; the others run."""

import pytest
from oracle import duck_rows, spark_rows

from sparkcol.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, data_dir, name):
    assert spark_rows(registry.queries()[name](spark, data_dir)) == duck_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, data_dir, name):
    assert registry.queries()[name](spark, data_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_set_operators_have_queries_over_whole_tables(spark, data_dir):
    lines, orders = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    found = {n: registry.queries()[f"set_{n}"](spark, data_dir).count() for n in ("union_all", "union", "intersect", "except", "except_all")}
    assert found["union_all"] == lines.count() + orders.count()
    assert 0 < found["intersect"] < found["union"] and 0 < found["except"] < found["except_all"] < lines.count()
    assert found["intersect"] + found["except"] == lines.select("l_partkey").distinct().count()
