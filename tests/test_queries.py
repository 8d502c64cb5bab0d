import pytest

from tessera.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(name, spark, duck, sf, as_rows):
    assert as_rows(q.QUERIES[name](spark, sf).toPandas()) == as_rows(duck.sql(q.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["user", "other", "scene", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_mixed_case_is_kept_out_of_profiles(spark, sf):
    assert q.QUERIES["unique_guard"](spark, sf).filter("guard != 'ok'").isEmpty()
