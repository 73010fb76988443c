import pytest

from tickloom.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, sf, compare, name):
    compare(QUERIES[name](spark, sf), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01" if name == "walk_forward" else sf).collect()  # its windows need more bars


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["symbol", "ts", "close", "sma", "volume"] and got.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
