import pytest

from graphonic import catalogue

from .duck import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_gives_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "ipa", "n_words", "coverage", "confidence"] and df.count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
