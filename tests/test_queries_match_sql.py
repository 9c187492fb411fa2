"""Every registered query with SQL gives exactly the rows of the SQL; the others give rows."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
MODELS = [n for n in QUERIES if QUERIES[n].__module__.endswith("modelling")]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = oracle.connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    problems = oracle.compare(duck, ORACLE[name], QUERIES[name](spark, sf_dir))
    assert not problems, "\n".join(problems)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_is_the_feature_table(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "aqi_t1" in df.columns


def test_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
