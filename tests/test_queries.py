import pytest

from annalist.plans import answers, composed, data_changes, monitoring, ranking, rules, workflow
from oracle import database, same

MODULES = (data_changes, rules, ranking, answers, monitoring, workflow, composed)
WITH_SQL = [(n, f, m.SQL[n]) for m in MODULES for n, f in m.QUERIES.items() if n in m.SQL]
WITHOUT = [(n, f) for m in MODULES for n, f in m.QUERIES.items() if n not in m.SQL]


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name,query,sql", WITH_SQL, ids=[x[0] for x in WITH_SQL])
def test_query_equals_sql(spark, data, db, name, query, sql):
    same(query(spark, data), db, sql)


@pytest.mark.parametrize("name,query", WITHOUT, ids=[x[0] for x in WITHOUT])
def test_query_runs_twice_alike(spark, data, name, query):
    a, b = query(spark, data), query(spark, data)
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
