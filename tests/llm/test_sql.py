import pytest

from tablecare.llm import queries

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), sf, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_document_or_query_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
