import pytest

from quantloom.llm import registry
from tests.verify_oracles import compare, connect

ORACLE = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    said = compare(spark, connect(sf), name, QUERIES[name], ORACLE.get(name), sf)
    assert "MISMATCH" not in said, said
