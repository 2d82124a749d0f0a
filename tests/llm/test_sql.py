"""Queries that SQL can express."""

import pytest

from lodestone.llm.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
