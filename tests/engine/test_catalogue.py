"""Every query against its SQL; those without SQL for rows and a stable schema."""

import pytest

from lodestone.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], oracles.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns and df.schema == queries.QUERIES[name](spark, sf_dir).schema
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLE_SQL) <= set(queries.QUERIES)
