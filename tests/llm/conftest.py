import pytest
from llm_cases import AWKWARD


@pytest.fixture
def small_batches(spark):
    """Arrow batches of a few rows, so that operators meet batch borders."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that operators use inside.
    return rows.withColumns({c: F.lit(7) for c in ("rid", "doc", "h", "_text", "_words", "item_id", "fp", "start", "grams")}).repartition(3)


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.limit(0)
