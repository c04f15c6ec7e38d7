import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import SCHEMA, rows  # noqa: E402


@pytest.fixture(scope="session")
def shared(spark):
    """The session of tests names a shared folder."""
    assert spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(scope="session")
def small_docs(spark, shared):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark, shared):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir(spark, small_docs, tmp_path_factory):
    """A table folder like the driver's, with extra columns whose names clash with outputs."""
    top = tmp_path_factory.mktemp("sf")
    small_docs.selectExpr("*", "1 AS size", "'x' AS taken", "2 AS h", "3 AS cell", "4 AS start").write.parquet(f"{top}/documents.parquet")
    labelled = [(r[0], int(r[0] % 7 != 0), int(r[0] % 5 == 0)) for r in rows()]
    spark.createDataFrame(labelled, "doc_id long, quality long, toxic long").write.parquet(f"{top}/labels.parquet")
    return str(top)
