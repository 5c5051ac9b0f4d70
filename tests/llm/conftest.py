import os

import pytest

BASE = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    """The words of the contracts: runs without ASCII white space."""
    return (text or "").encode().split()


@pytest.fixture
def docs(spark):
    """A factory of documents from (doc_id, text, source) rows, with extra columns that clash."""
    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], BASE)
        from pyspark.sql import functions as F
        for name in extra:
            df = df.withColumn(name, F.lit(f"own {name}"))
        return df
    return make


@pytest.fixture(scope="session")
def sf(spark):
    from tessera.llm.common import prepare
    prepare(spark)
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(sf):
    """doc_id -> text of the smallest test table."""
    import duckdb
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM read_parquet('{os.path.join(sf, 'documents.parquet')}')").fetchall()
    return {i: (t, s) for i, t, s in rows}


ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (None, "one two three", "b"), (4, "one two three", "b"),
       (5, "é ñ 漢字 \U0001f600 x", None), (6, "one two three", "b"), (6, "one two three", "b"), (7, "w " * 30000, "a")]
