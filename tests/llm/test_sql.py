"""The SQL of the queries on small fixtures with edge rows, against the operators."""

import duckdb
import pandas as pd
import pytest

from corpusloom.llm import neardup, queries, secrets
from tests.llm.test_neardup import corpus
from tests.llm.test_secrets import TEXTS
from tests.parity import assert_same, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    assert_same(queries.queries()[name](spark, FOLDER), con, queries.oracle_sql()[name])


def with_documents(texts):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.Series(range(len(texts)), dtype="int64"), "text": pd.Series(texts, dtype="object")}))
    return con


def test_secret_scan_sql_on_edge_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert_same(secrets.report(docs), with_documents(TEXTS), queries.oracle_sql()["op3_secret_scan"])


def test_near_duplicate_sql_on_random_copies(spark):
    texts = [t for _, t in corpus(5)] + ["", None, "one two", "One\ttwo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert_same(neardup.near_duplicates(docs), with_documents(texts), queries.oracle_sql()["op5_minhash_neardup"])
