"""Slopes of participants with a single labelled session, against the queries' SQL."""

import math

import duckdb
import pytest

from corpusloom import catalog
from tests.parity import assert_same


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smoke-test conversations and one participant more, who has one session."""
    out = str(tmp_path_factory.mktemp("single"))
    source = "/root/testdata/sf0.001/conversations.parquet"
    duckdb.sql(f"COPY (SELECT * FROM '{source}' UNION ALL BY NAME SELECT conv_id + 4000 AS conv_id, * EXCLUDE (conv_id) FROM '{source}' WHERE conv_id = 0) TO '{out}/conversations.parquet'")
    return out


def check(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    df = catalog.queries()[name](spark, folder)
    assert_same(df, con, catalog.oracle_sql()[name])
    return df.where("participant_id = 'p1000'").first()


def test_typology_of_a_single_session(spark, folder):
    row = check(spark, folder, "trajectory_typology")
    assert math.isnan(row["slope"]) and row["kind"] == "climber"


def test_trend_of_a_single_session(spark, folder):
    row = check(spark, folder, "trend_classes")
    assert math.isnan(row["trend"]) and row["class"] == "advancing"
