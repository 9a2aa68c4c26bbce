"""trend_classes against its SQL to the last bit: slopes half-way between two roundings, and zeros with their sign."""

import math
from hashlib import md5
from itertools import count

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusloom import catalog
from corpusloom.operators.aggregates import place_slope


def text_of(label: int) -> str:
    """A text whose digest gives ``label``."""
    return next(t for t in (f"t{i}" for i in count()) if ord(md5(t.encode()).hexdigest()[0]) % 6 == label)


def compared(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cur = con.execute(catalog.oracle_sql()["trend_classes"])
    names = [x[0] for x in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    df = catalog.queries()["trend_classes"](spark, folder)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, got)) == want
    return {r[0]: r[1] for r in got}


@pytest.mark.parametrize("middle, total, want", [([4, 3, 0], 45, 0.351563), ([1, 0, 0], 141, 1.101563)])
def test_slope_half_way_falls_as_in_sql(spark, tmp_path, middle, total, want):
    sessions = [[0] * 64, middle, [total // 64 + (i < total % 64) for i in range(64)]]
    rows = [(s, t, "user", text_of(label)) for s, labels in enumerate(sessions) for t, label in enumerate(labels)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows))))), tmp_path / "conversations.parquet")
    assert compared(spark, str(tmp_path)) == {"p0": want}


def test_zeros_have_the_sign_of_the_sql(spark):
    got = compared(spark, "/root/testdata/sf0.1")
    assert any(v == 0 and math.copysign(1, v) < 0 for v in got.values())


def test_place_slope_of_missing_values():
    assert place_slope([]) == place_slope([math.nan]) == 0.0
    assert math.isnan(place_slope([math.nan, 1.0]))
    assert place_slope([0.0, math.nan, 1.0]) == 0.5
