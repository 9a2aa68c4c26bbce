"""Cue blocks carry the turns' texts only for those who read them."""

import pytest

from corpusloom import catalog
from corpusloom.operators import transitions as T
from corpusloom.sources.corpus import segments
from tests.parity import connection

SMOKE = "/root/testdata/sf0.001"


def planned(df) -> list[str]:
    """The lines of the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


@pytest.mark.parametrize("columns", [["moves"], ["turn_ids", "n_turns"], ["from_stage", "to_stage"]])
def test_blocks_without_texts_join_none(spark, columns):
    plan = planned(T.cue_blocks(segments(spark, SMOKE)).select(*columns))
    assert not [x for x in plan if "_text" in x]


def test_bootstrap_of_changes_joins_no_texts(spark):
    plan = planned(catalog.queries()["delta_bootstrap_by_stage_move"](spark, SMOKE))
    assert not [x for x in plan if "_text" in x]


def test_texts_are_those_of_the_turns_in_order(spark):
    blocks = T.cue_blocks(segments(spark, SMOKE)).select("turn_ids", "cue_text").collect()
    texts = dict(connection(SMOKE).execute("SELECT 'c' || conv_id || '_t' || turn, coalesce(text, '') FROM conversations").fetchall())
    assert any(len(b["turn_ids"]) > 1 for b in blocks)
    for b in blocks:
        assert b["cue_text"] == "\n".join(texts[i] for i in b["turn_ids"])
