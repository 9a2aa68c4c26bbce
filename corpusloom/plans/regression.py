"""Registered queries on ordinal and mixed models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import regression as R
from corpusloom.plans.inference import _blocks
from corpusloom.sources.corpus import labelled


def _moved(spark, sf_dir):
    return _blocks(spark, sf_dir).where("move is not null and to_stage is not null")


@register("ordinal_move_model")
def ordinal_move_model(spark, sf_dir):
    """Cuts and coefficients of the next label on the label before and the move."""
    return R.ordered_logit(_moved(spark, sf_dir), "to_stage", [("from_stage",), ("move",)])


@register("ordinal_interaction_test")
def ordinal_interaction_test(spark, sf_dir):
    """Whether the move's effect on the next label depends on the label before."""
    return R.ordinal_interaction_test(_moved(spark, sf_dir), "to_stage", "from_stage", "move")


@register("mixed_label_trend")
def mixed_label_trend(spark, sf_dir):
    """Slope of the participants' session means with random intercepts and slopes."""
    per = labelled(spark, sf_dir).groupBy("participant_id", "session_number").agg(F.avg("label").alias("mean_label"))
    return R.mixed_trend(per, "mean_label", "session_number", "participant_id")


@register("mixed_move_effects")
def mixed_move_effects(spark, sf_dir):
    """Effects of the moves on the change, with random intercepts of participants."""
    return R.mixed_terms(_moved(spark, sf_dir), "delta", "participant_id", [("move",)])


@register("mixed_move_interaction")
def mixed_move_interaction(spark, sf_dir):
    """How many contrasts of stage and move have an interval without zero."""
    return R.mixed_interaction(_moved(spark, sf_dir), "delta", "from_stage", "move", "participant_id")
