"""Labels, ballots and sources as they come, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of abstentions and of missing votes, and label sources by rank.
ABSTAINS = ("abstain", "none", "no code", "no_code", "nocode")
MISSING = ("", "nan", "null", "na", "n/a", "-")
SOURCES = ("adjudicated", "human_consensus", "llm_zero_shot", "probe_consensus", "gnn_consensus")


def whole_number(value: Column) -> Column:
    """The value as an int where it is a whole number, else null; NaN and text give null."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d) & (d == F.floor(d)) & (F.abs(d) < 2**31), d.cast("int"))


def stage_or_null(value: Column, stages: int) -> Column:
    """A label from 0 to ``stages`` - 1, else null."""
    n = whole_number(value)
    return F.when((n >= 0) & (n < stages), n)


def ballot(value: Column, stages: int) -> Column:
    """Any spelling of a vote: the label, -1 for abstentions, null for what is missing or unknown."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isNull() | text.isin(*MISSING), None).when(text.isin(*ABSTAINS) | (text == "-1"), -1).otherwise(stage_or_null(text, stages)).cast("int")


def source_of(source: Column) -> Column:
    """A known label source; unknown ones count as the machine's, null stays null."""
    return F.when(source.isNull(), None).when(source.isin(*SOURCES), source).otherwise("llm_zero_shot")


def known_flag(value: Column) -> Column:
    """Three-valued flag from 0, 1, text or null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "1.0", "true", "t", "yes"), True).when(text.isin("0", "0.0", "false", "f", "no"), False)


def is_therapist(speaker: Column) -> Column:
    return F.coalesce(F.lower(F.trim(speaker)).isin("therapist", "t", "interviewer"), F.lit(False))
