"""Sequences of labels: transitions, cue blocks and what lies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def direction(before: Column, after: Column) -> Column:
    """forward, backward or lateral."""
    return F.when(after > before, "forward").when(after < before, "backward").otherwise("lateral")


def with_next(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``next_<column>`` of the following row within ``keys``; the last row has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def transition_counts(labelled: DataFrame) -> DataFrame:
    """Counts of consecutive labels within participant and session: from_stage, to_stage, n."""
    pairs = with_next(labelled, ["participant_id", "session_id"], ["segment_index"], ["label"]).where("next_label is not null")
    return pairs.groupBy(F.col("label").alias("from_stage"), F.col("next_label").alias("to_stage")).agg(F.count("*").alias("n"))


def transition_matrix(labelled: DataFrame, stages: int) -> DataFrame:
    """All stages squared, zeros filled in, with the row's share."""
    grid = labelled.sparkSession.range(stages * stages).select((F.col("id") / stages).cast("int").alias("from_stage"), (F.col("id") % stages).cast("int").alias("to_stage"))
    counts = grid.join(transition_counts(labelled), ["from_stage", "to_stage"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("from_stage"))
    return counts.select("from_stage", "to_stage", "n", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6).alias("share"))


def session_progression(labelled: DataFrame) -> DataFrame:
    """Per participant and session: sequence, moves up, down and level, highest and dominant label.

    The dominant label is the most frequent one; of equal ones that which comes first.
    """
    keys = ["participant_id", "session_id", "session_number", "cohort_id"]
    rows = with_next(labelled, ["participant_id", "session_id"], ["segment_index"], ["label"])
    turn = direction(F.col("label"), F.col("next_label"))
    count = lambda d: F.sum(F.when(F.col("next_label").isNotNull() & (turn == d), 1).otherwise(0)).alias(d)
    base = rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "label"))), lambda x: x["label"]).alias("labels"),
        count("forward"), count("backward"), count("lateral"), F.max("label").alias("max_stage"),
        F.count("second_label").alias("dual_coded"), F.count("*").alias("n_segments"),
    )
    tally = labelled.groupBy(*keys[:2], "label").agg(F.count("*").alias("c"), F.min("segment_index").alias("at"))
    dominant = tally.groupBy(*keys[:2]).agg(F.min_by("label", F.struct(-F.col("c"), "at")).alias("dominant_stage"))
    out = base.join(dominant, keys[:2])
    return out.select(*keys, F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("sequence"), "forward", "backward", "lateral", "max_stage", "dominant_stage", "dual_coded", "n_segments")


def modal_label(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent label of each group, the smallest of equal ones."""
    counts = labelled.groupBy(*keys, "label").agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("dominant_stage"))


def cross_session_transitions(labelled: DataFrame) -> DataFrame:
    """Counts of changes of the modal label from a participant's session to the next one."""
    modal = modal_label(labelled, ["participant_id", "session_id", "cohort_id", "session_number"])
    pairs = with_next(modal, ["participant_id"], ["cohort_id", "session_number", "session_id"], ["dominant_stage"]).where("next_dominant_stage is not null")
    return pairs.groupBy(F.col("dominant_stage").alias("from_stage"), F.col("next_dominant_stage").alias("to_stage")).agg(F.count("*").alias("n"))


def regressions(labelled: DataFrame) -> DataFrame:
    """Falls of the modal label between a participant's sessions, by the later session's number."""
    modal = modal_label(labelled, ["participant_id", "session_id", "cohort_id", "session_number"])
    pairs = with_next(modal, ["participant_id"], ["cohort_id", "session_number", "session_id"], ["dominant_stage", "session_number"])
    falls = pairs.where("next_dominant_stage < dominant_stage")
    return falls.groupBy(F.col("next_session_number").alias("session_number"), F.col("dominant_stage").alias("from_stage"), F.col("next_dominant_stage").alias("to_stage")).agg(F.count("*").alias("n"), F.countDistinct("participant_id").alias("participants"))


def cue_blocks(segments: DataFrame, require_label: bool = True) -> DataFrame:
    """A block for each pair of consecutive participant segments of a session, with the therapist turns between.

    Turns overlap the gap strictly on both sides; where the first segment has no
    end time, turns between the two by place count. Unlabelled participant segments
    are dropped before pairing, and blocks without turns stay. Sessions are the
    join key, so the interval condition compares rows of one session only.
    """
    who = segments.where("speaker = 'participant'")
    if require_label:
        who = who.where("label is not null")
    pairs = with_next(who, ["session_id"], ["start_ms", "segment_index"], ["segment_id", "label", "start_ms", "segment_index", "confidence", "participant_id"]).where("next_segment_id is not null")
    blocks = pairs.select(
        "session_id", "cohort_id", "session_number", "participant_id", F.col("segment_id").alias("from_id"), F.col("next_segment_id").alias("to_id"), F.col("label").alias("from_stage"), F.col("next_label").alias("to_stage"),
        F.col("end_ms").alias("_end"), F.col("next_start_ms").alias("_start"), F.col("segment_index").alias("_from"), F.col("next_segment_index").alias("_to"), F.col("confidence").alias("from_confidence"), F.col("next_confidence").alias("to_confidence"),
    )
    turns = segments.where("speaker = 'therapist'").select(F.col("session_id").alias("_session"), F.col("start_ms").alias("_ts"), F.col("end_ms").alias("_te"), F.col("segment_index").alias("_ti"), F.col("segment_id").alias("_tid"), "move", F.col("text").alias("_text"))
    between = F.when(F.col("_end") > 0, (F.col("_ts") < F.col("_start")) & (F.col("_te") > F.col("_end"))).otherwise((F.col("_ti") > F.col("_from")) & (F.col("_ti") < F.col("_to")))
    joined = blocks.join(turns, (blocks["session_id"] == turns["_session"]) & between, "left")
    known, turn = F.col("_tid").isNotNull(), ["_ts", "_ti", "_tid", "move"]
    # Texts have a list of their own: queries that use none read and shuffle none.
    grouped = joined.groupBy(*[c for c in blocks.columns if c[0] != "_"]).agg(F.array_sort(F.collect_list(F.when(known, F.struct(*turn)))).alias("t"), F.array_sort(F.collect_list(F.when(known, F.struct(*turn, "_text")))).alias("texts"))
    return grouped.select(
        *[c for c in blocks.columns if c[0] != "_"], direction(F.col("from_stage"), F.col("to_stage")).alias("direction"),
        F.transform("t", lambda x: x["_tid"]).alias("turn_ids"), F.filter(F.transform("t", lambda x: x["move"]), lambda m: m.isNotNull()).alias("moves"),
        F.array_join(F.transform("texts", lambda x: x["_text"]), "\n").alias("cue_text"), F.size("t").alias("n_turns"), (F.size("t") == 0).alias("is_empty"),
    )


def dominant_move(moves: Column, n: int) -> Column:
    """Most frequent move of an array; of equal ones that which comes first. None for an empty one."""
    counted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: F.struct((-F.size(F.filter(moves, lambda x: x == m))).alias("c"), F.array_position(moves, m).alias("at"), m.alias("m")))
    return F.when(F.size(moves) > 0, F.array_min(F.filter(counted, lambda x: x["at"] > 0))["m"])


def block_influence(blocks: DataFrame, moves: int) -> DataFrame:
    """Share of the dominant moves for each pair of labels, blocks without moves apart."""
    rows = blocks.withColumn("move", dominant_move(F.col("moves"), moves))
    counts = rows.groupBy("from_stage", "to_stage", "move").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("from_stage", "to_stage"))
    return counts.select("from_stage", "to_stage", F.coalesce("move", F.lit(-1)).alias("move"), "n", F.round(F.col("n") / total, 6).alias("share"))


def move_lift(blocks: DataFrame, moves: int) -> DataFrame:
    """P(to_stage | dominant move) / P(to_stage) over blocks with moves."""
    rows = blocks.withColumn("move", dominant_move(F.col("moves"), moves)).where("move is not null")
    counts = rows.groupBy("move", "to_stage").agg(F.count("*").alias("n"))
    by_move, by_stage, all_ = (F.sum("n").over(Window.partitionBy(*k)) for k in (["move"], ["to_stage"], [F.lit(1)]))
    return counts.select("move", "to_stage", "n", F.round((F.col("n") / by_move) / (by_stage / all_), 6).alias("lift"))


def empty_cue_rate(blocks: DataFrame) -> DataFrame:
    """Blocks and share of empty ones for each pair of labels."""
    return blocks.groupBy("from_stage", "to_stage").agg(F.count("*").alias("blocks"), F.round(F.avg(F.col("is_empty").cast("double")), 6).alias("empty_rate"))


def delta_by_move(blocks: DataFrame, moves: int, least: int = 2) -> DataFrame:
    """Change of the label by first label and dominant move: count, mean, population deviation, directions."""
    delta = (F.col("to_stage") - F.col("from_stage")).cast("double")
    rows = blocks.withColumn("move", dominant_move(F.col("moves"), moves)).where("move is not null").withColumn("delta", delta)
    part = lambda d: F.sum((F.col("direction") == d).cast("int")).alias(f"n_{d}")
    return rows.groupBy("from_stage", "move").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.stddev_pop("delta"), 6).alias("sd_delta"), part("forward"), part("backward"), part("lateral")).where(F.col("n") >= least)


def transition_move_profile(blocks: DataFrame) -> DataFrame:
    """Sums of every move between two different labels."""
    moved = blocks.where("from_stage <> to_stage").select("from_stage", "to_stage", F.explode("moves").alias("move"))
    return moved.groupBy("from_stage", "to_stage", "move").agg(F.count("*").alias("n"))


def first_examples(labelled: DataFrame) -> DataFrame:
    """The first transition of each kind in every cohort and session number."""
    pairs = with_next(labelled, ["participant_id", "session_id"], ["segment_index"], ["label", "segment_id"]).where("next_label is not null")
    keys = ["cohort_id", "session_number", F.col("label").alias("from_stage"), F.col("next_label").alias("to_stage")]
    return pairs.groupBy(*keys).agg(F.min_by(F.struct("segment_id", "next_segment_id"), F.struct("session_id", "participant_id", "segment_index")).alias("x")).select("cohort_id", "session_number", "from_stage", "to_stage", F.col("x.segment_id").alias("from_id"), F.col("x.next_segment_id").alias("to_id"))


def advances(labelled: DataFrame) -> DataFrame:
    """Rises of the modal label between sessions, with the surest segment at the new label."""
    modal = modal_label(labelled, ["participant_id", "session_id", "cohort_id", "session_number"])
    pairs = with_next(modal, ["participant_id"], ["cohort_id", "session_number", "session_id"], ["dominant_stage", "session_id", "session_number"]).where("next_dominant_stage > dominant_stage")
    best = labelled.groupBy("session_id", "participant_id", F.col("label").alias("next_dominant_stage")).agg(F.min_by("segment_id", F.struct(-F.col("confidence"), "segment_index")).alias("quote_id"))
    joined = pairs.join(best.withColumnRenamed("session_id", "next_session_id"), ["participant_id", "next_session_id", "next_dominant_stage"])
    return joined.select("participant_id", F.col("next_session_number").alias("session_number"), F.col("dominant_stage").alias("from_stage"), F.col("next_dominant_stage").alias("to_stage"), "quote_id")


def therapist_islands(segments: DataFrame, gap_ms: int = 2500) -> DataFrame:
    """Runs of therapist turns without another speaker or a longer gap between them."""
    w = Window.partitionBy("session_id").orderBy("segment_index")
    rows = segments.withColumn("new", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")) | (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms), F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("new").cast("int")).over(w)).where("speaker = 'therapist'")
    return rows.groupBy("session_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("turns"), F.sum("word_count").alias("words"))


def speaker_numbers(segments: DataFrame) -> DataFrame:
    """Dense numbers of the speakers' roles within a session by first appearance."""
    first = segments.groupBy("session_id", "speaker").agg(F.min("segment_index").alias("first_index"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("session_id").orderBy("first_index")))


def nearest_turn(segments: DataFrame) -> DataFrame:
    """For each participant segment the therapist turn whose middle is nearest; the earlier of equal ones.

    An as-of lookup on both sides by running windows: no pairs are made.
    """
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    r = segments.where("speaker in ('participant', 'therapist')").select("session_id", "segment_id", "speaker", mid.alias("mid"))
    turn = F.when(F.col("speaker") == "therapist", F.struct("mid", F.col("segment_id").alias("id")))
    w = Window.partitionBy("session_id").orderBy("mid").rangeBetween
    before, after = F.last(turn, True).over(w(Window.unboundedPreceding, 0)), F.first(turn, True).over(w(0, Window.unboundedFollowing))
    r = r.withColumn("b", before).withColumn("a", after).where("speaker = 'participant' and (a is not null or b is not null)")
    near_b, near_a = F.col("mid") - F.col("b.mid"), F.col("a.mid") - F.col("mid")
    first = F.col("a").isNull() | (near_b <= near_a)
    return r.select("segment_id", F.when(F.coalesce(first, F.lit(False)), F.col("b.id")).otherwise(F.col("a.id")).alias("turn_id"), F.when(F.coalesce(first, F.lit(False)), near_b).otherwise(near_a).alias("distance_ms"))
