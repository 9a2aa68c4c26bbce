"""What a cue does to the position that follows it: changes, leverage, pools and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.transitions import dominant_move, modal_label

DEAD_BAND = 0.15
TIERS = ("high", "medium", "low")


def moved(delta: Column, dead_band: float = DEAD_BAND) -> Column:
    """advanced, regressed or stayed within the dead band."""
    return F.when(delta > dead_band, "advanced").when(delta < -dead_band, "regressed").otherwise("stayed")


def enriched(blocks: DataFrame, mixed: DataFrame, moves: int) -> DataFrame:
    """Blocks with the coordinates of both ends, their change, and the dominant move (null for empty cues)."""
    ends = mixed.select("segment_id", "coordinate", "entropy")
    f, t = ends.toDF("from_id", "from_coordinate", "from_entropy"), ends.toDF("to_id", "to_coordinate", "to_entropy")
    b = blocks.withColumn("move", dominant_move(F.col("moves"), moves)).join(f, "from_id").join(t, "to_id")
    b = b.withColumn("delta", F.round(F.col("to_coordinate") - F.col("from_coordinate"), 4))
    return b.withColumn("response", moved(F.col("delta")))


def leverage(rows: DataFrame, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Mean size of the change by how mixed the first end is."""
    bucket = F.when(F.col("from_entropy") < low, "low").when(F.col("from_entropy") < high, "mid").otherwise("high")
    return rows.groupBy(bucket.alias("entropy")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("delta")), 6).alias("mean_change"))


def into_stage(rows: DataFrame, stage: int = 1, least: int = 2) -> DataFrame:
    """Moves before an entry into ``stage``: count and mean change."""
    r = rows.where((F.col("to_stage") == stage) & (F.col("from_stage") != stage) & F.col("move").isNotNull())
    return r.groupBy("move").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta")).where(F.col("n") >= least)


def out_of_stage(rows: DataFrame, stage: int = 1) -> DataFrame:
    """How often each move leads out of ``stage`` upwards, downwards or not at all."""
    r = rows.where((F.col("from_stage") == stage) & F.col("move").isNotNull())
    on = lambda c: F.sum(c.cast("long"))
    return r.groupBy("move").agg(F.count("*").alias("n"), on(F.col("to_stage") > stage).alias("up"), on(F.col("to_stage") < stage).alias("down"), on(F.col("to_stage") == stage).alias("stays"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def response_table(rows: DataFrame, least: int = 2) -> DataFrame:
    """By first label and move: size, mean change, deviation, responses and entropy."""
    on = lambda v: F.sum((F.col("response") == v).cast("long")).alias(v)
    r = rows.where("move is not null").groupBy("from_stage", "move").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.stddev_pop("delta"), 6).alias("sd_delta"), on("advanced"), on("regressed"), on("stayed"), F.round(F.avg("from_entropy"), 6).alias("mean_entropy"))
    return r.where(F.col("n") >= least)


def weakest_tier(a: Column, b: Column) -> Column:
    """The lower of two confidence tiers."""
    order = F.array(*[F.lit(t) for t in TIERS])
    return F.get(order, F.greatest(F.array_position(order, a), F.array_position(order, b)).cast("int") - 1)


def examples(rows: DataFrame, folds: DataFrame, tier) -> DataFrame:
    """One row per block with a cue: text hash, move, change, response, weakest tier of both ends and fold."""
    e = rows.where("not is_empty").withColumn("cue_sha", F.sha2("cue_text", 256))
    e = e.withColumn("tier", weakest_tier(tier(F.col("from_confidence")), tier(F.col("to_confidence"))))
    return e.join(folds, "participant_id", "left").select("from_id", "to_id", "participant_id", "from_stage", "to_stage", "move", "delta", "response", "tier", "fold", "cue_sha", "cue_text")


def cue_pool(rows: DataFrame) -> DataFrame:
    """Every distinct cue: uses, most frequent move (the smallest of equal ones), share of advances."""
    e = rows.where("not is_empty").withColumn("cue_sha", F.sha2("cue_text", 256))
    by = e.groupBy("cue_sha", "move").agg(F.count("*").alias("c"), F.sum((F.col("response") == "advanced").cast("long")).alias("up"))
    best = F.min_by("move", F.when(F.col("move").isNotNull(), F.struct(-F.col("c"), "move")))
    return by.groupBy("cue_sha").agg(F.sum("c").alias("uses"), best.alias("move"), F.round(F.sum("up") / F.sum("c"), 6).alias("advanced"))


def tuning_view(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Instruction, input and output of the blocks that advanced."""
    name = F.array(*[F.lit(n) for n in names])
    r = rows.where("response = 'advanced' and not is_empty")
    return r.select("from_id", F.concat(F.lit("Respond to a speaker in "), F.get(name, F.col("from_stage")), F.lit(" so that "), F.get(name, F.col("to_stage")), F.lit(" can follow.")).alias("instruction"), F.col("cue_text").alias("output"))


def session_moves(segments: DataFrame) -> DataFrame:
    """Most frequent move between consecutive labelled participant segments of a session, whoever speaks.

    Pairs that do not leave a gap in time are skipped; gaps without a labelled move
    don't count. Counted by session number, labels and move.
    """
    who = segments.where("speaker = 'participant' and label is not null")
    w = Window.partitionBy("session_id").orderBy("start_ms", "segment_index")
    p = who.select("session_id", "session_number", "segment_id", F.col("label").alias("from_stage"), F.lead("label").over(w).alias("to_stage"), F.col("end_ms").alias("_e"), F.lead("start_ms").over(w).alias("_s")).where("_s > _e")
    t = segments.where("move is not null").select("session_id", F.col("start_ms").alias("_ts"), F.col("end_ms").alias("_te"), "move")
    j = p.join(t, "session_id").where("_ts < _s and _te > _e")
    best = modal_label(j.select("segment_id", F.col("move").alias("label")), ["segment_id"]).withColumnRenamed("dominant_stage", "move")
    return p.join(best, "segment_id").groupBy("session_number", "from_stage", "to_stage", "move").agg(F.count("*").alias("n"))


def external_links(slopes: DataFrame, outcomes: DataFrame, measures: list[str]) -> DataFrame:
    """Pearson r of slope, change and endpoint with every outcome over shared participants, three at least."""
    joined = slopes.join(outcomes, "participant_id")
    cells = F.array(*[F.struct(F.lit(p).alias("progress"), F.lit(m).alias("measure"), F.col(p).cast("double").alias("x"), F.col(m).cast("double").alias("y")) for p in ("slope", "change", "endpoint") for m in measures])
    c = joined.select(F.explode(cells).alias("c")).select("c.*").where("x is not null and y is not null")
    return c.groupBy("progress", "measure").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r")).where("n >= 3")


def arm_verdict(arms: DataFrame) -> DataFrame:
    """STABLE where all arms with a slope, two at least, share one sign that is not zero."""
    a = arms.where("slope is not null").agg(F.count("*").alias("arms"), F.sum((F.col("slope") > 0).cast("long")).alias("up"), F.sum((F.col("slope") < 0).cast("long")).alias("down"), F.round(F.min("slope"), 6).alias("lowest"), F.round(F.max("slope"), 6).alias("highest"))
    stable = (F.col("arms") >= 2) & ((F.col("up") == F.col("arms")) | (F.col("down") == F.col("arms")))
    return a.select("arms", "up", "lowest", "highest", F.when(stable, "STABLE").otherwise("MIXED").alias("verdict"))


def ranked(rows: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with ``name``: average rank of ``column``, ties sharing theirs."""
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    return rows.withColumn(name, F.rank().over(w.orderBy(column)) + (F.count("*").over(w.partitionBy(*(keys or []), column)) - 1) / 2)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho, sign agreement and size over a table of cells where both are known."""
    r = ranked(ranked(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return r.agg(F.count("*").alias("n"), F.round(F.corr("_ra", "_rb"), 6).alias("rho"), F.round(F.avg((F.signum(a) == F.signum(b)).cast("double")), 6).alias("same_sign"))


def top_blocks(rows: DataFrame, key: str, top: int = 3) -> DataFrame:
    """The blocks with the largest rise and the largest fall of each group."""
    up = Window.partitionBy(key).orderBy(F.desc("delta"), "from_id")
    down = Window.partitionBy(key).orderBy("delta", "from_id")
    r = rows.where(F.col(key).isNotNull()).withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    high = r.where((F.col("_u") <= top) & (F.col("delta") > 0)).select(key, F.lit("up").alias("side"), F.col("_u").alias("rank"), "from_id", "delta")
    return high.union(r.where((F.col("_d") <= top) & (F.col("delta") < 0)).select(key, F.lit("down"), "_d", "from_id", "delta"))
