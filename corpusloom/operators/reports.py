"""Tables behind the reports: sessions, themes, codes, participants and comparisons of raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_shares(labelled: DataFrame, stages: int) -> DataFrame:
    """Per session the unweighted mean of its participants' label shares."""
    per = labelled.groupBy("session_id", "participant_id").agg(*[F.round(F.avg((F.col("label") == k).cast("double")), 4).alias(f"s{k}") for k in range(stages)])
    return per.groupBy("session_id").agg(F.count("*").alias("participants"), *[F.round(F.avg(f"s{k}"), 6).alias(f"share_{k}") for k in range(stages)])


def theme_report(labelled: DataFrame) -> DataFrame:
    """Prevalence of every label overall and by cohort, session number and participant, as rows."""
    cells = F.array(*[F.struct(F.lit(k).alias("by"), F.coalesce(c.cast("string"), F.lit("")).alias("value")) for k, c in (("all", F.lit("")), ("cohort", F.col("cohort_id")), ("session", F.col("session_number")), ("participant", F.col("participant_id")))])
    r = labelled.select("label", F.explode(cells).alias("c")).select("label", "c.by", "c.value")
    counts = r.groupBy("label", "by", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("by", "value"))
    return counts.select("label", "by", "value", "n", F.round(F.col("n") / total, 6).alias("prevalence"))


def theme_codes(labelled: DataFrame, by_count: int = 6, by_lift: int = 3) -> DataFrame:
    """Of each label's most frequent codes those with the highest lift."""
    held = labelled.select("segment_id", "label", F.explode(F.array_distinct("codes")).alias("code"))
    joint = held.groupBy("label", "code").agg(F.count("*").alias("n"))
    first = joint.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "code"))).where(F.col("_r") <= by_count)
    codes, labels = held.groupBy("code").agg(F.count("*").alias("nc")), labelled.groupBy("label").agg(F.count("*").alias("nl"))
    total = labelled.agg(F.count("*").alias("na"))
    lift = F.round(F.coalesce(F.try_divide(F.col("n") / F.col("nl"), F.col("nc") / F.col("na")), F.lit(0.0)), 6)
    r = first.join(codes, "code").join(labels, "label").crossJoin(F.broadcast(total)).withColumn("lift", lift)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("lift"), "code"))).where(F.col("rank") <= by_lift).select("label", "code", "n", "lift", "rank")


def code_report(rows: DataFrame) -> DataFrame:
    """Every code's segments, share, sessions, participants and mean confidence."""
    total = rows.agg(F.count("*").alias("n_all"))
    held = rows.select("session_id", "participant_id", "confidence", F.explode(F.array_distinct("codes")).alias("code"))
    out = held.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("participant_id").alias("participants"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return out.crossJoin(F.broadcast(total)).select("code", "n", F.round(F.col("n") / F.col("n_all"), 3).alias("prevalence"), "sessions", "participants", "mean_confidence")


def participant_report(mixed: DataFrame) -> DataFrame:
    """Per participant and session number: modal label, progression, volatility, coordinate, entropy and confidence."""
    keys = ["participant_id", "session_number"]
    tally = mixed.groupBy(*keys, "label").agg(F.count("*").alias("c"))
    modal = tally.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("modal"))
    out = mixed.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("label"), 8).alias("progression"), F.round(F.stddev_pop("label"), 8).alias("volatility"), F.round(F.avg("coordinate"), 8).alias("coordinate"), F.round(F.avg("entropy"), 8).alias("entropy"), F.round(F.avg("confidence"), 8).alias("confidence"))
    return out.join(modal, keys)


def secondary_map(labelled: DataFrame) -> DataFrame:
    """Counts of each first and second label by session."""
    return labelled.where("second_label is not null").groupBy("session_id", "label", "second_label").agg(F.count("*").alias("n"))


def compare_lifts(a: DataFrame, b: DataFrame, high: float = 1.2) -> DataFrame:
    """Full outer join of two lift tables (label, code, lift), zeros filled in; ``both`` where both are high."""
    j = a.select("label", "code", F.col("lift").alias("lift_a")).join(b.select("label", "code", F.col("lift").alias("lift_b")), ["label", "code"], "full")
    j = j.select("label", "code", F.coalesce("lift_a", F.lit(0.0)).alias("lift_a"), F.coalesce("lift_b", F.lit(0.0)).alias("lift_b"))
    return j.withColumn("both", (F.col("lift_a") >= high) & (F.col("lift_b") >= high))


def reconcile(a: DataFrame, b: DataFrame, policy: str = "prefer_first") -> DataFrame:
    """Two code sets (segment_id, code, confidence) side by side: agreed, first only or second only, and what is kept.

    require_agreement keeps agreed codes, prefer_first the first set's, union all of them.
    """
    j = a.select("segment_id", "code", F.col("confidence").alias("ca")).join(b.select("segment_id", "code", F.col("confidence").alias("cb")), ["segment_id", "code"], "full")
    state = F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), "agreed").when(F.col("ca").isNotNull(), "first").otherwise("second")
    j = j.withColumn("state", state)
    kept = {"require_agreement": F.col("state") == "agreed", "prefer_first": F.col("state") != "second", "union": F.lit(True)}[policy]
    return j.select("segment_id", "code", "state", kept.alias("kept"), F.greatest("ca", "cb").alias("confidence"))


def convergent_pairs(lifts: DataFrame, expected: list[tuple[int, str]], least: float = 1.0) -> DataFrame:
    """How many of the expected pairs of label and code are lifted."""
    want = lifts.sparkSession.createDataFrame(expected, "label int, code string")
    j = F.broadcast(want).join(lifts.select("label", "code", "lift"), ["label", "code"], "left")
    return j.agg(F.count("*").alias("expected"), F.sum((F.coalesce("lift", F.lit(0.0)) >= least).cast("long")).alias("convergent"))


def class_scores(rows: DataFrame, truth: str, predicted: str, stages: int) -> DataFrame:
    """Each label's support, recall, precision and kappa of label against rest; labels that never occur stay in."""
    r = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(stages).select(F.col("id").cast("int").alias("label"))
    on = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    j = F.broadcast(spine).crossJoin(r)
    s = j.groupBy("label").agg(on((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("hit"), on(F.col("t") == F.col("label")).alias("support"), on(F.col("p") == F.col("label")).alias("said"), F.sum("n").alias("all"))
    part = lambda d: F.round(F.when(F.col(d) > 0, F.col("hit") / F.col(d)).otherwise(0.0), 6)
    po = (F.col("all") - F.col("support") - F.col("said") + 2 * F.col("hit")) / F.col("all")
    pe = (F.col("support") * F.col("said") + (F.col("all") - F.col("support")) * (F.col("all") - F.col("said"))) / (F.col("all") * F.col("all"))
    return s.select("label", "support", part("support").alias("recall"), part("said").alias("precision"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"))


def readiness(kappa: DataFrame, scores: DataFrame, target: float = 0.7, rare: tuple[int, ...] = (3, 4), recall: float = 0.5, support: int = 5) -> DataFrame:
    """Whether kappa meets its target and every rare label with enough support is recalled."""
    weak = scores.where(F.col("label").isin(*rare) & (F.col("support") >= support) & (F.col("recall") < recall)).agg(F.count("*").alias("weak"))
    return kappa.select("n", "kappa").crossJoin(F.broadcast(weak)).select("n", "kappa", "weak", F.coalesce((F.col("kappa") >= target) & (F.col("weak") == 0), F.lit(False)).alias("ready"))


def pass_rates(rows: DataFrame, keys: list[str], expected: str = "expected") -> DataFrame:
    """Share of items whose first or second label is the expected one."""
    ok = (F.col("label") == F.col(expected)) | F.coalesce(F.col("second_label") == F.col(expected), F.lit(False))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("double")), 6).alias("passed"))


def session_examples(labelled: DataFrame) -> DataFrame:
    """Between a participant's sessions: both modal labels, the gap in session numbers, and the surest segment on both sides."""
    keys = ["participant_id", "session_id", "cohort_id", "session_number"]
    tally = labelled.groupBy(*keys, "label").agg(F.count("*").alias("c"), F.min_by("segment_id", F.struct(-F.col("confidence"), "segment_index")).alias("best"))
    modal = tally.groupBy(*keys).agg(F.min_by(F.struct("label", "best"), F.struct(-F.col("c"), "label")).alias("m")).select(*keys, F.col("m.label").alias("stage"), "m.best")
    w = Window.partitionBy("participant_id").orderBy("cohort_id", "session_number", "session_id")
    nxt = modal.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("stage", "best", "session_number")]).where("n_stage is not null and n_stage <> stage")
    return nxt.select("participant_id", "session_number", F.col("stage").alias("from_stage"), F.col("n_stage").alias("to_stage"), F.col("best").alias("from_id"), F.col("n_best").alias("to_id"), (F.col("n_session_number") - F.col("session_number")).alias("gap"))
