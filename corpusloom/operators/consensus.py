"""Ballots, consensus, provenance, mixtures and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABSTAIN = -1
SECOND_WEIGHT, ACTIVE, LIMINAL_ENTROPY, LIMINAL_GAP = 0.5, 0.15, 0.6, 0.25


def cast_ballots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cast``: labels with ABSTAIN for abstentions; errors are left out."""
    vote = F.transform(F.arrays_zip("ballots", "abstains"), lambda x: F.when(x["ballots"].isNotNull(), x["ballots"]).when(x["abstains"], F.lit(ABSTAIN)))
    return rows.withColumn("cast", F.filter(vote, lambda v: v.isNotNull())).withColumn("n_raters", F.size("ballots"))


def vote(rows: DataFrame) -> DataFrame:
    """Strict-majority consensus of every row: winner, n_agree, n_ballots, level, tied.

    A label (or abstention) wins with more than half of all raters, failed ones
    included. unanimous needs every rater; split has ballots without a winner.
    """
    r = cast_ballots(rows)
    # counts by label, the smallest label first among equal ones
    tally = F.transform(F.array_sort(F.array_distinct("cast")), lambda v: F.struct((-F.size(F.filter("cast", lambda x: x == v))).alias("c"), v.alias("v")))
    r = r.withColumn("tally", F.array_sort(tally)).withColumn("best", F.when(F.size("tally") > 0, F.element_at("tally", 1)))
    n_agree = F.coalesce(-F.col("best.c"), F.lit(0))
    won = n_agree * 2 > F.col("n_raters")
    tied = (F.size("tally") > 1) & (F.coalesce(F.get("tally", F.lit(1))["c"], F.lit(0)) == F.col("best.c"))
    level = F.when(F.size("cast") == 0, "none").when(~won, "split").when(n_agree == F.col("n_raters"), "unanimous").otherwise("majority")
    return r.select(*rows.columns, F.when(won, F.col("best.v")).alias("winner"), n_agree.alias("n_agree"), F.size("cast").alias("n_ballots"), level.alias("level"), F.coalesce(tied, F.lit(False)).alias("tied"))


def agreement_levels(rows: DataFrame) -> DataFrame:
    """How many rows reached each level of agreement."""
    return vote(rows).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg(F.col("n_agree").cast("double")), 6).alias("mean_agree"))


def provenance(rows: DataFrame) -> DataFrame:
    """Final label with its source and confidence tier.

    A human label counts where it equals the machine's; else the consensus label
    stands. The tier asks for three agreeing raters for high, two for medium.
    """
    v = vote(rows).withColumn("machine", F.when(F.col("winner") >= 0, F.col("winner")))
    source = F.when(F.col("human_label").isNotNull() & (F.col("human_label") == F.col("machine")), "human_consensus").when(F.col("machine").isNotNull(), "machine")
    high = (F.col("n_agree") == 3) & (F.col("confidence") > 0.8)
    tier = F.when(high, "high").when((F.col("n_agree") >= 2) & (F.col("confidence") > 0.6), "medium").otherwise("low")
    return v.select("segment_id", F.col("machine").alias("final_label"), source.alias("source"), F.when(source.isNotNull(), tier).alias("tier"))


def percent_agreement(rows: DataFrame) -> DataFrame:
    """Over rows with two or more ballots: share unanimous and mean share of agreeing pairs."""
    r = cast_ballots(rows).where(F.size("cast") >= 2)
    same = F.aggregate(F.transform(F.array_distinct("cast"), lambda v: F.size(F.filter("cast", lambda x: x == v))), F.lit(0), lambda a, c: a + c * (c - 1))
    n = F.size("cast")
    return r.agg(F.count("*").alias("units"), F.round(F.avg((F.size(F.array_distinct("cast")) == 1).cast("double")), 6).alias("unanimous"), F.round(F.avg(same / (n * (n - 1))), 6).alias("pairwise"))


def _unit_counts(rows: DataFrame, least: int) -> DataFrame:
    return cast_ballots(rows).where(F.size("cast") >= least).select("segment_id", F.explode("cast").alias("label")).groupBy("segment_id", "label").agg(F.count("*").alias("c"))


def fleiss_kappa(rows: DataFrame, complete: bool = False) -> DataFrame:
    """Fleiss kappa for unequal numbers of ballots; ``complete`` takes fully rated rows only."""
    r = cast_ballots(rows)
    r = r.where(F.size("cast") == F.col("n_raters")) if complete else r.where(F.size("cast") >= 2)
    counts = r.select("segment_id", F.explode("cast").alias("label")).groupBy("segment_id", "label").agg(F.count("*").alias("c"))
    unit = counts.groupBy("segment_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    observed = unit.agg(F.count("*").alias("units"), F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("po"))
    every = Window.partitionBy(F.lit(1))
    share = counts.groupBy("label").agg(F.sum("c").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(every)).agg(F.sum(F.col("p") * F.col("p")).alias("pe"))
    kappa = F.when(F.col("pe") >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return observed.crossJoin(share).select("units", F.round("po", 6).alias("observed"), F.round("pe", 6).alias("expected"), F.round(F.when(F.col("units") >= 2, kappa), 6).alias("kappa"))


def krippendorff_alpha(rows: DataFrame) -> DataFrame:
    """Nominal alpha from the coincidences of rows with two or more ballots."""
    counts = _unit_counts(rows, 2)
    unit = Window.partitionBy("segment_id")
    c = counts.withColumn("n", F.sum("c").over(unit))
    agree = c.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("n") - 1)).alias("same"), F.sum("c").alias("total"))
    marginal = counts.groupBy("label").agg(F.sum("c").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("by_chance"))
    observed = 1 - F.col("same") / F.col("total")
    expected = 1 - F.col("by_chance") / (F.col("total") * (F.col("total") - 1))
    return agree.crossJoin(marginal).select(F.col("total").alias("ballots"), F.round(F.when(expected == 0, 1.0).otherwise(1 - observed / expected), 6).alias("alpha"))


def krippendorff_alpha_scaled(rows: DataFrame, level: str) -> DataFrame:
    """Ordinal or interval alpha from rows with two or more ballots on the scale; abstentions have no place on it.

    An ordinal label stands at the middle of its ballots in the ranking of all. Both
    levels then weigh two ballots by the squared distance of numbers, so sums by row
    take the place of pairs. The scale's labels are few and are ranked in one task.
    """
    if level not in ("ordinal", "interval"):
        raise ValueError(f"no such level: {level}")
    c = _unit_counts(rows, 2).where(F.col("label") != ABSTAIN).withColumn("n", F.sum("c").over(Window.partitionBy("segment_id"))).where("n >= 2")
    middle = F.sum("m").over(Window.partitionBy(F.lit(1)).orderBy("label")) - F.col("m") / 2
    scale = c.groupBy("label").agg(F.sum("c").alias("m")).select("label", (middle if level == "ordinal" else F.col("label").cast("double")).alias("x"))
    cx = F.col("c") * F.col("x")
    unit = c.join(scale, "label").groupBy("segment_id").agg(F.sum("c").alias("n"), F.sum(cx).alias("s"), F.sum(cx * F.col("x")).alias("q"))
    t = unit.agg(F.sum("n").alias("ballots"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1)).alias("apart"))
    expected = (F.col("ballots") * F.col("q") - F.col("s") * F.col("s")) / (F.col("ballots") - 1)
    return t.select("ballots", F.round(F.when(expected == 0, 1.0).otherwise(1 - F.col("apart") / expected), 6).alias("alpha"))


def null_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and share of missing values of each column, from one pass."""
    one = rows.agg(F.count("*").alias("_n"), *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    parts = [F.struct(F.lit(c).alias("kind"), F.col("_n").alias("n"), F.round(F.col(c), 6).alias("share")) for c in columns]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def cohen_kappa(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Kappa, agreement and size over rows where both labels are known, by group."""
    keys = keys or []
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    base = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    size = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    share = lambda c, name: r.groupBy(*keys, F.col(c).alias("v")).agg(F.count("*").alias("c")).withColumn(name, F.col("c") / F.sum("c").over(size)).drop("c")
    both = share(a, "pa").join(share(b, "pb"), [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("pa") * F.col("pb")).alias("pe"))
    joined = base.join(both, keys, "left") if keys else base.crossJoin(both)
    pe = F.coalesce("pe", F.lit(0.0))
    kappa = F.when(pe >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / (1 - pe))
    return joined.select(*keys, "n", F.round("po", 6).alias("agreement"), F.round(F.when(F.col("n") >= 2, kappa), 6).alias("kappa"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each pair of true and predicted label."""
    return rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def precision_recall(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support, precision and recall of each label, 0 where undefined."""
    c = confusion(rows, truth, predicted)
    sides = c.select(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).union(c.select("predicted", F.lit(0), "n", F.lit(0)))
    s = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum("hit").alias("hit"))
    part = lambda d: F.round(F.when(F.col(d) > 0, F.col("hit") / F.col(d)).otherwise(0.0), 6)
    return s.select("label", "support", part("said").alias("precision"), part("support").alias("recall"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, the first one closed at zero."""
    b = F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece"))


def label_mixture(label: Column, second: Column, confidence: Column, stages: int) -> Column:
    """Shares of the labels: the first with its confidence, the second with half of it; uniform for none."""
    mass = [F.when(label == k, F.greatest(confidence, F.lit(0.01))).otherwise(0.0) + F.when(second == k, SECOND_WEIGHT * F.greatest(confidence, F.lit(0.01))).otherwise(0.0) for k in range(stages)]
    mass = [F.coalesce(m, F.lit(0.0)) for m in mass]
    total = sum(mass[1:], mass[0])
    return F.array(*[F.when(total > 0, m / total).otherwise(1.0 / stages) for m in mass])


def superposition(rows: DataFrame, stages: int) -> DataFrame:
    """``rows`` with mixture, coordinate, entropy, max_stage, second_stage, n_active, liminal.

    Of equal shares the higher label comes first.
    """
    m = label_mixture(F.col("label"), F.coalesce("second_label", F.lit(-1)), F.col("confidence"), stages)
    r = rows.withColumn("mixture", F.transform(m, lambda x: F.round(x, 4)))
    ranked = F.sort_array(F.transform("mixture", lambda p, k: F.struct(p.alias("p"), k.alias("k"))), asc=False)
    r = r.withColumn("ranked", ranked)
    entropy = -F.aggregate("mixture", F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0)) / F.log(F.lit(float(stages)))
    coordinate = F.aggregate(F.transform("mixture", lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)
    gap = F.get("ranked", F.lit(0))["p"] - F.get("ranked", F.lit(1))["p"]
    r = r.withColumn("entropy", F.round(entropy, 4)).withColumn("coordinate", F.round(coordinate, 4))
    r = r.withColumn("max_stage", F.get("ranked", F.lit(0))["k"]).withColumn("second_stage", F.get("ranked", F.lit(1))["k"])
    r = r.withColumn("n_active", F.size(F.filter("mixture", lambda p: p >= ACTIVE)))
    return r.withColumn("liminal", (F.col("entropy") >= LIMINAL_ENTROPY) | (F.round(gap, 4) < LIMINAL_GAP)).drop("ranked")


def rater_labels(rows: DataFrame) -> DataFrame:
    """One row per rater and segment with a ballot; abstentions are the label ``ABSTAIN``."""
    z = rows.select("segment_id", F.posexplode(F.arrays_zip("ballots", "abstains")).alias("rater", "x"))
    v = F.when(F.col("x.ballots").isNotNull(), F.col("x.ballots")).when(F.col("x.abstains"), F.lit(ABSTAIN))
    return z.select("segment_id", "rater", v.alias("label")).where("label is not null")


def rater_pairs(rows: DataFrame) -> DataFrame:
    """Kappa of each pair of raters over the segments that both judged."""
    r = rater_labels(rows)
    pairs = r.alias("x").join(r.alias("y"), (F.col("x.segment_id") == F.col("y.segment_id")) & (F.col("x.rater") < F.col("y.rater")))
    pairs = pairs.select(F.col("x.rater").alias("rater_a"), F.col("y.rater").alias("rater_b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
    return cohen_kappa(pairs, "la", "lb", ["rater_a", "rater_b"])


def multi_label_vote(rows: DataFrame) -> DataFrame:
    """Codes applied in more than half of a segment's code slots."""
    held = rows.select("segment_id", F.size("codes").alias("n"), F.explode("codes").alias("code"))
    return held.groupBy("segment_id", "n", "code").agg(F.count("*").alias("c")).where(F.col("c") * 2 > F.col("n")).select("segment_id", "code", F.col("c").alias("votes"))


def discrepancies(rows: DataFrame) -> DataFrame:
    """Segments whose human label differs from the consensus; no consensus counts as abstention."""
    v = vote(rows).withColumn("machine", F.coalesce("winner", F.lit(ABSTAIN)))
    return v.where(F.col("human_label").isNotNull() & (F.col("human_label") != F.col("machine"))).select("segment_id", "human_label", "machine")
