"""Simple models over vectors and cue blocks: code assignment, folds, nested comparisons, what-if scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lineage import materialize
from corpusloom.operators.vectors import cosine


def code_scores(rows: DataFrame, codes: DataFrame, margin: float = 1.375) -> DataFrame:
    """Codes of every row (id, vector) by similarity to the code's vectors (code, definition, criteria, examples).

    The score is cos(definition) + cos(criteria) / 2 + cos(examples) / 2. A code's
    baseline is its mean score or the mean of all, whichever is higher; scores over
    ``margin`` times it assign the code. The code book is a dimension of fixed size
    and is broadcast.
    """
    s = rows.crossJoin(F.broadcast(codes))
    part = lambda c: F.coalesce(cosine(F.col("vector"), F.col(c)), F.lit(0.0))
    s = s.select("id", "code", F.round(part("definition") + 0.5 * part("criteria") + 0.5 * part("examples"), 9).alias("score"))
    sums = s.groupBy("code").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    all_ = sums.agg((F.sum("s") / F.sum("n")).alias("overall"))
    base = sums.crossJoin(all_).select("code", F.round(F.greatest(F.col("s") / F.col("n"), "overall"), 6).alias("baseline"))
    j = s.join(F.broadcast(base), "code").where(F.col("score") > F.col("baseline") * margin)
    return j.select("id", "code", F.round("score", 6).alias("score"), F.round(F.least(F.lit(1.0), F.when(F.col("baseline") > 0, F.col("score") / (F.col("baseline") * margin)).otherwise(1.0)), 4).alias("confidence"))


def neighbour_votes(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each query by its neighbours' summed similarity, the smallest of equal ones: query_id, predicted, share."""
    j = neighbours.join(labels.toDF("vec_id", "label"), "vec_id").where("label is not null")
    by = j.groupBy("query_id", "label").agg(F.sum(F.greatest("similarity", F.lit(0.0))).alias("w"))
    return by.groupBy("query_id").agg(F.min_by("label", F.struct(-F.round("w", 6), "label")).alias("predicted"), F.round(F.max("w") / F.sum("w"), 6).alias("share"))


def resolved_folds(nodes: DataFrame, folds: DataFrame, group: str, ident: str, k: int) -> DataFrame:
    """A fold for every node by its group's, nodes without one dealt in turn by id."""
    j = nodes.join(folds, group, "left")
    free = j.where("fold is null").select(ident).distinct().withColumn("_f", F.pmod(F.crc32(F.col(ident).cast("string")), F.lit(k)).cast("int"))
    return j.join(free, ident, "left").withColumn("fold", F.coalesce("fold", "_f")).drop("_f")


def nested_log_losses(rows: DataFrame, models: dict[str, list[str]], target: str, folds: int = 3) -> DataFrame:
    """Held-out log-loss of logistic models over nested sets of category columns; ``rows`` has fold.

    Whole groups share a fold. Every model is fitted by the library's distributed
    solver, once for each fold; only coefficients reach the driver.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = rows.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
    used = sorted({c for cs in models.values() for c in cs})
    rows = rows.select("fold", "label", *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in used])
    # Categories are numbered once: that tells nothing about the target.
    steps = [StringIndexer(inputCols=used, outputCols=[f"{c}_i" for c in used]), OneHotEncoder(inputCols=[f"{c}_i" for c in used], outputCols=[f"{c}_v" for c in used], dropLast=False)]
    steps += [VectorAssembler(inputCols=[f"{c}_v" for c in columns], outputCol=f"features_{name}") for name, columns in models.items()]
    data = materialize(Pipeline(stages=steps).fit(rows).transform(rows).select("fold", "label", *[f"features_{name}" for name in models]))
    p, out = F.try_element_at(vector_to_array("probability"), (F.col("label") + 1).cast("int")), None
    for name in models:
        for f in range(folds):
            model = LogisticRegression(featuresCol=f"features_{name}", maxIter=15, regParam=0.05).fit(data.where(F.col("fold") != f))
            part = model.transform(data.where(F.col("fold") == f)).select(F.lit(name).alias("model"), (-F.log(F.greatest(F.coalesce(p, F.lit(1e-6)), F.lit(1e-6)))).alias("loss"))
            out = part if out is None else out.union(part)
    return out.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("log_loss"))


def what_if(blocks: DataFrame, moves: int) -> DataFrame:
    """Expected next label by first label and move, shrunk to the first label's mean by one block; and the best move's gain."""
    b = blocks.where("move is not null")
    own = b.groupBy("from_stage", "move").agg(F.count("*").alias("n"), F.sum("to_stage").alias("s"))
    all_ = own.groupBy("from_stage").agg((F.sum("s") / F.sum("n")).alias("mean"))
    spine = all_.select("from_stage", "mean", F.explode(F.sequence(F.lit(0), F.lit(moves - 1))).alias("move"))
    j = spine.join(own, ["from_stage", "move"], "left").select("from_stage", "move", F.coalesce("n", F.lit(0)).alias("n"), F.round((F.coalesce("s", F.lit(0)) + F.col("mean")) / (F.coalesce("n", F.lit(0)) + 1), 6).alias("expected"), F.round("mean", 6).alias("mean"))
    return j.select("from_stage", "move", "n", "expected", F.round(F.col("expected") - F.col("mean"), 6).alias("gain"))


def noise_stability(blocks: DataFrame, rounds: int = 20, noise: float = 0.2, moves: int = 5, seed: int = 42) -> DataFrame:
    """How well the order of the moves' mean change holds when a share of the moves is replaced, round by round.

    Every round replaces moves by a seeded hash; means are summed by round and move
    in one aggregation, and rank correlations with the clean order follow.
    """
    b = blocks.where("move is not null").select("from_id", "move", "delta")
    r = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    h = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "from_id", "round"), F.lit(1_000_000))
    swapped = F.when((F.col("round") > 0) & (h(1) < int(noise * 1_000_000)), F.pmod(h(2), F.lit(moves)).cast("int")).otherwise(F.col("move"))
    means = r.groupBy("round", swapped.alias("move")).agg(F.round(F.avg("delta"), 9).alias("m"))
    rank = means.withColumn("r", F.rank().over(Window.partitionBy("round").orderBy("m")))
    clean = rank.where("round = 0").select("move", F.col("r").alias("r0"))
    return rank.where("round > 0").join(F.broadcast(clean), "move").groupBy("round").agg(F.round(F.corr("r", "r0"), 6).alias("rho"), F.max_by("move", F.struct("m", "move")).alias("top_move"))


def factor_links(scores: DataFrame, outcome: str, k: int) -> DataFrame:
    """Correlation of each of ``k`` factor scores with an outcome column."""
    one = scores.agg(*[F.corr(F.get("scores", F.lit(i)), F.col(outcome).cast("double")).alias(f"c{i}") for i in range(k)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("factor"), F.round(f"c{i}", 6).alias("r")) for i in range(k)])).alias("x")).select("x.*")


def subtypes(rows: DataFrame, groups: list[int], k: int = 2, label: str = "label", seed: int = 42) -> DataFrame:
    """k-means clusters within each of the named groups; groups with fewer rows than clusters stay out."""
    from corpusloom.operators.vectors import fit_clusters

    sizes = {r[label]: r["n"] for r in rows.where(F.col(label).isin(*groups)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    out = None
    for g in groups:
        if sizes.get(g, 0) >= k:
            part = fit_clusters(rows.where(F.col(label) == g), k, seed).withColumn(label, F.lit(g))
            out = part if out is None else out.union(part)
    return out


def design_frame(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per block with both labels: words of the cue, turns, session number, move and change."""
    words = segments.select(F.col("segment_id").alias("turn"), "word_count")
    b = blocks.where("from_stage is not null and to_stage is not null")
    cue = b.select("from_id", F.explode("turn_ids").alias("turn")).join(words, "turn").groupBy("from_id").agg(F.sum("word_count").alias("cue_words"))
    return b.join(cue, "from_id", "left").select("from_id", "participant_id", "session_number", "from_stage", "to_stage", "n_turns", F.coalesce("cue_words", F.lit(0)).cast("long").alias("cue_words"), (F.col("to_stage") - F.col("from_stage")).alias("delta"))


def random_intercept_slope(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Slope of y on x within groups (each group's means taken off), its standard error and z, from sums by group."""
    g = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    off = lambda ab, a, b: F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("n"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), off("xx", "sx", "sx").alias("sxx"), off("xy", "sx", "sy").alias("sxy"), off("yy", "sy", "sy").alias("syy"))
    b = F.col("sxy") / F.col("sxx")
    se = F.sqrt((F.col("syy") - b * F.col("sxy")) / (F.col("n") - F.col("groups") - 1) / F.col("sxx"))
    ok = (F.col("sxx") > 0) & (F.col("n") > F.col("groups") + 1)
    return t.select("n", "groups", F.round(F.when(ok, b), 6).alias("slope"), F.round(F.when(ok, se), 6).alias("se"), F.round(F.when(ok & (se > 0), b / se), 4).alias("z"))
