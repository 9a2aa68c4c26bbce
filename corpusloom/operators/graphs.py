"""Segment graphs: typed edges, communities, motifs and what their members share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lineage import materialize
from corpusloom.operators.vectors import temporal_edges


def cue_edges(blocks: DataFrame) -> DataFrame:
    """Edges from the turns of a cue to the segment that follows, both ways, of weight 1."""
    e = blocks.select(F.explode("turn_ids").alias("src"), F.col("to_id").alias("dst"))
    return e.union(e.select("dst", "src")).withColumn("weight", F.lit(1.0))


def code_chain(rows: DataFrame) -> DataFrame:
    """Consecutive holders of a code, in order of id, both ways; other pairs that share it have no edge.

    Edges weigh one for each code whose holders they follow in. ``shared_code_edges`` has all pairs.
    """
    held = rows.select("segment_id", F.explode(F.array_distinct("codes")).alias("code"))
    e = held.withColumn("dst", F.lead("segment_id").over(Window.partitionBy("code").orderBy("segment_id"))).where("dst is not null")
    e = e.select(F.col("segment_id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    return e.union(e.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def code_classes(rows: DataFrame) -> DataFrame:
    """Segments by the set of codes that they hold: segment_id, codes (sorted) and class_id, the smallest segment_id of the set.

    All segments of a set have the same links, so pairs need to be made between classes only
    and none is lost. A segment without codes is a class of its own. Rows of one id are one
    segment, with the codes of all of them.
    """
    sets = rows.where("segment_id is not null").select("segment_id", F.explode_outer("codes").alias("code")).groupBy("segment_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    least = sets.where(F.size("codes") > 0).groupBy("codes").agg(F.min("segment_id").alias("class_id"))
    return sets.join(least, "codes", "left").select("segment_id", "codes", F.coalesce("class_id", "segment_id").alias("class_id"))


def class_links(classes: DataFrame) -> DataFrame:
    """Every two classes (class_id, codes) that share codes, both ways, each class with itself too: src, dst, shared."""
    held = classes.select("class_id", F.explode("codes").alias("code"))
    return held.withColumnRenamed("class_id", "src").join(held.withColumnRenamed("class_id", "dst"), "code").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def shared_code_edges(rows: DataFrame) -> DataFrame:
    """All pairs of segments that share a code, by class: src, dst, weight (the codes that they share) and kind, both ways.

    An edge of kind ``class`` links the first segments of two classes (``code_classes``) and stands for all pairs of their members, one
    of kind ``member`` links a segment with the first of its own class. Two members of a class weigh as either
    does with the first. Rows grow with the segments and with pairs of sets of codes, not with pairs of segments.
    """
    m = code_classes(rows)
    between = class_links(m.where("segment_id = class_id")).where("src <> dst").select("src", "dst", F.col("shared").cast("double").alias("weight"), F.lit("class").alias("kind"))
    inner = m.where("segment_id <> class_id").select(F.col("segment_id").alias("src"), F.col("class_id").alias("dst"), F.size("codes").cast("double").alias("weight"), F.lit("member").alias("kind"))
    return between.union(inner).union(inner.select("dst", "src", "weight", "kind"))


def typed_edges(segments: DataFrame, blocks: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """All edges with their kind: temporal, cue, and similar where given."""
    e = temporal_edges(segments).withColumn("kind", F.lit("temporal")).unionByName(cue_edges(blocks).withColumn("kind", F.lit("cue")))
    return e if similar is None else e.unionByName(similar.withColumn("kind", F.lit("similar")))


def anchor_edges(anchors: list[tuple[str, list[float]]], rows: DataFrame, top: int = 8) -> DataFrame:
    """Each anchor's ``top`` most similar segments by cosine: anchor_id, segment_id, weight (none below 0).

    ``rows`` has segment_id and vector. Anchors are a code book's definitions, a few
    dozen, and go along as literals; each task keeps an anchor's best rows before the shuffle.
    Equal similarities go by segment_id; zero and null vectors have similarity 0.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    dot = lambda c: F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    parts = []
    for name, c in anchors:
        size = sum(x * x for x in c) ** 0.5
        near = dot(c) / (norm("vector") * F.lit(size)) if size else F.lit(0.0)
        parts.append(F.struct(F.lit(name).alias("anchor_id"), F.round(F.greatest(F.lit(0.0), F.coalesce(F.when(norm("vector") > 0, near), F.lit(0.0))), 6).alias("weight")))
    every = rows.select("segment_id", F.explode(F.array(*parts)).alias("a")).select("a.anchor_id", "segment_id", "a.weight")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("weight"), "segment_id"))
    return every.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def cross_anchor_edges(lift: DataFrame, least: float = 1.5) -> DataFrame:
    """Edges between a label's and a code's anchor where their lift (label, code, lift) is ``least`` or more."""
    return lift.where(F.col("lift") >= least).select(F.concat(F.lit("stage:"), F.col("label")).alias("src"), F.concat(F.lit("code:"), F.col("code")).alias("dst"), F.col("lift").alias("weight"))


def neighbour_mean(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Weighted mean of the neighbours' values (id, value) of each target."""
    j = edges.join(values.withColumnRenamed("id", "src"), "src")
    return j.groupBy("dst").agg(F.round(F.sum(F.col("weight") * F.col("value")) / F.sum("weight"), 6).alias("mean"), F.count("*").alias("edges"))


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation: every node takes its neighbours' heaviest label, its own counting once; the smallest of equal ones.

    ``nodes`` has id. Labels start as ids; each round is a join and two aggregations.
    """
    state = nodes.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        moved = edges.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "community", "weight")
        mass = moved.union(state.select("id", "community", F.lit(1.0))).groupBy("id", "community").agg(F.sum("weight").alias("w"))
        state = mass.groupBy("id").agg(F.min_by("community", F.struct(-F.round("w", 6), "community")).alias("community"))
    return state


def code_communities(rows: DataFrame, rounds: int = 5) -> DataFrame:
    """``communities`` over all pairs of segments that share a code (segment_id, codes): id, community.

    No pair is made: a class sees a label as often as its codes' holders have it, less the node itself.
    At the start each label is one node's, and of a class's equal labels the two smallest decide, since a
    node may not count its own but for once. So the first node of a class, the second and all the rest are
    three cells, whose nodes move together in every round.
    """
    members = materialize(code_classes(rows))
    second = F.min(F.when(F.col("segment_id") != F.col("class_id"), F.col("segment_id")))
    sized = materialize(members.where(F.size("codes") > 0).groupBy("class_id", "codes").agg(F.count("*").alias("n"), second.alias("second")))
    held = sized.select("class_id", F.explode("codes").alias("code"))
    cell = lambda at, label, n: F.struct(F.lit(at).alias("cell"), label.alias("label"), n.cast("long").alias("n"))
    three = F.array(cell(0, F.col("class_id"), F.lit(1)), cell(1, F.col("second"), F.least(F.col("n") - 1, F.lit(1))), cell(2, F.lit(None).cast("string"), F.col("n") - 2))
    cells = sized.select("class_id", "second", F.size("codes").alias("size"), F.explode(F.filter(three, lambda c: c["n"] > 0)).alias("c")).select("class_id", "second", "size", "c.*")
    for _ in range(rounds):
        seen = cells.where("label is not null").join(held, "class_id").groupBy("code", "label").agg(F.sum("n").alias("n"))
        mass = held.join(seen, "code").groupBy("class_id", "label").agg(F.sum("n").alias("mass"))
        score = F.col("mass") - F.when(F.col("label") == F.col("own"), F.col("size") - 1).otherwise(0)
        choice = cells.withColumnRenamed("label", "own").join(mass, "class_id").groupBy("class_id", "second", "size", "cell", "n")
        cells = materialize(choice.agg(F.min_by("label", F.struct(-score, "label")).alias("label")))
    at = F.when(F.col("segment_id") == F.col("class_id"), 0).when(F.col("segment_id") == F.col("second"), 1).otherwise(2)
    placed = members.join(cells.select("class_id", "second", "cell", "label"), "class_id", "left").where(F.col("cell").isNull() | (F.col("cell") == at))
    return placed.select(F.col("segment_id").alias("id"), F.coalesce("label", "segment_id").alias("community"))


def community_transitions(rows: DataFrame) -> DataFrame:
    """Changes from one community to another between consecutive segments of a session."""
    nxt = F.lead("community").over(Window.partitionBy("session_id").orderBy("segment_index"))
    return rows.withColumn("next", nxt).where("next is not null and next <> community").groupBy(F.col("community").alias("from_community"), F.col("next").alias("to_community")).agg(F.count("*").alias("n"))


def community_profile(rows: DataFrame) -> DataFrame:
    """Size, sessions, mean label and the share of the modal label of each community."""
    by = rows.where("label is not null").groupBy("community", "label").agg(F.count("*").alias("c"))
    pure = by.groupBy("community").agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("modal"), F.round(F.max("c") / F.sum("c"), 6).alias("purity"))
    out = rows.groupBy("community").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.round(F.avg("label"), 6).alias("mean_label"))
    return out.join(pure, "community", "left")


def top_terms(rows: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Each group's terms with the highest tf-idf (text tokens of three or more characters)."""
    words = rows.select(key, F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)), lambda t: F.length(t) >= 3)).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    groups = rows.select(key).distinct().agg(F.count("*").alias("groups"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    score = F.round(F.col("tf") * (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1), 6)
    r = tf.join(df, "term").crossJoin(F.broadcast(groups)).withColumn("score", score)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= top).select(key, "term", "score", "rank")


def block_vectors(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of each block's turns, as from_id, place and mean."""
    t = blocks.select("from_id", F.explode("turn_ids").alias("segment_id")).join(vectors, "segment_id")
    return t.select("from_id", F.posexplode("vector").alias("place", "x")).groupBy("from_id", "place").agg(F.round(F.avg("x"), 6).alias("mean"))


def routines(blocks: DataFrame, group: DataFrame, least: int = 3) -> DataFrame:
    """How often the cue's group leads to the next segment's group: ``group`` has segment_id and community."""
    cue = blocks.select("from_id", "to_id", F.explode("turn_ids").alias("segment_id")).join(group, "segment_id")
    modal = cue.groupBy("from_id", "to_id", "community").agg(F.count("*").alias("c")).groupBy("from_id", "to_id").agg(F.min_by("community", F.struct(-F.col("c"), "community")).alias("cue"))
    to = group.select(F.col("segment_id").alias("to_id"), F.col("community").alias("response"))
    return modal.join(to, "to_id").groupBy("cue", "response").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def motifs(rows: DataFrame, least: int = 3, influence: float = 1.05, purity: float = 0.5) -> DataFrame:
    """Groups of cues (motif, move, forward): size, purity of the moves, influence on going forward, and whether it is emergent."""
    by = rows.groupBy("motif", "move").agg(F.count("*").alias("c"), F.sum(F.col("forward").cast("long")).alias("f"), F.count("forward").alias("_known"))
    base = by.agg((F.sum("f") / F.sum("_known")).alias("base"))
    m = by.groupBy("motif").agg(F.sum("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("purity"), (F.sum("f") / F.sum("c")).alias("rate")).crossJoin(F.broadcast(base))
    m = m.select("motif", "n", "purity", F.round(F.when(F.col("base") > 0, F.col("rate") / F.col("base")).otherwise(0.0), 6).alias("influence"))
    return m.withColumn("emergent", (F.col("n") >= least) & (F.col("influence") >= influence) & (F.col("purity") < purity))


def rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two groupings from the counts of their table."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda df, n: df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(n))
    side = lambda c, n: pairs(cells.groupBy(c).agg(F.sum("n").alias("n")), n)
    t = pairs(cells, "both").crossJoin(side("a", "sa")).crossJoin(side("b", "sb")).crossJoin(cells.agg(F.sum("n").alias("n")))
    chance = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    return t.select("n", F.round(F.when(top == chance, 1.0).otherwise((F.col("both") - chance) / (top - chance)), 6).alias("ari"))


def nearest_centroid(vectors: DataFrame, top: int = 3, key: str = "label", vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """The rows nearest to each group's centroid by Euclidean distance."""
    from corpusloom.operators.vectors import centroids

    means = centroids(vectors, key, vector).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("c"))
    d = F.sqrt(F.aggregate(F.zip_with(vector, "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    r = vectors.join(means, key).withColumn("distance", F.round(d, 5))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", ident))).where(F.col("rank") <= top).select(key, ident, "rank")
