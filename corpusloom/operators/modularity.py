"""Communities of weighted graphs by modularity, and how stable they are.

A level moves nodes between communities in rounds, then the graph is contracted to one
node a community, until a level moves nothing; then single nodes move once more. Several graphs, told apart by ``part``,
are worked on at once.

In a round each community either gives or takes nodes, by a digest, so that no target
changes under a move's feet. Of the moves that raise modularity alone, those are made
whose gain also outweighs what all others into the same target and out of the same
source could cost, and the best one of each target that is also its source's best.
Together they never lower modularity, and the best move of all is always among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.operators.graphs import class_links
from corpusloom.operators.inference import drawn_times
from corpusloom.operators.lineage import materialize

#: Tables of nodes, edges and communities meet by shuffle only: as broadcasts they would pass the driver in every round.
SHUFFLED = "merge"
#: Rounds of one level at most; what they leave is moved on the contracted graph.
ROUNDS = 8


def _takes(part: Column, community: Column, turn: int) -> Column:
    """Whether a community takes nodes; two turns that follow each other swap takers and givers."""
    return F.pmod(F.xxhash64(F.lit(turn // 2), part, community), F.lit(2)) == turn % 2


def _strengths(edges: DataFrame) -> DataFrame:
    return edges.groupBy("part", F.col("src").alias("id")).agg(F.sum("weight").alias("k"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Modularity of each part's grouping: ``edges`` (part, src, dst, weight) both ways, ``groups`` (part, id, community)."""
    at = lambda end, name: groups.select("part", F.col("id").alias(end), F.col("community").alias(name))
    e = edges.join(at("src", "a").hint(SHUFFLED), ["part", "src"]).join(at("dst", "b").hint(SHUFFLED), ["part", "dst"])
    by = e.groupBy("part", "a").agg(F.sum("weight").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"))
    whole = edges.groupBy("part").agg(F.sum("weight").alias("m2"))
    return by.join(F.broadcast(whole), "part").groupBy("part").agg(F.round(F.sum(F.col("inner") / F.col("m2") - (F.col("tot") / F.col("m2")) ** 2), 9).alias("modularity"), F.count("*").alias("communities"))


def _round(edges: DataFrame, state: DataFrame, turn: int) -> DataFrame:
    """``state`` (part, id, k, m2, community) with ``target``: where the node goes now, and ``better``: whether any move would gain."""
    totals = state.groupBy("part", "community").agg(F.sum("k").alias("tot"))
    placed = state.join(totals.hint(SHUFFLED), ["part", "community"])
    ends = placed.select("part", F.col("id").alias("dst"), F.col("community").alias("target"), F.col("tot").alias("tot_there"))
    links = edges.where("src <> dst").join(ends.hint(SHUFFLED), ["part", "dst"]).groupBy("part", F.col("src").alias("id"), "target").agg(F.sum("weight").alias("w"), F.max("tot_there").alias("tot_there"))
    inner = F.col("target") == F.col("community")
    # Nodes that can't gain stay in, so that no join has to bring them back.
    j = placed.join(links.hint(SHUFFLED), ["part", "id"], "left").withColumn("w_own", F.max(F.when(inner, F.col("w"))).over(Window.partitionBy("part", "id")))
    gain = F.col("w") - F.coalesce("w_own", F.lit(0.0)) - F.col("k") * (F.col("tot_there") - F.col("tot") + F.col("k")) / F.col("m2")
    c = j.withColumn("gain", F.when(~inner, F.round(gain, 9)))
    allowed = _takes(F.col("part"), F.col("target"), turn) & ~_takes(F.col("part"), F.col("community"), turn)
    order = F.when((F.col("gain") > 0) & allowed, F.struct(-F.col("gain"), F.col("target")))
    best = c.groupBy("part", "id", "k", "m2", "community").agg(F.max(F.when(F.col("gain") > 0, True)).alias("better"), F.min_by(F.struct("target", "gain"), order).alias("move"))
    # A node without a move is a group of its own in both windows, so that large communities at rest are never one task's group.
    free = F.col("move").isNotNull()
    b = best.withColumns({"free": free, "into": F.coalesce("move.target", "id"), "out_of": F.when(free, F.col("community")).otherwise(F.col("id")), "gain": F.col("move.gain")})
    rank = F.struct(-F.col("gain"), F.col("id"))
    into, out_of = Window.partitionBy("part", "free", "into"), Window.partitionBy("part", "free", "out_of")
    m = b.withColumns({"k_in": F.sum("k").over(into), "first_in": F.min(rank).over(into)}).withColumns({"k_out": F.sum("k").over(out_of), "first_out": F.min(rank).over(out_of)})
    safe = F.col("gain") * F.col("m2") >= F.col("k") * (F.col("k_in") + F.col("k_out") - 2 * F.col("k"))
    made = F.col("free") & (safe | ((F.col("first_in") == rank) & (F.col("first_out") == rank)))
    return m.select("part", "id", "k", "m2", "community", F.when(made, F.col("into")).alias("target"), "better")


def _settled(edges: DataFrame, state: DataFrame, turn: int, rounds: int) -> tuple[DataFrame, int, int, bool]:
    """``state`` after rounds until no move gains: the state, the last turn, how many moves were made, and whether some still gain."""
    moved, better = 0, True
    for _ in range(rounds):
        turn += 1
        counts = Observation()
        done = materialize(_round(edges, state, turn).observe(counts, F.count("better").alias("better"), F.count("target").alias("made")))
        better = counts.get["better"]
        state, moved = done.select("part", "id", "k", "m2", F.coalesce("target", "community").alias("community")), moved + counts.get["made"]
        if not better:
            break
    return state, turn, moved, bool(better)


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Community of every node by modularity: part, id, community, its smallest member's id.

    ``edges`` has part, src, dst, weight, each edge both ways, weights above zero;
    ``nodes`` part and id. Nodes without edges are communities of their own; nulls are
    left out; repeated edges add up. The same rows give the same communities on every run.
    After the levels single nodes move once more, on the graph as it was, since
    contraction holds together what an early round has joined.
    """
    nodes = nodes.select("part", "id").where("id is not null").distinct()
    e = given = materialize(edges.where("src is not null and dst is not null and weight > 0").groupBy("part", "src", "dst").agg(F.sum("weight").alias("weight")))
    whole = materialize(e.groupBy("part").agg(F.sum("weight").alias("m2")))
    found, turn = materialize(nodes.withColumn("community", F.col("id"))), 0
    better = not e.isEmpty()
    while better:
        state, turn, moved, better = _settled(e, _strengths(e).join(F.broadcast(whole), "part").withColumn("community", F.col("id")), turn, rounds)
        if not moved:
            continue  # The digest allowed none of the moves that gain, if there are any; further rounds draw anew.
        step = state.select("part", F.col("id").alias("community"), F.col("community").alias("_to"))
        found = materialize(found.join(step.hint(SHUFFLED), ["part", "community"], "left").select("part", "id", F.coalesce("_to", "community").alias("community")))
        to = lambda end: state.select("part", F.col("id").alias(end), F.col("community").alias(f"_{end}"))
        e = materialize(e.join(to("src").hint(SHUFFLED), ["part", "src"]).join(to("dst").hint(SHUFFLED), ["part", "dst"]).groupBy("part", F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("weight").alias("weight")))
        better = True
    if turn:
        last, *_ = _settled(given, _strengths(given).join(F.broadcast(whole), "part").join(found.hint(SHUFFLED), ["part", "id"]), turn, rounds)
        found = materialize(found.join(last.select("part", "id", F.col("community").alias("_to")).hint(SHUFFLED), ["part", "id"], "left").select("part", "id", F.coalesce("_to", "community").alias("community")))
    least = found.groupBy("part", "community").agg(F.min("id").alias("_least"))
    return found.join(least.hint(SHUFFLED), ["part", "community"]).select("part", "id", F.col("_least").alias("community"))


def class_graph(sizes: DataFrame) -> DataFrame:
    """Links of all pairs of nodes that share a code, summed by class: part, src, dst, weight, both ways, a class's inner pairs as a loop.

    ``sizes`` has part, class_id, codes and n, the nodes of that set of codes. A pair weighs one for each
    code it shares. Nodes of one set of codes are together in every best partition: they see the same, and by the
    Cauchy-Schwarz inequality their own link weighs more than k * k / m2; so a class may move as one node.
    Weights are divided by a power of two, which brings the mean strength of a class near one and keeps their sums exact.
    """
    links = class_links(sizes.select("class_id", "codes").distinct())
    end = lambda name: sizes.select("part", F.col("class_id").alias(name), F.col("n").alias(f"n_{name}"))
    holders = sizes.select("part", "n", F.explode("codes").alias("code")).groupBy("part", "code").agg(F.sum("n").alias("h"))
    whole = holders.groupBy("part").agg(F.sum(F.col("h") * (F.col("h") - 1)).alias("m2")).where("m2 > 0")
    scale = sizes.groupBy("part").agg(F.count("*").alias("classes")).join(whole, "part").select("part", F.pow(F.lit(2.0), -F.ceil(F.log2(F.col("m2") / F.col("classes")))).alias("scale"))
    pairs = F.col("n_src") * (F.col("n_dst") - (F.col("src") == F.col("dst")).cast("long"))
    e = links.join(end("src").hint(SHUFFLED), "src").join(end("dst").hint(SHUFFLED), ["part", "dst"]).join(F.broadcast(scale), "part")
    return e.select("part", "src", "dst", (F.col("shared") * pairs * F.col("scale")).alias("weight")).where("weight > 0")


def code_communities(members: DataFrame) -> DataFrame:
    """Communities by modularity of nodes (segment_id, codes, class_id) of which all pairs that share a code are linked: id, community."""
    sizes = materialize(members.groupBy("class_id", "codes").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), "class_id", "codes", "n"))
    found = communities(class_graph(sizes), sizes.select("part", F.col("class_id").alias("id"))).select(F.col("id").alias("class_id"), "community")
    return members.join(found, "class_id").select(F.col("segment_id").alias("id"), "community")


def kept_together(full: DataFrame, refitted: DataFrame) -> DataFrame:
    """Pairs of each community's members that are in a refit at all, and that it keeps together.

    ``full`` has id and community, ``refitted`` draw, id and community, and n where a row
    stands for so many members. Pairs are counted as n (n - 1) / 2 of the cells and of their sums; none is made.
    """
    members = F.col("n") if "n" in refitted.columns else F.lit(1)
    cells = refitted.select("draw", "id", F.col("community").alias("again"), members.alias("_n")).join(full.hint(SHUFFLED), "id").groupBy("community", "draw", "again").agg(F.sum("_n").alias("n"))
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    by = cells.groupBy("community", "draw").agg(F.sum(pairs(F.col("n"))).alias("together"), pairs(F.sum("n")).alias("seen"))
    return by.groupBy("community").agg(F.sum("seen").alias("seen"), F.sum("together").alias("together"))


def stability(edges: DataFrame, members: DataFrame, full: DataFrame, draws: int = 10, least: int = 3, enough: float = 0.5, seed: int = 42) -> DataFrame:
    """Share of each community's pairs that stay together when refitted on drawn participants.

    ``edges`` has src, dst, weight, ``members`` id and participant_id, ``full`` id and
    community. A draw holds the participants that a digest gives it once or more; all draws are fitted at
    once, as parts. Communities under ``least`` members have no row; ``stability`` is null
    where no draw saw a pair.
    """
    drawn = members.where("participant_id is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = materialize(drawn.where(drawn_times(F.col("participant_id"), F.col("part"), seed) > 0).select("part", "id"))
    e = edges.join(drawn.withColumnRenamed("id", "src").hint(SHUFFLED), "src").join(drawn.withColumnRenamed("id", "dst").hint(SHUFFLED), ["part", "dst"]).select("part", "src", "dst", "weight")
    again = communities(e, drawn).withColumnRenamed("part", "draw")
    sizes = full.groupBy("community").agg(F.count("*").alias("size"))
    return _rated(sizes, kept_together(full.select("id", "community"), again), least, enough)


def _rated(sizes: DataFrame, kept: DataFrame, least: int, enough: float) -> DataFrame:
    """Stability of the communities (community, size) of ``least`` members or more, from the counts of ``kept_together``."""
    counted = sizes.where(F.col("size") >= least).join(kept.hint(SHUFFLED), "community", "left")
    rate = F.round(F.when(F.col("seen") > 0, F.col("together") / F.col("seen")), 6)
    return counted.select("community", "size", F.coalesce("seen", F.lit(0)).alias("pairs_seen"), rate.alias("stability"), F.coalesce(rate >= enough, F.lit(False)).alias("stable"))


def code_stability(members: DataFrame, full: DataFrame, draws: int = 50, least: int = 3, enough: float = 0.5, seed: int = 42) -> DataFrame:
    """``stability`` of communities of nodes of which all pairs that share a code are linked.

    ``members`` has segment_id, codes, class_id and participant_id, ``full`` id and community
    (``code_communities``). A draw's graph and its pairs are counted by set of codes, so no draw repeats the segments.
    """
    counts = materialize(members.where("participant_id is not null").groupBy("participant_id", "class_id").agg(F.count("*").alias("n")))
    drawn = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).where(drawn_times(F.col("participant_id"), F.col("part"), seed) > 0)
    codes = members.where("segment_id = class_id").select("class_id", "codes")
    sizes = materialize(drawn.groupBy("part", "class_id").agg(F.sum("n").alias("n")).join(codes.hint(SHUFFLED), "class_id").select("part", "class_id", "codes", "n"))
    again = communities(class_graph(sizes), sizes.select("part", F.col("class_id").alias("id")))
    again = again.join(sizes.select("part", F.col("class_id").alias("id"), "n").hint(SHUFFLED), ["part", "id"]).withColumnRenamed("part", "draw")
    # A class lies in one community, that of its first member.
    first = full.join(codes.select(F.col("class_id").alias("id")).hint(SHUFFLED), "id").select("id", "community")
    return _rated(full.groupBy("community").agg(F.count("*").alias("size")), kept_together(first, again), least, enough)
