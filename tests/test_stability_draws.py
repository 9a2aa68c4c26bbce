"""The stability query takes fifty draws, and pairs counted by set of codes are those of the segments."""

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import graphs as N
from corpusloom.operators import modularity as M
from corpusloom.operators.inference import drawn_times

FOLDER = "/root/testdata/sf0.001"


def test_query_takes_fifty_draws(spark, monkeypatch):
    parts = []

    def whole(edges, nodes, *_):
        """One community a part, in place of the search."""
        parts.append(nodes.select("part").distinct().count())
        return nodes.select("part", "id", F.min("id").over(Window.partitionBy("part")).alias("community"))

    monkeypatch.setattr(M, "communities", whole)
    (row,) = catalog.queries()["community_stability"](spark, FOLDER).collect()
    # A draw of the five participants may hold none.
    assert parts[0] == 1 and 40 < parts[1] <= 50 and row.stability == 1.0
    # No three draws see more pairs than three times all.
    assert 3 * row.size * (row.size - 1) // 2 < row.pairs_seen <= 50 * row.size * (row.size - 1) // 2


def test_pairs_are_those_of_the_segments(spark, monkeypatch):
    again = lambda d, i: F.pmod(F.xxhash64(d, i), F.lit(3))
    monkeypatch.setattr(M, "communities", lambda edges, nodes: nodes.select("part", "id", again(F.col("part"), F.col("id")).alias("community")))
    rows = spark.createDataFrame([(f"s{i:02d}", [c for c in "abcd" if (i * 7 + ord(c)) % 3 == 0], f"p{i % 6}" if i % 11 else None) for i in range(40)], "segment_id string, codes array<string>, participant_id string")
    members = N.code_classes(rows).join(rows.select("segment_id", "participant_id"), "segment_id")
    at = {r.segment_id: r for r in members.collect()}
    full = {i: "ab"[len(r.codes) % 2] for i, r in at.items()}
    got = {r.community: r for r in M.code_stability(members, spark.createDataFrame(sorted(full.items()), "id string, community string"), draws=4).collect()}
    draws = rows.select("participant_id").where("participant_id is not null").distinct().select("participant_id", F.explode(F.array(*map(F.lit, range(4)))).alias("d"))
    drawn = {(r.d, r.participant_id) for r in draws.where(drawn_times(F.col("participant_id"), F.col("d"), 42) > 0).collect()}
    to = {(r.d, r.class_id): r.c for r in members.select("class_id", F.explode(F.array(*map(F.lit, range(4)))).alias("d")).distinct().withColumn("c", again(F.col("d"), F.col("class_id"))).collect()}
    for c in set(full.values()):
        ids = sorted(i for i in full if full[i] == c)
        seen = [(d, a, b) for d in range(4) for a, b in itertools.combinations(ids, 2) if (d, at[a].participant_id) in drawn and (d, at[b].participant_id) in drawn]
        together = sum(to[d, at[a].class_id] == to[d, at[b].class_id] for d, a, b in seen)
        assert (got[c].size, got[c].pairs_seen, got[c].stability) == (len(ids), len(seen), round(together / len(seen), 6))
