"""A round of the communities is one write: no table between, and its counts come with it."""

from corpusloom.operators import modularity as M


def test_a_round_is_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(M, "materialize", lambda df, write=M.materialize: written.append(df) or write(df))
    # Two triangles that one edge links, and a node whose only edge is its own.
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    edges = spark.createDataFrame([(0, s, t, 1.0) for a, b in pairs for s, t in ((a, b), (b, a))] + [(0, "loop", "loop", 1.0)], "part int, src string, dst string, weight double")
    strength = {"a": 2, "b": 2, "c": 3, "x": 3, "y": 2, "z": 2, "loop": 1}
    state = spark.createDataFrame([(0, i, float(k), 15.0, i) for i, k in strength.items()], "part int, id string, k double, m2 double, community string")
    step = {r.id: r for r in M._round(edges, state, 1).collect()}
    assert not written and set(step) == set(strength) and step["loop"].target is None and step["loop"].better is None
    assert all(step[i].better for i in "abcxyz")
    after, turn, moved, better = M._settled(edges, state, 0, 1)
    assert len(written) == turn == 1 and better
    community = {r.id: r.community for r in after.collect()}
    assert moved == sum(r.target is not None for r in step.values()) == sum(community[i] != i for i in community)


def test_counts_of_a_round_without_rows(spark):
    edges = spark.createDataFrame([], "part int, src string, dst string, weight double")
    state = spark.createDataFrame([], "part int, id string, k double, m2 double, community string")
    after, turn, moved, better = M._settled(edges, state, 0, 3)
    assert (turn, moved, better, after.count()) == (1, 0, False, 0)
