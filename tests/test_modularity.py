"""Modularity communities on planted graphs, and pair counts against all pairs."""

import itertools
import random
from collections import Counter

from corpusloom.operators import modularity as M

EDGES, NODES = "part int, src string, dst string, weight double", "part int, id string"


def planted(seed, groups=2, size=7, part=0):
    rng = random.Random(seed)
    nodes = [f"n{g}_{i:02d}" for g in range(groups) for i in range(size)]
    edges = []
    for a, b in itertools.combinations(nodes, 2):
        if rng.random() < (0.9 if a[:2] == b[:2] else 0.04):
            w = rng.choice([1.0, 2.0])
            edges += [(part, a, b, w), (part, b, a, w)]
    return nodes, edges


def plain_modularity(edges, label):
    m2 = sum(w for *_, w in edges)
    tot, inner = Counter(), 0.0
    for _, a, b, w in edges:
        tot[label[a]] += w
        inner += w * (label[a] == label[b])
    return inner / m2 - sum((t / m2) ** 2 for t in tot.values())


def test_planted_groups_come_back_in_every_part(spark):
    nodes, first = planted(1)
    _, second = planted(2, part=1)
    e = spark.createDataFrame(first + second, EDGES)
    n = spark.createDataFrame([(p, i) for p in (0, 1) for i in nodes] + [(0, "alone"), (1, None)], NODES)
    got = M.communities(e, n)
    label = {(r.part, r.id): r.community for r in got.collect()}
    assert len(label) == 2 * len(nodes) + 1 and label[0, "alone"] == "alone"
    for p in (0, 1):
        assert all(label[p, i] == f"{i[:2]}_00" for i in nodes)
    assert label == {(r.part, r.id): r.community for r in M.communities(e.repartition(3), n).collect()}
    q = {r.part: r.modularity for r in M.modularity(e, got).collect()}
    assert abs(q[0] - plain_modularity(first, {i: label[0, i] for i in nodes})) < 1e-8


def test_rounds_never_lower_modularity(spark):
    rng = random.Random(3)
    nodes = [f"v{i}" for i in range(40)]
    edges = []
    for a in nodes:
        for b in rng.sample(nodes, 3):
            if a != b:
                edges += [(0, a, b, 1.0), (0, b, a, 1.0)]
    # A hub that every node leans on.
    edges += [x for a in nodes[1:] for x in ((0, a, "v0", 1.0), (0, "v0", a, 1.0))]
    e = spark.createDataFrame(edges, EDGES)
    total = sum(w for *_, w in edges)
    strength = Counter()
    for _, a, _, w in edges:
        strength[a] += w
    label, last = {i: i for i in nodes}, -1.0
    for turn in range(1, 5):
        state = spark.createDataFrame([(0, i, strength[i], total, label[i]) for i in nodes], "part int, id string, k double, m2 double, community string")
        for r in M._round(e, state, turn).collect():
            if r.target is not None:
                label[r.id] = r.target
        now = plain_modularity(edges, label)
        assert now >= last - 1e-9
        last = now
    assert last > 0


def test_edges_of_nothing(spark):
    empty = spark.createDataFrame([], EDGES)
    assert M.communities(empty, spark.createDataFrame([(0, "a")], NODES)).collect()[0].community == "a"
    assert M.communities(empty, spark.createDataFrame([], NODES)).count() == 0


def test_pairs_are_counted_without_being_made(spark):
    rng = random.Random(5)
    full = {f"i{k}": rng.choice("AB") for k in range(20)}
    refits = {d: {i: rng.choice("xyz") for i in rng.sample(sorted(full), 13)} for d in range(4)}
    got = M.kept_together(spark.createDataFrame(sorted(full.items()), "id string, community string"), spark.createDataFrame([(d, i, c) for d, m in refits.items() for i, c in m.items()], "draw int, id string, community string"))
    want = {}
    for c in "AB":
        pairs = [(a, b, m) for m in refits.values() for a, b in itertools.combinations(sorted(i for i in m if full[i] == c), 2)]
        want[c] = (len(pairs), sum(m[a] == m[b] for a, b, m in pairs))
    assert {r.community: (r.seen, r.together) for r in got.collect()} == want


def test_stable_groups_are_found_stable(spark):
    nodes, edges = planted(6)
    e = spark.createDataFrame([x[1:] for x in edges], "src string, dst string, weight double")
    members = spark.createDataFrame([(i, f"p{k % 5}") for k, i in enumerate(nodes)], "id string, participant_id string")
    full = spark.createDataFrame([(i, i[:2]) for i in nodes] + [("z", "small")], "id string, community string")
    rows = {r.community: r for r in M.stability(e, members, full, draws=2).collect()}
    assert set(rows) == {"n0", "n1"} and all(r.stable and r.stability > 0.8 for r in rows.values())
