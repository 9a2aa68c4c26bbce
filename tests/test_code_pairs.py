"""Modularity communities link all pairs of segments that share a code, against the pairs made one by one."""

import itertools
import random
from collections import Counter

import pytest

from corpusloom.operators import graphs as N
from corpusloom.operators import modularity as M
from tests.test_modularity import plain_modularity

FOLDER = "/root/testdata/sf0.001"


def coded(seed, size=60):
    """Segments of two vocabularies of codes, some mixed, with codes repeated, null and missing."""
    rng = random.Random(seed)
    rows = [(f"s{i:02d}", [rng.choice("abc" if rng.random() < 0.9 else "xyz") if i % 2 else rng.choice("xyz" if rng.random() < 0.9 else "abc") for _ in range(3)]) for i in range(size)]
    return [*rows, ("t0", ["only"]), ("t1", []), ("t2", None), ("t3", [None, "a"])]


def all_pairs(rows):
    sets = {i: {x for x in c or () if x} for i, c in rows}
    return [(0, a, b, float(len(sets[a] & sets[b]))) for a, b in itertools.permutations(sorted(sets), 2) if sets[a] & sets[b]]


@pytest.fixture(scope="module")
def rows():
    return coded(4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "segment_id string, codes array<string>")


def test_class_graph_holds_every_pair(spark, rows):
    members = N.code_classes(frame(spark, rows))
    to = {r.segment_id: r.class_id for r in members.collect()}
    sizes = members.groupBy("class_id", "codes").count().selectExpr("0 as part", "class_id", "codes", "`count` as n")
    got = {(r.src, r.dst): r.weight for r in M.class_graph(sizes).collect()}
    want = Counter()
    for _, a, b, w in all_pairs(rows):
        want[to[a], to[b]] += w
    scale = sum(got.values()) / sum(want.values())
    assert got == {k: w * scale for k, w in want.items()} and scale in [2.0**-i for i in range(12)]
    assert to["t1"] == "t1" and to["t2"] == "t2" and to["t3"] not in ("t1", "t2")


def test_communities_of_all_pairs(spark, rows):
    label = {r.id: r.community for r in M.code_communities(N.code_classes(frame(spark, rows))).collect()}
    assert set(label) == {i for i, _ in rows} and all(label[c] == c and c <= i for i, c in label.items())
    assert all(label[i] == i and sum(c == i for c in label.values()) == 1 for i in ("t0", "t1", "t2"))
    edges = all_pairs(rows)
    direct = {r.id: r.community for r in M.communities(spark.createDataFrame(edges, "part int, src string, dst string, weight double"), spark.createDataFrame([(0, i) for i in label], "part int, id string")).collect()}
    assert plain_modularity(edges, label) >= plain_modularity(edges, direct) - 1e-9 > 0


def test_query_links_holders_that_do_not_follow_each_other(spark):
    from corpusloom import catalog
    from corpusloom.sources.corpus import labelled

    sets = [(r.segment_id, r.codes) for r in labelled(spark, FOLDER).select("segment_id", "codes").collect()]
    edges = all_pairs(sets)
    chain = M.communities(N.code_chain(labelled(spark, FOLDER)).selectExpr("0 as part", "*"), spark.createDataFrame([(0, i) for i, _ in sets], "part int, id string"))
    got = {r.id: r.community for r in catalog.queries()["modularity_communities"](spark, FOLDER).collect()}
    assert plain_modularity(edges, got) > plain_modularity(edges, {r.id: r.community for r in chain.collect()}) + 0.01
