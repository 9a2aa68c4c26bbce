"""Edges and label propagation over all pairs of segments that share a code, against the pairs made one by one."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from corpusloom import catalog
from corpusloom.operators import graphs as N
from corpusloom.plans.graphs import LINKS, SET_GROUPS
from corpusloom.sources.corpus import oracle
from tests.parity import connection
from tests.test_code_pairs import FOLDER, all_pairs, coded, frame


def expanded(rows):
    """All pairs, from the edges of classes and the links to the first member."""
    group, weight = defaultdict(set), {}
    for a, b, w, kind in rows:
        group[a].add(a)
        group[b].add(b)
        weight[a, b] = w
        if kind == "member":
            first = min(a, b)
            group[first] |= {a, b}
            weight[first, first] = w
    first = {b: a for a in group for b in group[a] if all(weight.get((a, x)) for x in group[a] - {a}) and len(group[a]) > 1}
    at = lambda i: first.get(i, i)
    every = sorted({x for v in group.values() for x in v})
    return sorted((a, b, weight[at(a), at(b)]) for a, b in itertools.permutations(every, 2) if (at(a), at(b)) in weight)


def propagated(rows, rounds):
    label = {i: i for i, _ in rows}
    links = defaultdict(list)
    for _, a, b, w in all_pairs(rows):
        links[a].append((b, w))
    for _ in range(rounds):
        new = {}
        for i in label:
            mass = Counter({label[i]: 1.0})
            for b, w in links[i]:
                mass[label[b]] += w
            new[i] = min(mass, key=lambda x: (-mass[x], x))
        label = new
    return label


def sample(seed):
    rng = random.Random(seed)
    many = [(f"s{i:03d}", rng.sample("abcdefgh", rng.choice([1, 1, 2, 2, 3, 4]))) for i in range(45)]
    return [*coded(seed, 30), *((f"v{i}", c) for i, c in many), ("u0", ["own"]), ("u1", ["two"]), ("u2", ["two"])]


def in_sql(rows, body):
    con = duckdb.connect()
    con.execute("CREATE TABLE labelled (segment_id VARCHAR, codes VARCHAR[])")
    con.executemany("INSERT INTO labelled VALUES (?, ?)", rows)
    return con.execute(f"WITH {body}").fetchall()


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_lose_no_pair(spark, seed):
    rows = sample(seed)
    want = sorted((a, b, w) for _, a, b, w in all_pairs(rows))
    assert expanded(N.shared_code_edges(frame(spark, rows)).collect()) == want
    assert expanded(in_sql(rows, f"{LINKS} SELECT src, dst, weight, kind FROM edges")) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_spread_over_all_pairs(spark, seed):
    rows = sample(seed)
    for rounds in (0, 1, 3):
        got = N.code_communities(frame(spark, rows), rounds).collect()
        assert len(got) == len(rows) and {r.id: r.community for r in got} == propagated(rows, rounds)
    assert dict(in_sql(rows, f"{SET_GROUPS} SELECT segment_id, community FROM grouped")) == propagated(rows, 3)


@pytest.fixture(scope="module")
def sets():
    return connection(FOLDER).execute(oracle("SELECT segment_id, codes FROM labelled")).fetchall()


def rows_of(spark, query):
    return catalog.queries()[query](spark, FOLDER).collect()


def test_query_edges(spark, sets):
    assert set(expanded(rows_of(spark, "shared_code_edges"))) == {(a, b, w) for _, a, b, w in all_pairs(sets)}


def test_query_communities(spark, sets):
    assert {r.segment_id: r.community for r in rows_of(spark, "segment_communities")} == propagated(sets, 3)


def test_query_transitions(spark, sets):
    label = propagated(sets, 3)
    order = connection(FOLDER).execute(oracle("SELECT session_id, segment_id FROM labelled ORDER BY session_id, segment_index")).fetchall()
    moves = Counter((label[a], label[b]) for (s, a), (t, b) in itertools.pairwise(order) if s == t and label[a] != label[b])
    assert moves and {(r.from_community, r.to_community): r.n for r in rows_of(spark, "community_transitions")} == moves


def test_query_profile(spark, sets):
    assert {r.community: r.n for r in rows_of(spark, "community_profile")} == Counter(propagated(sets, 3).values())


def test_query_agreement(spark, sets):
    label = propagated(sets, 3)
    cells = [(label[i], stage) for i, stage in connection(FOLDER).execute(oracle("SELECT segment_id, label FROM labelled")).fetchall()]
    pairs = lambda keys: sum(n * (n - 1) / 2 for n in Counter(keys).values())
    both, a, b = pairs(cells), pairs(c for c, _ in cells), pairs(s for _, s in cells)
    chance = a * b / (len(cells) * (len(cells) - 1) / 2)
    (row,) = rows_of(spark, "community_stage_agreement")
    assert row.n == len(cells) and abs(row.ari - (both - chance) / ((a + b) / 2 - chance)) < 1e-6
