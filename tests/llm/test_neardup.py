import random
import re

import numpy as np
import pytest

from corpusloom.llm import neardup
from corpusloom.llm.graph import connected_components
from corpusloom.llm.wordhash import shingle_sets

SCHEMA = "doc_id long, text string, lang string, id string, n long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 7, "k") for i, t in rows], SCHEMA)


def brute(rows, percent=85, width=5):
    sets, parent = [], {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((i, s))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = rng.choice([" ", "\t", "\n "]).join(copy)
            rows.append((n, text.upper() if rng.random() < 0.2 else text))
            n += 1
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(1000)}" for _ in range(80)]
    rows = []
    for i in range(250):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_edges(spark):
    long = " ".join(f"t{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three four five"), (8, long), (9, long + " end"), (None, "one"), (5, "ONE")]
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 5000, 8, True), (9, 5001, 8, False), (None, 1, None, True)], key=str)
    left = neardup.drop_near_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8, None]


def test_repeated_kept_row_stays_once(spark):
    assert neardup.drop_near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x")])).count() == 2


def test_empty(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(frame(spark, [])).count() == 0


def test_signature_distance_has_a_shared_key():
    rng = np.random.default_rng(1)
    lanes = rng.integers(0, 512, (neardup.CHUNKS, neardup.LANES))
    for _ in range(50):
        other = lanes.copy()
        at = rng.choice(lanes.size, 2 * neardup.CHUNKS - 1, replace=False)
        other.ravel()[at] ^= 1
        assert ((lanes != other).sum(1) <= 1).any()


def test_shingles_of_bytes():
    a, b, c = shingle_sets([b"A b c d e f", b"a B c d e", b"x y"])
    assert len(a) == 2 and len(b) == 1 and b[0] in a and len(c) == 1


@pytest.mark.parametrize("n", [1, 40])
def test_chain_components(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5), (None, 3)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
