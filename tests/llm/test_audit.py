import random
import re
from itertools import permutations

import duckdb
import pandas as pd
import pytest

from corpusloom.llm import audit, queries
from tests.parity import assert_same

ORDERS = ["".join(p) for p in permutations("ABCDE")]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "DELTA", "straße", "漢字", "x#", "y%", "|"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([9, 309])]) for _ in range(rng.choice([0, 1, 5, 199, 200, 201, 260]))) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(60)] + [None, None, "", " \t\n", "a b", "a b", "A" * 5000, "A" * 4999 + "B", "A" * 5000, "b" * 600, "b" * 600 + "c", "word\x0bword\x0cword"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[70], ids[100], ids[101] = ids[4], None, None, -7
    return [(i, t, rng.choice(["en", "fr", None, ""])) for i, t in zip(ids, texts)]


def plainly(rows, labels):
    """Counts by running every order over every document."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, removed_at = {}, {}
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        for order in ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_at[part, f] = removed_at.get((part, f), 0) + len(gone)
                earlier = set(order[: step - 1])
                out[part, order, step] = [len(left), len(gone), sum(f in x[1] and bool(x[1] & earlier) for x in mine), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, removed_at[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_equals_running_every_order(spark, bits):
    rows = corpus(7)
    rng = random.Random(8)
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d, *_ in rows if rng.random() < 0.6] + [(None, 1, 1), (5, None, 1), (6, 1, None), (999, 1, 1)]
    docs = spark.createDataFrame([(d, t, x, 1, "y") for d, t, x in rows], "doc_id long, text string, lang string, n int, part string")
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == plainly(rows, labels)
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})


def test_sql_on_the_same_rows(spark):
    rows = corpus(9)
    labels = [(d, d % 2, d % 3 == 0) for d, *_ in rows if d is not None and d % 5]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([d for d, *_ in rows], "Int64"), "text": [t for _, t, _ in rows], "lang": [x for *_, x in rows]}))
    con.register("labels", pd.DataFrame({"doc_id": [d for d, *_ in labels], "quality": [q for _, q, _ in labels], "toxic": [int(x) for *_, x in labels]}))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert_same(audit.audit(docs, spark.createDataFrame([(d, q, int(x)) for d, q, x in labels], "doc_id long, quality int, toxic int")), con, queries.oracle_sql()["op11_filter_audit"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", None)], docs.schema)
    assert audit.audit(one, labels).where("removed = 1 and filter_order like 'A%' and step = 1").count() == 24


def test_blocks_cover_long_texts():
    long = ("word " * 300_000).encode()
    assert len(audit.block_hashes(long)) > 4
    assert audit.block_hashes(long)[-1] != audit.block_hashes(long[:-1] + b"x")[-1]
    assert len(audit.block_hashes(b"")) == 1
