import random

import numpy as np

from corpusloom.llm import quality

SCHEMA = "doc_id long, text string, pattern string, score string, kept string"


def corpus(n=300, seed=0):
    rng = random.Random(seed)
    words = ["of", "and", "water", "people", "stone", "the", "river", "is", "letter", "in", "music", "walking"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", str(rng.randrange(9))]) for _ in range(rng.randrange(40, 200)))
        kind = i % 5
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        elif kind == 1:
            text = " ".join(f"{w}###" for w in text.split())
        rows.append((i, text, kind > 1))
    return rows


def test_bad_documents_are_found_without_labels(spark):
    rows = corpus()
    got = quality.classify(spark.createDataFrame([(i, t, "p", "s", "k") for i, t, _ in rows], SCHEMA)).collect()
    good = {i: g for i, _, g in rows}
    assert len(got) == len(rows)
    assert np.mean([r.kept == good[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.posterior <= 1 and 0 <= r.score <= 1 for r in got)


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.7
    accuracy = [0.9, 0.8, 0.75, 0.7, 0.6]
    patterns = {}
    for t in truth:
        v = [int(t) if rng.random() < a else 1 - int(t) for a in accuracy]
        v = [2 if rng.random() < 0.3 else x for x in v]
        k = quality.pattern(v)
        patterns[k] = patterns.get(k, 0) + 1
    _, table, prior = quality.label_model(patterns, 5)
    # Given that a labeller votes, its share of right votes follows its accuracy.
    right = [(table[i, 1, 1] / table[i, 1, :2].sum() + table[i, 0, 0] / table[i, 0, :2].sum()) / 2 for i in range(5)]
    assert np.abs(np.array(right) - accuracy).max() < 0.05


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "short text of a few words here"), (4, "word " * 100_000)]
    got = quality.classify(spark.createDataFrame([(i, t, "p", "s", "k") for i, t in rows], SCHEMA)).collect()
    assert len(got) == 6 and all(r.score is not None for r in got)
    assert quality.classify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_do_not_decide_the_fit(spark):
    rows = corpus(400)
    own = {t: r.kept for (_, t, _), r in zip(rows, quality.classify(spark.createDataFrame([(i, t, "p", "s", "k") for i, t, _ in rows], SCHEMA), fit_docs=150).collect())}
    for ident in (None, 7):
        got = quality.classify(spark.createDataFrame([(ident, t, "p", "s", "k") for _, t, _ in rows], SCHEMA), fit_docs=150).collect()
        assert len(got) == len(rows) and len({r.score for r in got}) > 100
        assert np.mean([r.kept == g for r, (_, _, g) in zip(got, rows)]) > 0.95
    assert np.mean([own[t] == g for _, t, g in rows]) > 0.95
