import itertools
import math
import random
import zlib

import numpy as np

from corpusloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, held_out string, score string"
WORDS = {
    "en": "the of and that was with this have from which there their would about people water".split(),
    "de": "der die das und nicht werden eine sich auch durch zwischen über straße können müssen".split(),
    "fr": "le les des une dans pour avec être où était cette aussi très même français leur".split(),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k, "h", "s") for i, t, k in rows], SCHEMA)


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.choice([3, 20, 200]))), k if rng.random() > 0.05 else None))
    return rows


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def truth(text):
    return max(WORDS, key=lambda k: sum(w in WORDS[k] for w in text.split()))


def test_held_out_accuracy(spark):
    rows = corpus()
    got = langid.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in text if zlib.crc32(str(i).encode()) % 4 == 2} and len(held) > 50
    assert np.mean([r.lang_pred == truth(text[r.doc_id]) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_and_labels_of_others_change_nothing(spark):
    rows = corpus()
    a = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, rows)).collect()}
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows]
    assert a == {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, changed)).collect()}


def test_edges(spark):
    rows = corpus() + [(900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "the " * 50_000, None), (None, "der die das und", "de"), (5, corpus()[5][1], "fr")]
    got = langid.identify(frame(spark, rows)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 900}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "de"]
    kept = langid.keep_identified(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(frame(spark, [])).count() == 0
    assert [r.lang_pred for r in langid.identify(frame(spark, [(1, "abc", None)])).collect()] == ["und"]


def test_mixture_recovers_proportions():
    rng = np.random.default_rng(0)
    model = rng.dirichlet(np.ones(200) * 0.3, 4).T + 1e-6
    model /= model.sum(0)
    counts = rng.multinomial(20_000, model @ np.array([0.7, 0.0, 0.3, 0.0]))
    seen = np.flatnonzero(counts)
    shares, _ = langid.mixture(seen, counts[seen], model)
    assert set(shares) == {0, 2} and abs(shares[0] - 0.7) < 0.03
    single = rng.multinomial(20_000, model[:, 1])
    assert set(langid.mixture(np.flatnonzero(single), single[single > 0], model)[0]) == {1}


def test_rows_are_kept_by_their_own_text(spark):
    rng = random.Random(8)
    known = [(i, text(rng, k, 80), k) for i in range(300) for k in [rng.choice(sorted(WORDS))]]
    mixed = " ".join(text(rng, k, 40) for k in sorted(WORDS))
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzßñ0123456789") for _ in range(9)) for _ in range(60))
    rows = known + [(500, mixed, None), (501, noise, None), (502, "--- 12 ---", "en"), (503, None, "en"), (503, mixed, "en"), (None, mixed, None), (None, noise, None)]
    docs = frame(spark, rows)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.where("doc_id is null or doc_id >= 500").collect()), key=str) == [500, 503, None]
    assert kept.where("doc_id < 500").count() == len(known)


def test_identify_matches_a_plain_recount(spark):
    """Model, likelihoods and mixture weights recomputed by dictionaries and plain loops."""
    rng = random.Random(9)
    rows = [(i, text(rng, k, rng.choice([3, 20, 60])), k) for i in range(200) for k in [rng.choice(sorted(WORDS))]]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    counts = {}
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for b, n in zip(*langid.ngram_counts(t)):
                counts.setdefault(k, {}).setdefault(int(b), 0)
                counts[k][int(b)] += int(n)
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) + langid.SMOOTH * langid.BUCKETS for k in langs}
    for i, t, _ in rows:
        grams = [(int(b), int(n)) for b, n in zip(*langid.ngram_counts(t))]
        p = {k: [(counts[k].get(b, 0) + langid.SMOOTH) / total[k] for b, _ in grams] for k in langs}
        single = {k: sum(n * math.log(x) for (_, n), x in zip(grams, p[k])) for k in langs}
        # Every set of languages, each with its weights by many EM steps; the best by penalised likelihood.
        best, lang = None, None
        size = sum(n for _, n in grams)
        for m in range(1, len(langs) + 1):
            for chosen in itertools.combinations(langs, m):
                w = {k: 1 / m for k in chosen}
                for _ in range(200 if m > 1 else 1):
                    mix = [sum(w[k] * p[k][j] for k in chosen) for j in range(len(grams))]
                    w = {k: sum(n * w[k] * p[k][j] / mix[j] for j, (_, n) in enumerate(grams)) / size for k in chosen}
                value = sum(n * math.log(x) for (_, n), x in zip(grams, [sum(w[k] * p[k][j] for k in chosen) for j in range(len(grams))])) - (m - 1) * (langid.PENALTY + langid.PENALTY_SHARE * size)
                if best is None or value > best:
                    best, lang = value, max(w, key=w.get)
        assert got[i].lang_pred == lang, (i, single)


def test_null_and_repeated_ids_teach_like_others(spark):
    rows = corpus()
    truth = {t: k for _, t, k in rows if k and len(t.split()) > 10}
    for ident in (None, 1):
        got = langid.identify(frame(spark, [(ident, t, k) for _, t, k in rows]), fit_docs=20).collect()
        preds = [(r.lang_pred, truth[t]) for r, (_, t, _) in zip(got, rows) if t in truth]
        assert len(got) == len(rows) and sum(a == b for a, b in preds) > 0.95 * len(preds)
        assert langid.keep_identified(frame(spark, [(ident, t, k) for _, t, k in rows]), 20).count() > 0.9 * len(rows)
