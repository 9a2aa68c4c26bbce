import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


def targets(sizes):
    """Water filling by repeated resharing."""
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [k for k in order if k not in fixed]
        left = budget - sum(fixed.values())
        share = {k: left * weight[k] / sum(weight[r] for r in rest) for k in rest}
        over = [k for k in rest if share[k] > 2 * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: 2.0 * sizes[k] for k in over}


def corpus():
    rows = []
    for i in range(400):
        source = ["a", "b", "ä", None, "z"][min(i % 7, 4)]
        rows.append((i, " ".join(["w"] * (i * i % 97 + (0 if i % 50 else 3000))), source))
    return rows + [(400, None, "empty"), (401, " \n", "empty"), (7, rows[7][1], rows[7][2])]


def test_targets_and_taken_words(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_one_hot_length_is_split_by_salt(spark):
    rows = [(i, "one two", "s") for i in range(3000)] + [(5000, "one", "t")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert abs(sum(r.taken for r in got) - 1.5 * 6001) <= 2


def test_mixed_documents_repeat_rows(spark):
    docs = frame(spark, corpus())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


def test_null_and_repeated_ids_and_any_column(spark):
    names = ["_times", "_copy", "payload", "rank", "times", "skey"]
    rows = [(None if i % 3 else 7, "w " * (i % 5 + 1), "s" if i % 2 else None, *names) for i in range(300)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in names)}")
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixing.mix(docs).collect())
    assert all(tuple(r)[3:] == tuple(names) for r in out) and mixing.mixed_documents(docs).columns == docs.columns


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 6)), max_size=8), st.integers(0, 900))
def test_subset_fits_as_well_as_brute_force(lengths, budget):
    lengths = list(dict(lengths).items())
    taken = mixing.fit_subset(lengths, budget)
    counts = dict(lengths)
    assert all(0 < k <= counts[n] for n, k in taken.items())
    got = sum(n * k for n, k in taken.items())
    assert got <= budget
    reach = {0}
    for n, c in lengths:
        reach = {x + n * k for x in reach for k in range(c + 1)}
    assert got == max(x for x in reach if x <= budget)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9000), st.integers(1, 40)), min_size=1, max_size=40), st.floats(0.05, 0.99))
def test_large_budgets_keep_the_mix_of_lengths(lengths, share):
    lengths = list(dict(lengths).items())
    budget = int(sum(n * c for n, c in lengths) * share)
    taken = mixing.fit_subset(lengths, budget)
    got, longest = sum(n * k for n, k in taken.items()), max(n for n, _ in lengths)
    assert all(0 < k <= dict(lengths)[n] for n, k in taken.items()) and got <= budget and budget - got < longest
    below = 0
    for n, c in sorted(lengths):
        below += n * c
        words = sum(m * k for m, k in taken.items() if m <= n)
        assert -longest - mixing.RESERVE <= words - share * below <= longest + mixing.RESERVE
