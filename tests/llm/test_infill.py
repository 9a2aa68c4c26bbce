import hashlib
import random
import re

import pytest

from corpusloom.llm import infill, queries
from tests.llm.test_sql import with_documents
from tests.parity import assert_same


def plainly(doc, text):
    """The transformation of one text by the contract's words."""
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, t
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def texts(seed):
    rng = random.Random(seed)
    letters = ["ab", "C", " ", "\n", "\r\n", "\t", "é", "漢", "🙂", "<", ">", "<S", "P>", "M", "\\", "'", "0", "\x00" if seed else "x"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(250)] + [None, "", "x", "<P>", "a<S>b", "<M>", "<<P", "<P" * 9, "S><", "word " * 40_000]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_the_plain_version(spark, seed):
    rows = list(enumerate(texts(seed))) + [(None, "no id here"), (3, "an id again"), (-5, "below zero"), (2**62, "large")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = sorted((str(r.doc_id), r.output, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in infill.fill_in_middle(docs).collect())
    want = []
    for i, t in rows:
        n, form, p, m, out = plainly(i, t)
        want.append((str(i), out, n, form, p, m, sha(out), sha(t or "")))
    assert [str(x) for x in got] == [str(x) for x in sorted(want)]
    assert {w[3] for w in want} == {"plain", "spm", "psm"}


def test_slices_of_a_batch_keep_every_row(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(infill, "PART", 10)
    batch = pa.record_batch({"doc_id": list(range(7)), "text": ["a" * 4, None, "b" * 30, "", "c" * 10, "d", "e" * 9]})
    parts = list(infill._parts(batch))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(7)) and len(parts) > 3
    assert list(infill._parts(batch.slice(0, 0))) == []


def test_sql_and_empty_table(spark):
    some = texts(0)[:80] + [None, "", "<P>"]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    assert_same(infill.fill_in_middle(docs, output=False), with_documents(some), queries.oracle_sql()["op12_fill_in_middle"])
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
