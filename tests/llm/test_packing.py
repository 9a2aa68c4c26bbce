import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, uid string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def test_ids_equal_the_tokenizer_library():
    rng = random.Random(1)
    texts = ["", " ", "It's they're we'll I'd", "a  b\n\n c\t", "été Straße 漢字 🙂 ١٢٣", "<|endoftext|> x", "''s 's ''", "x" * 3000, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000))]
    library = Tokenizer.from_file(PATH)
    for t in texts:
        assert packing.encoder(PATH)(t) == library.encode(t, add_special_tokens=False).ids


def check(rows, got, capacity=1024):
    """Pieces rebuild the documents; sequences are gapless and within capacity."""
    library = Tokenizer.from_file(PATH)
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert len({i for i, _ in rows}) == len(docs)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seqs)


def best_fit(lengths, capacity=1024):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_packs_about_as_well_as_sequential_best_fit(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "straße", "x1"]) for _ in range(int(rng.expovariate(1 / 250))))) for i in range(300)] + [(1000, None), (1001, "")]
    got = packing.pack(frame(spark, rows), PATH).collect()
    used = check(rows, got)
    assert used <= best_fit([r.length for r in got]) * 1.01 + 1


def test_many_short_documents(spark):
    rows = [(i, "word " * (i % 7)) for i in range(900)]
    got = packing.pack(frame(spark, rows), PATH).collect()
    assert check(rows, got) <= -(-sum(r.length for r in got) // 1024) + 1


def test_repeated_null_and_empty(spark):
    got = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert sorted(((r.doc_id or 0), r.length) for r in got) == [(0, 2), (1, 3), (1, 3)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 3 and len({r.sequence_id for r in got}) == 1
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_exact_multiples(spark):
    docs = frame(spark, [(1, " a" * 1023), (2, " a" * 1024), (3, " a" * 2047)])
    got = sorted((r.doc_id, r.piece, r.start, r.length) for r in packing.pack(docs, PATH).collect())
    assert got == [(1, 0, 0, 1024), (2, 0, 0, 1), (2, 1, 1, 1024), (3, 0, 0, 1024), (3, 1, 1024, 1024)]
