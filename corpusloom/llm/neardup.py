"""MinHash near-duplicates through a multi-index Hamming join.

A document's signature holds CHUNKS * LANES min-hash symbols of SYMBOL_BITS bits,
LANES of them in one long per chunk. Two signatures that differ in at most
``2 * CHUNKS - 1`` symbols have, by pigeonhole, a chunk with at most one
differing symbol. Every chunk is indexed once for each lane left out, so such a
pair shares at least one key: no pair under that distance is missed. MORE further
symbols of few bits sharpen the distance that a candidate may have before its
full shingle sets are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._session import materialize, skew_join, small_side, text_batches
from corpusloom.llm.graph import forest_roots, merged
from corpusloom.llm.wordhash import mix, shingle_sets, sliced

CHUNKS, LANES, SYMBOL_BITS = 10, 6, 9
LANE = SYMBOL_BITS + 1  # a spare bit on top of each symbol takes the carry that shows a difference
WIDTH, PERCENT = 5, 85
MORE, MORE_BITS, MORE_LANES = 240, 3, 15
_CHUNK = [f"c{i}" for i in range(CHUNKS)]
_MORE = [f"e{i}" for i in range(MORE // MORE_LANES)]
_SIG = _CHUNK + _MORE
_FULL = sum(((1 << SYMBOL_BITS) - 1) << (LANE * i) for i in range(LANES))
_CARRY = sum((1 << SYMBOL_BITS) << (LANE * i) for i in range(LANES))
_MORE_FULL = sum(((1 << MORE_BITS) - 1) << ((MORE_BITS + 1) * i) for i in range(MORE_LANES))
_MORE_CARRY = sum((1 << MORE_BITS) << ((MORE_BITS + 1) * i) for i in range(MORE_LANES))

SET_SCHEMA = f"doc_id long, n_shingles long, h1 long, h2 long, {', '.join(f'{c} long' for c in _SIG)}"


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    n = CHUNKS * LANES + MORE
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def distance_limit(percent: int) -> int:
    """Symbols in which a pair at the similarity may differ: mean and 3.7 deviations."""
    apart = 1 - percent / 100
    parts = [(n, apart * (1 - 0.5**bits)) for n, bits in ((CHUNKS * LANES, SYMBOL_BITS), (MORE, MORE_BITS))]
    return int(sum(n * p for n, p in parts) + 3.7 * sum(n * p * (1 - p) for n, p in parts) ** 0.5)


def _signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), np.iinfo(np.uint64).max)
    for k in range(0, len(s), 1 << 10):
        low = np.minimum(low, (s[None, k : k + (1 << 10)] * mul[:, None] + add[:, None]).min(1))
    symbols, packed = mix(low), []
    for part, bits, lanes in ((symbols[: CHUNKS * LANES], SYMBOL_BITS, LANES), (symbols[CHUNKS * LANES :], MORE_BITS, MORE_LANES)):
        part = (part & np.uint64((1 << bits) - 1)).reshape(-1, lanes)
        packed.append((part << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits + 1))).sum(1, dtype=np.uint64))
    return np.concatenate(packed).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _describe(width: int):
    def run(batches):
        mul, add = _constants()
        for batch in batches:
            rows = []
            for part in sliced(_texts(batch)):
                for s in shingle_sets(part, width):
                    if len(s):
                        rows.append([len(s), int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)), *_signature(s, mul, add).tolist()])
                    else:
                        rows.append([0] + [None] * (2 + len(_SIG)))
            cols = list(zip(*rows)) if rows else [()] * (3 + len(_SIG))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n_shingles", "h1", "h2", *_SIG])

    return run


def _full_sets(width: int):
    def run(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            sets = [s.astype(np.int64) for part in sliced(_texts(batch)) for s in shingle_sets(part, width)]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))).cast(kind)], names=["id", "shingles"])

    return run


def _differing(a: str, b: str, full: int = _FULL, carry: int = _CARRY) -> Column:
    """Number of lanes in which two packed longs differ."""
    return F.bit_count((F.col(a).bitwiseXOR(F.col(b)) + F.lit(full)).bitwiseAND(F.lit(carry)))


def _close(percent: int) -> Column:
    """Sizes of a and b allow the similarity, and the signatures are within the distance limit."""
    sizes = (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * percent)
    apart = [_differing(f"{c}_a", f"{c}_b") for c in _CHUNK] + [_differing(f"{c}_a", f"{c}_b", _MORE_FULL, _MORE_CARRY) for c in _MORE]
    return sizes & (sum(apart[1:], apart[0]) <= distance_limit(percent))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of ``pairs`` (a, b and others) whose full shingle sets reach the similarity.

    The sets of b join first: a hub is the a of many pairs, and its set is then read
    beside them instead of being copied into a shuffle for each.
    """
    left, right = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    joined = skew_join(skew_join(pairs, right, ["b"]), left, ["a"])
    joined = joined.select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).alias("x"), (F.size("sa") + F.size("sb")).alias("both"))
    return joined.where(F.col("x") * 100 >= (F.col("both") - F.col("x")) * percent).select(*pairs.columns)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Equal shingle sets are one node first, named by their smallest doc_id, so
    copies never meet as pairs. Nodes sharing a key try the key's smallest node, its
    hub: the hub of most shared keys first, then those in other components.
    Candidates within the signature distance are confirmed on full sets, which are
    hashed once for all nodes that share a key. Last, all
    pairs of a key that lie in different components are tried too (pairs already
    joined cannot change a component), so no link is lost to the hubs.

    Null or empty texts have no shingles and link with nothing; rows with a null
    doc_id keep their count, take part in no link, get a null component_id and
    are kept. Repeated rows stay rows; rows of one doc_id with different texts are one
    document that links by any of them. Other columns of ``docs`` are ignored. An empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with text_batches(docs.sparkSession):
        base = materialize(docs.mapInArrow(_describe(width), SET_SCHEMA))
    nodes = materialize(base.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), *[F.max(c).alias(c) for c in _SIG]))
    slots = F.array(*[F.struct(F.lit(i * LANES + k).alias("slot"), F.xxhash64(F.lit(i * LANES + k), F.col(c).bitwiseAND(F.lit(_FULL & ~(((1 << LANE) - 1) << (LANE * k))))).alias("key")) for i, c in enumerate(_CHUNK) for k in range(LANES)])
    keys = nodes.select("id", F.explode(slots).alias("s")).select("id", F.col("s.slot").alias("slot"), F.col("s.key").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = materialize(skew_join(keys, hubs, ["key"]))
    sigs = nodes.select("id", "n", *_SIG)
    wanted = materialize(shared.select(F.col("id").alias("doc_id")).distinct())
    with text_batches(docs.sparkSession):
        sets = materialize(docs.join(small_side(wanted, wanted.count()), "doc_id", "left_semi").mapInArrow(_full_sets(width), "id long, shingles array<long>"))

    # A node first tries the hub that it shares most keys with; that settles most groups.
    stars = shared.where("id != hub").groupBy(F.col("id").alias("b"), F.col("hub").alias("a")).agg(F.count("*").alias("keys"))
    best = stars.groupBy("b").agg(F.min_by("a", F.struct(-F.col("keys"), "a")).alias("a"))
    parts = forest_roots(materialize(_confirm(best, sets, percent)), "b", "a")
    labelled = materialize(skew_join(shared, parts, ["id"], "left").withColumn("component", F.coalesce("component", "id")))

    # Then the hubs of other components.
    others = labelled.where("id != hub").groupBy(F.col("id").alias("b"), F.col("hub").alias("a")).agg(F.first("component").alias("part"))
    others = skew_join(others, parts.select(F.col("id").alias("a"), "component"), ["a"], "left").where(F.col("part") != F.coalesce("component", "a"))
    others = others.select("a", "b", F.col("part").alias("v"), F.coalesce("component", "a").alias("u"))
    close = skew_join(skew_join(others, _named(sigs, "b"), ["b"]), _named(sigs, "a"), ["a"]).where(_close(percent)).select(*others.columns)
    parts = merged(parts, _confirm(close, sets, percent).select("u", "v"))
    labelled = skew_join(shared.where("members > 2").select("id", "slot", "key"), parts, ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    labelled = materialize(labelled)

    # Of a key's components one is the main one; every pair of two components has a row outside of it.
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("components"), F.max_by("component", F.struct("size", "component")).alias("main")).where("components > 1").select("key", "main")
    rows = skew_join(skew_join(labelled, mixed, ["key"]), sigs, ["id"])
    rows = materialize(rows.withColumn("aside", F.col("component") != F.col("main")))
    chunk = F.floor(F.col("slot_a") / LANES)
    # A pair is taken at the first key that it shares, so it is made once.
    first = (_at(chunk, [_differing(f"{c}_a", f"{c}_b") for c in _CHUNK]) > 0) | (F.col("slot_a") % LANES == 0)
    for i, c in enumerate(_CHUNK[:-1]):
        first = first & ((chunk <= i) | (_differing(f"{c}_a", f"{c}_b") > 1))
    once = ~F.col("aside_a") | (F.col("a") < F.col("b"))
    left, right = (_named(rows.select("id", "n", *_SIG, "key", "slot", "component", "aside"), k) for k in "ab")
    more = left.join(right.where("aside_b"), (F.col("key_a") == F.col("key_b")) & once & (F.col("component_a") != F.col("component_b")) & _close(percent) & first)
    more = _confirm(more.select("a", "b", F.col("component_a").alias("u"), F.col("component_b").alias("v")), sets, percent)
    parts = merged(parts, more.select("u", "v"))

    named = skew_join(nodes.select("h1", "h2", "id"), parts, ["id"], "left").select("h1", "h2", F.coalesce("component", "id").alias("component_id"))
    alone = F.col("n_shingles").isNull() | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    linked = skew_join(base.where(~alone).select("doc_id", "n_shingles", "h1", "h2"), named, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    rest = base.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _named(nodes: DataFrame, end: str) -> DataFrame:
    """Columns of ``nodes`` with the end's letter: id as the letter, others with it behind."""
    return nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in nodes.columns if c != "id"])


def _at(index: Column, values: list[Column]) -> Column:
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, v)
    return out


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest doc_id's.

    Where that doc_id has repeated rows one of them stays. Documents that link
    with nothing all stay, as do rows with a null doc_id.
    """
    found = materialize(near_duplicates(docs, percent, width))
    gone = materialize(found.where("not kept").select("doc_id").distinct())
    again = materialize(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(small_side(gone, gone.count()), "doc_id", "left_anti")
    rows = again.count()
    if rows:
        once = left.join(small_side(again, rows), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(small_side(again, rows), "doc_id", "left_anti").unionByName(once)
    return left.select(*docs.columns)
