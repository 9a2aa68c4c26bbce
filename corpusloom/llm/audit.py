"""What each of five filters removes in each of their orders.

Duplicates are found by partition refinement: classes of equal code-point length are
split by the hashes of successive blocks of the text, and a class of one row is
dropped as soon as it stands alone. Whole texts of what survives are compared with
the text of their class's smallest id.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._session import materialize, skew_join, small_side

# The filters by letter.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
ODD = re.compile(rb"[#$%&*|]")
#: Bytes of the first block; each further one is BLOCK_GROWTH times as long.
BLOCK, BLOCK_GROWTH = 512, 8
HASH_BITS = 64

PROFILE = "doc_id bigint, part string, fails string, length bigint, blocks array<bigint>"


def block_hashes(data: bytes, bits: int = HASH_BITS) -> list[int]:
    """Hashes of successive blocks that cover all of ``data``, one at least."""
    out, start, size = [], 0, BLOCK
    while start < len(data) or not out:
        digest = int.from_bytes(hashlib.blake2b(data[start : start + size], digest_size=8).digest(), "little", signed=True)
        out.append(digest >> (HASH_BITS - bits))
        start, size = start + size, size * BLOCK_GROWTH
    return out


def own_failures(data: bytes) -> tuple[str, int]:
    """Letters of the filters A to D that a text of UTF-8 bytes fails, and its code points."""
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    points = int(np.count_nonzero((raw & 0xC0) != 0x80))
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    fails = "A" * (len(words) < LEAST_WORDS) + "B" * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
    return fails + "C" * (100 * capitals > CAPITAL_PERCENT * points) + "D" * bool(ODD.search(data)), points


def _profiles(with_text: bool, bits: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = [(*own_failures(data), block_hashes(data, bits)) for data in ((t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts)]
            cols = [batch.column("doc_id"), batch.column("part"), pa.array([f for f, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([b for _, _, b in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.compute.coalesce(texts, "")] if with_text else [])], names=["doc_id", "part", "fails", "length", "blocks", *(["text"] if with_text else [])])

    return run


def profiles(docs: DataFrame, with_text: bool = False, bits: int = HASH_BITS) -> DataFrame:
    """PROFILE of every row: its part, own failures, code points, block hashes, and the text where asked for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_profiles(with_text, bits), PROFILE + (", text string" if with_text else ""))


def refined(rows: DataFrame) -> DataFrame:
    """Classes of several rows that length and all block hashes leave: length, chain, n, least.

    Round k splits the classes by the hash of block k; rows alone in their class go.
    Counts come from partial aggregates, and adaptive execution may split a class's
    rows in the join that follows, so a class may hold most of the table.
    """
    rows = rows.select("doc_id", "length", "blocks", F.lit(0).cast("long").alias("chain"))
    level = -1
    while True:
        shared = rows.groupBy("length", "chain").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        rows = materialize(skew_join(rows, shared, ["length", "chain"], "left_semi"))
        level += 1
        if rows.where(F.size("blocks") > level).isEmpty():
            return rows.groupBy("length", "chain").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
        rows = rows.withColumn("chain", F.when(F.size("blocks") > level, F.xxhash64("chain", F.get("blocks", F.lit(level)))).otherwise(F.col("chain")))


def _chain(blocks):
    """The chain of all blocks, as ``refined`` builds it."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda chain, block: F.xxhash64(chain, block))


def duplicates(docs: DataFrame, rows: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """Rows whose whole text a smaller doc_id has: doc_id, part, fails.

    Texts are read again only to be compared within the classes that ``refined``
    leaves. A class whose rows differ after all, by clashing hashes, is gone through
    text by text: those equal to its smallest id's text are settled, the rest follow.
    """
    classes = materialize(refined(rows).where("least is not null"))
    texts = profiles(docs, True, bits).withColumn("chain", _chain(F.col("blocks"))).drop("blocks")
    texts = texts.join(small_side(classes.select("length", "chain"), classes.count()), ["length", "chain"], "left_semi")
    found = None
    while True:
        firsts = texts.join(small_side(classes.select("length", "chain", F.col("least").alias("doc_id")), classes.count()), ["length", "chain", "doc_id"], "left_semi")
        # One text of the smallest id; where it has several, the largest.
        firsts = firsts.groupBy("length", "chain").agg(F.max("text").alias("first_text"), F.min("doc_id").alias("least"))
        paired = skew_join(texts, firsts, ["length", "chain"]).withColumn("same", F.col("text") == F.col("first_text"))
        state = materialize(paired.select("length", "chain", "doc_id", "part", "fails", "same", (F.col("same") & (F.col("doc_id") > F.col("least"))).alias("copy")))
        hits = state.where("copy").select("doc_id", "part", "fails")
        found = hits if found is None else found.union(hits)
        rest = state.where("not same and doc_id is not null")
        if rest.isEmpty():
            return found
        classes = materialize(rest.groupBy("length", "chain").agg(F.min("doc_id").alias("least")))
        texts = paired.where("not same").select(*texts.columns)


def failure_counts(docs: DataFrame, labels: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """Documents by part, failed filters (letters in order) and labels: part, fails, good, toxic, n."""
    rows = materialize(profiles(docs, bits=bits))
    copies = duplicates(docs, rows, bits)
    signed = rows.select("doc_id", "part", "fails", F.lit(1).cast("long").alias("n"))
    signed = signed.union(copies.select("doc_id", "part", "fails", F.lit(-1).cast("long"))).union(copies.select("doc_id", "part", F.concat("fails", F.lit("E")), F.lit(1).cast("long")))
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    signed = signed.groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n")).where("n > 0")
    joined = skew_join(signed, marked, ["doc_id"], "left")
    return joined.groupBy("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """``counts`` (part, fails, good, toxic, n) as one row per part, order of the filters and step.

    A document falls to the first filter of an order that it fails. Over all orders
    each of its m failing filters comes first equally often, in 120 / m of them.
    """
    every = ["".join(p) for p in permutations(FILTERS)]
    at = F.col("place")
    rows = counts.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(every) * len(FILTERS) - 1))))
    rows = rows.withColumn("step", (at % len(FILTERS) + 1).cast("int")).withColumn("filter_order", F.get(F.split(F.lit(",".join(every)), ","), F.floor(at / len(FILTERS)).cast("int")))
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    passed = F.expr("translate(substring(filter_order, 1, step - 1), fails, '') = substring(filter_order, 1, step - 1)")
    failing = F.contains("fails", own)

    def total(condition, n=F.col("n")):
        return F.sum(F.when(condition, n).otherwise(F.lit(0))).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(passed & ~failing).alias("kept"),
        total(passed & failing).alias("removed"),
        total(~passed & failing).alias("redundant"),
        total(F.col("fails") == own).alias("unique_fails"),
        total(passed & failing & (F.col("good") == 1)).alias("good_lost"),
        total(passed & failing & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(failing, F.expr(f"n * {len(every)} div length(fails)")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` holds doc_id, text and lang, ``labels`` doc_id, quality and toxic. A null
    text is an empty one, and all empty texts are identical; a null lang is the part
    of the empty string. A row without id is never a copy, nor is another row a copy
    of it, and it has no label; rows that repeat an id are documents of their own, and
    not copies of each other. An id that has several labels is good or toxic where one of
    them says so. Columns of other names are left; an empty table gives no rows.
    ``bits`` of the block hashes decide how many classes only whole texts can part, never the result.
    """
    return orders(failure_counts(docs, labels, bits))
