"""Packing of token sequences by lexical neighbours out of a sharded BM25 index.

Whole windows of long documents are sequences at once. What is left of each document,
a tail of less than a window, is packed with tails that share its telling terms: tails
are range-sorted by their heaviest terms, runs of SHARD of them are the shards, and
each shard holds an inverted index of its own with weights by the whole corpus's
counts. The unused tail of the lowest place is a seed; its best unused neighbours
fill the window, the last one is cut to fit. What a shard can't fill goes on to the next
shard of its range, and the ranges' rests are the tails of the next round.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._session import materialize, parallelism, text_batches
from corpusloom.llm.packing import encoder

CAPACITY, END = 1024, 0
#: Tails of one shard, and windows that its ids fill at least.
SHARD, LEAST = 512, 4
#: Ranges of the sort whose rests meet in one range of the next round.
FAN = 32
#: Neighbours that a window tries to take whole before one is cut.
LOOK = 16
#: Terms of a tail's place in the sort.
KEYS = 4
# The usual constants of BM25.
K1, B = 1.2, 0.75
#: Ids as the checksum takes them.
NUMBER = "<u4"

ROWS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
_SCHEMA = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in NAMES])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype(NUMBER).tobytes())


class _Numbers:
    """Sequence numbers that no other task and round gives."""

    def __init__(self, level: int):
        self.next = (level << 56) + (TaskContext.get().partitionId() << 32)

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types)], schema=_SCHEMA)


def _tokens(path: str, capacity: int, end: int):
    def run(batches):
        encode, numbers = encoder(path), _Numbers(0)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end], NUMBER)
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, _crc(ids[start : start + capacity]), len(ids), numbers.take(), 0, None))
                if whole < len(ids):
                    rows.append((doc, whole, len(ids) - whole, _crc(ids[whole:]), len(ids), None, None, ids[whole:].tobytes()))
            yield _batch(rows)

    return run


def _document_counts(batches):
    """Tails that hold each id, summed within the task."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column("ids"):
            terms = np.unique(np.frombuffer(ids.as_py(), NUMBER))
            if terms[-1] >= len(counts):
                counts = np.concatenate([counts, np.zeros(int(terms[-1]) + 1 - len(counts), np.int64)])
            counts[terms] += 1
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], names=["term", "n"])


def term_weights(tails: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Inverse document frequency and document count by term id, and the mean length.

    The driver gets one row a term of the vocabulary, and two sums.
    """
    n, size = tails.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    rows = tails.select("ids").mapInArrow(_document_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["term"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["term"]] = r["n"]
    return np.log1p((n - counts + 0.5) / (counts + 0.5)).astype(np.float32), counts, float(size)


def _saturated(tf: np.ndarray, length, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def heaviest(ids: np.ndarray, idf: np.ndarray, counts: np.ndarray, mean: float) -> list[int]:
    """The KEYS terms of most weight that other tails have too, the heaviest first."""
    terms, tf = np.unique(ids, return_counts=True)
    weight = np.where(counts[terms] > 1, idf[terms] * _saturated(tf, len(ids), mean), -1)
    best = np.argpartition(-weight, KEYS)[:KEYS] if len(weight) > KEYS else np.arange(len(weight))
    best = best[np.lexsort((terms[best], -weight[best]))]
    return [int(terms[i]) for i in best if weight[i] >= 0]


def _keyed(weights):
    def run(batches):
        idf, counts, mean = weights.value
        for batch in batches:
            keys = [heaviest(np.frombuffer(x.as_py(), NUMBER), idf, counts, mean) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return run


class Index:
    """Inverted index of one shard's tails: postings by term, weighted as BM25."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(tails)
        lengths = np.array([len(t) for t in tails])
        places = np.repeat(np.arange(self.n), lengths)
        pairs, tf = np.unique(np.concatenate(tails).astype(np.int64) * self.n + places, return_counts=True)
        terms, self.tail = np.divmod(pairs, self.n)
        self.weight = idf[terms] * _saturated(tf, lengths[self.tail], mean)
        fresh = np.flatnonzero(np.diff(terms, prepend=-1))
        self.first, self.size = fresh, np.diff(fresh, append=len(terms))
        order = np.argsort(self.tail, kind="stable")
        self.terms_of = np.split(np.repeat(np.arange(len(fresh)), self.size)[order], np.cumsum(np.bincount(self.tail, minlength=self.n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every tail for the seed's terms."""
        terms = self.terms_of[seed]
        size = self.size[terms]
        at = np.arange(size.sum()) + np.repeat(self.first[terms] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return np.bincount(self.tail[at], self.weight[at], self.n)


def fill_windows(tails: list[np.ndarray], idf: np.ndarray, mean: float, capacity: int = CAPACITY) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Windows of (tail, from, to), each full, and the (tail, from) that are left, of less than a window in all.

    The seed is the unused tail of the lowest place, from where an earlier window has
    cut it. Neighbours come by falling score, then by place: the first LOOK unused ones
    are taken where they fit whole, then the best of those that don't is cut to the room
    that is left; where all fitted, the next LOOK follow.
    """
    index = Index(tails, idf, mean)
    start, lengths = np.zeros(len(tails), np.int64), np.array([len(t) for t in tails])
    left, total, windows, seed = lengths.copy(), int(lengths.sum()), [], 0
    while total >= capacity:
        while not left[seed]:
            seed += 1
        window, room = [(seed, int(start[seed]), int(lengths[seed]))], capacity - int(left[seed])
        score = index.scores(seed)
        left[seed] = 0
        near = np.flatnonzero(left)
        near = near[np.argsort(-score[near], kind="stable")]
        for at in range(0, len(near), LOOK):
            missed = []
            for k in near[at : at + LOOK]:
                if room and left[k] <= room:
                    window.append((int(k), int(start[k]), int(lengths[k])))
                    room -= int(left[k])
                    left[k] = 0
                elif room:
                    missed.append(k)
            if room and missed:
                k, end = missed[0], int(start[missed[0]]) + room
                window.append((int(k), int(start[k]), end))
                left[k], start[k], room = left[k] - room, end, 0
            if not room:
                break
        windows.append(window)
        total -= capacity
    return windows, [(int(k), int(start[k])) for k in np.flatnonzero(left)]


def powers(rest: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """(tail, from, to) laid end to end and cut into windows whose sizes are powers of two."""
    total = sum(to - at for _, at, to in rest)
    out, waiting = [], list(reversed(rest))
    for bit in reversed(range(capacity.bit_length())):
        if total >> bit & 1:
            window, room = [], 1 << bit
            while room:
                tail, at, to = waiting.pop()
                if to - at > room:
                    waiting.append((tail, at + room, to))
                    to = at + room
                window.append((tail, at, to))
                room -= to - at
            out.append(window)
    return out


def _packed(weights, level: int, capacity: int, last: bool):
    def placed(held, windows, numbers):
        for window in windows:
            number, offset = numbers.take(), 0
            for k, at, to in window:
                doc, start, ids, tokens = held[k]
                yield doc, start + at, to - at, _crc(ids[at:to]), tokens, number, offset, None
                offset += to - at

    def shard(held, numbers):
        windows, rest = fill_windows([h[2] for h in held], *weights.value[::2], capacity)
        return list(placed(held, windows, numbers)), [(held[k][0], held[k][1] + at, held[k][2][at:], held[k][3]) for k, at in rest]

    def run(batches):
        numbers, held, size = _Numbers(level), [], 0
        for batch in batches:
            for row in batch.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                held.append((row["doc_id"], row["start"], np.frombuffer(row["ids"], NUMBER), row["doc_tokens"]))
                size += len(held[-1][2])
                if len(held) >= SHARD and size >= LEAST * capacity:
                    rows, held = shard(held, numbers)
                    size = sum(len(h[2]) for h in held)
                    yield _batch(rows)
        if held:
            rows, held = shard(held, numbers)
            yield _batch(rows)
        if last:
            yield _batch(list(placed(held, powers([(k, 0, len(h[2])) for k, h in enumerate(held)], capacity), numbers)))
        else:
            yield _batch([(doc, start, len(ids), _crc(ids), tokens, None, None, ids.tobytes()) for doc, start, ids, tokens in held])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two. Every sequence is full but those of the very last
    rest, whose sizes are different powers of two, so nothing is padded. A null text is
    an empty one, one id long. Repeated rows and null ids are documents of their own;
    columns of other names are left; an empty table gives no rows. Tails without a common
    term, and equal ones, go by their place in the sort. A task holds one shard. A range of
    the sort leaves less than a window, and FAN ranges meet in the next round, so a few
    rounds end with one range.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [*[F.get("keys", F.lit(k)) for k in range(KEYS)], F.desc("length"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    with text_batches(spark):
        rows = materialize(slim.mapInArrow(_tokens(tokenizer_path, capacity, end), ROWS))
        placed, tails = [rows.where("ids is null")], rows.where("ids is not null")
        waiting, level = tails.count(), 0
        weights = spark.sparkContext.broadcast(term_weights(tails))
        ranges = max(1, min(parallelism(spark), waiting // SHARD))
        while waiting:
            level, last = level + 1, ranges == 1
            keyed = tails.mapInArrow(_keyed(weights), ROWS + ", keys array<bigint>")
            # The range sort reads its rows twice, to find the ranges and to deal them.
            keyed = materialize(keyed) if level == 1 and not last else keyed
            dealt = keyed.repartitionByRange(ranges, *order) if level == 1 and not last else keyed.coalesce(ranges)
            rows = materialize(dealt.sortWithinPartitions(*order).mapInArrow(_packed(weights, level, capacity, last), ROWS))
            placed.append(rows.where("ids is null"))
            tails = rows.where("ids is not null")
            waiting, ranges = 0 if last else tails.count(), -(-rows.rdd.getNumPartitions() // FAN)
    out = placed[0]
    for part in placed[1:]:
        out = out.union(part)
    return out.drop("ids")
