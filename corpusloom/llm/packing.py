"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._session import constants, materialize, text_batches, with_position

CAPACITY, EOS = 1024, 2
_encoders: dict[str, object] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """Function from a text to its ids by the byte-level BPE file of ``tokenizers``.

    The file's vocabulary is given to tiktoken, which yields the same ids several
    times faster. Strings of special tokens in a text become those tokens, as they
    do in ``tokenizers``.
    """
    if path not in _encoders:
        import json

        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        model = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            return model.encode(text, allowed_special="all") if any(s in text for s in special) else model.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def _cut(path: str, capacity: int, eos: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), eos], "<u4")
                start, end, piece = 0, (len(ids) - 1) % capacity + 1, 0
                while start < len(ids):
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """One row per piece of each document's ids with the end id: PIECES.

    Documents over ``capacity`` ids are cut into full pieces after a first one
    that may be shorter. A null text is an empty one: the end id alone.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(tokenizer_path, capacity, eos), PIECES)


def _ladder(counts: dict[tuple[int, int], int], capacity: int) -> tuple[list[int], list[int]]:
    """By size * 2 + kind: rows before that size and kind in the walk, and the level there."""
    starts, levels = [0] * (2 * capacity + 2), [0] * (2 * capacity + 2)
    place = level = 0
    for size, kind in sorted(counts, key=lambda c: (-c[0], c[1])):
        starts[2 * size + kind], levels[2 * size + kind] = place, level
        place += counts[size, kind]
        level += counts[size, kind] * (1 if kind == 0 else -1)
    return starts, levels


def _round(open_pieces: DataFrame, slots: DataFrame, counts: dict[tuple[int, int], int], capacity: int) -> DataFrame:
    """Match pieces to slots of gaps, one piece a slot: the largest piece first, each to its successor.

    Sizes are walked downwards, slots before pieces of the same size. A slot raises
    the level by one, a piece lowers it; a piece takes the last slot that raised the
    level to where the piece finds it, which is the smallest free one that holds
    it. Rows are range-sorted, so a row's place in the walk and the counts of the
    larger sizes (``counts`` by size and kind) give its level, and every row finds its
    partner by one sort within its level, to which a size adds two rows at most.
    """
    rows = open_pieces.select(F.lit(1).alias("kind"), F.col("length").alias("size"), F.col("uid").alias("id"), "doc_id", "ids_crc32", F.lit(None).cast("long").alias("gap")).union(
        slots.select(F.lit(0).alias("kind"), F.col("size"), F.col("seq").alias("id"), F.lit(None).cast("long"), F.lit(None).cast("long"), "gap")
    )
    rows = with_position(rows, [F.desc("size"), F.col("kind"), F.col("id")])
    starts, levels = (constants(x) for x in _ladder(counts, capacity))
    at = (F.col("size") * 2 + F.col("kind")).cast("int")
    place, base = F.col("position") - F.get(starts, at), F.get(levels, at)
    rows = rows.withColumn("level", F.when(F.col("kind") == 0, base + place + 1).otherwise(base - place))
    turn = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    return rows.select(
        "kind", "size", "id", "doc_id", "ids_crc32", "gap",
        F.lag("kind").over(turn).alias("gap_kind"), F.lag("id").over(turn).alias("gap_id"),
        F.when(F.lead("kind").over(turn) == 1, F.lead("size").over(turn)).otherwise(F.lit(0)).alias("taken"),
    )


def _parts(gap: int, longest: int, most: int) -> int:
    """Slots of a gap, as ``_slots`` has it."""
    return max(1, min(gap // longest, most))


def _slots(gaps: DataFrame, longest: int, most: int) -> DataFrame:
    """A row for each equal part of a gap: as many as hold the longest waiting piece, ``most`` at most.

    A gap narrower than two such pieces is one slot, as in plain best fit; a wide one
    takes several pieces in a round.
    """
    parts = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / longest), F.lit(most))).cast("int")
    return gaps.withColumn("parts", parts).select("seq", "gap", F.floor(F.col("gap") / F.col("parts")).alias("size"), F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part")).drop("part")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset, in as few sequences as best fit finds.

    Full pieces and pieces over half the capacity open sequences of their own. Then
    rounds follow: remaining pieces are matched to slots of the gaps, gaps shrink, and
    for pieces that no gap can hold any more as many empty sequences open as their
    words need at least. Offsets follow from the pieces of each sequence, 1,024 at
    most. The driver sees counts by size, ``capacity`` of them at most.
    """
    spark = pieces.sparkSession
    with text_batches(spark):
        pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = [pieces.where(F.col("length") * 2 > capacity).select(*columns, F.col("uid").alias("sequence_id"))]
    small = pieces.where(F.col("length") * 2 <= capacity).select("uid", "doc_id", "length", "ids_crc32")
    gaps = pieces.where((F.col("length") * 2 > capacity) & (F.col("length") < capacity)).select(F.col("uid").alias("seq"), (F.lit(capacity).cast("long") - F.col("length")).alias("gap"))
    opened = 0
    waiting, free = _sizes(small, gaps)
    while waiting:
        stuck = sum(k * n for k, n in waiting.items() if k > max(free, default=0))
        if stuck:
            n = -(-stuck // capacity)
            fresh = spark.range(opened, opened + n).select((-F.col("id") - 1).alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            gaps, opened = gaps.union(fresh), opened + n
            free[capacity] = free.get(capacity, 0) + n
        # Pieces only get fewer, so a gap below the least of them is done with.
        free = {k: n for k, n in free.items() if k >= min(waiting)}
        gaps = gaps.where(F.col("gap") >= min(waiting))
        longest, most = max(waiting), -(-2 * sum(waiting.values()) // sum(free.values()))
        counts = {(k, 1): n for k, n in waiting.items()}
        for k, n in free.items():
            parts = _parts(k, longest, most)
            counts[k // parts, 0] = counts.get((k // parts, 0), 0) + n * parts
        done = materialize(_round(small, _slots(gaps, longest, most), counts, capacity))
        taken = F.coalesce(F.col("gap_kind") == 0, F.lit(False))
        placed.append(done.where((F.col("kind") == 1) & taken).select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("size").alias("length"), "ids_crc32", F.col("gap_id").alias("sequence_id")))
        small = done.where((F.col("kind") == 1) & ~taken).select(F.col("id").alias("uid"), "doc_id", F.col("size").alias("length"), "ids_crc32")
        gaps = materialize(done.where("kind = 0").groupBy(F.col("id").alias("seq")).agg((F.max("gap") - F.sum("taken")).alias("gap")).where("gap > 0"))
        waiting, free = _sizes(small, gaps)
    out = placed[0]
    for part in placed[1:]:
        out = out.union(part)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _sizes(small: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Counts by size of the waiting pieces and of the gaps."""
    rows = small.select(F.lit(1).alias("kind"), F.col("length").alias("size")).union(gaps.select(F.lit(0), "gap")).groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
    return ({r["size"]: r["n"] for r in rows if r["kind"] == kind} for kind in (1, 0))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """Pieces of all documents with their sequences: PIECES, sequence_id, offset.

    Null and empty texts are one-id documents; repeated rows and null ids are
    documents of their own; an empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, eos), capacity)
