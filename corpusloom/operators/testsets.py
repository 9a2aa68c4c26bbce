"""Worksheets for human raters: pools, samples without reuse, keys and agreement by sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lineage import numbered

from corpusloom.functions.labels import is_therapist


def pool(segments: DataFrame, kind: str) -> DataFrame:
    """What a kind of worksheet draws from: labels, moves or codes."""
    named = F.length(F.trim(F.coalesce("speaker", F.lit("")))) > 0
    if kind == "labels":
        return segments.where(named & ~is_therapist(F.col("speaker")))
    if kind == "moves":
        return segments.where(is_therapist(F.col("speaker")) & F.col("move").isNotNull())
    if kind == "codes":
        return segments.where(named & ~is_therapist(F.col("speaker")) & (F.size("codes") > 0))
    raise ValueError(f"no pool of {kind}")


def without(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Rows whose (session_id, segment_index) no earlier worksheet holds."""
    return rows.join(used.select("session_id", "segment_index").distinct(), ["session_id", "segment_index"], "left_anti")


def slice_of(rows: DataFrame, stratum: str, share: float, number: int, seed: int = 42) -> DataFrame:
    """The ``number``-th run of round(n * share), at least one, of each stratum in a seeded order.

    Runs of different numbers do not overlap, and together they take a stratum whole.
    """
    w = Window.partitionBy(stratum)
    place = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("segment_id"))), "segment_id")) - 1
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share + 0.5))
    return rows.withColumn("_p", place).withColumn("_s", size).where((F.col("_p") >= F.col("_s") * number) & (F.col("_p") < F.col("_s") * (number + 1))).drop("_p", "_s")


def worksheet(rows: DataFrame, number: int, seed: int = 42) -> DataFrame:
    """Items of one worksheet in a seeded order: worksheet_n, item_num, session_id, seg_num (from 1), sha.

    Rows are range-sorted by a digest of their id and numbered range by range.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:{number}:"), F.col("segment_id")))
    slim = rows.select("segment_id", "session_id", (F.col("segment_index") + 1).alias("seg_num"), F.sha2("text", 256).alias("sha"), digest.alias("_digest"))
    placed = numbered(slim, [F.col("_digest"), F.col("segment_id")], "item_num")
    return placed.select(F.lit(number).alias("worksheet_n"), F.col("item_num").cast("int").alias("item_num"), "session_id", "seg_num", "sha")


def resolved(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Items with their segment; ``state`` is ok, drift or unresolved."""
    s = segments.select("session_id", (F.col("segment_index") + 1).alias("seg_num"), "segment_id", F.sha2("text", 256).alias("_now"))
    j = items.join(s, ["session_id", "seg_num"], "left")
    state = F.when(F.col("segment_id").isNull() | F.col("sha").isNull(), "unresolved").when(F.col("sha") != F.col("_now"), "drift").otherwise("ok")
    return j.select("worksheet_n", "item_num", "segment_id", state.alias("state"))


def nested_items(items: DataFrame) -> DataFrame:
    """One row per worksheet with its ordered items."""
    return items.groupBy("worksheet_n").agg(F.count("*").alias("n_items"), F.transform(F.array_sort(F.collect_list(F.struct("item_num", "session_id", "seg_num"))), lambda x: F.concat_ws(":", x["session_id"], x["seg_num"].cast("string"))).alias("items"))


def agreement_by_sheet(votes: DataFrame) -> DataFrame:
    """Krippendorff's alpha and share of agreeing pairs for every worksheet (worksheet_n, item, label)."""
    counts = votes.where("label is not null").groupBy("worksheet_n", "item", "label").agg(F.count("*").alias("c"))
    unit = counts.groupBy("worksheet_n", "item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    seen = unit.groupBy("worksheet_n").agg(F.count("*").alias("units"), F.sum("n").alias("total"), F.sum(F.col("same") / (F.col("n") - 1)).alias("same"), F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("pairwise"))
    marginal = counts.join(unit.select("worksheet_n", "item"), ["worksheet_n", "item"]).groupBy("worksheet_n", "label").agg(F.sum("c").alias("m")).groupBy("worksheet_n").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("chance"))
    expected = 1 - F.col("chance") / (F.col("total") * (F.col("total") - 1))
    alpha = F.when(expected == 0, 1.0).otherwise(1 - (1 - F.col("same") / F.col("total")) / expected)
    return seen.join(marginal, "worksheet_n").select("worksheet_n", "units", F.round("pairwise", 6).alias("pairwise"), F.round(alpha, 6).alias("alpha"))


def grouped_by_rater(codes: DataFrame) -> DataFrame:
    """Codes of each worksheet item as a map from rater to label, consensus rows left out."""
    own = codes.where("not is_consensus and label is not null").groupBy("worksheet_n", "item", "rater").agg(F.max("label").alias("label"))
    return own.groupBy("worksheet_n", "item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rater", "label")))).alias("votes"))
