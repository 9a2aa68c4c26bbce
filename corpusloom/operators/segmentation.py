"""From sentences to segments: curves, boundaries, islands, splits and merges.

Rows are sentences: session_id, place, speaker, text, words, start and end in
seconds, and ``vector``, the encoder's output. Every session is one ordered run.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusloom.functions.text import sentence_list
from corpusloom.operators.lineage import materialize
from corpusloom.operators.ordered import ordered_fold

MAX_GAP, SILENCE_MS, MIN_WORDS, MAX_WORDS, MAX_SECONDS, SHIFT = 30.0, 2000.0, 12, 60, 300.0, 0.25
#: Places of a sentence's sketch.
SKETCH = 32


@lru_cache(maxsize=1 << 16)
def _slot(feature: bytes) -> int:
    """A feature's place, plus SKETCH where its sign is minus: the last bits of the first eight digits of its md5."""
    return int.from_bytes(md5(feature).digest()[:4], "big") % (2 * SKETCH)


@F.pandas_udf(ArrayType(DoubleType()))
def _sketches(texts: pd.Series) -> pd.Series:
    slots, sizes = [], []
    for text in texts:
        words = text.split() if text is not None else []
        slots += map(_slot, words)
        slots += map(_slot, map(b" ".join, zip(words, words[1:])))
        sizes.append(max(0, 2 * len(words) - 1))
    flat = np.repeat(np.arange(len(sizes)) * 2 * SKETCH, sizes) + np.asarray(slots, dtype=np.int64)
    signed = np.bincount(flat, minlength=len(sizes) * 2 * SKETCH).reshape(-1, 2, SKETCH)
    counts = (signed[:, 0] - signed[:, 1]).astype(float)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pd.Series(list(np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)))


def sketch(text: Column) -> Column:
    """Unit vector of a text's words and pairs of adjacent words, hashed to SKETCH places with a sign each.

    Place and sign come from the first eight digits of the feature's md5. A text without
    words, or whose signs cancel out, gives zeros. Words are counted in Arrow batches: as
    an expression each of the places would go over all words again.
    """
    return _sketches(text.cast("binary"))


def sentences(segments: DataFrame) -> DataFrame:
    """The sentences of every segment in order, its time shared out evenly."""
    parts = sentence_list(F.col("text"))
    rows = segments.withColumn("parts", parts).select("session_id", "speaker", "segment_index", "start_ms", "end_ms", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "text"))
    step = (F.col("end_ms") - F.col("start_ms")) / F.col("n") / 1000
    rows = rows.select("session_id", "speaker", F.trim("text").alias("text"), (F.col("segment_index") * 1000 + F.col("i")).cast("long").alias("place"), (F.col("start_ms") / 1000 + F.col("i") * step).alias("start"), (F.col("start_ms") / 1000 + (F.col("i") + 1) * step).alias("end"))
    return rows.withColumn("words", F.size(F.split("text", r"\s+"))).withColumn("vector", sketch(F.lower("text")))


def _mean_dot(a: Column, b: Column) -> Column:
    """Dot product of the means of two lists of vectors."""
    add = lambda vs: F.aggregate(vs, F.transform(F.get(vs, F.lit(0)), lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    total = F.aggregate(F.zip_with(add(a), add(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return total / (F.size(a) * F.size(b))


def curves(rows: DataFrame, span: int = 3) -> DataFrame:
    """``rows`` with ``pause_ms`` to the next sentence and ``similarity`` of the ``span`` sentences on both sides of the gap.

    Both are null after a session's last sentence.
    """
    w = Window.partitionBy("session_id").orderBy("place")
    left, right = F.collect_list("vector").over(w.rowsBetween(1 - span, 0)), F.collect_list("vector").over(w.rowsBetween(1, span))
    out = rows.withColumn("pause_ms", F.greatest(F.lit(0.0), F.lead("start").over(w) - F.col("end")) * 1000).withColumn("next_speaker", F.lead("speaker").over(w))
    out = out.withColumn("_l", left).withColumn("_r", right)
    return out.withColumn("similarity", F.when(F.size("_r") > 0, F.round(_mean_dot(F.col("_l"), F.col("_r")), 6))).withColumn("pause_ms", F.when(F.size("_r") > 0, F.round("pause_ms", 3))).drop("_l", "_r")


def minima(curve: DataFrame) -> DataFrame:
    """Sentences after which the similarity is lower than on both sides."""
    w = Window.partitionBy("session_id").orderBy("place")
    low = (F.col("similarity") < F.lag("similarity").over(w)) & (F.col("similarity") < F.lead("similarity").over(w))
    return curve.withColumn("low", F.coalesce(low, F.lit(False))).where("low").select("session_id", "place", "similarity")


def candidates(curve: DataFrame, max_gap: float = MAX_GAP, silence_ms: float = SILENCE_MS, shift: float = SHIFT, topics: DataFrame | None = None) -> DataFrame:
    """``curve`` with ``forced`` (speaker change or long gap) and ``soft`` (silence, or similarity below the session's quantile).

    The boundaries of ``topics`` (session_id, place) are soft ones too.
    """
    # A window over the session, not a join: the curve is made once.
    r = curve.withColumn("limit", F.percentile("similarity", shift).over(Window.partitionBy("session_id")))
    forced = (F.col("next_speaker") != F.col("speaker")) | (F.col("pause_ms") > max_gap * 1000)
    soft = (F.col("pause_ms") > silence_ms) | (F.col("similarity") < F.col("limit"))
    if topics is not None:
        r = r.join(topics.select("session_id", "place", F.lit(True).alias("_topic")), ["session_id", "place"], "left")
        soft = F.coalesce(soft, F.lit(False)) | F.coalesce("_topic", F.lit(False))
    return r.withColumn("forced", F.coalesce(forced, F.lit(False))).withColumn("soft", F.coalesce(soft, F.lit(False))).drop("_topic")


def boundary_confidence(curve: DataFrame, broad_span: int = 6, max_gap: float = MAX_GAP, shift: float = SHIFT) -> DataFrame:
    """confident where the speaker changes, the gap is long, or the broad curve dips too; else ambiguous."""
    broad = curves(curve.drop("pause_ms", "next_speaker", "similarity"), broad_span).select("session_id", "place", F.col("similarity").alias("broad"))
    limit = broad.groupBy("session_id").agg(F.percentile("broad", shift).alias("broad_limit"))
    r = candidates(curve, max_gap=max_gap, shift=shift).where("forced or soft").join(broad, ["session_id", "place"]).join(limit, "session_id")
    sure = F.col("forced") | F.coalesce(F.col("broad") < F.col("broad_limit"), F.lit(False))
    return r.select("session_id", "place", F.when(sure, "confident").otherwise("ambiguous").alias("confidence"))


def _segment_number(min_words: int):
    def step(state, row):
        number, words = state
        words += row["words"]
        value = number
        if row["forced"] or (row["soft"] and words >= min_words):
            number, words = number + 1, 0
        return (number, words), value

    return step


def numbered(marked: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``marked`` with ``segment``: a forced boundary always ends one, a soft one after ``min_words`` words."""
    return ordered_fold(marked, "session_id", ["place"], ["words", "forced", "soft"], lambda: (0, 0), _segment_number(min_words), "segment", "long")


def split_long(rows: DataFrame, max_words: int = MAX_WORDS, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Segments over the limits cut at their middle sentence, again and again; ``part`` tells the halves.

    Every round is one window over the segments; rounds grow with the log of the
    longest segment's sentences, which is what the driver asks for.
    """
    rows = materialize(rows.withColumn("part", F.lit("0")))
    longest = rows.groupBy("session_id", "segment").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, int(longest - 1).bit_length())):
        w = Window.partitionBy("session_id", "segment", "part")
        size, place = F.count("*").over(w), F.row_number().over(w.orderBy("place"))
        over = (F.sum("words").over(w) > max_words) | (F.max("end").over(w) - F.min("start").over(w) > max_seconds)
        half = F.when(place <= F.floor(size / 2), "0").otherwise("1")
        rows = rows.withColumn("part", F.when(over & (size > 1), F.concat("part", half)).otherwise(F.col("part")))
    return rows


def built(rows: DataFrame) -> DataFrame:
    """One row per segment: session_id, first_place, speaker, text, words, start, end."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c])
    return rows.groupBy("session_id", "segment", "part").agg(
        F.min("place").alias("first_place"), F.min_by("speaker", "place").alias("speaker"), F.array_join(ordered("text"), " ").alias("text"),
        F.sum("words").alias("words"), F.min("start").alias("start"), F.max("end").alias("end"),
    ).drop("segment", "part")


def merge_short(segments: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``segments`` with ``group``: short ones join the one before of the same speaker, a leading short one the next."""
    w = Window.partitionBy("session_id").orderBy("first_place")
    short = F.col("words") < min_words
    back = short & (F.lag("speaker").over(w) == F.col("speaker"))
    r = segments.withColumn("_g", F.sum(F.when(F.coalesce(back, F.lit(False)), 0).otherwise(1)).over(w))
    g = r.groupBy("session_id", "_g").agg(F.sum("words").alias("_w"), F.min("speaker").alias("_s"))
    v = Window.partitionBy("session_id").orderBy("_g")
    forward = (F.lag("_w").over(v) < min_words) & (F.lag("_s").over(v) == F.col("_s"))
    g = g.withColumn("group", F.sum(F.when(F.coalesce(forward, F.lit(False)), 0).otherwise(1)).over(v)).select("session_id", "_g", "group")
    return r.join(g, ["session_id", "_g"]).drop("_g")


def merged(segments: DataFrame) -> DataFrame:
    """One row per group of ``merge_short``."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("first_place", "text"))), lambda x: x["text"])
    return segments.groupBy("session_id", "group").agg(F.min("first_place").alias("first_place"), F.min_by("speaker", "first_place").alias("speaker"), F.array_join(text, " ").alias("text"), F.sum("words").alias("words"), F.count("*").alias("pieces"))


def fold_short(rows: DataFrame, least: int = 4) -> DataFrame:
    """``rows`` with ``into``: the place that a sentence is folded into, its own when it is long enough.

    A short one goes to the nearer long neighbour in time of its own speaker, else
    of anyone; the earlier one of equal distance. Without any it stays.
    """
    w = Window.partitionBy("session_id")
    before, after = w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1), w.orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    own = Window.partitionBy("session_id", "speaker")
    own_before, own_after = own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1), own.orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    long = F.when(F.col("words") >= least, F.struct("place", "start", "end"))

    def nearer(b: Column, a: Column) -> Column:
        return F.when(b.isNull(), a["place"]).when(a.isNull() | (F.col("start") - b["end"] <= a["start"] - F.col("end")), b["place"]).otherwise(a["place"])

    mine = nearer(F.last(long, True).over(own_before), F.first(long, True).over(own_after))
    any_ = nearer(F.last(long, True).over(before), F.first(long, True).over(after))
    return rows.withColumn("into", F.when(F.col("words") >= least, F.col("place")).otherwise(F.coalesce(mine, any_, F.col("place"))))


def segment_sessions(rows: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """All steps: curves, boundaries, segments, splits and merges of short ones."""
    return merged(merge_short(built(split_long(numbered(candidates(curves(rows)), min_words), max_words)), min_words))


def coherence(segments: DataFrame, low: float = 0.3, slack: float = 0.1, least_parts: int = 4) -> DataFrame:
    """split, keep or ask for each segment with ``least_parts`` sentences, by the similarity of adjacent ones.

    split where the lowest is under ``low``; keep where it is within ``slack`` of the
    mean; else a scorer is to be asked. ``at`` is the number of sentences before the lowest gap.
    """
    parts = segments.select("segment_id", F.posexplode(sentence_list(F.col("text"))).alias("i", "s")).withColumn("v", sketch(F.lower("s")))
    w = Window.partitionBy("segment_id").orderBy("i")
    nxt = F.lead("v").over(w)
    dot = F.aggregate(F.zip_with("v", nxt, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    per = parts.withColumn("sim", F.round(dot, 6)).groupBy("segment_id").agg(F.count("*").alias("parts"), F.min("sim").alias("lowest"), F.avg("sim").alias("mean"), F.min_by("i", F.struct("sim", "i")).alias("gap")).where(F.col("parts") >= least_parts)
    verdict = F.when(F.col("lowest") < low, "split").when(F.col("lowest") > F.round(F.col("mean"), 6) - slack, "keep").otherwise("ask")
    gap = parts.withColumn("sim", F.round(dot, 6)).where("sim is not null").groupBy("segment_id").agg(F.min_by("i", F.struct("sim", "i")).alias("at0"))
    return per.join(gap, "segment_id").select("segment_id", "parts", "lowest", verdict.alias("verdict"), (F.col("at0") + 1).alias("at"))


def split_at(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Two rows for each segment in ``cuts`` (segment_id, at): sentences before and after, time cut at its middle.

    The second row's id ends in ``_split``; its cohort is not carried over.
    """
    parts = sentence_list(F.col("text"))
    joined = segments.join(cuts.select("segment_id", "at"), "segment_id", "left")
    mid = ((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    first = F.struct(F.col("segment_id").alias("id"), F.array_join(F.slice(parts, F.lit(1), F.col("at")), " ").alias("text"), F.col("start_ms").alias("s"), mid.alias("e"), F.col("cohort_id").alias("c"))
    second = F.struct(F.concat("segment_id", F.lit("_split")).alias("id"), F.array_join(F.slice(parts, F.col("at") + 1, F.greatest(F.size(parts), F.lit(1))), " ").alias("text"), mid.alias("s"), F.col("end_ms").alias("e"), F.lit(None).cast("int").alias("c"))
    whole = F.struct(F.col("segment_id").alias("id"), F.col("text"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("cohort_id").alias("c"))
    out = joined.select("session_id", F.explode(F.when(F.col("at").isNull(), F.array(whole)).otherwise(F.array(first, second))).alias("x"))
    return out.select("session_id", F.col("x.id").alias("segment_id"), "x.text", F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"), F.col("x.c").alias("cohort_id"))


def merge_flagged(segments: DataFrame, flags: DataFrame, near_ms: int = 2000) -> DataFrame:
    """``segments`` with ``group``: neighbours of one speaker join where a flagged time (session_id, at_ms) lies near their edge."""
    w = Window.partitionBy("session_id").orderBy("segment_index")
    r = segments.withColumn("_pe", F.lag("end_ms").over(w)).withColumn("_ps", F.lag("speaker").over(w))
    edges = r.where("_ps = speaker").select("session_id", "segment_index", "start_ms", "_pe")
    close = (F.abs(F.col("at_ms") - F.col("start_ms")) <= near_ms) | (F.abs(F.col("at_ms") - F.col("_pe")) <= near_ms)
    hit = edges.join(flags.select("session_id", "at_ms"), "session_id").where(close).select("session_id", "segment_index").distinct().withColumn("_hit", F.lit(True))
    joined = r.join(hit, ["session_id", "segment_index"], "left")
    return joined.withColumn("group", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w)).drop("_pe", "_ps", "_hit")


def speaker_lines(segments: DataFrame) -> DataFrame:
    """Runs of one speaker's segments as lines ``speaker: text``."""
    w = Window.partitionBy("session_id").orderBy("segment_index")
    r = segments.withColumn("_new", F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(True)).cast("int")).withColumn("line", F.sum("_new").over(w))
    text = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda x: x["text"])
    return r.groupBy("session_id", "line", "speaker").agg(F.concat_ws(": ", F.first("speaker"), F.array_join(text, " ")).alias("text"), F.count("*").alias("turns")).drop("speaker")


def context_before(segments: DataFrame, k: int = 3, budget: int = 30) -> DataFrame:
    """The ``k`` segments before each one, from the nearest back while the words last; the last one cut at its end."""
    w = Window.partitionBy("session_id").orderBy("segment_index").rowsBetween(-k, -1)
    before = F.reverse(F.collect_list(F.split("text", r"\s+")).over(w))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("out"))

    def step(acc, words):
        kept = F.slice(words, F.lit(1), F.greatest(acc["left"], F.lit(0)))
        return F.struct((acc["left"] - F.size(kept)).alias("left"), F.when(F.size(kept) > 0, F.concat(F.array(F.array_join(kept, " ")), acc["out"])).otherwise(acc["out"]).alias("out"))

    return segments.select("segment_id", F.array_join(F.aggregate(before, start, step, lambda acc: acc["out"]), "\n").alias("context"))


def boundary_agreement(a: DataFrame, b: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """Jaccard of two sets of boundaries (session_id, at_ms), matched one to one within the tolerance.

    Both sides are walked in order by time: a match takes the nearest free boundary
    ahead. Both empty give no row.
    """
    both = a.select("session_id", "at_ms", F.lit(0).alias("side")).distinct().union(b.select("session_id", "at_ms", F.lit(1)).distinct())

    def step(state, row):
        queue = [x for x in state if row["at_ms"] - x[0] <= tolerance_ms]
        for i, (_, side) in enumerate(queue):
            if side != row["side"]:
                del queue[i]
                return queue, 1
        return [*queue, (row["at_ms"], row["side"])], 0

    m = ordered_fold(both, "session_id", ["at_ms", "side"], ["at_ms", "side"], list, step, "hit", "int")
    per = m.groupBy("session_id").agg(F.sum("hit").alias("matched"), F.count("*").alias("n"))
    return per.select("session_id", "matched", F.round(F.col("matched") / (F.col("n") - F.col("matched")), 6).alias("jaccard"))


def overlap_labels(new: DataFrame, canon: DataFrame) -> DataFrame:
    """Labels of old segments projected on new ones (session_id, new_id, start_ms, end_ms, text).

    Weight: token Jaccard plus a millionth of the shared milliseconds; the heaviest
    label wins, the smallest of equal ones; the coordinate is the weighted mean.
    Without overlap the label is null.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0)))
    c = canon.select("session_id", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce"), tokens(F.col("text")).alias("ct"), "label")
    j = new.withColumn("nt", tokens(F.col("text"))).join(c, "session_id").where((F.col("cs") < F.col("end_ms")) & (F.col("ce") > F.col("start_ms")))
    shared = F.size(F.array_intersect("nt", "ct")) / F.greatest(F.size(F.array_union("nt", "ct")), F.lit(1))
    ms = F.least("end_ms", "ce") - F.greatest("start_ms", "cs")
    w = j.withColumn("w", shared + ms * 1e-6).where("label is not null")
    by = w.groupBy("new_id", "label").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("x"))
    best = by.groupBy("new_id").agg(F.min_by("label", F.struct(-F.round("w", 9), "label")).alias("projected"), F.round(F.sum("x") / F.sum("w"), 6).alias("coordinate"))
    return new.select("new_id").join(best, "new_id", "left")


def nearest_unit(new: DataFrame, canon: DataFrame) -> DataFrame:
    """Nearest old segment of each new one by the middle of their time, the earlier of equal ones.

    Both are laid on one time line of the session, where a window finds the last old
    segment before and the first one after; no pairs are made. Sessions without old
    segments give null.
    """
    middle = (F.col("start_ms") + F.col("end_ms")) / 2
    old = canon.select("session_id", middle.alias("at"), F.struct(middle.alias("at"), F.col("segment_id").alias("id")).alias("unit"), F.lit(None).cast("string").alias("new_id"))
    line = old.union(new.select("session_id", middle.alias("at"), F.lit(None).cast(old.schema["unit"].dataType).alias("unit"), F.col("new_id").cast("string")))
    # Of old segments with one middle the first id counts on both sides.
    w = Window.partitionBy("session_id").orderBy("at", F.col("unit").isNull(), F.desc("unit.id"))
    v = Window.partitionBy("session_id").orderBy(F.desc("at"), F.col("unit").isNull(), F.desc("unit.id"))
    line = line.withColumn("before", F.last("unit", True).over(w)).withColumn("after", F.last("unit", True).over(v)).where("unit is null")
    near = F.when(F.col("before").isNull(), F.col("after.id")).when(F.col("after").isNull(), F.col("before.id"))
    return line.select("new_id", near.when(F.col("at") - F.col("before.at") <= F.col("after.at") - F.col("at"), F.col("before.id")).otherwise(F.col("after.id")).alias("nearest_id"))
