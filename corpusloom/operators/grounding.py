"""Texts that hold given passages whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Passages whose keys go to every task as one array of longs (under 1 MB).
FEW_PASSAGES = 100_000
GRAM = 3


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _word_keys(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words."""
    last = F.size(words) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def _letter_keys(text: Column) -> Column:
    """Hashes of the text's code points."""
    return F.transform(F.split(text, ""), lambda c: F.xxhash64(c))


def _matches(texts: DataFrame, passages: DataFrame, keys) -> DataFrame:
    """Candidates share a key; the passage is looked for in the text itself."""
    if passages.isEmpty():
        return texts.crossJoin(passages.select("item_id", "passage").limit(0)).select("item_id")
    if passages.count() <= FEW_PASSAGES:
        wanted = F.broadcast(passages.agg(F.collect_set("key").alias("wanted")))
        hits = texts.crossJoin(wanted).withColumn("key", F.explode(F.array_intersect(keys, "wanted"))).drop("wanted")
        found = hits.join(F.broadcast(passages), "key")
    else:
        hits = texts.withColumn("key", F.explode(F.array_distinct(keys)))
        found = hits.join(passages, "key")
    return found.where(F.contains("t", "passage")).select("item_id")


def passages_in_texts(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """One row (item_id) for every row of ``texts`` (text) and passage (item_id, passage) it holds, lower-cased.

    A passage may begin and end within a word of the text, so only its inner words
    stand whole there: passages of five words or more are looked up by their second
    to fourth word, those of three or four by their second, shorter ones by their
    first letter. Few passages go to the tasks and texts are not shuffled; many
    meet the texts' keys in a join. Null texts and passages match nothing, an empty
    passage is in every text, and repeated rows count as rows.
    """
    p = passages.select("item_id", F.lower("passage").alias("passage")).where("passage is not null")
    p = p.withColumn("words", F.split("passage", " "))
    d = texts.select(F.lower("text").alias("t")).where("t is not null")
    many, some = F.size("words") >= GRAM + 2, F.size("words") >= 3
    word = lambda n: F.xxhash64(*[F.get("words", F.lit(1 + k)) for k in range(n)])
    classes = (
        (p.where(many), word(GRAM), _bound(F.split("t", " "), lambda w: _word_keys(w, GRAM))),
        (p.where(~many & some), word(1), _bound(F.split("t", " "), lambda w: _word_keys(w, 1))),
        (p.where(~some & (F.length("passage") > 0)), F.xxhash64(F.substring("passage", 1, 1)), _letter_keys(F.col("t"))),
    )
    found = [_matches(d, rows.select("item_id", "passage", key.alias("key")), keys) for rows, key, keys in classes]
    empty = p.where("passage = ''").select("item_id")
    out = found[0].union(found[1]).union(found[2])
    return out if empty.isEmpty() else out.union(d.select(F.lit(1).alias("one")).join(F.broadcast(empty)).select("item_id"))
