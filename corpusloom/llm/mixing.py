"""Mixing sources to target weights by whole documents.

Documents are counted by source and exact length. Each source takes its
documents as often as its target allows in full; what remains is first spread
over the lengths in proportion to their words, and the last words (RESERVE and
what the spreading leaves) are fitted by a bounded knapsack over the lengths'
remaining documents. Which documents of a
length are taken follows a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._session import materialize, skew_join, with_position

# The weights, repeating over the sources by code point.
WEIGHTS = (3, 1, 2)
SHARE, REPEATS, SEED = 1.5, 2, 17
#: Words of each source that the subset sum fits besides what is left of the proportional part.
RESERVE = 1 << 14
#: Documents of one source, length and salt that a task ranks, about.
GROUP_ROWS = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def fit_subset(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents of each length (length, count) add up to nearly ``budget`` words.

    Never more than ``budget``. All but RESERVE words are taken in proportion: the
    words so far follow the lengths' share so far, so what is left over is less than
    one document. A bounded subset sum over bits fits that and the reserve exactly
    where the remaining documents allow it.
    """
    lengths = sorted((n, c) for n, c in lengths if n > 0 and c > 0)
    total = sum(n * c for n, c in lengths)
    if budget <= 0 or not total:
        return {}
    spread, seen, used, taken = min(max(0, budget - RESERVE), total), 0, 0, {}
    for n, c in lengths:
        seen += n * c
        taken[n] = min(c, (spread * seen // total - used) // n)
        used += n * taken[n]
    left = budget - used
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for n, c in lengths:
        free, chunk = min(c - taken[n], left // n), 1
        while free and not reach >> left & 1:
            k = min(chunk, free)
            wider = (reach | reach << n * k) & mask
            if wider != reach:
                steps.append((n, k, reach))
                reach = wider
            free, chunk = free - k, chunk * 2
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return {n: k for n, k in taken.items() if k}


_PLAN = T.ArrayType(T.StructType([T.StructField("size", T.LongType()), T.StructField("extra", T.LongType())]))


@F.udf(returnType=_PLAN)
def _extras(lengths, rest):
    return sorted(fit_subset([(x["size"], x["n"]) for x in lengths], int(rest)).items())


def source_targets(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares by weight under caps.

    The level at which capped sources stop is raised until no other source is
    above its cap; each round only two sums reach the driver.
    """
    placed = with_position(sources, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    placed = materialize(placed.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * repeats).cast("double")))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        row = placed.agg(F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(over.cast("long"))).first()
        if not row[0] or row[2] == capped:
            break
        level, capped = (share * total - row[1]) / row[0], row[2]
    return placed.withColumn("target", F.least(F.col("weight") * level, F.col("cap"))).drop("position", "weight", "cap")


def _taken(docs: DataFrame, payload: Column, share: float, repeats: int, seed: int, slim: bool = False) -> DataFrame:
    """``payload`` of every row of ``docs`` with size, source_size, target and times.

    Only one shuffle moves the payload: rows are ranked within their source, size
    and salt, and that group's share of the takes comes to them by the same keys.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    base = docs.select(payload.alias("payload"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("digest"), source.alias("source"), size.alias("size"))
    base = base.withColumn("skey", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))).withColumn("h", F.xxhash64(F.lit(seed), "id", "size"))
    if slim:
        base = materialize(base)
    salts = max(16, (base if slim else docs).count() // GROUP_ROWS)
    base = base.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed + 1), "h", "digest"), F.lit(salts).cast("long")))
    groups = materialize(base.groupBy("skey", "source", "size", "salt").agg(F.count("*").alias("n")))
    lengths = groups.groupBy("skey", "source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.collect_list(F.struct("size", "n")).alias("lengths"))
    sources = source_targets(sources, share, repeats)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    rest = F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    plan = materialize(sources.withColumn("full", full).withColumn("extras", F.when(F.col("full") < repeats, _extras(F.array_sort("lengths"), rest)).otherwise(F.array().cast("array<struct<size: bigint, extra: bigint>>"))))

    extras = plan.select("skey", F.explode("extras").alias("x")).select("skey", "x.size", "x.extra")
    before = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    quota = skew_join(groups.select("skey", "size", "salt", "n"), extras, ["skey", "size"], "left").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = quota.select("skey", "size", "salt", F.greatest(F.lit(0), F.least("n", F.coalesce("extra", F.lit(0)) - F.col("before"))).alias("quota"))
    quota = materialize(skew_join(quota, plan.select("skey", "source_size", "target", "full"), ["skey"]))
    rank = F.row_number().over(Window.partitionBy("skey", "size", "salt").orderBy("h", "id", "digest"))
    times = F.when(F.col("size") > 0, F.col("full") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)).otherwise(0)
    return base.withColumn("rank", rank).join(quota, ["skey", "size", "salt"]).select("payload", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    ``taken`` is 0 to ``repeats`` times the size. A null source is a source of its
    own, the last one. Null and wordless texts have size 0 and take nothing. Ties
    of the hash go by doc_id, then by text; repeated rows are documents of their own. An empty
    table gives no rows. The same rows give the same result on every run.
    """
    rows = _taken(docs, F.col("doc_id"), share, repeats, seed, slim=True)
    return rows.select(F.col("payload").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time a document is taken.

    Every row goes by its own decision, also where ids repeat or are null, so the
    rows hold exactly the words of ``mix``. Null and wordless texts are in no row.
    Columns of any name keep their values; an empty table gives no rows.
    """
    rows = _taken(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), share, repeats, seed).where("times > 0")
    return rows.select("payload", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).select("payload.*")
