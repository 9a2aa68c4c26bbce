"""Families of tests, resampling and trends over grouped rows."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions import stats as S


@F.pandas_udf(DoubleType())
def sign_probability(positive: pd.Series, negative: pd.Series) -> pd.Series:
    """Exact two-sided sign test of each row's counts."""
    return pd.Series([S.sign_test(int(a), int(b)) for a, b in zip(positive, negative)], dtype="float64")


def benjamini_hochberg(rows: DataFrame, p: str, family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """``rows`` with ``q`` and ``rejected`` within each family; null probabilities stay null.

    A family's rows are ranked in one task each: families are tables of tests,
    which don't grow with the corpus.
    """
    keys = family or []
    known = F.col(p).isNotNull()
    every = Window.partitionBy(*keys, known)
    w = every.orderBy(p)
    raw = F.col(p) * F.count("*").over(every) / F.row_number().over(w)
    ranked = rows.withColumn("_raw", raw).withColumn("_n", F.row_number().over(w))
    down = Window.partitionBy(*keys, known).orderBy(F.desc("_n"))
    q = F.least(F.lit(1.0), F.min("_raw").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("q", F.when(known, F.round(q, 6))).withColumn("rejected", F.coalesce(F.col("q") <= alpha, F.lit(False))).drop("_raw", "_n")


def cramers_v(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared, Cramer's V and size of two labels' table."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = r.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("na")), cells.groupBy("b").agg(F.sum("o").alias("nb"))
    n = cells.agg(F.sum("o").alias("n"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    # sum of o^2 / (na * nb) over the cells that occur gives chi-squared without the empty ones
    part = cells.join(ra, "a").join(rb, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb"))).alias("s"))
    chi2 = F.col("n") * (F.col("s") - 1)
    least = F.least("ka", "kb") - 1
    return part.crossJoin(n).select("n", F.round(chi2, 6).alias("chi2"), F.round(F.when(least > 0, F.sqrt(chi2 / (F.col("n") * least))).otherwise(0.0), 6).alias("v"))


def cliffs_delta(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(# greater - # smaller) / pairs between groups true and false, from ranks of value counts."""
    c = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.sum(F.col(group).cast("long")).alias("t"), F.sum((~F.col(group)).cast("long")).alias("f"))
    below = F.coalesce(F.sum("f").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = c.withColumn("below", below).withColumn("all_f", F.sum("f").over(Window.partitionBy(F.lit(1))))
    out = s.agg(F.sum(F.col("t") * (F.col("below") - (F.col("all_f") - F.col("below") - F.col("f")))).alias("d"), F.sum("t").alias("n_true"), F.max("all_f").alias("n_false"))
    return out.select("n_true", "n_false", F.round(F.col("d") / (F.col("n_true") * F.col("n_false")), 6).alias("delta"))


def within_between(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Group mean and deviation from it of each row."""
    mean = F.avg(value).over(Window.partitionBy(group))
    return rows.withColumn("between", F.round(mean, 6)).withColumn("within", F.round(F.col(value) - mean, 6))


#: Cumulative probabilities of a Poisson draw of mean one, from none to eight.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9))


def drawn_times(cluster: Column, draw: Column, seed: int) -> Column:
    """How often a cluster is in a draw: Poisson of mean one, from a digest of seed, draw and cluster; once in draw -1.

    The digest is bound in an array of one element, so that the nine comparisons share it.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), cluster.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    times = F.get(F.transform(F.array(u), lambda x: sum(((x >= F.lit(c)).cast("int") for c in POISSON[1:]), (x >= F.lit(POISSON[0])).cast("int"))), F.lit(0))
    return F.when(draw < 0, 1).otherwise(times)


def with_draws(rows: DataFrame, cluster: str, draws: int, seed: int) -> DataFrame:
    """``rows`` in every draw that has them: draw (-1: the rows as they are) and times, each digest taken once."""
    every = F.transform(F.sequence(F.lit(-1), F.lit(draws - 1)), lambda d: F.struct(d.alias("draw"), drawn_times(F.col(cluster), d, seed).alias("times")))
    return rows.withColumn("_d", F.explode(F.filter(every, lambda x: x["times"] > 0))).select(*rows.columns, "_d.draw", "_d.times")


#: Keys whose sums a task holds before it hands them on.
HELD_KEYS = 512
#: Rows whose weights are laid out at once.
LAID_OUT = 1024


def drawn_sums(rows: DataFrame, keys: list[str], cluster: str, values: list[str], draws: int, seed: int) -> DataFrame:
    """Sums of ``values`` (double) and number of rows (``clusters``) of each key in every draw that has it: keys, draw, values, clusters.

    ``rows`` has one row for each key and cluster. The draws are those of ``with_draws``, but no row is
    repeated: a task takes a cluster's digests once for all of its rows and hands on sums by key and draw,
    so what is shuffled grows with the rows, and with keys times draws, but not with rows times draws.
    """
    names = [f"_v{i}" for i in range(len(values))]
    dealt = rows.select(*keys, F.col(cluster).cast("string").alias("_c"), *[F.col(v).cast("double").alias(n) for v, n in zip(values, names)])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "_c").sortWithinPartitions("_c")
    limits, starts = np.array(POISSON), [f"{seed}:{d}".encode() for d in range(draws)]
    kinds = dict(rows.dtypes)

    def times_of(name: str | None) -> np.ndarray:
        tail = b"" if name is None else b":" + name.encode()
        digests = b"".join([md5(x + tail).digest()[:4] for x in starts])
        return np.append(1, np.searchsorted(limits, np.frombuffer(digests, ">u4") / float(1 << 32), side="right"))

    def handed_on(sums: dict, schema: dict):
        for key, s in sums.items():
            at = np.flatnonzero(s[-1])
            columns = [pa.array([x] * len(at), schema[k]) for x, k in zip(key, keys)]
            columns += [pa.array(at - 1, pa.int32()), *[pa.array(v[at]) for v in s[:-1]], pa.array(s[-1][at].astype("int64"))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "draw", *names, "_clusters"])

    def run(batches):
        sums, schema, known, times = {}, {}, object(), None
        for batch in batches:
            schema = {k: batch.schema.field(k).type for k in keys}
            clusters, found = batch.column("_c").to_pylist(), list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * len(batch)
            # A null value adds nothing to a sum.
            x = np.vstack([*[np.nan_to_num(batch.column(n).to_numpy(zero_copy_only=False), nan=0.0) if batch.column(n).null_count else batch.column(n).to_numpy(zero_copy_only=False) for n in names], np.ones(len(batch))])
            for low in range(0, len(batch), LAID_OUT):
                high, weights, by_key = min(low + LAID_OUT, len(batch)), [], {}
                for i in range(low, high):
                    if clusters[i] != known:
                        known = clusters[i]
                        times = times_of(known)
                    weights.append(times)
                    by_key.setdefault(found[i], []).append(i - low)
                weights = np.array(weights, dtype=float)
                for key, at in by_key.items():
                    w = weights[at]
                    part = np.vstack([x[:-1, low:high][:, at] @ w, (w > 0).sum(axis=0)])
                    sums[key] = sums[key] + part if key in sums else part
                if len(sums) > HELD_KEYS:
                    yield from handed_on(sums, schema)
                    sums = {}
        yield from handed_on(sums, schema)

    out = dealt.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "draw int", *[f"{n} double" for n in names], "_clusters long"]))
    return out.groupBy(*keys, "draw").agg(*[F.sum(n).alias(v) for n, v in zip(names, values)], F.sum("_clusters").alias("clusters"))


def cluster_bootstrap(rows: DataFrame, keys: list[str], cluster: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of each group, whole clusters being resampled.

    Clusters are summed first; how often a draw takes one follows a digest, so draws
    are summed by shuffle like any group and no task holds all clusters.
    Below two clusters the interval is null.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_n"))
    drawn = drawn_sums(sums, keys, cluster, ["_s", "_n"], draws, seed).select(*keys, "draw", F.col("_s").alias("s"), F.col("_n").cast("long").alias("n"), "clusters")
    mean, real = F.col("s") / F.col("n"), F.col("draw") < 0
    own = lambda c: F.max(F.when(real, F.col(c)))
    out = drawn.groupBy(*keys).agg(own("n").alias("n"), own("clusters").alias("clusters"), F.max(F.when(real, mean)).alias("mean"), F.percentile(F.when(~real, mean), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    bound = lambda i: F.when(F.col("clusters") > 1, F.round(F.get("q", F.lit(i)), 6))
    return out.select(*keys, "n", "clusters", F.round("mean", 6).alias("mean"), bound(0).alias("low"), bound(1).alias("high"))


def permutation_test(rows: DataFrame, stratum: str, group: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Two-sided probability that a stratum's groups true and false have one mean.

    The groups' labels are dealt anew over the distinct values' counts
    (hypergeometric draws), so a task holds the counts and not the rows.
    """
    counts = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(stratum, F.col(value).cast("double").alias("x")).agg(F.sum(F.col(group).cast("long")).alias("t"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, t, n = pdf["x"].to_numpy(), pdf["t"].to_numpy(), pdf["n"].to_numpy()
        a, b = t.sum(), (n - t).sum()
        out = {stratum: pdf[stratum].iloc[0], "n_true": int(a), "n_false": int(b), "difference": None, "p": None}
        if a and b:
            diff = lambda k: (k @ x) / a - ((n - k) @ x) / b
            real = diff(t)
            drawn = np.random.default_rng(seed).multivariate_hypergeometric(n, int(a), draws, method="marginals")
            out |= {"difference": round(float(real), 6), "p": round((1 + int((np.abs(diff(drawn)) >= abs(real) - 1e-12).sum())) / (draws + 1), 6)}
        return pd.DataFrame([out])

    kind = dict(rows.dtypes)[stratum]
    return counts.groupBy(stratum).applyInPandas(run, f"{stratum} {kind}, n_true long, n_false long, difference double, p double")
