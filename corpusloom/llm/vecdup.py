"""Embedding near-duplicates: hyperplane sign hashing, exact cosine, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._session import materialize, skew_join
from corpusloom.llm.graph import connected_components

THRESHOLD, TABLES, BITS = 0.93, 40, 16
_PER_LONG = 64 // BITS
_SIG = [f"s{i}" for i in range(TABLES // _PER_LONG)]


def _mask(slot: int) -> Column:
    """The bits of a table's code in its long, ``slot`` codes from the low end."""
    bits = ((1 << BITS) - 1) << (BITS * slot)
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def _first_table(xored: list[Column]) -> Column:
    """Number of the first table whose codes agree, from the signatures' differing bits."""
    out = F
    for t in range(TABLES):
        out = out.when(xored[t // _PER_LONG].bitwiseAND(_mask(t % _PER_LONG)) == 0, t)
    return out


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([7_919, dim]).standard_normal((dim, TABLES * BITS))


def _signs(batches):
    """Append the signature: one bit for each hyperplane, 64 to a long."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("vector")
        width = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.zeros((len(width), len(_SIG)), np.int64)
        for dim in np.unique(width):
            rows = np.flatnonzero(width == dim)
            x = flat[(ends[rows][:, None] + np.arange(dim)[None, :]).ravel()].reshape(len(rows), dim)
            if dim not in planes:
                planes[dim] = _planes(int(dim))
            bits = np.packbits((x @ planes[dim]) > 0, axis=1, bitorder="little")
            out[rows] = np.ascontiguousarray(bits).view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), vectors, *[pa.array(out[:, i]) for i in range(len(_SIG))]], names=["node", "label", "vector", *_SIG])


def hamming_limit(threshold: float) -> int:
    """Sign bits in which a pair at ``threshold`` may differ: mean and five deviations."""
    p = np.arccos(threshold) / np.pi
    n = TABLES * BITS
    return int(n * p + 5 * np.sqrt(n * p * (1 - p)))


def vector_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept.

    Vectors of one label that agree on the BITS sign bits of any of TABLES tables
    are candidates, each pair in the first such table; those whose whole signatures are within ``hamming_limit`` are
    confirmed by the cosine in double precision. Equal vectors of a label are one
    node with a count, so copies never meet as pairs. At cosine 0.93 a pair is
    missed with a chance of about 0.004, less the nearer it is.

    Rows whose label or vec_id is null and vectors that are null, empty, zero or
    hold null or non-finite components link with nothing and are kept, as is every
    component's smallest vec_id. Vectors of unequal length don't link. Repeated
    rows count as vectors of their own.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "vector")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.min(F.struct("label", "vector")).alias("v"))
    nodes = materialize(nodes.select("node", "first_id", "copies", "v.label", "v.vector"))
    signed = nodes.select("node", "label", "vector").mapInArrow(_signs, f"node long, label string, vector array<double>, {', '.join(f'{c} long' for c in _SIG)}")
    signed = materialize(signed.select("node", "label", F.size("vector").alias("dim"), *_SIG))
    code = [F.shiftrightunsigned(F.col(_SIG[t // _PER_LONG]), BITS * (t % _PER_LONG)).bitwiseAND(F.lit((1 << BITS) - 1)) for t in range(TABLES)]
    keys = signed.select("node", *_SIG, F.posexplode(F.array(*[F.xxhash64("label", "dim", F.lit(t), c) for t, c in enumerate(code)])).alias("table", "key"))
    xored = [F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in _SIG]
    apart = sum((F.bit_count(x) for x in xored[1:]), F.bit_count(xored[0]))
    # A pair is taken in the first table whose codes agree, so it is made once.
    first = _first_table(xored) == F.col("x.table")
    pairs = keys.alias("x").join(keys.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (apart <= hamming_limit(threshold)) & first)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    known = nodes.select("node", "label", "vector", "copies", F.sqrt(square).alias("norm"))
    left, right = (known.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in known.columns[1:]]) for k in "ab")
    dot = F.aggregate(F.zip_with("vector_a", "vector_b", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    links = pairs.join(left, "a").join(right, "b").where((F.col("label_a") == F.col("label_b")) & (F.size("vector_a") == F.size("vector_b")))
    links = materialize(links.where(dot / (F.col("norm_a") * F.col("norm_b")) >= threshold).select("a", "b", "copies_a", "copies_b"))

    degree = links.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).union(links.select("b", "copies_a")).groupBy("node").agg(F.sum("n").alias("others"))
    parts = materialize(connected_components(links, "a", "b").toDF("node", "part").join(nodes.select("node", "first_id"), "node"))
    lowest = parts.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = skew_join(parts, lowest, ["part"]).select("node", "component_id")
    info = nodes.select("node", "copies", "first_id").join(named, "node", "left").join(degree, "node", "left")
    info = materialize(info.select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")))
    linked = skew_join(rows.where("node is not null").select("vec_id", "node"), info, ["node"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
