"""Distributed connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._session import materialize, skew_join


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u over v, each once; nulls and self-loops left out."""
    return materialize(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _rooted(hooks: DataFrame) -> DataFrame:
    """A forest's parents (u, hook) with each node's root: u, hook, root."""
    rows = hooks.withColumn("root", F.col("hook"))
    while True:
        further = rows.select(F.col("u").alias("root"), F.col("root").alias("next"))
        rows = materialize(skew_join(rows, further, ["root"], "left").select("u", "hook", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if rows.where("moved").isEmpty():
            return rows.drop("moved")


def smaller_reachable(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable id of every id that reaches a smaller one: ``id``, ``component``.

    Each round hooks every node to its smallest neighbour, finds the roots of that
    forest by pointer jumping, and contracts the edges to the roots; at least half
    of the nodes that still have edges go, so O(log n) rounds are enough also on long
    chains. Edges and labels stay distributed, hot nodes may be split in every join,
    and the driver only asks whether rows are left.
    Nulls and self-loops are ignored; no edges give no rows.
    """
    e, whole = _contracted(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))), None
    while whole is None or not e.isEmpty():
        trees = _rooted(e.groupBy("u").agg(F.min("v").alias("hook")))
        rest = skew_join(e, trees, ["u"]).where("v != hook").select(F.col("root").alias("u"), "v")
        e = _contracted(skew_join(rest, trees.select(F.col("u").alias("v"), "root"), ["v"], "left").select("u", F.coalesce("root", "v").alias("v")))
        found = trees.select(F.col("u").alias("id"), F.col("root").alias("component"))
        whole = found if whole is None else materialize(relabelled(whole, found).union(found))
    return whole


def forest_roots(parents: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """Root of every node of a forest, whose nodes have one smaller parent each: ``id``, ``component``."""
    return _rooted(parents.select(F.col(node).alias("u"), F.col(parent).alias("hook"))).select(F.col("u").alias("id"), F.col("root").alias("component"))


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` whose column ``component`` follows ``found`` (id, component) one step on."""
    step = found.select(F.col("id").alias("component"), F.col("component").alias("_next"))
    return skew_join(labels, step, ["component"], "left").withColumn("component", F.coalesce("_next", "component")).select(*labels.columns)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after components that ``links`` (u, v) join are one.

    Components that so far were one node only have no row in ``labels``; they get one.
    """
    found = materialize(smaller_reachable(links, "u", "v"))
    fresh = found.join(labels.select("id"), "id", "left_anti")
    return materialize(relabelled(labels, found).union(fresh))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable id of every id in ``edges``: columns ``id`` and ``component``.

    As ``smaller_reachable``, with a row for each component's smallest id too.
    """
    found = smaller_reachable(edges, src, dst)
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
