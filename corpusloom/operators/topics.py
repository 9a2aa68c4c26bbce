"""Boundaries where a session's topic changes: Ward clusters of its sentences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.operators.ordered import ordered_groups


def ward_merges(vectors: np.ndarray) -> list[tuple[float, int, int]]:
    """The n - 1 merges of Ward's clustering as (cost, row, row), the cheapest first.

    A chain of nearest neighbours grows until two clusters are each other's nearest and
    merge; such merges are those of the greedy order. State is a mean and a size a
    cluster, so memory is that of the vectors and time n squared. A merge names the
    smallest row of each cluster; equal costs go by these rows.
    """
    n = len(vectors)
    mean, size, first = np.array(vectors, float), np.ones(n), np.arange(n)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        top = chain[-1]
        gap = mean - mean[top]
        cost = np.round(size * size[top] / (size + size[top]) * np.einsum("ij,ij->i", gap, gap), 12)
        cost[~alive] = np.inf
        cost[top] = np.inf
        near = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
            near = chain[-2]
        if len(chain) > 1 and near == chain[-2]:
            a, b = sorted((top, near), key=lambda i: first[i])
            merges.append((float(cost[near]), int(first[a]), int(first[b])))
            mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            chain = chain[:-2]
        else:
            chain.append(near)
    return sorted(merges)


def ward_labels(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Cluster of every row after the cheapest n - ``clusters`` merges, named by its smallest row."""
    parent = np.arange(len(vectors))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in ward_merges(vectors)[: max(0, len(vectors) - clusters)]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return np.array([root(i) for i in range(len(vectors))], dtype=np.int64)


def topic_boundaries(rows: DataFrame, per_topic: int = 10, least: int = 4) -> DataFrame:
    """Sentences (session_id, place) after which the topic changes.

    ``rows`` has session_id, place and vector. A session's sentences form a tenth as many
    clusters, two at least; sessions of fewer than ``least`` sentences have no boundary. One
    session is one task's group: memory grows with its vectors, time with the square
    of their number, at any length the same way. A null vector counts as zeros.
    """

    def run(key, columns: dict[str, np.ndarray]) -> list[tuple]:
        place, vectors = columns["place"], columns["vector"]
        if len(place) < least:
            return []
        width = max((len(v) for v in vectors if v is not None), default=1)
        x = np.vstack([np.zeros(width) if v is None else np.asarray(v, float) for v in vectors])
        labels = ward_labels(x, min(len(x) - 1, max(2, len(x) // per_topic)))
        return [(key, p) for p in place[:-1][labels[1:] != labels[:-1]]]

    kinds = dict(rows.dtypes)
    return ordered_groups(rows.select("session_id", "place", "vector"), "session_id", ["place"], run, f"session_id {kinds['session_id']}, place {kinds['place']}")
