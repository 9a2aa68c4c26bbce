"""Passes over ordered rows: with a small state, or with one whole key at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], needs: list[str], start: Callable[[], object], step: Callable, column: str, kind: str) -> DataFrame:
    """``rows`` with ``column``: what ``step(state, row)`` returns along each key's order.

    Rows are dealt by ``key`` and sorted within partitions, so batches stream past
    and only the state of the current key is kept, however long its run is.
    ``step`` returns (state, value); ``needs`` names the columns that it sees.
    """
    names = rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{column}` {kind}"
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind]

    def run(batches):
        known, state = object(), None
        for batch in batches:
            keys = batch.column(key).to_pylist()
            seen = [batch.column(c).to_pylist() for c in needs]
            out = []
            for i, k in enumerate(keys):
                if k != known:
                    known, state = k, start()
                state, value = step(state, dict(zip(needs, (c[i] for c in seen))))
                out.append(value)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, arrow)], names=[*names, column])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ordered_groups(rows: DataFrame, key: str, order: list[str], run: Callable[[object, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """What ``run(key, columns)`` returns for each key's rows in order: a list of rows of ``schema``.

    As a grouped map, but keys stream past within sorted partitions: many small keys share
    one Arrow batch and one frame of results. A key that goes on beyond its batch is held until it ends.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches):
        held = []
        for batch in batches:
            if not len(batch):
                continue
            at = batch[key]
            new = (at != at.shift()) & ~(at.isna() & at.shift().isna())
            new.iloc[0] = not held or not (held[-1][key].iloc[-1] == at.iloc[0] or (pd.isna(held[-1][key].iloc[-1]) and pd.isna(at.iloc[0])))
            starts = np.flatnonzero(new)
            if not len(starts):
                held.append(batch)
                continue
            held.append(batch.iloc[: starts[0]])
            yield from done(held)
            out = []
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            for low, high in zip(starts[:-1], starts[1:]):
                out += run(columns[key][low], {c: v[low:high] for c, v in columns.items()})
            if out:
                yield pd.DataFrame(out, columns=names)
            held = [batch.iloc[starts[-1] :]]
        yield from done(held)

    def done(held):
        held = [x for x in held if len(x)]
        if held:
            pdf = pd.concat(held) if len(held) > 1 else held[0]
            out = run(pdf[key].iloc[0], {c: pdf[c].to_numpy() for c in pdf.columns})
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.repartition(parts, key).sortWithinPartitions(key, *order).mapInPandas(each, schema)
