"""Fill-in-middle transformation of whole texts by DuckDB SQL over Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sentinels and what share of texts takes which form, in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST, SEED = 90, 20, 1
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Bytes of text that DuckDB takes at a time; one text at least.
PART = 4 << 20

FIELDS = {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}


def transform_sql(table: str = "batch", seed: int = SEED) -> str:
    """SQL over (doc_id, text) with FIELDS, ``output`` and ``restored``.

    Prefix, middle and suffix are slices of the list of units; ``restored`` is cut out
    of ``output`` at the sentinels and knows nothing else of the text.
    """
    word = "('0x' || substr(h, {} * 8 + 1, 8))::UINTEGER".format
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {table}),
units AS (SELECT *, regexp_extract_all(t, '{UNIT}') AS u, {word(0)}::BIGINT AS h1, {word(1)}::BIGINT AS h2, {word(2)}::BIGINT AS h3, {word(3)}::BIGINT AS h4 FROM texts),
cuts AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {TRANSFORMED} THEN 'plain'
         WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM units
),
parts AS (
  SELECT doc_id, t, len(u) AS n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, len(u)), '') AS s FROM cuts
),
outputs AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output
  FROM parts
),
marks AS (SELECT *, strpos(output, CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS second, strpos(output, '{MIDDLE}') AS third FROM outputs),
fields AS (SELECT *, substr(output, 4, second - 4) AS x, substr(output, second + 3, third - second - 3) AS y, substr(output, third + 3) AS z FROM marks),
rebuilt AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x || z || y ELSE y || z || x END AS restored FROM fields)
SELECT doc_id, n::BIGINT AS n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256, output, restored FROM rebuilt
"""


def _parts(batch: pa.RecordBatch):
    """Slices of ``batch`` of about PART bytes of text, a row at least."""
    sizes = batch.column("text").value_lengths() if hasattr(batch.column("text"), "value_lengths") else pa.compute.binary_length(batch.column("text"))
    first = held = 0
    for i, size in enumerate(sizes.to_pylist()):
        if i > first and held + (size or 0) > PART:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _run(fields: list[str], seed: int):
    query = f"SELECT {', '.join(fields)} FROM ({transform_sql(seed=seed)})"

    def run(batches):
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute("SET temp_directory = ''")
        for batch in batches:
            for part in _parts(batch):
                con.register("batch", pa.Table.from_batches([part]))
                found = con.execute(query).to_arrow_table()
                con.unregister("batch")
                yield from found.cast(pa.schema([(f, pa.int64() if FIELDS.get(f) == "bigint" else pa.string()) for f in fields])).to_batches()
        con.close()

    return run


def fill_in_middle(docs: DataFrame, output: bool = True, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): FIELDS, and the text ``output`` where asked for.

    A text is cut into runs of letters and single other characters; two draws from the
    digest of its id place the middle. Texts that are empty or hold a sentinel, and a
    tenth of the others, stay as they are (``plain``, no part lengths). A null text is
    an empty one; a null id is drawn for as an empty id; repeated rows are rows of their
    own; columns of other names are left; an empty table gives no rows. Batches reach
    DuckDB in slices of PART bytes, so a task holds one slice, or one longer text, and
    its units.
    """
    fields = [*FIELDS, *(["output"] if output else [])]
    schema = ", ".join(f"{f} {FIELDS.get(f, 'string')}" for f in fields)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(fields, seed), schema)
