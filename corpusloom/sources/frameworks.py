"""Label frameworks and code books from Markdown, and what is looked up in them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import slug

#: ``## Stage 0 — Name``, ``## Move 1 — Key — Name``, ``## Code 12 — id — Category``.
HEADING = re.compile(r"^##\s+(Stage|Move|Code)\s+(\d+)\s+[—–-]+\s+(.+?)\s*$", re.M)


@dataclass
class Framework:
    """Parsed framework: meta data, and (kind, number, key, name, category, definition, utterances) of its entries."""

    meta: dict[str, str] = field(default_factory=dict)
    entries: list[tuple] = field(default_factory=list)


def parse_framework(text: str) -> Framework:
    """Front matter of ``key: value`` lines, then a section for every entry.

    Of a section, the first plain paragraph is the definition, and list items in
    double quotes are utterances, whose level is the last third-level heading.
    """
    meta, body = {}, text
    front = re.match(r"\A---\n(.*?)\n---\n", text, re.S)
    if front:
        body = text[front.end() :]
        meta = {k.strip(): v.strip().strip("'\"") for k, _, v in (line.partition(":") for line in front[1].splitlines() if ":" in line and not line.startswith((" ", "#", "-")))}
    found = list(HEADING.finditer(body))
    entries = []
    for m, end in zip(found, [*[x.start() for x in found[1:]], len(body)]):
        kind, number = m[1].lower(), int(m[2])
        names = re.split(r"\s+[—–-]+\s+", m[3])
        key, name = (names[0], names[-1]) if len(names) > 1 else (re.sub(r"[^a-z0-9]+", "_", names[0].lower()).strip("_"), names[0])
        definition, level, said = "", "", []
        for block in body[m.end() : end].split("\n"):
            line = block.strip()
            quoted = re.match(r"[-*]\s+[\"“](.+?)[\"”]\s*$", line)
            if line.startswith("###"):
                level = line.lstrip("# ").lower()
            elif quoted:
                said.append((level, quoted[1]))
            elif line and not definition and not line.startswith(("#", "-", "*", "|", ">")):
                definition = line
        entries.append((kind, number, key, name, name if kind == "code" else "", definition, said))
    return Framework(meta, entries)


def framework_table(spark: SparkSession, framework: Framework) -> DataFrame:
    """Dimension: kind, number, key, name, category, definition. Its size is the framework's, not the data's."""
    return spark.createDataFrame([e[:6] for e in framework.entries], "kind string, number int, key string, name string, category string, definition string")


def read_framework(spark: SparkSession, path: str) -> DataFrame:
    """Dimension of one Markdown file in any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    return framework_table(spark, parse_framework(text[0] if text else ""))


def alias_map(dimension: DataFrame) -> DataFrame:
    """Every spelling (key, name, slug of the name, number as text) of an entry: alias, number."""
    a = dimension.select("number", F.explode(F.array(F.lower("key"), F.lower("name"), slug(F.col("name")), F.col("number").cast("string"))).alias("alias"))
    return a.groupBy("alias").agg(F.min("number").alias("number"))


def with_label_ids(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``<column>_id`` by any spelling; ``No code`` and ``none`` are -1, unknown names and blanks null."""
    key = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    j = rows.withColumn("_alias", key).join(F.broadcast(aliases.withColumnRenamed("alias", "_alias").withColumnRenamed("number", "_n")), "_alias", "left")
    return j.withColumn(f"{column}_id", F.when(F.col("_alias").isin("no code", "none", "abstain"), -1).otherwise(F.col("_n"))).drop("_alias", "_n")


def content_items(spark: SparkSession, framework: Framework) -> DataFrame:
    """Test items from a framework's utterances: item_id, ord, text, expected, difficulty, sha."""
    rows = [(e[1], level, said) for e in framework.entries for level, said in e[6]]
    items = [(f"cv_{i:04d}", i, said, number, level) for i, (number, level, said) in enumerate(rows, 1)]
    return spark.createDataFrame(items, "item_id string, ord int, text string, expected int, difficulty string").withColumn("sha", F.sha2("text", 256))


def test_sets(items: DataFrame) -> DataFrame:
    """Every test set (name, item_id) with its size."""
    return items.groupBy("name").agg(F.count("*").alias("n_items"))


def content_signature(items: DataFrame) -> DataFrame:
    """First 16 hex digits of the digest of each worksheet's ordered items (worksheet_n, item, text)."""
    cell = F.concat_ws(":", F.col("worksheet_n").cast("string"), F.col("item").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item", cell.alias("cell")))), lambda x: x["cell"])
    return items.groupBy("worksheet_n").agg(F.substring(F.sha2(F.array_join(ordered, "|"), 256), 1, 16).alias("signature"), F.count("*").alias("n_items"))
