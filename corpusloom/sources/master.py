"""The master table as CSV or JSON lines, training exports, and caches keyed by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = {"session_number": "int", "segment_index": "int", "start_time_ms": "long", "end_time_ms": "long", "word_count": "int", "cohort_id": "int", "final_label": "int", "llm_confidence_primary": "double", "progression_coord": "double"}
LISTS = ("rater_ids", "codebook_labels_ensemble", "codebook_labels_embedding", "codebook_labels_llm")


def list_column(text: Column) -> Column:
    """Array of strings from a list written with quotes of either kind; an empty one for anything else."""
    parsed = F.from_json(F.translate(text, "'", '"'), "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def cohort_of(session_id: Column) -> Column:
    """Cohort number at the start of a session id, else null."""
    return F.regexp_extract(session_id, r"(?i)^c([0-9]+)s", 1).try_cast("int")


def read_master(spark: SparkSession, path: str, speaker: str | None = "participant", labelled: bool = True) -> DataFrame:
    """Master CSV with typed columns: what does not parse is null, lists are arrays, a missing cohort comes from the session id.

    ``speaker`` keeps one role, ``labelled`` rows with a final label. Quoted fields
    may hold line breaks.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for name, kind in NUMBERS.items():
        number = F.col(name).try_cast("double") if name in raw.columns else F.lit(None).cast("double")
        raw = raw.withColumn(name, number.cast(kind))
    for name in LISTS:
        raw = raw.withColumn(name, list_column(F.col(name)) if name in raw.columns else F.array().cast("array<string>"))
    raw = raw.withColumn("cohort_id", F.coalesce("cohort_id", cohort_of(F.col("session_id"))))
    rows = raw.where(F.col("speaker") == speaker) if speaker else raw
    return rows.where("final_label is not null") if labelled else rows


def read_legacy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an older project; fields of another type are null."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def migrate(spark: SparkSession, source: str, target: str, schema: str, key: str = "session_id") -> None:
    """JSON lines rewritten as Parquet by session, one row for each segment_id."""
    read_legacy(spark, source, schema).dropDuplicates(["segment_id"]).write.mode("overwrite").partitionBy(key).parquet(target)


def mixtures(rows: DataFrame, stages: int, prefix: str = "mix_") -> DataFrame:
    """segment_id and normalised ``mixture`` from columns; rows without mass go."""
    cells = F.array(*[F.coalesce(F.col(f"{prefix}{k}").try_cast("double"), F.lit(0.0)) for k in range(stages)])
    r = rows.select("segment_id", cells.alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda a, x: a + x)
    return r.withColumn("t", total).where("t > 0").select("segment_id", F.transform("m", lambda x: F.round(x / F.col("t"), 6)).alias("mixture"))


def single_label_export(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """text, label, label_name of labelled rows, for a JSON sink."""
    name = F.array(*[F.lit(n) for n in names])
    return rows.where("label is not null").select("segment_id", "text", "label", F.get(name, F.col("label")).alias("label_name"))


def multi_label_export(rows: DataFrame) -> DataFrame:
    """text and the sorted numbers of its codes; codes are numbered by name."""
    codes = rows.select(F.explode("codes").alias("code")).distinct().groupBy().agg(F.array_sort(F.collect_set("code")).alias("_all"))
    r = rows.crossJoin(F.broadcast(codes))
    return r.select("segment_id", "text", F.array_sort(F.transform(F.array_distinct("codes"), lambda c: (F.array_position("_all", c) - 1).cast("int"))).alias("labels"))


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows (segment_id, text) that the cache (segment_id, sha) lacks or holds for another text."""
    return texts.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(cache.select("segment_id", "sha"), ["segment_id", "sha"], "left_anti")


def refreshed(texts: DataFrame, cache: DataFrame, encode) -> DataFrame:
    """The cache with what was missing computed by ``encode`` (DataFrame to DataFrame with ``vector``), stale rows replaced."""
    now = texts.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).select("segment_id", "sha")
    kept = cache.join(now, ["segment_id", "sha"], "left_semi")
    return kept.unionByName(encode(missing_texts(texts, cache)).select(*cache.columns))


def updated_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifest (key, entry) with the new entries in place of old ones of their key."""
    return manifest.join(entries, "key", "left_anti").unionByName(entries)


def renamed_speakers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that changed between two name keys (name, id). Two new ids for one old id are an error."""
    j = old.select("name", F.col("id").alias("old_id")).join(new.select("name", F.col("id").alias("new_id")), "name").where("old_id <> new_id").select("old_id", "new_id").distinct()
    if not j.groupBy("old_id").count().where("count > 1").isEmpty():
        raise ValueError("an old id maps to two new ids")
    return j


def new_segment_ids(segments: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """old_id, new_id of segments whose id starts with ``old_prefix``. Colliding new ids are an error."""
    m = segments.where(F.col("segment_id").startswith(f"{old_prefix}_")).select(F.col("segment_id").alias("old_id"), F.concat(F.lit(f"{new_prefix}_"), F.substring("segment_id", len(old_prefix) + 2, 1 << 20)).alias("new_id"))
    if not m.groupBy("new_id").count().where("count > 1").isEmpty():
        raise ValueError("two segments get one id")
    return m


def write_block_motifs(motifs: DataFrame, path: str) -> None:
    """The clusters of the blocks (from_id, to_id, motif) as Parquet, in place of older ones."""
    motifs.select("from_id", "to_id", F.col("motif").cast("int").alias("motif")).write.mode("overwrite").parquet(path)


def read_block_motifs(spark: SparkSession, path: str) -> DataFrame:
    """from_id, to_id, motif of a kept table; where its columns are missing, no rows."""
    kept = spark.read.parquet(path)
    if not {"from_id", "to_id", "motif"} <= set(kept.columns):
        return spark.createDataFrame([], "from_id string, to_id string, motif int")
    return kept.select("from_id", "to_id", "motif")


#: Out-of-fold predictions of both frameworks' labels by segment.
HELDOUT = "segment_id string, label_pred int, label_conf double, move_pred int, move_conf double"


def write_heldout(labels: DataFrame, moves: DataFrame, path: str) -> None:
    """Out-of-fold predictions (segment_id, predicted, confidence) of labels and moves as one CSV table, confidences to four places."""
    side = lambda df, name: df.select("segment_id", F.col("predicted").cast("int").alias(f"{name}_pred"), F.round("confidence", 4).alias(f"{name}_conf"))
    side(labels, "label").join(side(moves, "move"), "segment_id", "full").write.mode("overwrite").csv(path, header=True)


def read_heldout(spark: SparkSession, path: str) -> DataFrame:
    """HELDOUT of a kept table; fields of another type are null."""
    return spark.read.schema(HELDOUT).csv(path, header=True, mode="PERMISSIVE")
