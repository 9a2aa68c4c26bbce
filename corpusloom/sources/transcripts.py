"""Transcript files: WebVTT and diarized JSON, and label worksheets in CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCES = "session_id string, place int, speaker string, text string, start double, end double"
_SENTENCE = "array<struct<text: string, speaker: string, start: double, end: double>>"
JSON_SCHEMA = f"sentences {_SENTENCE}, sections array<struct<sentences: {_SENTENCE}>>"


def _seconds(stamp: Column) -> Column:
    """HH:MM:SS,mmm or MM:SS.mmm in seconds."""
    parts = F.transform(F.split(F.regexp_replace(stamp, ",", "."), ":"), lambda x: x.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of WebVTT files, one file a session named by its stem: UTTERANCES.

    Headers, notes and cue numbers are skipped; text before the first colon is the
    speaker, else it is ``unknown``; empty cues go.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.vtt").text(path, wholetext=True)
    return parse_vtt(files.select(F.input_file_name().alias("path"), "value"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues of whole WebVTT files (path, value), as a table or a stream: UTTERANCES."""
    files = files.select(F.regexp_extract("path", r"([^/]+)\.vtt$", 1).alias("session_id"), F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[ \t]*\n")).alias("place", "block"))
    stamp = r"([0-9:]+[.,][0-9]+)\s*-->\s*([0-9:]+[.,][0-9]+)[^\n]*\n?([\s\S]*)"
    cues = files.where(F.col("block").contains("-->"))
    body = F.trim(F.regexp_replace(F.regexp_extract("block", stamp, 3), r"\s+", " "))
    named = body.contains(":")
    cues = cues.select("session_id", "place", F.when(named, F.trim(F.regexp_extract(body, r"^([^:]*):", 1))).otherwise("unknown").alias("speaker"), F.when(named, F.trim(F.regexp_extract(body, r"^[^:]*:([\s\S]*)", 1))).otherwise(body).alias("text"), _seconds(F.regexp_extract("block", stamp, 1)).alias("start"), _seconds(F.regexp_extract("block", stamp, 2)).alias("end"))
    return cues.where("text <> ''")


def read_diarized(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of diarized result.json files, the parent folder being the session: UTTERANCES."""
    files = spark.read.schema(JSON_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").json(path, multiLine=True)
    rows = F.coalesce("sentences", F.flatten(F.transform("sections", lambda x: x["sentences"])))
    found = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/result\.json$", 1).alias("session_id"), F.posexplode(rows).alias("place", "s"))
    return found.select("session_id", "place", "s.speaker", "s.text", "s.start", "s.end").where("text <> ''")


def speaker_counts(utterances: DataFrame) -> DataFrame:
    """Utterances of each speaker."""
    return utterances.groupBy("speaker").agg(F.count("*").alias("n"))


def speaker_samples(utterances: DataFrame, most: int = 5, chars: int = 200) -> DataFrame:
    """Up to ``most`` evenly spaced utterances of each speaker, cut to ``chars``: a display sample."""
    from pyspark.sql import Window

    w = Window.partitionBy("speaker")
    r = utterances.withColumn("i", F.row_number().over(w.orderBy("session_id", "place")) - 1).withColumn("n", F.count("*").over(w))
    k = F.least(F.lit(most), F.col("n"))
    wanted = F.exists(F.sequence(F.lit(0).cast("long"), (k - 1).cast("long")), lambda j: F.bround(j * (F.col("n") - 1) / F.greatest(k - 1, F.lit(1))) == F.col("i"))
    return r.where(wanted).select("speaker", "session_id", "place", F.substring("text", 1, chars).alias("sample"))


def melt_codes(wide: DataFrame, raters: list[str], names: dict[str, int]) -> DataFrame:
    """Wide worksheets (<rater>_p, <rater>_s) as rows: worksheet_n, item, rater, primary, secondary.

    ``No code`` is -1, unknown names and blanks are null.
    """
    known = F.create_map(*[F.lit(x) for k, v in [*names.items(), ("no code", -1)] for x in (k.lower(), v)])
    code = lambda c: F.element_at(known, F.lower(F.trim(F.coalesce(c, F.lit("")))))
    cells = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(f"{r}_p").alias("p"), F.col(f"{r}_s").alias("s")) for r in raters])
    return wide.select("worksheet_n", "item", F.explode(cells).alias("c")).select("worksheet_n", "item", "c.rater", F.try_element_at(known, F.lower(F.trim(F.coalesce("c.p", F.lit(""))))).alias("primary"), F.try_element_at(known, F.lower(F.trim(F.coalesce("c.s", F.lit(""))))).alias("secondary"))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """External outcomes: wide ``<m>_pre``/``<m>_post`` columns give measure and change, long ones measure and value."""
    raw = spark.read.csv(path, header=True)
    pairs = [c[:-4] for c in raw.columns if c.endswith("_pre") and f"{c[:-4]}_post" in raw.columns]
    if pairs:
        cells = F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(f"{m}_post").try_cast("double") - F.col(f"{m}_pre").try_cast("double")).alias("change")) for m in pairs])
        return raw.select("participant_id", F.explode(cells).alias("c")).select("participant_id", "c.measure", "c.change")
    keys = [c for c in raw.columns if c in ("participant_id", "session_id", "session_number", "timepoint")]
    numbers = [c for c in raw.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).try_cast("double").alias("value")) for m in numbers])
    return raw.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.measure", "c.value")
