"""Registered queries on the event table: the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.sources.corpus import table
from corpusloom.streaming import sessions as S


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("event_sessions", """WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
n AS (SELECT *, sum((before IS NULL OR ts - before >= INTERVAL 30 MINUTE)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
SELECT user_id, count(*) AS events, round(sum(value), 6) AS total, epoch_us(min(ts)) // 1000 AS started_ms FROM n GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return S.sessions(_events(spark, sf_dir)).select("user_id", "events", "total", F.unix_millis("started").alias("started_ms"))


@register("event_type_counts", "SELECT epoch_ms(date_trunc('day', ts)) AS started_ms, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_type_counts(spark, sf_dir):
    return S.type_counts(_events(spark, sf_dir)).select(F.unix_millis("started").alias("started_ms"), "event_type", "n", "total")


ORDINAL = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


@register("event_type_transitions", f"WITH p AS (SELECT {ORDINAL} AS a, lead({ORDINAL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a AS from_stage, b AS to_stage, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL")
def event_type_transitions(spark, sf_dir):
    from corpusloom.operators.transitions import with_next

    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.expr(ORDINAL).alias("label"))
    pairs = with_next(rows, ["user_id"], ["ts", "event_id"], ["label"]).where("next_label is not null")
    return pairs.groupBy(F.col("label").alias("from_stage"), F.col("next_label").alias("to_stage")).agg(F.count("*").alias("n"))
