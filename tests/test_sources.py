"""Readers, stores, frameworks, master table and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import frameworks as W
from corpusloom.sources import master as M
from corpusloom.sources import store as S
from corpusloom.sources import transcripts as T
from corpusloom.streaming import sessions as E


def test_vtt_cues(spark, tmp_path):
    (tmp_path / "c1s2.vtt").write_text("WEBVTT\n\n1\n00:00:01,500 --> 00:00:03,000\nAnn: Hello\nthere: you\n\n2\n01:02.250 --> 01:03.000\nno name here\n\n3\n00:02:00.000 --> 00:02:01.000\n\n")
    rows = T.read_vtt(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.session_id, r.speaker, r.text, r.start, r.end) for r in rows] == [("c1s2", "Ann", "Hello there: you", 1.5, 3.0), ("c1s2", "unknown", "no name here", 62.25, 63.0)]


def test_diarized_json(spark, tmp_path):
    for name, body in (("c1s1", {"sentences": [{"text": "a", "speaker": "x", "start": 0.0, "end": 1.0}]}), ("c1s3", {"sections": [{"sentences": [{"text": "b", "speaker": "y", "start": 1.0, "end": 2.0}]}, {"sentences": [{"text": "", "speaker": "y", "start": 2.0, "end": 3.0}]}]})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps(body))
    rows = T.read_diarized(spark, str(tmp_path))
    assert sorted((r.session_id, r.speaker, r.text) for r in rows.collect()) == [("c1s1", "x", "a"), ("c1s3", "y", "b")]
    assert {(r.speaker, r.n) for r in T.speaker_counts(rows).collect()} == {("x", 1), ("y", 1)}


def test_speaker_samples_are_evenly_spaced(spark):
    rows = spark.createDataFrame([("s", i, "x", f"text {i}", 0.0, 1.0) for i in range(9)], T.UTTERANCES)
    assert [r.place for r in T.speaker_samples(rows, 3).orderBy("place").collect()] == [0, 4, 8]


def test_melted_codes(spark):
    wide = spark.createDataFrame([(1, 1, "Vigilance", None, "No code", " "), (1, 2, "odd", "avoidance", "", "Vigilance")], "worksheet_n int, item int, a_p string, a_s string, b_p string, b_s string")
    got = {(r.item, r.rater, r.primary, r.secondary) for r in T.melt_codes(wide, ["a", "b"], {"Vigilance": 0, "Avoidance": 1}).collect()}
    assert got == {(1, "a", 0, None), (1, "b", -1, None), (2, "a", None, 1), (2, "b", None, 0)}


def test_outcomes_wide_and_long(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("participant_id,mood_pre,mood_post\np1,1,4\np2,x,3\n")
    (tmp_path / "long.csv").write_text("participant_id,session_number,mood\np1,1,2.5\n")
    assert {(r.participant_id, r.change) for r in T.read_outcomes(spark, str(tmp_path / "wide.csv")).collect()} == {("p1", 3.0), ("p2", None)}
    assert [(r.measure, r.value) for r in T.read_outcomes(spark, str(tmp_path / "long.csv")).collect()] == [("mood", 2.5)]


def test_frozen_sessions(spark, tmp_path):
    path = str(tmp_path / "frozen")
    rows = spark.createDataFrame([("a", "s1", 1, "x"), ("b", "s1", 0, "y")], "segment_id string, session_id string, segment_index int, text string")
    S.write_frozen(rows, path)
    with pytest.raises(ValueError):
        S.write_frozen(rows, path)
    S.write_frozen(rows.withColumn("text", F.lit("z")), path, force=True)
    S.write_frozen(rows.withColumn("session_id", F.lit("s2")), path)
    assert [r.text for r in S.read_session(spark, path, "s1").collect()] == ["z", "z"]
    assert [r.segment_id for r in S.read_session(spark, path, "s2").collect()] == ["b", "a"]


def test_upsert_remap_and_drift(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "segment_id string, label int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "segment_id string, label int")
    assert sorted(tuple(r) for r in S.merged(old, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    swap = spark.createDataFrame([("a", "b"), ("b", "a")], "old_id string, new_id string")
    assert sorted(tuple(r) for r in S.remapped(old, swap).collect()) == [("a", 2), ("b", 1)]
    frozen = spark.createDataFrame([("a", "x"), ("gone", "y")], "segment_id string, sha string")
    now = spark.createDataFrame([("a", "text")], "segment_id string, text string")
    assert {(r.segment_id, r.state) for r in S.drift(frozen, now).collect()} == {("a", "drift"), ("gone", "unresolved")}


MARKDOWN = """---
name: Demo
version: 2
---
# Demo

## Stage 0 — Watchful
Looks out for it.

### Clear
- "I keep watching."
- "It may come back."

### Subtle
- “Always there.”

## Move 1 — ask — Open question
Asks.
"""


def test_framework_tables(spark):
    f = W.parse_framework(MARKDOWN)
    assert f.meta == {"name": "Demo", "version": "2"}
    table = W.framework_table(spark, f)
    assert [tuple(r)[:4] for r in table.orderBy("number").collect()] == [("stage", 0, "watchful", "Watchful"), ("move", 1, "ask", "Open question")]
    items = W.content_items(spark, f).orderBy("ord").collect()
    assert [(r.item_id, r.expected, r.difficulty) for r in items] == [("cv_0001", 0, "clear"), ("cv_0002", 0, "clear"), ("cv_0003", 0, "subtle")]
    rows = spark.createDataFrame([("WATCHFUL ",), ("open_question",), ("No code",), ("?",), (None,)], "code string")
    assert [r.code_id for r in W.with_label_ids(rows, W.alias_map(table), "code").collect()] == [0, 1, -1, None, None]


def test_framework_file(spark, tmp_path):
    (tmp_path / "f.md").write_text(MARKDOWN)
    assert W.read_framework(spark, str(tmp_path / "f.md")).count() == 2


def test_master_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("segment_id,session_id,speaker,text,word_count,final_label,rater_ids\na,c2s1,participant,\"two\nlines\",x,3,\"['r1', 'r2']\"\nb,odd,participant,t,2,,\nc,c1s1,therapist,t,2,1,nonsense\n")
    rows = M.read_master(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.segment_id, r.text, r.word_count, r.final_label, r.cohort_id, r.rater_ids) for r in rows] == [("a", "two\nlines", None, 3, 2, ["r1", "r2"])]
    every = {r.segment_id: r for r in M.read_master(spark, str(tmp_path / "m.csv"), None, False).collect()}
    assert every["b"].cohort_id is None and every["c"].rater_ids == []


def test_legacy_migration(spark, tmp_path):
    (tmp_path / "old.jsonl").write_text('{"segment_id":"a","session_id":"s","n":1}\n{"segment_id":"a","session_id":"s","n":1}\n{"segment_id":"b","session_id":"s","n":"bad"}\n')
    M.migrate(spark, str(tmp_path / "old.jsonl"), str(tmp_path / "new"), "segment_id string, session_id string, n int")
    assert sorted((r.segment_id, r.n) for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [("a", 1), ("b", None)]


def test_cache_and_manifest(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "segment_id string, text string")
    cache = texts.where("segment_id = 'a'").select("segment_id", F.sha2("text", 256).alias("sha"), F.array(F.lit(1.0)).alias("vector")).union(spark.sql("SELECT 'b', 'stale', array(0.0D)"))
    got = M.refreshed(texts, cache, lambda d: d.withColumn("vector", F.array(F.lit(2.0))))
    assert sorted((r.segment_id, r.vector) for r in got.collect()) == [("a", [1.0]), ("b", [2.0])]
    old = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, entry string")
    assert sorted(tuple(r) for r in M.updated_manifest(old, spark.createDataFrame([("l", "3")], "key string, entry string")).collect()) == [("k", "1"), ("l", "3")]


def test_renamed_keys(spark):
    key = lambda rows: spark.createDataFrame(rows, "name string, id string")
    assert [tuple(r) for r in M.renamed_speakers(key([("n", "p1"), ("m", "p2")]), key([("n", "p9"), ("m", "p2")])).collect()] == [("p1", "p9")]
    with pytest.raises(ValueError):
        M.renamed_speakers(key([("n", "p1"), ("m", "p1")]), key([("n", "p8"), ("m", "p9")]))
    assert [tuple(r) for r in M.new_segment_ids(spark.createDataFrame([("t_1",), ("u_1",)], "segment_id string"), "t", "v").collect()] == [("t_1", "v_1")]


def test_streams_match_their_batch_forms(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = tmp_path / "in"
    batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3).write.parquet(str(folder))
    stream = E.type_counts(E.read_events(spark, str(folder)), late="400 days")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, E.type_counts(batch).collect()))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        E.upsert_stream(E.read_events(spark, str(folder)), out, check).awaitTermination()
    assert E.read_latest(spark, out).count() == batch.select("event_id").distinct().count()


def test_overlay_life_cycle(spark, tmp_path):
    from corpusloom.sources import store

    path = f"{tmp_path}/overlay"
    rows = lambda *x: spark.createDataFrame(list(x), "segment_id string, v int")
    assert not store.overlay_exists(spark, path) and store.read_overlay_at(spark, path) is None
    store.clear_overlay(spark, path)
    store.write_overlay(spark, rows(("a", 1), ("b", 1)), path)
    store.write_overlay(spark, rows(("b", 2), ("c", 2)), path)
    assert store.overlay_exists(spark, path)
    assert sorted(map(tuple, store.read_overlay_at(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    store.clear_overlay(spark, path)
    assert not store.overlay_exists(spark, path) and store.read_overlay_at(spark, path).columns == ["segment_id", "v"]
