"""Transcripts arriving in two batches."""

from corpusloom.streaming import incremental as I

CUE = "WEBVTT\n\n1\n00:00:00.000 --> 00:00:04.000\nAnn: {a} words that are said here by one of them at some length for once\n\n2\n00:00:05.000 --> 00:00:09.000\nBob: an answer\n"


def test_new_sessions_are_processed_once(spark, tmp_path):
    folder, store, check = (tmp_path / x for x in ("in", "store", "check"))
    folder.mkdir()
    (folder / "c1s1.vtt").write_text(CUE.format(a="first"))
    settings = {"min_words": 5, "max_words": 50}
    run = lambda: I.watch_transcripts(spark, str(folder), str(store), str(check), settings).awaitTermination()
    run()
    first = spark.read.parquet(str(store))
    assert {(r.session_id, r.speaker) for r in first.collect()} == {("c1s1", "Ann"), ("c1s1", "Bob")}
    (folder / "c1s2.vtt").write_text(CUE.format(a="second"))
    run()
    stored = spark.read.parquet(str(store))
    assert stored.groupBy("session_id").count().count() == 2 and stored.count() == 4
    sessions = spark.createDataFrame([("c1s1",), ("c1s2",), ("c1s3",)], "session_id string")
    assert [r.session_id for r in I.outdated(sessions, stored, settings).collect()] == ["c1s3"]
    assert I.outdated(sessions, stored, settings | {"min_words": 9}).count() == 3
