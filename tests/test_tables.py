"""Readers, writers, exports and streaming monitors."""

from pyspark.sql import functions as F

from loomwright.sources import tables
from loomwright.streaming import monitors

DOC = '{"id": "a1", "video_id": "v", "quality_score": null, "tags": ["x"], "segments": [{"start_time": 0.0, "end_time": 1.5, "caption": "one", "actions": [{"verb": "cut", "noun": "fig"}], "objects": [{"name": "fig", "confidence": 0.9}]}, {"start_time": 1.5, "end_time": 4.0, "caption": null}]}'


def test_json_to_index_and_exports(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.json").write_text(DOC + "\nnot json\n")
    df = tables.read_json(spark, str(tmp_path / "in"))
    row = tables.flatten(df).first()
    assert (row.id, row.num_segments, row.total_duration, row.source, row.quality_score) == ("a1", 2, 4.0, "model", None)
    assert [(r.verb, r.n) for r in tables.verbs(df).where("verb is not null").collect()] == [("cut", 1)]
    turns = tables.llava(df).first().conversations
    assert [t["from"] for t in turns] == ["human", "gpt"] * 2 and turns[0].value.endswith("fig") and turns[3].value == ""
    steps = tables.episodes(df).collect()
    assert [(s.step, s.next_observation, s.is_first, s.is_last, s.discount) for s in steps] == [(0, None, True, False, 1.0), (1, None, False, True, 0.0)]


def test_store_and_compaction(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("source"))
    for _ in range(2):
        tables.write_store(rows.repartition(4), str(tmp_path / "s"), ["source"])
    tables.compact(spark, str(tmp_path / "s"), str(tmp_path / "t"), ["source"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 3
    assert tables.find(tables.read_parquet(spark, str(tmp_path / "t")), "id", 7).count() == 2
    tables.write_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 100


def test_monitors_equal_the_batch_result(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = monitors.read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double")
    for name, make in {
        "w": lambda e: monitors.windowed(e, "ts", ["event_type"], "value", "1 hour", late="60 days"),
        "r": lambda e: monitors.alerts(monitors.error_rate(e, "ts", ["event_type"], "event_type", "error", "1 day", "60 days"), "rate", 0.5, 0.9),
        "d": lambda e: monitors.deduplicated(e, "ts", "event_id", "60 days"),
    }.items():
        mode = "append" if name == "d" else "update"
        monitors.write_once(make(stream), str(tmp_path / name), str(tmp_path / f"{name}-state"), mode).awaitTermination()
        got = spark.read.parquet(str(tmp_path / name)).drop("batch")
        want = make(events)
        rounded = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert rounded(got.select(want.columns)) == rounded(want)
