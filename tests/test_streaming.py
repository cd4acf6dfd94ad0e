import json

from pagegraph.streaming import events


def test_first_seen(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"url": u, "host": "h", "bytes_read": 5, "ts": f"2024-01-01T00:00:0{k}"} for k, u in enumerate("aabac")]
    for k, r in enumerate(rows):
        (source / f"{k}.json").write_text(json.dumps(r))
    stream = events.event_stream(spark, str(source), "url string, host string, bytes_read long, ts timestamp")
    events.sink(events.first_seen(stream, "ts", "1 hour"), f"seen-{tmp_path.name}", str(tmp_path / "out"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
