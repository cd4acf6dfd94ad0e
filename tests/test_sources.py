import pytest

from pagegraph.sources import snapshots


def test_event_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.createDataFrame([("page", "https://h/?a<b&c", None), ("error", "https://h/x", 3)], "type string, url string, retry_attempts int")
    snapshots.write_events(rows, path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines[1] == '{"type":"page","url":"https://h/?a\\u003cb\\u0026c"}'
    back = snapshots.read_events(spark, path, "type string, url string, retry_attempts int")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}


def test_write_all(spark, tmp_path):
    """Several writers get the same events in order; the first that fails ends it."""
    seen = []

    def lines(path):
        return lambda df: snapshots.write_events(df, path)

    def failing(df):
        raise OSError("full")

    rows = spark.createDataFrame([("page", "u")], "type string, url string")
    with pytest.raises(OSError, match="full"):
        snapshots.write_all(rows, [lines(str(tmp_path / "a")), failing, lambda df: seen.append(df.count())])
    assert spark.read.text(str(tmp_path / "a")).count() == 1 and not seen
    routed = [len(snapshots.routed(out, lines, seen.append)) for out in ("-", "/x", "", None)]
    assert routed == [1, 2, 1, 1]


def test_environment(spark):
    row = snapshots.environment(spark).first()
    assert row.spark == spark.version and row.cores > 0 and row.os
