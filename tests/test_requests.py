from datetime import datetime, timedelta

import pytest

from gaugeworks.streaming import requests

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def feed(spark, tmp_path, batches, columns, out, late="1 second", second=None):
    """Rows of the output, in order of arrival: each batch is a file and a micro-batch of its own."""
    def stream(rows, name):
        folder, schema = f"{tmp_path}/{name}", rows
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}").withWatermark("at", late)

    def add(rows, name, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")

    inputs = [("in", columns)] + ([("second", second[0])] if second else [])
    for name, _ in inputs:
        (tmp_path / name).mkdir()
    result = out(*(stream(schema, name) for name, schema in inputs))
    name = f"out_{tmp_path.name}".replace("-", "_")
    query = result.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        for i, rows in enumerate(batches):
            if second and second[1][i]:
                add(second[1][i], "second", second[0])
            if rows:
                add(rows, "in", columns)
            query.processAllAvailable()
    finally:
        query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


FRAMES = "session_id string, seq long, at timestamp, generation long"


def test_throttle_over_batches_and_after_a_rest(spark, tmp_path):
    batches = [
        [("s", 1, at(0.2), 0), ("s", 0, at(0.1), 0), ("t", 9, at(0.9), 0)],
        [("s", 2, at(0.8), 0), ("s", 3, at(1.1), 0), ("s", 4, at(1.2), 0)],
        [("s", 5, at(0.9), 0), ("s", 6, at(2.0), 0)],  # 5 is of an interval that has passed
        [("t", 10, at(100), 0)],
        [("t", 11, at(0.95), 0), ("s", 12, at(101), 0)],  # 11 is older than the watermark
    ]
    found = feed(spark, tmp_path, batches, FRAMES, lambda s: requests.throttle(s, 1000, idle=5000), late="1 second")
    assert sorted(found) == [("s", 0), ("s", 3), ("s", 6), ("s", 12), ("t", 9), ("t", 10)]


def test_stale_frames_and_a_session_that_comes_back(spark, tmp_path):
    batches = [
        [("s", 0, at(0), 2), ("s", 1, at(1), 1), ("s", 2, at(2), 2)],
        [("s", 3, at(3), 1), ("s", 4, at(4), 3)],
        [("other", 5, at(60), 0)],
        [("other", 6, at(61), 0)],  # the watermark has passed the end of s by now
        [("s", 7, at(62), 1)],
    ]
    found = feed(spark, tmp_path, batches, FRAMES, lambda s: requests.drop_stale(s, idle=5000))
    assert sorted(found) == [("other", 5), ("other", 6), ("s", 0), ("s", 2), ("s", 4), ("s", 7)]


def test_reports_keep_their_distance_over_batches(spark, tmp_path):
    batches = [[("s", i, at(i * 0.4), 0) for i in range(3)], [("s", i, at(i * 0.4), 0) for i in range(3, 7)]]
    found = feed(spark, tmp_path, batches, FRAMES, lambda s: requests.report(s, 1000))
    assert sorted(found) == [("s", 0), ("s", 3), ("s", 6)]


@pytest.mark.parametrize("when", ["before", "later batch"])
def test_cancelled_documents(spark, tmp_path, when):
    first = [("d", 0, at(0)), ("e", 1, at(0))]
    then = [("d", 2, at(10)), ("e", 3, at(10))]
    cancel = [("d", at(0) if when == "before" else at(10))]
    second = [cancel, []] if when == "before" else [[], cancel]
    found = feed(spark, tmp_path, [first, then], "document_id string, seq long, at timestamp", requests.drop_cancelled, "1 minute", ("document_id string, at timestamp", second))
    assert sorted(found) == ([("e", 1), ("e", 3)] if when == "before" else [("d", 0), ("e", 1), ("e", 3)])


def test_only_the_latest_request_is_made(spark, tmp_path):
    batches = [
        [("d", 1, at(0), "a"), ("d", 2, at(1), "b"), ("e", 1, at(0), "x")],
        [("d", 0, at(0.5), "older"), ("d", 3, at(2), "c")],
        [("f", 1, at(30), "end")],
        [("f", 2, at(31), "end of all")],
    ]
    found = feed(spark, tmp_path, batches, "document_id string, seq long, at timestamp, request string", lambda s: requests.latest_request(s, 3000))
    assert sorted(found) == [("d", 3, "c"), ("e", 1, "x")]
