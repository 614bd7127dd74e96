
from gaugeworks.streaming import frames


def run(spark, df, out, tmp_path, name):
    """Feeds a frame to a stream in two files, one micro-batch each."""
    df.where("seq < 3").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = out(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        df.where("seq >= 3").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).orderBy("session_id", "seq").collect()


def test_repeated_frames_are_dropped_across_batches(spark, tmp_path):
    flat, other = bytes(16), bytes([200] * 16)
    rows = [("s", i, 1.0, p) for i, p in enumerate([flat, flat, other, other, flat, flat])]
    df = spark.createDataFrame(rows, "session_id string, seq long, sharpness double, pixels binary")
    found = run(spark, df, frames.accept_changed, tmp_path, "accepted")
    assert [r.accepted for r in found] == [True, False, True, False, True, False] and found[-1].n_accepted == 3


def test_stability_gate_drops_stale_generations(spark, tmp_path):
    rows = [("s", i, g, dx, 0.0, 0.5) for i, (g, dx) in enumerate([(1, 0.0), (1, 0.0), (0, 0.0), (1, 90.0), (1, 0.0), (2, 0.0)])]
    df = spark.createDataFrame(rows, "session_id string, seq long, generation long, dx double, dy double, response double")
    found = run(spark, df, lambda s: frames.gate_stable(s, 320.0), tmp_path, "gated")
    assert [(r.seq, r.streak, r.stable) for r in found] == [(0, 1, False), (1, 2, True), (3, 0, False), (4, 1, False), (5, 1, False)]



def test_tiles_are_built_where_the_view_stands(spark, tmp_path):
    places = [(0, 0), (0, 0), (0, 0), (0, 0), (50, 0), (50, 0), (50, 0), (90, 0), (90, 0), (90, 0)]
    rows = [("s", i, float(x), float(y), 0.5, 0.9 if x < 90 else 0.1) for i, (x, y) in enumerate(places)]
    df = spark.createDataFrame(rows, "session_id string, seq long, x double, y double, response double, match double")
    found = run(spark, df, lambda s: frames.build_tiles(s, 320.0), tmp_path, "tiles")
    assert [r.state for r in found] == [
        "settling", "sampling", "sampling", "sampling", "moving", "settling", "tile_committed", "moving", "settling", "candidate_rejected",
    ]
    assert [r.tile for r in found] == [0, 1, 1, 1, 1, 1, 2, 2, 2, 2] and found[3].n_frames == 3
