"""Tracks of a stream against tracks of all matches at once, after every batch, with restarts and batches that run again."""

import random

from manyview.operators import tracks
from manyview.streaming import MATCHES
from manyview.streaming.tracks import TrackState, keep_tracks


def everything(df):
    return sorted(map(tuple, df.select("img_id", "kp_id", "degree", "label").collect()))


def test_equal_after_each_batch(spark, tmp_path):
    draw, seen = random.Random(6), []
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for number in range(4):
        i = [draw.randrange(5) for _ in range(40)]
        rows = [(k, draw.randrange(k + 1, 7), draw.randrange(12), draw.randrange(12)) for k in i]
        if number == 2:
            rows += seen[:15] + rows[:5]  # old and repeated ones
        if number == 3:
            rows = [(0, 6, k, k) for k in range(12)]  # joins what earlier batches kept apart
        seen += rows
        spark.createDataFrame(rows, MATCHES).coalesce(1).write.mode("append").parquet(source)
        keep_tracks(spark, source, state, str(tmp_path / "log")).awaitTermination()  # a new query each time: a restart
        whole = spark.createDataFrame(seen, MATCHES).distinct()
        assert everything(TrackState(spark, state).labelled()) == everything(tracks.labelled(whole))
    got, expected = TrackState(spark, state).tracks(), tracks.build(tracks.labelled(whole))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_a_batch_may_run_again(spark, tmp_path):
    state = TrackState(spark, str(tmp_path))
    first, second = ([(0, 1, 0, 0), (2, 3, 0, 0)], [(1, 2, 0, 0), (1, 2, 5, 5)])
    state.add(spark.createDataFrame(first, MATCHES), 0)
    state.add(spark.createDataFrame(second[:1], MATCHES), 1)
    state.add(spark.createDataFrame(second, MATCHES), 1)
    assert everything(state.labelled()) == everything(tracks.labelled(spark.createDataFrame(first + second, MATCHES)))


def test_a_batch_reads_its_own_images(spark, tmp_path):
    state = TrackState(spark, str(tmp_path))
    state.add(spark.createDataFrame([(k, k + 1, 0, 0) for k in range(0, 20, 2)], MATCHES), 0)
    plan = state.read("nodes", 1, [4, 5]).select("node", "label")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "img_id" in plan and len(state.read("nodes", 1, [4, 5]).inputFiles()) > 0
    assert {r["img_id"] for r in state.read("nodes", 1, [4, 5]).collect()} == {4, 5}
    assert TrackState(spark, str(tmp_path / "none")).labelled().collect() == []
