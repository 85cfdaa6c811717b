"""The decoder over streams against a walk through each recording's frames, for many cuts and orders."""

import random
import time

import numpy as np
import pytest

from sonora.operators import decode
from sonora.plans import registry
from sonora.sources.storage import drained, replayed
from sonora.streaming import decode as streaming
from test_decode import HOP, decoded, recordings

SCHEMA = "recording_id string, frame_idx int, time_s double, prob double, n_frames int"


def rows_of(held):
    return [(k, i, t, p, len(f)) for k, f in held.items() for i, (t, p) in enumerate(f)]


def wanted(held, rule):
    return sorted(((k, *s) for k, f in held.items() for s in decoded(f, rule)), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_and_order(seed):
    """Frames dealt to micro-batches at random, some twice; the state packed and read back between them."""
    rng = random.Random(seed)
    rule = decode.Hysteresis(0.8, 0.2, rng.choice([0.0, 0.5]), rng.choice([0.0, 0.3, 0.6, 1.1]), rng.choice([0.0, 0.25, 5.0]))
    for f in recordings(seed).values():
        rows = [(i, t, float("nan") if p is None else p) for i, (t, p) in enumerate(f)]
        if seed % 2:
            rng.shuffle(rows)
        rows += rng.choices(rows, k=5) if seed % 3 else []
        state, got = streaming.Progress(), []
        cuts = sorted(rng.choices(range(len(rows)), k=rng.choice([0, 1, 3, 50])))
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            state.n_frames = len(f) if b == len(rows) else -1
            state = streaming.Progress.unpacked(state.packed())
            got += state.advance(np.array(rows[a:b], streaming.FRAME), rule)
        assert state.ended and not state.waiting and not len(state.early)
        assert got == decoded(f, rule)


def test_intervals_come_before_the_end():
    """What nothing later can change isn't held back, and the state doesn't grow with the recording."""
    rule = decode.Hysteresis(0.8, 0.2, 0.0, 0.5, 0.25)
    state, got = streaming.Progress(), 0
    for i in range(2000):
        got += len(state.advance(np.array([(i, i * HOP, 0.9 if i % 20 < 5 else 0.1)], streaming.FRAME), rule))
        assert len(state.waiting) <= 1 and not len(state.early)
    assert got == 100


def test_stream_in_micro_batches(spark):
    held = recordings(4)
    rule = decode.Hysteresis(0.8, 0.2, 0.5, 0.6, 0.25)
    rows = rows_of(held)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = drained(streaming.hysteresis_stream(replayed(df, 1), rule, n_frames="n_frames"))
    assert got.columns == ["recording_id", "onset", "offset"]
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(held, rule)


def test_a_query_that_starts_again_goes_on(spark, tmp_path):
    """The first frames and some of the later ones, the end of the query, the others: state comes from the checkpoint."""
    held, rule = recordings(0), decode.Hysteresis(0.8, 0.2, 0.0, 0.3)
    rows = rows_of(held)
    path, out = str(tmp_path / "frames"), str(tmp_path / "out")
    counts = []
    for later in (False, True):
        spark.createDataFrame([r for r in rows if (r[1] > 40 and r[1] % 2 == 1) == later], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = streaming.hysteresis_stream(spark.readStream.schema(SCHEMA).parquet(path), rule, n_frames="n_frames")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        counts.append(spark.read.parquet(out).count())
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=repr) == wanted(held, rule)
    assert 0 < counts[0] < counts[1]


def test_idle_recordings_end(spark, tmp_path):
    """Without a number of frames a recording ends after a while; frames over a gap are decoded then."""
    rule = decode.Hysteresis(0.8, 0.2, 0.0, 0.0)
    rows = [("a", i, i * HOP, p, None) for i, p in enumerate([0.1, 0.9, 0.5, 0.1, 0.1, 0.9]) if i != 2]
    path = str(tmp_path / "frames")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    stream = streaming.hysteresis_stream(spark.readStream.schema(SCHEMA).parquet(path), rule, idle_s=1.0)
    query = stream.writeStream.format("memory").queryName("idle").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while spark.table("idle").count() < 2 and time.time() < until:
            time.sleep(0.5)
        assert sorted(map(tuple, spark.table("idle").collect())) == [("a", HOP, 3 * HOP), ("a", 5 * HOP, 5 * HOP)]
    finally:
        query.stop()


def test_settings_and_no_frames(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        streaming.hysteresis_stream(df, decode.Hysteresis())
    with pytest.raises(ValueError):
        streaming.hysteresis_stream(df, decode.Hysteresis(), idle_s=0)
    assert drained(streaming.hysteresis_stream(replayed(df, 1), decode.Hysteresis(), n_frames="n_frames")).count() == 0


def test_query_equals_the_batch_decoder(spark):
    sf = "/root/testdata/sf0.001"
    got, batch = (sorted(map(tuple, registry.Q[q](spark, sf).collect())) for q in ("hysteresis_stream", "hysteresis_decode"))
    assert got == batch and got
