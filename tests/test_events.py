"""Reports, audio and event logs against plain restatements."""

import datetime as dt
import json
import random
import wave

import numpy as np
from pyspark.sql import functions as F

from lexstream.operators import events as ev
from lexstream.operators import quality as ql
from lexstream.operators import revision as rv
from lexstream.sources import audio, eventlog

T0 = dt.datetime(2024, 1, 1)


def test_playback_equals_the_loop(spark):
    rng = random.Random(8)
    rows = [(1, i, i * 3 + rng.randint(0, 40), rng.randint(1, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "s int, i int, a long, d long")
    got = {r.i: (r.start, r.finish) for r in ev.playback(d, "s", "i", F.col("a"), F.col("d"), rows=40).collect()}
    end = -(10**9)
    for _, i, a, n in rows:
        start = max(a, end)
        end = start + n
        assert got[i] == (start, end)


def test_lossless(spark):
    rows = [("error", None, None), ("asr_committed", True, None), ("asr_committed", False, None), ("tts_partial", None, True),
            ("tts_partial", None, None), ("asr_partial", True, True)]
    d = spark.createDataFrame(rows, "t string, f boolean, s boolean")
    got = [r[0] for r in d.select(ev.is_lossless(F.col("t"), F.col("f"), F.col("s"))).collect()]
    assert got == [True, True, False, True, False, False]


def test_finals_survive_coalescing(spark):
    rows = [("s", i, i == 50) for i in range(1, 101)]
    d = spark.createDataFrame(rows, "stream_id string, revision int, is_final boolean")
    got = sorted((r.revision, r.coalesced) for r in rv.latest_partials(d, "stream_id", F.lit(0)).collect())
    assert got == [(50, 98), (100, 98)]


def test_term_accuracy(spark):
    want = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a")], "case_id string, term_id string")
    got = spark.createDataFrame([("c1", "a"), ("c2", "x"), ("c2", "a")], "case_id string, term_id string")
    ban = spark.createDataFrame([("c2", "x")], "case_id string, term_id string")
    cases = spark.createDataFrame([("c1", "en", 1.0), ("c2", "vi", 1.0), ("c3", "vi", 2.0)], "case_id string, lang string, m double")
    o = ql.term_outcomes(want, got, ban)
    assert sorted((r.case_id, r.term_id, r.outcome) for r in o.collect()) == [
        ("c1", "a", "hit"), ("c1", "b", "miss"), ("c2", "a", "hit"), ("c2", "x", "excluded_hit")
    ]
    t = {r.lang: r for r in ql.term_accuracy(o, cases, "lang", minutes="m").collect()}
    assert (t["en"].recall, t["vi"].precision, t[None].false_per_minute) == (0.5, 0.5, 0.25)


def test_wav_chunks(spark, folder):
    x = (np.arange(1000) - 500).astype("<i2")
    with wave.open(f"{folder}/a.wav", "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(x.tobytes())
    rows = audio.read_wav_chunks(spark, folder).orderBy("sequence").collect()
    assert [len(r.samples) for r in rows] == [320, 320, 320, 40]
    assert [r.end_of_stream for r in rows] == [False, False, False, True]
    assert np.allclose(np.concatenate([r.samples for r in rows]), x / 32768)


def test_event_json(spark, folder):
    d = spark.createDataFrame([(1, [0.1, 0.2], ("hi", [1.0, 2.0, 3.0]))],
                              "event_id long, samples array<double>, payload struct<text:string,samples:array<double>>")
    assert json.loads(eventlog.to_event_json(d).first()[0]) == {
        "event_id": 1, "sample_count": 2, "payload": {"text": "hi", "sample_count": 3}
    }
    rows = [(i, "error", "s", f"m{i}", T0 + dt.timedelta(seconds=i), {"latency_ms": float(i)}) for i in range(8)]
    e = spark.createDataFrame(rows, eventlog.EVENTS)
    eventlog.write_events(e, f"{folder}/log")
    back = eventlog.read_events(spark, f"{folder}/log")
    assert sorted(back.collect()) == sorted(e.collect())
    assert [r.event_id for r in ev.last_messages(back, "session_id").orderBy("rank").collect()] == [7, 6, 5, 4, 3]
    assert [r.event_id for r in ev.read_ahead(back, 2).collect()] == [0, 1]
