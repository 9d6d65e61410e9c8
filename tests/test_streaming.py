"""A finished stream gives the rows of the batch job, whatever the micro-batches."""

import pytest
from pyspark.sql import functions as F

from lexstream.operators import revision as rv
from lexstream.operators import segments as sg
from lexstream.plans import inputs as inp
from lexstream.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def as_stream(spark, df, order, folder, parts):
    """Write rows as files in their order and read them back a file at a time."""
    path = f"{folder}/in"
    n = df.agg(F.max(order)).first()[0] + 1
    for i in range(parts):
        part = df.filter((F.col(order) >= n * i // parts) & (F.col(order) < n * (i + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def finish(out, folder):
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    q.trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.parquet(f"{folder}/out")


def same(a, b, cols):
    rows = lambda d: sorted(map(repr, d.select(*cols).collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("parts", [1, 3])
def test_commit_stream(spark, folder, parts):
    h = inp.hypotheses(spark, SF).filter("conv_id < 6")
    live = finish(jobs.commit_stream(as_stream(spark, h, "revision", folder, parts)), folder)
    cols = ["stream_id", "in_revision", "revision", "text", "is_final", "hold_ms"]
    same(live, rv.commit(h), cols)


def test_request_stream(spark, folder):
    h = inp.hypotheses(spark, SF).filter("conv_id < 6")
    live = finish(jobs.request_stream(as_stream(spark, h, "revision", folder, 2)), folder).filter("requested")
    same(live, rv.schedule_requests(rv.commit(h)), ["stream_id", "in_revision", "revision", "text"])


def test_phrase_stream(spark, folder):
    c = rv.commit(inp.hypotheses(spark, SF).filter("conv_id < 6"))
    u = c.select(
        "stream_id", F.col("revision").alias("seq"), "text", "lang", F.col("revision").alias("source_revision"), "is_final",
        F.timestamp_millis("at_ms").alias("at"),
    )
    o = dict(low=4, high=12, mode="stable_sentence")
    live = finish(jobs.phrase_stream(as_stream(spark, u, "seq", folder, 3), **o), folder)
    same(live, rv.phrases(u, **o), ["stream_id", "phrase_no", "source_revision", "text", "is_final"])


def test_segment_stream(spark, folder):
    f = inp.frames(spark, SF)
    end = f.groupBy("stream_id").agg((F.max("frame_no") + 1).alias("frame_no")).select(
        "stream_id", "frame_no", F.lit(False).alias("voiced"), F.lit(True).alias("end_of_stream")
    )
    rows = f.withColumn("end_of_stream", F.lit(False)).unionByName(end)
    o = dict(padding=2, min_speech=3, end_silence=5, emit=6, longest=60)
    live = finish(jobs.segment_stream(as_stream(spark, rows, "frame_no", folder, 3), **o), folder)
    same(live, sg.segments(f, **o), ["stream_id", "first_frame", "lead_frames", "end_frame", "n_frames", "at_frame", "is_final"])


def test_guard_stream(spark, folder):
    rows = spark.createDataFrame(
        [("a", 1, 1, False), ("a", 2, 3, False), ("a", 3, 2, False), ("a", 4, 4, True), ("a", 5, 1, False)],
        "stream_id string, seq int, revision int, is_final boolean",
    )
    live = finish(jobs.guard_stream(as_stream(spark, rows, "seq", folder, 2)), folder)
    assert sorted((r.revision, r.stale) for r in live.collect()) == [(1, False), (1, False), (2, True), (3, False), (4, False)]


def test_batch_operator_on_a_stream(spark, folder):
    from lexstream.operators import rewrite as rw

    docs = inp.table(spark, SF, "documents").filter("doc_id < 40")
    forms = inp.active_forms(spark)
    job = lambda d: rw.canonicalize(d, ["doc_id"], "text", "lang", forms)
    s = as_stream(spark, docs, "doc_id", folder, 2)
    jobs.for_each_batch(s, job, f"{folder}/out", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    same(spark.read.parquet(f"{folder}/out"), job(docs), ["doc_id", "canonical_text", "n_corrections"])


def test_windows_and_repeats_on_a_stream(spark, folder):
    from lexstream.operators import events as ev

    e = inp.event_log(spark, SF).select(
        F.col("type").alias("name"), F.floor("value").alias("amount"), "emitted_at", "event_id", "session_id"
    )
    s = as_stream(spark, e.withColumn("day", F.dayofyear("emitted_at")), "day", folder, 3)
    live = finish(ev.windowed_counters(s, "emitted_at", "1 hour", watermark="1 day"), folder)
    whole = ev.windowed_counters(e, "emitted_at", "1 hour")
    last = live.agg(F.max("window_end")).first()[0]
    same(live, whole.filter(F.col("window_end") <= F.lit(last)), live.columns)
    assert live.count() > whole.count() * 0.8
    once = jobs.once(as_stream(spark, e.withColumn("day", F.lit(1)), "day", f"{folder}/2", 1), ["session_id", "name"], "emitted_at", "1 day")
    assert finish(once, f"{folder}/2").count() == e.select("session_id", "name").distinct().count()
