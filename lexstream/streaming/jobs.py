"""Streaming forms of the revision operators.

The steps are those of the batch operators, so a finished stream gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import detokenize
from ..operators import agreement, chunking, keyed, voice
from ..operators import revision as rv
from ..schemas import schema

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drop(rows: T.StructType, name: str) -> T.StructType:
    return T.StructType([f for f in rows.fields if f.name != name])


def _run(rows: DataFrame, order: list[str], step, out: T.StructType, ttl_ms: int) -> DataFrame:
    fold = keyed.processor(["stream_id"], order, step, out, ttl_ms)
    return rows.groupBy("stream_id").transformWithStateInPandas(fold, out, "append", "ProcessingTime" if ttl_ms else "None")


def commit_stream(hypotheses: DataFrame, ttl_ms: int = 0, **options) -> DataFrame:
    """Commits of a stream of hypotheses; ``open_spans`` may be filled upstream from a static table.

    A final row resets its stream, so utterances need no numbering here.
    """
    step = partial(agreement.commit_step, **{**rv.COMMIT, **options})
    rows = rv.commit_input(hypotheses)
    out = _run(rows, ["revision"], step, _drop(rv.COMMITTED, "utterance"), ttl_ms)
    return out.withColumn("text", detokenize("tokens", F.col("lang")))


REQUESTED = T.StructType(_drop(rv.COMMITTED, "utterance").fields + [
    T.StructField("requested", T.BooleanType()), T.StructField("text_ends", T.BooleanType())
])


def _commit_and_request(state: dict, row: dict, commit: Callable, request: Callable) -> list[dict]:
    out = []
    for c in commit(state.setdefault("commit", {}), row):
        ends = agreement.sentence_ends(c["tokens"], c["lang"])[-1:] == [len(c["tokens"])] and bool(c["tokens"])
        asked = request(state.setdefault("request", {}), {**c, "n_tokens": len(c["tokens"]), "ends_sentence": ends})
        out.append({**c, "requested": bool(asked), "text_ends": ends})
    return out


def request_stream(hypotheses: DataFrame, commit: dict | None = None, request: dict | None = None, ttl_ms: int = 0) -> DataFrame:
    """Commits with the wait-k decision on each, in one state per stream."""
    step = partial(
        _commit_and_request,
        commit=partial(agreement.commit_step, **{**rv.COMMIT, **(commit or {})}),
        request=partial(agreement.request_step, **{**rv.REQUEST, **(request or {})}),
    )
    out = _run(rv.commit_input(hypotheses), ["revision"], step, REQUESTED, ttl_ms)
    return out.withColumn("text", detokenize("tokens", F.col("lang")))


def phrase_stream(rows: DataFrame, ttl_ms: int = 0, **options) -> DataFrame:
    """Phrases of a stream of revisions.

    A finished stream leaves a mark that makes duplicate finals silent until ``ttl_ms``.
    """
    step = partial(chunking.phrase_step, **{**rv.PHRASE, **options})
    out = _run(rv.phrase_input(rows), ["seq"], step, rv.PHRASES, ttl_ms)
    return out.withColumn("text", detokenize("tokens", F.col("lang")))


def _segment_frames(state: dict, row: dict, **options) -> list[dict]:
    if row.get("end_of_stream"):
        out = voice.segment_flush(state, row["frame_no"])
        state.clear()
        return out
    run = {"start": row["frame_no"], "n": 1, "voiced": row["voiced"], "cut": row.get("cut")}
    return voice.segment_step(state, run, **options)


def segment_stream(frames: DataFrame, ttl_ms: int = 0, **options) -> DataFrame:
    """Voice segments of a stream of frames (stream_id, frame_no, voiced, end_of_stream)."""
    from ..operators import segments as sg

    step = partial(_segment_frames, **{**sg.SETTINGS, **options})
    return _run(frames, ["frame_no"], step, _drop(sg.SEGMENTS, "part"), ttl_ms)


def _guard(state: dict, row: dict) -> list[dict]:
    seen = state.get("seen", -1)
    stale = row["revision"] < seen
    state["seen"] = max(seen, row["revision"])
    if row["is_final"] and not stale:
        state.clear()
    return [{"revision": row["revision"], "is_final": row["is_final"], "stale": stale}]


GUARDED = schema("stream_id string, revision int, is_final boolean, stale boolean")


def guard_stream(results: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Mark results older than one that already arrived; a final forgets its stream."""
    return _run(results, ["seq"], _guard, GUARDED, ttl_ms)


def once(results: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Drop repeats of a key within the watermark: duplicate finals, repeated phrases."""
    return results.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def for_each_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Run a batch operator on every micro-batch and write its result.

    The dictionary operators (canonical forms, protected translation, spoken forms) need no state, so
    they run unchanged.  A batch overwrites its own folder, so a retried batch is not written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
