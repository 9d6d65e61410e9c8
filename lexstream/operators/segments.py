"""Voice frames: runs, segments, fixed-size frames.

Frames are (stream_id, frame_no, voiced), numbered without gaps.  Frames first shrink to runs of
equal value.  A silence long enough to end any utterance and to refill the padding leaves the same
state whatever came before it, so a stream is cut there and its parts are folded apart: a stream
that never stops talking is the only one that stays in one task.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import schema
from . import keyed, ordered, voice

SETTINGS = dict(padding=10, min_speech=12, end_silence=30, emit=25, longest=750, context=0)
SEGMENTS = schema(
    "stream_id string, part long, first_frame long, lead_frames array<long>, from_frame long, end_frame long, "
    "n_frames long, at_frame long, is_final boolean, is_cut boolean, context_frames int"
)


def frame_runs(
    frames: DataFrame, breaks: Column | None = None, cut: ordered.Layout | None = None, rows: int = ordered.PART_ROWS
) -> DataFrame:
    """Runs of equal ``voiced``: (stream_id, start, n, voiced); ``breaks`` forces a new run."""
    place = (["stream_id"], ["frame_no"])
    cut = cut or ordered.layout(frames, *place, rows)
    d = ordered.previous(cut.parted(frames), *place, {"__was": F.col("voiced")}, cut=cut)
    opens = F.col("__was").isNull() | (F.col("__was") != F.col("voiced"))
    if breaks is not None:
        opens = opens | breaks
    d = ordered.scan(d, *place, {"start": ordered.Max(F.when(opens, F.col("frame_no")))}, cut=cut)
    extra = [F.max_by("cut", -F.col("frame_no")).alias("cut")] if "cut" in frames.columns else []
    # Tasks send a row for each of their runs; a run that goes on in another part is put together here.
    return d.groupBy("stream_id", "start").agg(F.count("*").alias("n"), F.any_value("voiced").alias("voiced"), *extra)


def segments(frames: DataFrame, cuts: DataFrame | None = None, rows: int = ordered.PART_ROWS, **options) -> DataFrame:
    """Partial and final voice segments.

    Frames are referred to by number: ``lead_frames`` (silence before the speech) and then
    ``from_frame`` to ``end_frame`` (exclusive).  ``cuts`` holds endpoint requests
    (stream_id, at_frame, first_frame, frames); ``frames`` null means to end at once.
    """
    o = {**SETTINGS, **options}
    d, breaks = frames.select("stream_id", "frame_no", "voiced"), None
    if cuts is not None:
        c = cuts.groupBy("stream_id", F.col("at_frame").alias("frame_no")).agg(
            F.struct(F.max("first_frame").alias("first"), F.max("frames").alias("frames")).alias("cut")
        )
        d = d.join(c, ["stream_id", "frame_no"], "left")
        breaks = F.col("cut").isNotNull()
    cut = ordered.layout(frames, ["stream_id"], ["frame_no"], rows)
    runs = frame_runs(d, breaks, cut)
    if cuts is None:
        runs = runs.withColumn("cut", F.lit(None).cast("struct<first:long,frames:long>"))
    quiet = o["end_silence"] + o["padding"]
    # With cut requests a pending request may outlive a silence, so those streams stay whole.
    splits = (~F.col("voiced") & (F.col("n") >= quiet)) if cuts is None else F.lit(False)
    # Runs start at frames, so the places where frames are cut divide them as well.
    starts = ordered.Layout(["stream_id"], ["start"], cut.hot)
    runs = ordered.scan(runs, ["stream_id"], ["start"], {"part": ordered.Sum(splits.cast("bigint"), inclusive=False)}, cut=starts)
    if cuts is None:
        # The silence that ends a part also fills the padding of the next one.
        padding = F.lit(o["padding"]).cast("bigint")
        this = F.struct("start", "n", "voiced", "cut", "part")
        tail = F.struct(
            (F.col("start") + F.col("n") - padding).alias("start"), padding.alias("n"), "voiced", "cut", (F.col("part") + 1).alias("part")
        )
        both = F.when(splits, F.array(this, tail)).otherwise(F.array(this))
        runs = runs.select("stream_id", F.explode(both).alias("r")).select("stream_id", "r.*")
    step = partial(voice.segment_step, **{k: o[k] for k in SETTINGS})
    flush = _flush
    return keyed.fold(runs, ["stream_id", "part"], ["start"], step, SEGMENTS, flush)


def _flush(state: dict, last: dict) -> list[dict]:
    return voice.segment_flush(state, last["start"] + last["n"])


def rechunk(chunks: DataFrame, size: int, keep_tail: bool = True, **options) -> DataFrame:
    """Cut the samples of a stream into frames of ``size`` across row borders.

    ``chunks``: stream_id, sequence, samples.  Offsets are running sums; each row gives its part of
    every frame it touches, and the parts of one frame meet in a group of bounded size.
    """
    n = F.size("samples").cast("bigint")
    d = ordered.scan(chunks.filter(F.size("samples") > 0), ["stream_id"], ["sequence"], {"__to": ordered.Sum(n)}, **options)
    d = d.withColumn("__from", F.col("__to") - n)
    first, last = F.floor(F.col("__from") / size), F.floor((F.col("__to") - 1) / size)
    d = d.withColumn("frame_no", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("frame_no") * size, F.col("__from"))
    hi = F.least((F.col("frame_no") + 1) * size, F.col("__to"))
    part = F.slice("samples", (lo - F.col("__from") + 1).cast("int"), (hi - lo).cast("int"))
    g = d.select("stream_id", "frame_no", lo.alias("lo"), part.alias("part")).groupBy("stream_id", "frame_no").agg(
        F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("ps")
    )
    out = g.select("stream_id", "frame_no", F.flatten(F.transform("ps", lambda x: x["part"])).alias("samples"))
    return out if keep_tail else out.filter(F.size("samples") == size)
