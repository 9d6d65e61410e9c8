"""Event-log reports: counters, latency, sessions, playback.

Event rows are (event_id, session_id, type, emitted_at, message, metrics, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from . import ordered

# Event types that no consumer may lose, and the guard behind a playback.
LOSSLESS = ("error", "overload", "asr_final", "translation_final", "tts_final")
PLAYBACK_GUARD_S = 0.15


def is_lossless(type_: Column, payload_final: Column, source_final: Column) -> Column:
    """Whether an event must not be dropped: finals, faults and what stems from a final."""
    yes = F.lit(True)
    return (
        type_.isin(*LOSSLESS)
        | ((type_ == "asr_committed") & payload_final.eqNullSafe(yes))
        | ((type_ == "tts_partial") & source_final.eqNullSafe(yes))
    )


def sum_counters(counters: DataFrame, *by: str) -> DataFrame:
    """Totals of (name, amount) counters."""
    return counters.groupBy(*by, "name").agg(F.sum("amount").alias("amount"))


def windowed_counters(counters: DataFrame, at: str, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Counter totals per event-time window; the same call serves tables and streams."""
    d = counters.withWatermark(at, watermark) if watermark else counters
    g = d.groupBy(F.window(at, length, slide or length), "name").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "name", "amount", "n")


def stage_latency(events: DataFrame, *by: str, probs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Distribution of every metric per ``by``, with exact percentiles: the least value that a share of the rows reaches.

    Equal values are counted before they are shuffled, and the counts run up along the values of a group
    (``ordered.scan``, which cuts a group of very many values), so groups of all sizes are treated alike.
    """
    keys = [*by, "name"]
    m = events.select(*by, F.explode("metrics").alias("name", "value"))
    g = m.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("__known"),
    )
    counts = m.filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("__n"))
    upto = ordered.scan(counts, keys, ["value"], {"__upto": ordered.Sum(F.col("__n"))})
    names = [f"__{k}" for k in keys]
    sizes = g.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "__known")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    ranked = upto.join(sizes, same)
    at = lambda q: F.min(F.when(F.col("__upto") >= F.greatest(F.ceil(F.lit(q) * F.col("__known")), F.lit(1)), F.col("value")))
    found = ranked.groupBy(*names).agg(*[at(q).alias(f"p{round(q * 100)}") for q in probs])
    return g.join(found, same, "left").drop(*names, "__known")


def session_report(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tails of each stage after the input, end to end time and feed drift, one row per session.

    ``events``: session_id, type, completed_at.  ``sessions``: session_id, input_started_at,
    input_finished_at, input_duration_s.  Marks before the input started do not count.
    """
    s = sessions.select("session_id", "input_started_at", "input_finished_at", "input_duration_s")
    finals = {"asr_end": ("asr_final",), "mt_end": ("translation_final",), "tts_end": ("tts_partial", "tts_final")}
    marks = [F.max(F.when(F.col("type").isin(*types), F.col("completed_at"))).alias(n) for n, types in finals.items()]
    wanted = [t for types in finals.values() for t in types]
    # The last mark of a stage counts if any does, so a busy session shrinks to one row before the join.
    e = events.filter(F.col("type").isin(*wanted)).groupBy("session_id").agg(*marks)
    r = s.join(e, "session_id", "left")
    for n in finals:
        r = r.withColumn(n, F.when(F.col(n) >= F.col("input_started_at"), F.col(n)))

    def gap(end: str, start: str) -> Column:
        micros = F.unix_micros(end) - F.unix_micros(start)
        return F.greatest(micros / 1e6, F.lit(0.0))

    gap_or_null = lambda end, start: F.when(F.col(end).isNotNull() & F.col(start).isNotNull(), gap(end, start))
    r = r.withColumn("pipeline_end", F.greatest("asr_end", "mt_end", "tts_end"))
    feed = gap_or_null("input_finished_at", "input_started_at")
    return r.select(
        "session_id",
        gap_or_null("asr_end", "input_finished_at").alias("asr_tail_s"),
        gap_or_null("mt_end", "asr_end").alias("mt_tail_s"),
        gap_or_null("tts_end", "mt_end").alias("tts_tail_s"),
        gap_or_null("pipeline_end", "input_finished_at").alias("post_input_s"),
        gap_or_null("tts_end", "input_started_at").alias("overall_s"),
        F.greatest(feed - F.col("input_duration_s"), F.lit(0.0)).alias("feed_drift_s"),
    )


def history(rows: DataFrame, session: str, order: list[str], text: str, rows_per_part: int = 4096) -> DataFrame:
    """Non-blank final texts, one part per ``rows_per_part`` texts, joined by blank lines.

    Parts keep the rows of a long session apart; ``part`` 0, 1, ... read one after the other give
    the whole history.
    """
    d = rows.filter(F.col("is_final") & ~is_blank(F.col(text)))
    d = ordered.numbered(d, [session], order, "__n")
    d = d.withColumn("__part", F.floor((F.col("__n") - 1) / rows_per_part))
    g = d.groupBy(session, "__part").agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text")))).alias("ts"), F.count("*").alias("n_texts")
    )
    joined = F.array_join(F.transform("ts", lambda x: x["__text"]), "\n\n")
    return g.select(session, F.col("__part").alias("part"), "n_texts", joined.alias("history"))


def last_messages(events: DataFrame, session: str, n: int = 5, types: tuple[str, ...] = ("overload", "error")) -> DataFrame:
    """The newest ``n`` warnings and errors of each session and type."""
    w = Window.partitionBy(session, "type").orderBy(F.desc("emitted_at"), F.desc("event_id"))
    d = events.filter(F.col("type").isin(*types)).withColumn("rank", F.row_number().over(w))
    return d.filter(F.col("rank") <= n)


def read_ahead(events: DataFrame, n: int) -> DataFrame:
    """The oldest ``n`` events."""
    return events.orderBy("emitted_at", "event_id").limit(n)


def playback(phrases: DataFrame, session: str, order: str, available: Column, duration: Column, **options) -> DataFrame:
    """Start and finish of phrases played one after another, in the time unit of ``available``.

    finish_i = max(available_i, finish_{i-1}) + duration_i, in one scan (``ordered.Finish``), so no row
    waits for the one before.
    """
    d = ordered.scan(phrases, [session], [order], {"finish": ordered.Finish(available, duration)}, **options)
    return d.withColumn("start", F.col("finish") - duration)


def pacing(chunks: DataFrame, session: str, order: str, at: Column, duration: Column, started: Column, **options) -> DataFrame:
    """How long each chunk must wait for the media clock: ``delay``, and how late it is: ``drift``."""
    d = ordered.scan(chunks, [session], [order], {"media": ordered.Sum(duration)}, **options)
    due = started + F.col("media")
    return d.withColumn("delay", F.greatest(due - at, F.lit(0))).withColumn("drift", F.greatest(at - due, F.lit(0)))


def phrase_audio(chunks: DataFrame, keys: list[str], order: str, samples: str, rate: str) -> DataFrame:
    """Samples of each phrase in order, with its duration; one phrase is one bounded group."""
    g = chunks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, samples))).alias("cs"), F.sum(F.size(samples)).alias("n_samples"),
        F.max(rate).alias("rate"),
    )
    joined = F.flatten(F.transform("cs", lambda c: c[samples]))
    return g.select(*keys, joined.alias("samples"), "n_samples", (F.col("n_samples") / F.col("rate")).alias("duration_s"))


def elapsed_since_previous(rows: DataFrame, key: str, order: str, at: str, **options) -> DataFrame:
    """Milliseconds since the row before in the same stream; null for the first."""
    d = ordered.previous(rows, [key], [order], {"__was": F.col(at)}, **options)
    ms = (F.unix_micros(at) - F.unix_micros("__was")) / 1000.0
    return d.withColumn("elapsed_ms", ms).drop("__was")
