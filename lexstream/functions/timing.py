"""Word timings as arrays of structs (text, start, end, confidence), one array per utterance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import patterns as p
from .text import strip

WORD = "struct<text:string,start:double,end:double,confidence:double>"

# Gap kept before the next word, tolerance at the edge of the overlap, in seconds.
MAX_GUARD_S = 0.06
EDGE_S = 0.02


def valid_words(words: Column) -> Column:
    """Words with text and finite, ordered times, sorted by start; order is kept among equals."""
    finite = lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    good = lambda w: (
        (strip(w["text"]) != "") & finite(w["start"]) & finite(w["end"]) & (w["start"] >= 0) & (w["end"] > w["start"])
    )
    indexed = F.transform(
        words,
        lambda w, i: F.struct(w["start"].alias("start"), i.alias("i"), w["end"].alias("end"),
                              strip(w["text"]).alias("text"), w["confidence"].alias("confidence")),
    )
    ordered = F.array_sort(F.filter(indexed, good))
    return F.transform(ordered, lambda w: F.struct(w["text"], w["start"], w["end"], w["confidence"]).cast(WORD))


def strip_context(words: Column, lang: Column, context_s: Column, raw: Column | None = None) -> Column:
    """Struct (text, words) without the words of the acoustic overlap, times shifted to its end.

    Without an overlap, or without words, the text is ``raw``, the recognizer's own, if given.
    """
    context_s = F.greatest(context_s, F.lit(0.0))
    seen = F.filter(words, lambda w: w["start"] >= context_s - EDGE_S)
    shifted = F.transform(
        seen,
        lambda w: F.struct(
            w["text"].alias("text"),
            F.greatest(F.lit(0.0), w["start"] - context_s).alias("start"),
            F.greatest(F.lit(0.0), w["end"] - context_s).alias("end"),
            w["confidence"].alias("confidence"),
        ),
    )
    texts = F.transform(seen, lambda w: w["text"])
    joined = F.when(lang == "zh", F.array_join(texts, "")).otherwise(F.array_join(texts, " "))
    if raw is not None:
        own = (F.coalesce(context_s, F.lit(0.0)) <= 0) | (F.coalesce(F.size(words), F.lit(0)) <= 0)
        joined = F.when(own, raw).otherwise(joined)
    return F.struct(joined.alias("text"), shifted.cast(f"array<{WORD}>").alias("words"))


def merge_lines(lines: Column) -> Column:
    """Text of transcript lines (start, text) in time order; without times the newest comes first."""
    timed = F.forall(lines, lambda x: x["start"].isNotNull())
    by_time = F.transform(
        F.array_sort(F.transform(lines, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x["text"].alias("t")))),
        lambda x: x["t"],
    )
    newest_last = F.reverse(F.transform(lines, lambda x: x["text"]))
    texts = F.transform(F.when(timed, by_time).otherwise(newest_last), strip)
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def words_from_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Word timings from subword pieces: (keys, pos, piece, at, lang, duration_s) to (keys, text, start, end).

    A piece that opens with a space mark starts a word.  A word ends shortly before the next one
    starts, the last at the end of the utterance.  The windows run within one utterance.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    d = pieces.withColumn("raw", F.replace("piece", F.lit("▁"), F.lit(" ")))
    d = d.filter("raw <> '' and not startswith(raw, '<')").withColumn("at", F.greatest(F.lit(0.0), "at"))
    spaced = F.col("raw").rlike(f"^[{p.SPACE}]")
    opens = F.when((F.col("lang") == "zh") | spaced, 1).otherwise(0)
    d = d.withColumn("word", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = d.groupBy(*keys, "word").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "").alias("text"),
        F.min_by("at", "pos").alias("start"), F.max_by("at", "pos").alias("last"), F.min("pos").alias("pos"),
        F.max("duration_s").alias("duration_s"),
    )
    g = g.withColumn("text", strip("text")).filter(F.col("text").rlike(r"[\p{L}\p{N}]"))
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("pos"))
    guard = F.least(F.lit(MAX_GUARD_S), F.greatest(F.lit(0.0), nxt - F.col("last")) / 2)
    clip = lambda c: F.least(c, F.col("duration_s"))
    g = g.withColumn("end", F.when(nxt.isNotNull(), nxt - guard).otherwise(F.col("duration_s")))
    g = g.withColumn("start", clip(F.col("start"))).withColumn("end", clip(F.greatest("start", "end")))
    return g.select(*keys, "pos", "text", "start", "end")
