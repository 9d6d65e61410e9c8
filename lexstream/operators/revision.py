"""Revision streams: growing, self-correcting hypotheses of utterances.

Input rows are (stream_id, revision, lang, tokens, is_final, is_endpoint_cut, at) and so on.  A
stream may hold many utterances, each closed by a final row; ``utterances`` numbers them, so that a
busy stream spreads over tasks.
"""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_prefix, detokenize, ends_sentence, sentence_token_ends, tokenize
from ..schemas import schema
from . import agreement, chunking, keyed, matching, ordered

# Windows ----------------------------------------------------------------------------------------


def utterances(
    rows: DataFrame, stream: str, order: str, final: str = "is_final", name: str = "utterance", cut: ordered.Layout | None = None
) -> DataFrame:
    """Number utterances from 0: a new one opens with the first row after a final row."""
    ends = F.coalesce(F.col(final), F.lit(False)).cast("bigint")
    return ordered.scan(rows, [stream], [order], {name: ordered.Sum(ends, inclusive=False)}, cut=cut)


def revise_numbers(rows: DataFrame, stream: str, order: str, name: str = "revision") -> DataFrame:
    """Number the rows of a stream from 1."""
    return ordered.numbered(rows, [stream], [order], name)


def latest_partials(rows: DataFrame, stream: str, slot: Column, revision: str = "revision") -> DataFrame:
    """Keep finals and, per stream and slot, the newest partial unless a later final is in the slot.

    Adds ``coalesced``: the partials of the slot that gave way.  Both sides aggregate before the
    shuffle, so a crowded slot costs one row per task.
    """
    d = rows.withColumn("__slot", slot)
    newest = F.max(F.struct(F.col(revision)))
    g = d.groupBy(stream, "__slot").agg(
        newest.alias("__top"), F.sum((~F.col("is_final")).cast("bigint")).alias("__partials"),
        F.max(F.when(F.col("is_final"), F.col(revision))).alias("__final"),
    )
    g = g.select(
        F.col(stream).alias("__s"), F.col("__slot").alias("__t"), F.col("__top")[revision].alias("__top"),
        "__partials", "__final",
    )
    j = d.join(g, (F.col(stream) == F.col("__s")) & (F.col("__slot") == F.col("__t")))
    keep = F.col("is_final") | (F.col(revision) == F.col("__top"))
    kept_partial = F.col("__final").isNull() | (F.col("__final") < F.col("__top"))
    coalesced = F.col("__partials") - kept_partial.cast("bigint")
    return j.filter(keep).withColumn("coalesced", coalesced).drop("__s", "__t", "__top", "__partials", "__final", "__slot")


def drop_stale_generations(rows: DataFrame, source: str, generation: str = "generation") -> DataFrame:
    """Rows of the newest generation of each source."""
    top = rows.groupBy(source).agg(F.max(generation).alias("__top")).withColumnRenamed(source, "__s")
    j = rows.join(top, (F.col(source) == F.col("__s")) & (F.col(generation) == F.col("__top")))
    return j.drop("__s", "__top")


def overload_generations(rows: DataFrame, source: str, order: str, overload: Column) -> DataFrame:
    """Add ``generation``: the overloads of the source so far, the row itself included."""
    return ordered.scan(rows, [source], [order], {"generation": ordered.Sum(overload.cast("bigint"))})


def revision_guard(rows: DataFrame, stream: str, order: str, revision: str) -> DataFrame:
    """Add ``stale``: a result with a revision below the highest that arrived before it."""
    d = ordered.scan(rows, [stream], [order], {"__seen": ordered.Max(F.col(revision), inclusive=False)})
    return d.withColumn("stale", F.coalesce(F.col(revision) < F.col("__seen"), F.lit(False))).drop("__seen")


def changed_only(rows: DataFrame, stream: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before in their stream."""
    d = ordered.previous(rows, [stream], [order], {"__was": F.col(value), "__any": F.lit(True)})
    return d.filter(F.col("__any").isNull() | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__was", "__any")


def freeze_after_endpoint(rows: DataFrame, stream: str, endpoint_revision: str, revision: str = "revision") -> DataFrame:
    """Drop partials newer than a pending endpoint; the final passes."""
    late = F.col(revision) > F.col(endpoint_revision)
    return rows.filter(F.col("is_final") | ~F.coalesce(late, F.lit(False)))


def stable_prefix(rows: DataFrame, keys: list[str], order: str, n: int = 2, hold: int = 1) -> DataFrame:
    """Plain agreement: common prefix of the last ``n`` hypotheses, less ``hold`` tokens.

    Adds ``stable`` (null until ``n`` rows are there).  ``keys`` name an utterance: number busy
    streams with ``utterances`` first.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    agreed = F.col("tokens")
    for k in range(1, n):
        agreed = common_prefix(agreed, F.lag("tokens", k).over(w))
    d = rows.withColumn("__agreed", agreed)
    d = d.withColumn("__agreed", F.when(F.lag(F.lit(1), n - 1).over(w).isNotNull() if n > 1 else F.lit(True), F.col("__agreed")))
    whole = ends_sentence(detokenize("__agreed", F.col("lang")))
    kept = F.slice("__agreed", F.lit(1), F.greatest(F.size("__agreed") - hold, F.lit(0)))
    return d.withColumn("stable", F.when(whole, F.col("__agreed")).otherwise(kept)).drop("__agreed")


def revision_rates(rows: DataFrame, stream: str) -> DataFrame:
    """Partials, finals and revisions per stream and per second."""
    span = (F.max(F.unix_micros("at")) - F.min(F.unix_micros("at"))) / 1e6
    return rows.groupBy(stream).agg(
        F.count_if(~F.col("is_final")).alias("partials"), F.count_if("is_final").alias("finals"),
        F.count("*").alias("revisions"), F.when(span > 0, F.count("*") / span).alias("per_second"),
    )


# Commit, requests, phrases ----------------------------------------------------------------------

_SPANS = "array<struct<start:int,end:int>>"
_KEY = ["stream_id", "utterance"]
#: Columns the request step reads.
REQUEST_READS = [
    *_KEY, "in_revision", "revision", "lang", "is_final", "at_ms", "since_ms", "is_endpoint", "n_tokens", "ends_sentence",
]


COMMITTED = schema(
    "stream_id string, utterance long, in_revision int, revision int, lang string, tokens array<string>, "
    "is_final boolean, at_ms long, since_ms long, is_endpoint boolean, cut_s double, hold_events int, "
    "hold_ms long, flushes int, n_frozen int"
)
PHRASES = schema(
    "stream_id string, phrase_no int, source_revision int, tokens array<string>, is_final boolean, "
    "source_is_final boolean, at_ms long, lang string, shifts int, oversized int"
)

COMMIT = dict(agreement=2, hold_tokens=1, term_timeout_ms=1500, endpoint=0)
REQUEST = dict(
    wait=6, update=4, timeout_ms=1200, zh_wait=12, zh_update=8, zh_timeout_ms=1000, interval_ms=500,
    sentences_only=False,
)
PHRASE = dict(low=8, high=24, agreement=2, mode="final_utterance")


def commit_input(hypotheses: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Columns the commit step reads; open term prefixes are found in the row, or by a join where ``prefixes`` are many."""
    d = hypotheses
    words = F.lit(None).cast("array<struct<tokens:array<string>,end:double>>")
    if "words" in d.columns:
        words = F.transform(
            "words", lambda w: F.struct(tokenize(w["text"], F.col("lang")).alias("tokens"), w["end"].alias("end"))
        )
    cut = F.col("is_endpoint_cut") if "is_endpoint_cut" in d.columns else F.lit(False)
    spans = F.lit(None).cast(_SPANS)
    d = d.withColumn("__words", words)
    if prefixes is not None:
        inside = matching.prefix_spans("tokens", "lang", prefixes, "is_open")
        if inside is None:
            hits = matching.prefix_hits(d, ["stream_id", "revision"], "tokens", "lang", prefixes).filter("is_open")
            grouped = hits.groupBy("stream_id", "revision").agg(F.collect_list(F.struct("start", "end")).alias("__open"))
            d = d.join(grouped, ["stream_id", "revision"], "left")
        spans = (F.col("__open") if inside is None else inside).cast(_SPANS)
    keep = [c for c in ("stream_id", "utterance") if c in d.columns]
    return d.select(
        *keep, "revision", "lang", "tokens", "is_final", cut.alias("is_endpoint_cut"),
        F.unix_millis("at").alias("at_ms"), spans.alias("open_spans"), F.col("__words").alias("words"),
    )


def commit(hypotheses: DataFrame, prefixes: DataFrame | None = None, rows: int = ordered.PART_ROWS, **options) -> DataFrame:
    """Local agreement commits of hypotheses, with locked sentences, term hold and endpoints.

    The fold runs by stream and numbers its utterances; streams that are too long for one task are numbered
    beforehand and folded by utterance.
    """
    step = partial(agreement.commit_step, **{**COMMIT, **options})
    cut = ordered.layout(hypotheses, ["stream_id"], ["revision"], rows)
    if cut.hot:
        d = utterances(hypotheses, "stream_id", "revision", cut=cut)
        out = keyed.fold(commit_input(d, prefixes), _KEY, ["revision"], step, COMMITTED)
    else:
        step = partial(agreement.numbered_step, step=step)
        out = keyed.fold(commit_input(hypotheses, prefixes), ["stream_id"], ["revision"], step, COMMITTED)
    return out.withColumn("text", detokenize("tokens", F.col("lang")))


def request_input(committed: DataFrame) -> DataFrame:
    return committed.withColumn("n_tokens", F.size("tokens")).withColumn("ends_sentence", ends_sentence("text"))


def schedule_requests(committed: DataFrame, **options) -> DataFrame:
    """Committed rows that become translation requests under wait-k."""
    step = partial(agreement.request_step, **{**REQUEST, **options})
    return keyed.pick(committed, _KEY, ["in_revision"], step, request_input(committed), REQUEST_READS)


def _with_terms(d: DataFrame, keys: list[str], prefixes: DataFrame | None) -> DataFrame:
    """Add ``term_hits``: the token spans of whole terms in ``tokens``."""
    if prefixes is None:
        return d.withColumn("term_hits", F.lit(None).cast(_SPANS))
    inside = matching.prefix_spans("tokens", "lang", prefixes, "is_term")
    if inside is not None:
        # A generator keeps Spark from copying the search into the expressions that read it.
        return d.select("*", F.explode(F.array(inside.cast(_SPANS))).alias("term_hits"))
    found = matching.prefix_hits(d, keys, "tokens", "lang", prefixes).filter("is_term")
    names = [f"__k{i}" for i in range(len(keys))]
    side = found.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.collect_list(F.struct("start", "end")).cast(_SPANS).alias("term_hits")
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return d.join(side, same, "left").drop(*names)


def phrase_input(rows: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Columns the phrase step reads, from (stream_id, seq, text, lang, source_revision, is_final, at)."""
    d = rows.withColumn("tokens", tokenize("text", F.col("lang")))
    d = d.withColumn("sentence_ends", sentence_token_ends("text", F.col("lang")))
    return _with_terms(d, ["stream_id", "seq"], prefixes).select(
        "stream_id", "seq", "source_revision", "lang", "tokens", "is_final", F.unix_millis("at").alias("at_ms"),
        "sentence_ends", "term_hits",
    )


def phrases(rows: DataFrame, prefixes: DataFrame | None = None, **options) -> DataFrame:
    """Speakable phrases of translated streams, with agreement; contradicted ones are withdrawn."""
    step = partial(chunking.phrase_step, **{**PHRASE, **options})
    out = keyed.fold(phrase_input(rows, prefixes), ["stream_id"], ["seq"], step, PHRASES)
    return out.withColumn("text", detokenize("tokens", F.col("lang")))


def chunk_finals(texts: DataFrame, keys: list[str], text: str, lang: str, prefixes: DataFrame | None = None, low: int = 8, high: int = 24) -> DataFrame:
    """Phrases of final texts: at most ``high`` tokens, sentences first, commas next, terms whole.

    Returns the keys and (phrase_no, lang, tokens, text, is_final, shifts, oversized).  Python sees the
    places of sentence ends, commas and terms, not the texts; rows are shuffled only to meet their terms.
    """
    d = texts.select(*keys, F.col(lang).alias("lang"), F.col(text).alias("__text"))
    d = d.withColumn("tokens", tokenize("__text", F.col("lang")))
    d = d.withColumn("__ends", sentence_token_ends("__text", F.col("lang"))).drop("__text")
    places = F.transform("tokens", lambda t, i: F.when(t.isin(*chunking.COMMAS), i + 1))
    d = _with_terms(d.withColumn("__commas", F.array_compact(places)), keys, prefixes)

    def cuts(sizes: pd.Series, ends: pd.Series, commas: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for n, e, c, h in zip(sizes, ends, commas, hits):
            spans = chunking.disjoint(h if h is None else list(h), n)
            found = chunking.cuts(0, max(0, n), list(e), list(c), spans, low, high, "stable_sentence", True)
            out.append([dict(zip(("end", "shifts", "oversized"), x)) for x in found])
        return pd.Series(out)

    cut = F.pandas_udf(cuts, "array<struct<end:int,shifts:int,oversized:int>>")
    none = F.array().cast("array<int>")
    size = F.coalesce(F.size("tokens"), F.lit(0))
    d = d.withColumn("__cuts", cut(size, F.coalesce("__ends", none), F.coalesce("__commas", none), "term_hits"))

    def phrase(c: Column, i: Column) -> Column:
        start = F.coalesce(F.get("__cuts", i - 1)["end"], F.lit(0))
        return F.struct(
            (i + 1).cast("int").alias("phrase_no"), F.slice("tokens", start + 1, c["end"] - start).alias("tokens"),
            (c["end"] == F.size("tokens")).alias("is_final"), c["shifts"].alias("shifts"), c["oversized"].alias("oversized"),
        )

    out = d.select(*keys, "lang", F.explode(F.transform("__cuts", phrase)).alias("p")).select(*keys, "lang", "p.*")
    return out.withColumn("text", detokenize("tokens", F.col("lang")))


# Endpoints --------------------------------------------------------------------------------------


def cut_positions(rows: DataFrame, keys: list[str], sentences: int, rate: Column) -> DataFrame:
    """Sample position at which the n-th committed sentence ends, from word timings.

    ``rows``: keys, tokens (committed), lang, words, n_samples.  Null if the lexical tokens of the
    sentences are not the first timed words.  All within one utterance row.
    """
    lexical = lambda ts: F.filter(ts, lambda t: t.rlike(r"[\p{L}\p{N}]"))
    low = lambda ts: F.transform(ts, lambda t: F.lower(t))
    ends = sentence_token_ends(detokenize("tokens", F.col("lang")), F.col("lang"))
    n_end = F.get(ends, F.lit(sentences - 1))
    d = rows.withColumn("__n", n_end)
    d = d.withColumn("__want", F.when(F.col("__n").isNotNull(), low(lexical(F.slice("tokens", F.lit(1), F.col("__n"))))))
    timed = F.flatten(
        F.transform(
            "words",
            lambda w: F.transform(
                low(lexical(tokenize(w["text"], F.col("lang")))),
                lambda t: F.struct(t.alias("t"), w["end"].alias("end")),
            ),
        )
    )
    d = d.withColumn("__timed", timed)
    size = F.size("__want")
    got = F.transform(F.slice("__timed", F.lit(1), size), lambda x: x["t"])
    end = F.get("__timed", size - 1)["end"]
    ok = (size > 0) & (got == F.col("__want")) & (end < float("inf")) & ~F.isnan(end)
    cut = F.when(ok, F.rint(end * rate).cast("bigint"))
    cut = F.when(cut > 0, F.least(cut, F.col("n_samples").cast("bigint")))
    return d.withColumn("cut_sample", cut).drop("__n", "__want", "__timed")
