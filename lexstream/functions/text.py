"""Text column functions.  All are built-in Spark expressions, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p

_BLOCK = 64
# The look-behind keeps the search linear over long runs of spaces inside the text.
_TAIL = f"(?<![{p.SPACE}])[{p.SPACE}]++\\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst may copy a projected column into a lambda, which would evaluate it per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_up(n: Column) -> Column:
    """Array 0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running values of a short array of longs."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(None).cast("bigint").alias("total"))

    def step(a: Column, v: Column) -> Column:
        total = F.coalesce(op(a["total"], v), v)
        return F.struct(F.concat(a["out"], F.array(total)).alias("out"), total.alias("total"))

    return F.aggregate(values, start, step, lambda a: a["out"])


def _prefixes(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running values of an array, scanned block by block so that long arrays stay cheap."""
    values = values.cast("array<bigint>")

    def whole(v: Column) -> Column:
        n = F.floor((F.size(v) + (_BLOCK - 1)) / _BLOCK).cast("int")
        blocks = F.transform(count_up(n), lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))

        def join(bs: Column) -> Column:
            totals = F.transform(
                bs, lambda x: F.aggregate(x, F.lit(None).cast("bigint"), lambda a, e: F.coalesce(op(a, e), e))
            )
            return let(
                _scan(totals, op),
                lambda ends: F.flatten(
                    F.transform(
                        bs,
                        lambda x, i: let(
                            F.when(i > 0, F.get(ends, i - 1)),
                            lambda base: F.transform(_scan(x, op), lambda e: F.coalesce(op(base, e), e)),
                        ),
                    )
                ),
            )

        return let(blocks, join)

    return let(values, whole)


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array."""
    return _prefixes(values, lambda a, b: a + b)


def prefix_maxima(values: Column) -> Column:
    """Inclusive running maxima of an array."""
    return _prefixes(values, lambda a, b: F.greatest(a, b))


def counts_below(values: Column, places: Column, inclusive: bool = False) -> Column:
    """For each place of a sorted array, how many values of another one lie below it (or at it, with ``inclusive``).

    Both arrays are merged and walked once.
    """
    value, place = (0, 1) if inclusive else (1, 0)
    entry = lambda at, kind: F.struct(at.cast("bigint").alias("at"), F.lit(kind).alias("kind"))
    merged = F.array_sort(F.concat(F.transform(values, lambda v: entry(v, value)), F.transform(places, lambda x: entry(x, place))))

    def walk(xs: Column) -> Column:
        seen = prefix_sums(F.transform(xs, lambda x: (x["kind"] == value).cast("bigint")))
        both = F.transform(F.arrays_zip(xs.alias("x"), seen.alias("n")), lambda z: F.struct(z["x"]["kind"].alias("kind"), z["n"].alias("n")))
        return F.transform(F.filter(both, lambda z: z["kind"] == place), lambda z: z["n"].cast("int"))

    return let(merged, walk)


def sentence_of_token(ends: Column, n: Column) -> Column:
    """For each of ``n`` tokens the sentence end at or behind it; null behind the last one.

    ``ends`` are ascending token counts, each of which gives its number to the tokens since the one before.
    """

    def fill(es: Column) -> Column:
        runs = F.transform(es, lambda e, i: F.array_repeat(e, (e - F.coalesce(F.get(es, i - 1), F.lit(0))).cast("int")))
        last = F.coalesce(F.get(es, F.size(es) - 1), F.lit(0))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(None).cast("int"), (n - last).cast("int")))

    return let(ends, fill)


_PIECE = 512
_NEAR = 16


def pieces(c: Column) -> Column:
    """A text as pieces of fixed length, so that ``cut`` need not walk it from the start."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def cut(ps: Column, start: Column, length: Column) -> Column:
    """Substring (0-based start) of a text given as ``pieces``."""
    first = F.floor(start / _PIECE).cast("int")
    n = F.floor((start + length) / _PIECE).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(ps, first + 1, n), ""), start - first * _PIECE + 1, length)


def collapse_spaces(c: Column | str) -> Column:
    """Trim and reduce every run of Unicode white space to one space."""
    return F.trim(F.regexp_replace(_col(c), p.SPACES, " "))


def _at_edge(c: Column, start: int) -> Column:
    """Whether the character at a place counted from 1, or from the end, is white space."""
    return F.substring(c, start, 1).rlike(f"[{p.SPACE}]")


def strip(c: Column | str) -> Column:
    # The whole text is searched only if there is something to take off.
    whole = lambda t: F.regexp_replace(t, f"^{p.SPACES}|{_TAIL}", "")
    return let(_col(c), lambda t: F.when(_at_edge(t, 1) | _at_edge(t, -1), whole(t)).otherwise(t))


def rstrip(c: Column | str) -> Column:
    return let(_col(c), lambda t: F.when(_at_edge(t, -1), F.regexp_replace(t, _TAIL, "")).otherwise(t))


def is_blank(c: Column | str) -> Column:
    return ~_col(c).rlike(f"[^{p.SPACE}]")


def tokenize(c: Column | str, lang: Column | None = None) -> Column:
    """Words (inner apostrophes and hyphens kept) and single marks; every visible character for zh."""
    words = F.regexp_extract_all(_col(c), F.lit(p.WORD_TOKEN), F.lit(0))
    if lang is None:
        return words
    chars = F.regexp_extract_all(_col(c), F.lit(p.CHAR_TOKEN), F.lit(0))
    return F.when(lang == "zh", chars).otherwise(words)


def detokenize(tokens: Column | str, lang: Column | None = None) -> Column:
    """Join tokens with the spacing rules of marks and brackets; no spaces for zh."""
    t = _col(tokens)
    spaced = F.regexp_replace(F.array_join(t, " "), f" ([{p.char_class(p.NO_SPACE_BEFORE)}])", "$1")
    spaced = F.regexp_replace(spaced, f"([{p.char_class(p.NO_SPACE_AFTER)}]) ", "$1")
    if lang is None:
        return spaced
    return F.when(lang == "zh", F.array_join(t, "")).otherwise(spaced)


def split_sentences(c: Column | str) -> Column:
    """Array of sentences; an unterminated tail is the last element."""
    parts = F.regexp_extract_all(collapse_spaces(c), F.lit(f"(?s).*?(?:{p.SENTENCE_END})|.+"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def count_sentences(c: Column | str) -> Column:
    """Number of complete sentences."""
    return F.regexp_count(_col(c), F.lit(p.SENTENCE_END))


def ends_sentence(c: Column | str) -> Column:
    """True when the text, without trailing space, ends at a sentence boundary."""
    return rstrip(c).rlike(f"(?:{p.SENTENCE_END})\\z")


def sentence_token_ends(c: Column | str, lang: Column | None = None) -> Column:
    """Cumulative token counts at the complete sentences of a text."""

    def ends(s: Column) -> Column:
        sizes = prefix_sums(F.transform(s, lambda x: F.size(tokenize(x, lang))))
        pairs = F.arrays_zip(sizes.alias("n"), F.transform(s, ends_sentence).alias("done"))
        return F.transform(F.filter(pairs, lambda x: x["done"]), lambda x: x["n"].cast("int"))

    # A text without any mark has no complete sentence; partial texts mostly have none.
    marked = lambda t: t.rlike(f"[{p.char_class(p.TERMINAL)}]")
    none = F.array().cast("array<int>")
    return let(_col(c), lambda t: F.when(marked(t), let(split_sentences(t), ends)).otherwise(F.when(t.isNotNull(), none)))


def _last_mark(c: Column) -> Column:
    """Last character that is neither white space nor a closing mark."""
    mark = lambda x: F.regexp_extract(x, f"([^{p.SPACE}{p.CLOSERS}])[{p.SPACE}{p.CLOSERS}]*\\z", 1)
    # It mostly stands among the last characters; the text is searched from its start only if it does not.
    near = lambda t: F.substring(t, -_NEAR, _NEAR)
    return let(c, lambda t: F.when(near(t).rlike(f"[^{p.SPACE}{p.CLOSERS}]"), mark(near(t))).otherwise(mark(t)))


def restore_punctuation(source: Column | str, translated: Column | str, target_lang: Column) -> Column:
    """Give the translation the source's sentence mark, before closing marks, if it lost its own."""
    terminal = f"[{p.char_class(p.TERMINAL)}]"
    wide = F.create_map(*[F.lit(x) for pair in p.FULL_WIDTH.items() for x in pair])

    def fix(mark: Column, translated: Column) -> Column:
        out = F.when(target_lang == "zh", F.coalesce(F.try_element_at(wide, mark), mark)).otherwise(mark)
        # White space at the end goes; closing marks stay behind the sentence mark.
        closed = lambda t: F.regexp_replace(t, f"(?<![{p.CLOSERS}])([{p.CLOSERS}]*+)\\z", F.concat(out, F.lit("$1")))
        ended = let(rstrip(translated), lambda t: F.when(
            F.substring(t, -1, 1).rlike(f"[{p.CLOSERS}]"), closed(t)
        ).otherwise(F.concat(t, out)))
        lost = mark.rlike(terminal) & ~_last_mark(translated).rlike(terminal)
        return F.when(lost, ended).otherwise(strip(translated))

    return let(_last_mark(_col(source)), lambda mark: let(_col(translated), lambda t: fix(mark, t)))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Longest common prefix of two token arrays."""
    a, b = _col(a), _col(b)
    n = F.aggregate(
        F.arrays_zip(a.alias("a"), b.alias("b")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
        lambda acc, x: F.struct(
            F.when(acc["same"] & x["a"].eqNullSafe(x["b"]), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["same"] & x["a"].eqNullSafe(x["b"])).alias("same"),
        ),
        lambda acc: acc["n"],
    )
    return F.slice(a, F.lit(1), n)


def sentence_case(c: Column | str, lang: Column) -> Column:
    """Turn an ALL-CAPS en/vi text into sentence case; other texts pass unchanged."""
    text = _col(c)
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[^.!?。！？]*[.!?。！？]|[^.!?。！？]+"), F.lit(0))
    raised = F.transform(
        parts,
        lambda s: F.concat(
            F.regexp_extract(s, r"(?s)^([^\p{L}]*)(\p{L}?)(.*)\z", 1),
            F.upper(F.regexp_extract(s, r"(?s)^([^\p{L}]*)(\p{L}?)(.*)\z", 2)),
            F.regexp_extract(s, r"(?s)^([^\p{L}]*)(\p{L}?)(.*)\z", 3),
        ),
    )
    shouted = (F.upper(text) == text) & (F.lower(text) != text) & lang.isin("en", "vi")
    return F.when(shouted, F.array_join(raised, "")).otherwise(text)


def spoken_or_display(spoken: Column | str, display: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(spoken), F.lit("")), _col(display))


def latency_ms(started: Column | str, completed: Column | str) -> Column:
    """Non-negative milliseconds between two timestamps."""
    gap = F.unix_micros(_col(completed)) - F.unix_micros(_col(started))
    return F.greatest(F.lit(0.0), gap / 1000.0)


def duration_s(n_samples: Column, rate: Column) -> Column:
    return F.when(rate > 0, n_samples / rate).otherwise(F.lit(0.0))


def real_time_factor(latency: Column, duration: Column) -> Column:
    """Processing time over audio time; 0 for empty audio."""
    return F.when(duration > 0, latency / 1000.0 / duration).otherwise(F.lit(0.0))


def placeholder_tokens(c: Column | str) -> Column:
    """Everything in a text that looks like a term placeholder, in any case and spacing."""
    return F.regexp_extract_all(_col(c), F.lit(p.PLACEHOLDER), F.lit(0))
