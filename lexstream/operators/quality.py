"""Quality reports: expected against observed terms, character and word error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import common_prefix, let


def term_outcomes(expected: DataFrame, observed: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Outcome of each (case_id, term_id): ``hit``, ``miss``, ``extra`` or ``excluded_hit``."""
    e = expected.select("case_id", "term_id").distinct().withColumn("want", F.lit(True))
    o = observed.select("case_id", "term_id").distinct().withColumn("got", F.lit(True))
    j = e.join(o, ["case_id", "term_id"], "full_outer")
    outcome = F.when(F.col("want") & F.col("got"), "hit").when(F.col("want"), "miss").otherwise("extra")
    if excluded is not None:
        x = excluded.select("case_id", "term_id").distinct().withColumn("ban", F.lit(True))
        j = j.join(x, ["case_id", "term_id"], "left")
        outcome = F.when(F.col("got") & F.col("ban"), "excluded_hit").otherwise(outcome)
    return j.select("case_id", "term_id", outcome.alias("outcome"))


def term_accuracy(outcomes: DataFrame, cases: DataFrame, *dims: str, minutes: str | None = None) -> DataFrame:
    """Recall and precision per dimension value and overall (grouping sets); nulls mark totals.

    Counts are taken per case first, so the totals add up a row per case rather than per term.
    """
    n = lambda name: F.count_if(F.col("outcome").isin(*name)).alias(name[0])
    per_case = outcomes.groupBy("case_id").agg(n(("hit",)), n(("miss",)), n(("extra", "excluded_hit")))
    c = cases.select("case_id", *dims, *([minutes] if minutes else []))
    d = c.join(per_case, "case_id", "left")
    sets = [[F.col(x)] for x in dims] + [[]]
    aggs = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("hit", "miss", "extra")]
    if minutes:
        aggs.append(F.sum(minutes).alias("minutes"))
    g = d.groupingSets(sets, *[F.col(x) for x in dims]).agg(*aggs)
    ratio = lambda a, b: F.when(b > 0, a / b)
    g = g.withColumn("recall", ratio(F.col("hit"), F.col("hit") + F.col("miss")))
    g = g.withColumn("precision", ratio(F.col("hit"), F.col("hit") + F.col("extra")))
    return g.withColumn("false_per_minute", ratio(F.col("extra"), F.col("minutes"))) if minutes else g


#: Widths of the band in which an edit distance is looked for before the whole table is filled.
BANDS = (8, 64, 512)


def _distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts in time length x distance: a band that is wide enough gives the exact value."""

    def within(bands: tuple[int, ...]) -> Column:
        if not bands:
            return F.levenshtein(a, b)
        return let(F.levenshtein(a, b, bands[0]), lambda d: F.when(d >= 0, d).otherwise(within(bands[1:])))

    return F.when(a.isNotNull() & b.isNotNull(), within(BANDS))


def character_errors(hypothesis: Column, reference: Column) -> Column:
    """Edit distance in characters.

    Equal beginnings never change the distance and are cut off first, piece by piece: hypotheses of
    one utterance mostly begin alike, and the distance costs the product of the lengths.
    """

    def differ(a: Column, b: Column) -> Column:
        n = F.size(common_prefix(a, b))
        rest = lambda x: F.array_join(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))), "")
        return let(rest(a), lambda x: let(rest(b), lambda y: _distance(x, y)))

    short = lambda c: F.regexp_extract_all(c, F.lit("(?s).{1,16}"), F.lit(0))
    return let(short(hypothesis), lambda a: let(short(reference), lambda b: differ(a, b)))


def word_errors(hypothesis: Column, reference: Column) -> Column:
    """Edit distance in tokens of two token arrays.

    Behind the common beginning, the distinct tokens of the pair are numbered and each written as one
    character of the higher planes, so that the built-in edit distance compares words.
    """

    def spell(ts: Column, v: Column) -> Column:
        code = lambda t: F.lpad(F.hex(F.array_position(v, t) + 0x10000), 8, "0")
        return F.array_join(F.transform(ts, lambda t: F.decode(F.unhex(code(t)), "UTF-32")), "")

    def differ(n: Column) -> Column:
        rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
        a, b = rest(hypothesis), rest(reference)

        def numbered(v: Column) -> Column:
            return let(spell(a, v), lambda x: let(spell(b, v), lambda y: _distance(x, y)))

        return let(F.array_distinct(F.concat(a, b)), numbered)

    return let(F.size(common_prefix(hypothesis, reference)), differ)


def corpus_rate(pairs: DataFrame, errors: str, size: str, *by: str) -> DataFrame:
    """Errors over reference size, summed over the corpus."""
    g = pairs.groupBy(*by).agg(F.sum(errors).alias("errors"), F.sum(size).alias("size"))
    return g.withColumn("rate", F.when(F.col("size") > 0, F.col("errors") / F.col("size")))
