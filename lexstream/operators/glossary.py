"""Glossary jobs: validation, domain activation, coverage, routes, guidance terms, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.text import is_blank, tokenize

# Translation policies, languages, translation pairs, the rule for ids, the default boost.
POLICIES = (
    "preferred_term",
    "preserve",
    "transliterate",
    "expand",
    "spell_out",
    "display_preserve_speech_override",
)
LANGUAGES = ("vi", "en", "zh", "ko")
PAIRS = (("vi", "en"), ("en", "vi"), ("zh", "en"), ("en", "zh"), ("ko", "en"), ("en", "ko"), ("zh", "vi"))
ID_RULE = r"^[a-z][a-z0-9_]*\z"
DEFAULT_BOOST = 1.5


def activate(terms: DataFrame, domains: list[str]) -> DataFrame:
    """Terms whose domains meet the requested ones."""
    if not domains:
        raise ValueError("name a domain: the bundle has no default domains")
    return terms.filter(F.arrays_overlap("domains", F.array(*[F.lit(d) for d in domains])))


def ambiguous_forms(terms: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs of terms that share a form, a domain and a priority, so that no rule picks one.

    Terms are first joined through (language, form, priority, domain); only pairs that collide there
    come out, never all pairs of a group.
    """
    d = forms.join(terms, "term_id").select(
        "lang", nz.normalize("form").alias("norm"), "priority", F.explode("domains").alias("domain"), "term_id"
    ).distinct()
    keys = ["lang", "norm", "priority", "domain"]
    # Each collision is reported against the first term of its key, so output grows with the input.
    first = d.groupBy(*keys).agg(F.min("term_id").alias("term_a"), F.count("*").alias("n")).filter("n > 1")
    pairs = d.join(first, keys).filter("term_id <> term_a")
    return pairs.select("lang", "norm", "priority", "term_a", F.col("term_id").alias("term_b")).distinct()


def validate_glossary(
    terms: DataFrame, forms: DataFrame, spoken: DataFrame, languages: tuple[str, ...] = LANGUAGES
) -> DataFrame:
    """Every rule breach as (rule, term_id, detail); empty for a valid glossary."""
    breach = lambda df, rule, detail: df.select(
        F.lit(rule).alias("rule"), "term_id", detail.cast("string").alias("detail")
    )
    blank = lambda c: F.col(c).isNull() | is_blank(c)
    no_domains = F.col("domains").isNull() | (F.size("domains") == 0)
    formless = terms.join(forms.select("term_id").distinct(), "term_id", "left_anti")
    norm = forms.withColumn("norm", nz.normalize("form"))
    twice = norm.groupBy("term_id", "lang", "norm").agg(F.count("*").alias("n")).filter("n > 1")
    ids = terms.groupBy("term_id").agg(F.count("*").alias("n")).filter("n > 1")
    langs = forms.select("term_id", "lang").union(spoken.select("term_id", "lang")).distinct()
    orphan = spoken.join(forms.select("term_id", "lang").distinct(), ["term_id", "lang"], "left_anti")
    clash = ambiguous_forms(terms, forms)
    rules = [
        breach(terms.filter(blank("term_id") | ~F.col("term_id").rlike(ID_RULE)), "term_id", F.col("term_id")),
        breach(ids, "duplicate_id", F.col("n")),
        breach(terms.filter(no_domains), "no_domain", F.lit("")),
        breach(terms.filter(F.size("domains") > F.size(F.array_distinct("domains"))), "duplicate_domain",
               F.array_join("domains", ",")),
        breach(terms.filter(F.col("priority").isNull()), "priority", F.lit("")),
        breach(terms.filter(~F.coalesce(F.col("policy").isin(*POLICIES), F.lit(False))), "policy", F.col("policy")),
        breach(formless, "no_form", F.lit("")),
        breach(forms.filter(blank("form")), "blank_form", F.col("lang")),
        breach(twice, "duplicate_form", F.concat_ws(":", "lang", "norm")),
        breach(forms.filter("boost <= 0"), "boost", F.col("form")),
        breach(langs.filter(~F.col("lang").isin(*languages)), "language", F.col("lang")),
        breach(spoken.filter(blank("spoken_form")), "blank_spoken_form", F.col("lang")),
        breach(orphan, "spoken_without_form", F.col("lang")),
        breach(clash.withColumnRenamed("term_a", "term_id"), "ambiguous_form",
               F.concat_ws(":", "lang", "norm", "term_b")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def routes(requests: DataFrame, pairs: DataFrame, pivot: str = "en") -> DataFrame:
    """Add ``route``: the direct edge if there is one, else through the pivot, else null; itself if equal.

    ``requests`` and ``pairs`` hold (source, target).
    """
    p = pairs.select("source", "target").distinct().withColumn("direct", F.lit(True))
    legs_in = pairs.filter(F.col("target") == pivot).select("source").distinct().withColumn("leg_in", F.lit(True))
    legs_out = pairs.filter(F.col("source") == pivot).select("target").distinct().withColumn("leg_out", F.lit(True))
    r = requests.join(p, ["source", "target"], "left").join(legs_in, "source", "left").join(legs_out, "target", "left")
    route = (
        F.when(F.col("source") == F.col("target"), F.array("source"))
        .when(F.col("direct"), F.array("source", "target"))
        .when(F.col("leg_in") & F.col("leg_out"), F.array(F.col("source"), F.lit(pivot), F.col("target")))
    )
    return r.withColumn("route", route).drop("direct", "leg_in", "leg_out")


def auto_sources(languages: DataFrame, target: str) -> DataFrame:
    """Source languages for automatic detection: all but the target."""
    return languages.filter(F.col("lang") != target)


def missing_on_route(terms: DataFrame, forms: DataFrame, routed: DataFrame) -> DataFrame:
    """Active terms without a form in a language of a route: (source, target, term_id, lang).

    A term is compared once with the languages of all routes; only what it lacks meets the routes.
    """
    steps = routed.select("source", "target", F.explode("route").alias("lang")).distinct()
    asked = steps.agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    known = forms.groupBy("term_id").agg(F.collect_set("lang").alias("known"))
    lacks = terms.select("term_id").join(known, "term_id", "left").select("term_id", asked.scalar().alias("asked"), "known")
    none = F.array().cast("array<string>")
    lacks = lacks.withColumn("lacks", F.array_except("asked", F.coalesce("known", none)))
    lacks = lacks.select("term_id", F.explode("lacks").alias("lang"))
    return lacks.join(steps, "lang").select("source", "target", "term_id", "lang")


def guidance_terms(terms: DataFrame, forms: DataFrame) -> DataFrame:
    """Distinct normalized forms per language; the first declared form stands for its equals."""
    d = forms.join(terms.select("term_id", "declaration_order"), "term_id")
    d = d.withColumn("norm", nz.normalize("form"))
    order = F.struct("declaration_order", "form_order")
    first = d.groupBy("lang", "norm").agg(F.min(order).alias("o"), F.min_by(F.struct("term_id", "form", "boost"), order).alias("f"))
    score = F.coalesce(F.nullif(F.col("f.boost"), F.lit(0.0)), F.lit(DEFAULT_BOOST))
    return first.select(
        "lang", "f.term_id", F.col("f.form").alias("text"), score.alias("score"),
        F.col("o.declaration_order"), F.col("o.form_order"),
    )


def budgeted_terms(guidance: DataFrame, max_terms: int, max_tokens: int, upper: bool = False) -> DataFrame:
    """Per language, terms in order: stop at ``max_terms``; pass over terms beyond the token budget.

    What is kept depends on what was kept before, so the choice is a fold.  Its input is bounded
    first: once a term of n tokens does not fit, no later one of n tokens does, so only the first
    ``max_tokens / n`` terms of each size can be kept.
    """
    text = F.upper("text") if upper else F.col("text")
    d = guidance.select("lang", "term_id", text.alias("text"), "score", "declaration_order", "form_order")
    d = d.withColumn("n", F.size(tokenize("text", F.col("lang")))).filter((F.col("n") > 0) & (F.col("n") <= max_tokens))
    by_size = Window.partitionBy("lang", "n").orderBy("declaration_order", "form_order")
    d = d.withColumn("nth", F.row_number().over(by_size))
    d = d.filter(f"nth <= {int(max_terms)} and nth * n <= {int(max_tokens)}")
    item = F.struct("declaration_order", "form_order", "term_id", "text", "score", "n")
    g = d.groupBy("lang").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["kept"]) < max_terms) & (a["used"] + x["n"] <= max_tokens)
        return F.when(
            fits, F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["used"] + x["n"]).alias("used"))
        ).otherwise(a)

    none = F.filter(F.col("items"), lambda x: F.lit(False))
    kept = F.aggregate("items", F.struct(none.alias("kept"), F.lit(0).alias("used")), step, lambda a: a["kept"])
    return g.select("lang", F.posexplode(kept).alias("pos", "k")).select(
        "lang", "pos", "k.term_id", "k.text", "k.score", F.col("k.n").alias("n_tokens")
    )


def profile_counts(terms: DataFrame, forms: DataFrame, spoken: DataFrame, routed: DataFrame) -> DataFrame:
    """Per route: active entries, distinct guidance forms, bindings over all hops, spoken forms.

    A last row with null languages holds the totals over all ``profiles``, that is routes.
    """
    entries = terms.agg(F.count("*").alias("entries"))
    hops = routed.select("source", "target", (F.size("route") - 1).alias("hops")).distinct()
    guide = guidance_terms(terms, forms).groupBy("lang").agg(F.count("*").alias("asr_terms"))
    voices = spoken.join(terms.select("term_id"), "term_id", "left_semi")
    voices = voices.join(forms.select("term_id", "lang").distinct(), ["term_id", "lang"], "left_semi")
    voices = voices.groupBy("lang").agg(F.count("*").alias("spoken_forms"))
    out = hops.join(guide.withColumnRenamed("lang", "source"), "source", "left")
    out = out.join(voices.withColumnRenamed("lang", "target"), "target", "left").withColumn("entries", entries.scalar())
    out = out.withColumn("mt_bindings", (F.col("hops") * F.col("entries")).cast("bigint"))
    measures = ["entries", "asr_terms", "mt_bindings", "spoken_forms"]
    sets = [[F.col("source"), F.col("target")], []]
    return out.groupingSets(sets, F.col("source"), F.col("target")).agg(
        F.count("hops").alias("profiles"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in measures]
    )


def split_by_vocabulary(units: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected terms: accepted when every piece is in the vocabulary.

    ``units`` holds (lang, term_id, text, pieces); ``vocabulary`` holds (lang, piece).
    """
    p = units.select("lang", "term_id", "text", F.explode("pieces").alias("piece"))
    lost = p.join(vocabulary.select("lang", "piece").distinct(), ["lang", "piece"], "left_anti")
    lost = lost.select("lang", "term_id", "text").distinct()
    keys = ["lang", "term_id", "text"]
    some = units.filter(F.size("pieces") > 0)
    rejected = units.filter(F.size("pieces") == 0).unionByName(some.join(lost, keys, "left_semi"))
    return some.join(lost, keys, "left_anti"), rejected
