"""Registered queries: every operator over whole given tables, or tables Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import patterns as p
from ..functions import text as tx
from ..functions import timing as tm
from ..operators import events as ev
from ..operators import glossary as gl
from ..operators import inrow as ir
from ..operators import matching as mt
from ..operators import ordered
from ..operators import quality as ql
from ..operators import revision as rv
from ..operators import rewrite as rw
from ..operators import segments as sg
from ..operators import translate as tr
from ..sources import eventlog
from ..sources import glossary as gs
from . import inputs as inp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _hash(c: Column) -> Column:
    return F.md5(c)


def _tokens_text(c: str) -> Column:
    return F.array_join(c, "\x1f")


# Text -------------------------------------------------------------------------------------------


@query
def collapsed_text(spark, sf):
    d = inp.texts(spark, sf, "documents")
    return d.select("doc_id", _hash(tx.collapse_spaces("text")).alias("text_md5"))


@query
def tokens_by_lang(spark, sf):
    d = inp.texts(spark, sf, "documents").select("lang", F.explode(tx.tokenize("text", F.col("lang"))).alias("token"))
    return d.groupBy("lang", F.lower("token").alias("token")).agg(F.count("*").alias("n"))


@query
def tokens_table(spark, sf):
    d = inp.texts(spark, sf, "conversations")
    return d.select("conv_id", "turn", F.posexplode(tx.tokenize("text")).alias("pos", "token"))


@query
def detokenize_roundtrip(spark, sf):
    d = inp.texts(spark, sf, "documents")
    back = tx.detokenize(tx.tokenize("text"))
    return d.select("doc_id", _hash(back).alias("text_md5"), (back == tx.collapse_spaces("text")).alias("same"))


@query
def character_tokens(spark, sf):
    d = inp.table(spark, sf, "benchmark")
    chars = tx.tokenize("text", F.lit("zh"))
    return d.select("item_id", F.size(chars).alias("n"), _hash(tx.detokenize(chars, F.lit("zh"))).alias("text_md5"))


@query
def sentences_by_doc(spark, sf):
    return inp.sentence_rows(spark, sf).select("doc_id", "lang", "pos", "sentence")


@query
def sentence_counts(spark, sf):
    d = inp.texts(spark, sf, "documents")
    return d.select("doc_id", tx.count_sentences("text").alias("n_sentences"))


@query
def sentence_token_ends(spark, sf):
    d = inp.texts(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(tx.sentence_token_ends("text", F.col("lang"))).alias("pos", "n_tokens"))


@query
def ends_phrase(spark, sf):
    d = inp.texts(spark, sf, "conversations")
    return d.select("conv_id", "turn", tx.ends_sentence("text").alias("complete"))


@query
def restore_punctuation(spark, sf):
    d = inp.sentence_rows(spark, sf)
    bare = F.regexp_replace("sentence", f"[{p.char_class(p.TERMINAL)}]+\\z", "")
    fixed = tx.restore_punctuation("sentence", bare, F.lit("en"))
    wide = tx.restore_punctuation("sentence", bare, F.lit("zh"))
    d = d.withColumn("fixed", fixed).withColumn("wide", wide)
    return d.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("fixed") == F.col("sentence")).alias("n_equal"),
        F.count_if(F.col("wide").rlike("[。！？]\\z")).alias("n_wide"),
    )


@query
def common_prefixes(spark, sf):
    h = inp.hypotheses(spark, sf).select("stream_id", "revision", "tokens")
    nxt = h.select("stream_id", (F.col("revision") - 1).alias("revision"), F.col("tokens").alias("next"))
    j = h.join(nxt, ["stream_id", "revision"])
    j = j.withColumn("n", F.size(tx.common_prefix("tokens", "next")))
    n = F.col("n")
    return j.groupBy("stream_id").agg(F.sum(n).alias("shared"), F.max(n).alias("longest"))


@query
def sentence_case(spark, sf):
    d = inp.texts(spark, sf, "documents")
    loud = d.withColumn("text", F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).withColumn("as_lang", F.lit("en"))
    return loud.select("doc_id", _hash(tx.sentence_case("text", F.col("as_lang"))).alias("text_md5"))


@query
def normalized_docs(spark, sf):
    d = inp.texts(spark, sf, "documents")
    return d.select("doc_id", _hash(nz.normalize("text")).alias("folded_md5"), _hash(nz.normalize("text", False)).alias("cased_md5"))


@query
def spoken_or_display(spark, sf):
    d = inp.texts(spark, sf, "conversations")
    spoken = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.lower("text"))
    return d.select("conv_id", "turn", _hash(tx.spoken_or_display(spoken, F.col("text"))).alias("text_md5"))


@query
def derived_measures(spark, sf):
    e = inp.table(spark, sf, "events")
    started = inp.instant("ts")
    done = F.timestamp_micros(F.unix_micros(started) + F.round((F.col("value") - 20) * 1000000).cast("bigint"))
    ms = tx.latency_ms(started, done)
    dur = tx.duration_s(F.floor("value") * 160, F.lit(16000))
    return e.select(
        "event_id", F.round(ms, 3).alias("latency_ms"), F.round(dur, 6).alias("duration_s"),
        F.round(tx.real_time_factor(ms, dur), 4).alias("rtf"),
    )


# Glossary ---------------------------------------------------------------------------------------


def _doc_glossary(spark: SparkSession, sf: str):
    """A glossary drawn from the benchmark table: the words of each whole item, with seeded faults."""
    b = inp.table(spark, sf, "benchmark")
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    i = F.col("item_id")
    d = b.withColumn("w", words).filter("size(w) > 0")
    tid = F.when(i % 10 == 3, F.concat(F.lit("Term"), i)).otherwise(F.concat(F.lit("term_"), i))
    terms = d.select(
        tid.alias("term_id"),
        F.when(i % 11 == 4, F.array().cast("array<string>")).when(i % 7 == 2, F.array(F.lit("a"), F.lit("a")))
        .otherwise(F.array(F.concat(F.lit("d"), i % 3))).alias("domains"),
        F.when(i % 13 != 5, (i % 4).cast("int")).alias("priority"),
        F.when(i % 9 == 1, "keep").otherwise("preserve").alias("policy"), i.cast("int").alias("declaration_order"),
    )
    canonical = F.array_join("w", " ")
    alias = F.when(i % 5 == 0, F.upper(canonical)).when(i % 5 == 1, F.left(F.get("w", F.lit(0)), F.lit(2))).otherwise(F.element_at("w", -1))
    rows = F.posexplode(F.array(canonical, alias))
    forms = d.select(
        tid.alias("term_id"), F.when(i % 8 == 6, "xx").otherwise("en").alias("lang"), canonical.alias("canonical"), i,
        rows.alias("form_order", "form"),
    ).select(
        "term_id", "lang", "form", "form_order", "canonical", (F.col("form_order") > 0).alias("is_alias"),
        F.when(i % 12 == 7, -1.0).when(i % 3 == 0, 2.5).alias("boost"),
    )
    spoken = d.filter(i % 4 == 0).select(
        tid.alias("term_id"), F.when(i % 8 == 4, "fr").otherwise("en").alias("lang"),
        F.when(i % 16 == 8, " ").otherwise(canonical).alias("spoken_form"),
    )
    return terms, forms, spoken


@query
def glossary_violations(spark, sf):
    return gl.validate_glossary(*_doc_glossary(spark, sf), languages=("en", "fr"))


def _bundles(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle document drawn from each benchmark item, with seeded faults."""
    i = F.col("item_id")
    word = F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0)
    form = F.concat(
        F.lit('{"canonical": '), F.to_json(F.array(word)).substr(F.lit(2), F.length(F.to_json(F.array(word))) - 2),
        F.when(i % 8 == 6, ', "weight": 2}').otherwise(', "aliases": []}'),
    )
    entry = F.concat(
        F.lit('{"id": "t'), i, F.lit('", "domain": ["d"], "priority": 1, "translation_policy": "preserve", "forms": {"en": '), form,
        F.when(i % 4 == 0, '}, "extra": 1}').when(i % 10 == 3, '}, "tts": {"en": {"spoken_form": "x", "voice": 1}}}').otherwise("}}"),
    )
    doc = F.concat(
        F.when(i % 7 == 1, '{"bundle_id": " "').when(i % 7 == 2, '{"description": "d"').otherwise('{"bundle_id": "b"'),
        F.when(i % 5 == 2, ', "schema_version": 2').when(i % 5 != 3, ', "schema_version": 1').otherwise(""),
        F.when(i % 6 == 3, ', "default_domains": ["a", "a"]').when(i % 6 == 4, ', "default_domains": ["a", ""]').otherwise(""),
        F.when(i % 9 == 5, ', "odd": true').otherwise(""),
        F.when(i % 11 == 4, F.lit(', "entries": []}')).otherwise(F.concat(F.lit(', "entries": ['), entry, F.lit("]}"))),
    )
    return inp.table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), i).alias("path"), doc.alias("doc"))


@query
def bundle_violations(spark, sf):
    return gs.bundle_violations(_bundles(spark, sf))


@query
def ambiguous_forms(spark, sf):
    terms, forms, _ = _doc_glossary(spark, sf)
    d = gl.ambiguous_forms(terms.withColumn("priority", F.lit(1)).withColumn("domains", F.array(F.lit("d"))), forms)
    return d.select("lang", "norm", "term_a", "term_b")


@query
def guidance_terms(spark, sf):
    terms, forms, _ = _doc_glossary(spark, sf)
    return gl.guidance_terms(terms, forms).select("lang", "term_id", "text", "score")


@query
def budgeted_terms(spark, sf):
    terms, forms, _ = _doc_glossary(spark, sf)
    return gl.budgeted_terms(gl.guidance_terms(terms, forms), max_terms=30, max_tokens=50)


@query
def domain_terms(spark, sf):
    terms, forms, _ = _doc_glossary(spark, sf)
    active = gl.activate(terms, ["d1", "a"])
    return active.join(forms, "term_id").groupBy("term_id", "priority").agg(F.count("*").alias("n_forms"))


def _lang_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Language pairs asked for: every language of the corpus with every target of the fixed list."""
    langs = inp.texts(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"))
    targets = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]))
    return langs.select(F.col("lang").alias("source"), targets.alias("target"), "n_docs")


def _corpus_pairs(spark: SparkSession) -> DataFrame:
    rows = [("fr", "en"), ("en", "fr"), ("de", "en"), ("en", "de"), ("es", "en"), ("fr", "de")]
    return spark.createDataFrame(rows, "source string, target string")


@query
def routes(spark, sf):
    r = gl.routes(_lang_pairs(spark, sf), _corpus_pairs(spark))
    return r.select("source", "target", "n_docs", F.array_join("route", ">").alias("route"))


@query
def route_coverage(spark, sf):
    g = inp.glossary(spark)
    r = gl.routes(_lang_pairs(spark, sf), _corpus_pairs(spark)).filter("route is not null")
    m = gl.missing_on_route(g.terms, g.forms, r)
    n = r.select("source", "target", "n_docs")
    return m.join(n, ["source", "target"]).select("source", "target", "term_id", "lang", "n_docs")


@query
def profile_counts(spark, sf):
    g = inp.glossary(spark)
    terms = gl.activate(g.terms, g.default_domains)
    r = gl.routes(_lang_pairs(spark, sf), _corpus_pairs(spark)).filter("route is not null")
    forms = g.forms.join(terms, "term_id", "left_semi")
    return gl.profile_counts(terms, forms, g.spoken, r)


@query
def auto_sources(spark, sf):
    langs = inp.texts(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"))
    return gl.auto_sources(langs, "en")


def _vocabulary_split(spark: SparkSession, sf: str):
    docs = inp.texts(spark, sf, "documents")
    vocabulary = docs.select(
        F.lit("en").alias("lang"), F.explode(F.array_distinct(F.transform(tx.tokenize("text"), lambda t: F.lower(t)))).alias("piece")
    )
    b = inp.table(spark, sf, "benchmark")
    units = b.select(
        F.lit("en").alias("lang"), F.col("item_id").alias("term_id"), "text",
        F.transform(tx.tokenize("text"), lambda t: F.lower(t)).alias("pieces"),
    )
    return gl.split_by_vocabulary(units, vocabulary)


@query
def hotword_vocab(spark, sf):
    good, bad = _vocabulary_split(spark, sf)
    return good.select("term_id", F.lit(True).alias("accepted")).unionByName(bad.select("term_id", F.lit(False).alias("accepted")))


# Matching ---------------------------------------------------------------------------------------


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return mt.find_terms(inp.texts(spark, sf, "documents"), ["doc_id"], "text", "lang", inp.active_forms(spark))


@query
def term_matches(spark, sf):
    m = _matches(spark, sf)
    return m.select("doc_id", "lang", "term_id", "form", "start", "end")


@query
def bigram_matches(spark, sf):
    docs = inp.texts(spark, sf, "documents")
    g = inp.bigram_glossary(docs)
    tid = F.concat("lang", F.lit(":"), "form")
    terms = g.select(
        tid.alias("term_id"), F.lit(1).alias("priority"), F.lit("preserve").alias("policy"),
        F.lit(0).alias("declaration_order"),
    )
    forms = g.select(
        tid.alias("term_id"), "lang", "form", F.lit(0).alias("form_order"),
        F.col("form").alias("canonical"), F.lit(False).alias("is_alias"), F.lit(None).cast("double").alias("boost"),
    )
    found = mt.find_terms(docs, ["doc_id"], "text", "lang", mt.prepare_forms(forms, terms, case_sensitive_codes=False))
    return found.groupBy("lang", "form").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def _bigram_forms(spark: SparkSession, docs: DataFrame) -> DataFrame:
    g = inp.bigram_glossary(docs)
    tid = F.concat("lang", F.lit(":"), "form")
    terms = g.select(tid.alias("term_id"), (F.length("form") % 2).alias("priority"), F.lit("preserve").alias("policy"), F.lit(0).alias("declaration_order"))
    forms = g.select(
        tid.alias("term_id"), "lang", "form", F.lit(0).alias("form_order"), F.col("form").alias("canonical"),
        F.lit(False).alias("is_alias"), F.lit(None).cast("double").alias("boost"),
    )
    return mt.prepare_forms(forms, terms, case_sensitive_codes=False)


@query
def best_bigrams(spark, sf):
    """Chains of overlapping matches, many of equal length, priority and declaration: ties go to the left."""
    docs = inp.texts(spark, sf, "documents")
    best = mt.best_matches(mt.find_terms(docs, ["doc_id"], "text", "lang", _bigram_forms(spark, docs)), ["doc_id"])
    return best.groupBy("doc_id", "lang", "form").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))


#: Forms whose language decides where a match may stand, and one of three words.
EDGE_FORMS = [("zh", "the"), ("zh", "in"), ("ko", "la"), ("ko", "de la"), ("de", "in"), ("es", "de la en")]


@query
def boundary_matches(spark, sf):
    """English and French texts read as Chinese, whose forms stand anywhere, and Korean, whose Latin forms stand alone."""
    docs = inp.texts(spark, sf, "documents")
    lang = F.when(F.col("lang") == "en", "zh").when(F.col("lang") == "fr", "ko").otherwise(F.col("lang"))
    rows = [(f"{lang}:{form}", lang, form, 0, form, False, None) for lang, form in EDGE_FORMS]
    terms = spark.createDataFrame([(r[0], ["d"], 1, "preserve", i) for i, r in enumerate(rows)], gs.TERMS)
    forms = mt.prepare_forms(spark.createDataFrame(rows, gs.FORMS), terms, case_sensitive_codes=False)
    m = ir.all_terms(docs.withColumn("lang", lang), ["doc_id"], "text", "lang", forms)
    return m.select("doc_id", "lang", "form", "start", "end")


@query
def best_matches(spark, sf):
    m = mt.best_matches(_matches(spark, sf), ["doc_id"])
    return m.select("doc_id", "lang", "term_id", "form", "start", "end")


@query
def match_order(spark, sf):
    d = mt.in_order(_matches(spark, sf), ["doc_id"])
    return d.select("doc_id", "pos", "term_id", "start", "end")


def _sentence_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = inp.sentence_rows(spark, sf)
    return d.withColumn("tokens", tx.tokenize("sentence", F.col("lang")))


@query
def token_term_spans(spark, sf):
    d = _sentence_tokens(spark, sf)
    hits = mt.prefix_hits(d, ["doc_id", "pos"], "tokens", "lang", inp.active_prefixes(spark))
    return mt.token_spans(hits, ["doc_id", "pos"])


@query
def turn_term_spans(spark, sf):
    d = inp.conversations(spark, sf).withColumn("tokens", tx.tokenize("text"))
    hits = mt.prefix_hits(d, ["conv_id", "turn"], "tokens", "lang", inp.active_prefixes(spark))
    return mt.token_spans(hits, ["conv_id", "turn"])


@query
def open_suffix(spark, sf):
    h = inp.hypotheses(spark, sf)
    hits = mt.prefix_hits(h, ["stream_id", "revision"], "tokens", "lang", inp.active_prefixes(spark))
    return mt.open_suffix(hits, ["stream_id", "revision"])


@query
def prefix_flags(spark, sf):
    h = inp.hypotheses(spark, sf)
    at = h.select("stream_id", "revision", "lang", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("pos"))
    pairs = at.withColumn("pair", F.slice("tokens", F.col("pos"), F.lit(2))).drop("tokens")
    return mt.prefix_flags(pairs, ["stream_id", "revision", "pos"], "pair", "lang", inp.active_prefixes(spark))


# Rewriting --------------------------------------------------------------------------------------


@query
def canonicalized_docs(spark, sf):
    d = rw.canonicalize(inp.texts(spark, sf, "documents"), ["doc_id"], "text", "lang", inp.active_forms(spark))
    return d.select("doc_id", "n_corrections", _hash(F.col("canonical_text")).alias("text_md5"))


@query
def canonical_term_counts(spark, sf):
    """Flagship: canonicalize the corpus, then count canonical terms per language."""
    forms = inp.active_forms(spark)
    d = rw.canonicalize(inp.texts(spark, sf, "documents"), ["doc_id"], "text", "lang", forms)
    d = d.select("doc_id", "lang", tx.collapse_spaces("canonical_text").alias("text"))
    m = ir.best_terms(d, ["doc_id"], "text", "lang", forms)
    return m.groupBy("lang", "term_id").agg(F.count("*").alias("n_matches"), F.count_distinct("doc_id").alias("n_docs"))


@query
def spoken_text(spark, sf):
    g = inp.glossary(spark)
    d = rw.speak(inp.texts(spark, sf, "documents"), ["doc_id"], "text", "lang", inp.active_forms(spark), g.spoken)
    return d.select("doc_id", "substitutions", _hash(F.col("spoken_text")).alias("text_md5"))


@query
def word_timing_remap(spark, sf):
    r = rw.retimed(inp.timed_turns(spark, sf), ["stream_id"], "text", "lang", "words", inp.active_forms(spark))
    return r.select("conv_id", "turn", F.posexplode("new_words").alias("pos", "w")).select(
        "conv_id", "turn", "pos", F.col("w.text").alias("word"), F.round("w.start", 4).alias("start_s"),
        F.round("w.end", 4).alias("end_s"), F.round("w.confidence", 6).alias("confidence"),
    )


@query
def cut_position(spark, sf):
    d = inp.timed_turns(spark, sf)
    d = d.withColumn("n_samples", F.size("words") * 4000 + 8000)
    c = rv.cut_positions(d, ["stream_id"], 2, F.lit(16000))
    return c.select("conv_id", "turn", "cut_sample")


# Word timings -----------------------------------------------------------------------------------


def _piece_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Subword pieces of each turn: words cut after their third character, 0.1 s apart."""
    d = inp.conversations(spark, sf)
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    cut = F.flatten(
        F.transform(
            w, lambda x: F.filter(F.array(F.concat(F.lit("▁"), F.left(x, F.lit(3))), F.substring(x, F.lit(4), F.length(x))), lambda y: y != "")
        )
    )
    d = d.withColumn("ps", cut)
    return d.select(
        "conv_id", "turn", "lang", F.posexplode("ps").alias("pos", "piece"), (F.size("ps") / 10.0).alias("duration_s")
    ).withColumn("at", F.col("pos") / 10.0)


@query
def words_from_pieces(spark, sf):
    w = tm.words_from_pieces(_piece_rows(spark, sf), ["conv_id", "turn"])
    return w.select("conv_id", "turn", "pos", "text", F.round("start", 4).alias("start_s"), F.round("end", 4).alias("end_s"))


@query
def stripped_context(spark, sf):
    d = inp.timed_turns(spark, sf)
    bad = F.transform(
        "words",
        lambda w, i: F.struct(
            w["text"].alias("text"), F.when(i % 7 == 3, -1.0).otherwise(w["start"]).alias("start"),
            F.when(i % 11 == 5, w["start"]).otherwise(w["end"]).alias("end"), w["confidence"].alias("confidence"),
        ),
    )
    d = d.withColumn("good", tm.valid_words(bad))
    context = F.when(F.col("turn") % 3 == 0, 0.0).otherwise(1.0)
    d = d.withColumn("s", tm.strip_context(F.col("good"), F.col("lang"), context, F.col("text")))
    return d.select("conv_id", "turn", F.size("good").alias("n_valid"), F.size("s.words").alias("n_kept"), _hash(F.col("s.text")).alias("text_md5"))


@query
def merged_lines(spark, sf):
    c = inp.texts(spark, sf, "conversations")
    c = c.withColumn("newest", -F.col("turn"))
    c = ordered.numbered(c, ["conv_id"], ["newest"], "n")
    g = c.withColumn("part", F.floor((F.col("n") - 1) / 4096)).groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text")))).alias("ls")
    )
    lines = F.transform("ls", lambda x: F.struct((-x["turn"]).cast("double").alias("start"), x["text"].alias("text")))
    return g.select("conv_id", "part", _hash(tm.merge_lines(lines)).alias("text_md5"))


# Translation ------------------------------------------------------------------------------------


def _other(lang: Column) -> Column:
    """The language a text goes to: French, and English for French ones."""
    return F.when(lang == "fr", "en").otherwise("fr")


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = inp.sentence_rows(spark, sf)
    return d.withColumn("source", F.col("lang")).withColumn("target", _other(F.col("lang")))


def _bound(spark: SparkSession) -> DataFrame:
    g = inp.glossary(spark)
    return rw.bindings(g.forms, gl.activate(g.terms, g.default_domains))


@query
def target_forms(spark, sf):
    m = ir.best_terms(inp.texts(spark, sf, "documents"), ["doc_id"], "text", "lang", inp.active_forms(spark))
    b = _bound(spark).filter("target = 'en'").select("term_id", F.col("source").alias("lang"), "target_form")
    return m.join(b, ["term_id", "lang"]).groupBy("lang", "term_id", "target_form").agg(F.count("*").alias("n"))


@query
def protected_text(spark, sf):
    d = rw.term_spans(_sentences(spark, sf), ["doc_id", "pos"], "sentence", "source", "target", inp.active_forms(spark), _bound(spark))
    text = rw.protected(F.col("sentence"), F.col("spans"), p.PLACEHOLDER_FORMATS[0])
    return d.select("doc_id", "pos", F.size("spans").alias("n_terms"), text.alias("protected"))


def _faulty(text: Column, kind: Column) -> Column:
    """Outputs a translator may spoil: lost, doubled, rewritten, extra, swapped placeholders."""
    one, two, held = F.lit("__TERM_0001__"), F.lit("__TERM_0002__"), F.lit("\x01")
    swapped = F.replace(F.replace(F.replace(text, one, held), two, one), held, two)
    return (
        F.when(kind == 1, F.replace(text, one, F.lit("")))
        .when(kind == 2, F.concat(text, F.lit(" "), one))
        .when(kind == 3, F.replace(text, F.lit("__TERM_"), F.lit("__term_ ")))
        .when(kind == 4, F.concat(text, F.lit(" __TERM_9999__")))
        .when((kind == 5) & text.contains("__TERM_0002__"), swapped)
        .otherwise(text)
    )


@query
def validated(spark, sf):
    d = rw.term_spans(_sentences(spark, sf), ["doc_id", "pos"], "sentence", "source", "target", inp.active_forms(spark), _bound(spark))
    d = d.withColumn("marks", rw.placeholders(F.col("spans"), p.PLACEHOLDER_FORMATS[0]))
    d = d.withColumn("out", _faulty(rw.protected(F.col("sentence"), F.col("spans"), p.PLACEHOLDER_FORMATS[0]), F.col("doc_id") % 6))
    d = d.withColumn("restored", tr.restore(F.col("out"), F.col("marks"), F.col("spans")))
    fault = tr.check(F.col("out"), F.col("marks"), F.col("restored"), in_order=True)
    d = d.withColumn("fault", F.coalesce(fault, F.lit("none")))
    return d.groupBy("doc_id", "fault").agg(F.count("*").alias("n"))


@query
def residue_faults(spark, sf):
    """A target form that reads like a placeholder is left over when all others are restored."""
    bound = _bound(spark).withColumn("target_form", F.when(F.col("term_id") == "that_word", "<term_7>").otherwise(F.col("target_form")))
    d = rw.term_spans(_sentences(spark, sf), ["doc_id", "pos"], "sentence", "source", "target", inp.active_forms(spark), bound)
    d = d.withColumn("marks", rw.placeholders(F.col("spans"), p.PLACEHOLDER_FORMATS[1]))
    d = d.withColumn("out", rw.protected(F.col("sentence"), F.col("spans"), p.PLACEHOLDER_FORMATS[1]))
    d = d.withColumn("restored", tr.restore(F.col("out"), F.col("marks"), F.col("spans")))
    fault = F.coalesce(tr.check(F.col("out"), F.col("marks"), F.col("restored")), F.lit("none"))
    return d.groupBy("doc_id", fault.alias("fault")).agg(F.count("*").alias("n"))


@query
def restored(spark, sf):
    d = rw.term_spans(_sentences(spark, sf), ["doc_id", "pos"], "sentence", "source", "target", inp.active_forms(spark), _bound(spark))
    marks = rw.placeholders(F.col("spans"), p.PLACEHOLDER_FORMATS[0])
    out = rw.protected(F.col("sentence"), F.col("spans"), p.PLACEHOLDER_FORMATS[0])
    return d.select("doc_id", "pos", tr.restore(out, marks, F.col("spans")).alias("restored"))


def _unsteady(text: Column, source: Column, target: Column) -> Column:
    """Echo that spoils placeholders depending on the length of the text and the format."""
    kind = F.length(text) % 5
    spoiled = (
        F.when((kind == 1) & text.contains("__TERM"), F.replace(text, F.lit("__TERM_"), F.lit("__term_ ")))
        .when((kind == 2) & text.contains("TERM"), F.regexp_replace(text, "(?i)term", "T"))
        .when((kind == 3) & text.rlike("__TERM|OVT"), F.regexp_replace(text, "__|OVT", ""))
        .otherwise(text)
    )
    return tr.echo(spoiled, source, target)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    d = inp.texts(spark, sf, "documents")
    return d.select(
        "doc_id", F.array("lang", _other(F.col("lang"))).alias("route"), F.col("source").alias("stream_id"), F.col("doc_id").alias("revision"), "text",
        (F.col("doc_id") % 2 == 0).alias("is_final"),
    )


@query
def translated(spark, sf):
    t = tr.translate_requests(_requests(spark, sf), ["doc_id"], "route", inp.active_forms(spark), _bound(spark), _unsteady, hops=1, fallback=False)
    return t.select("doc_id", "translated", *tr.STATS, "cache_hits", "faults")


@query
def translated_with_fallback(spark, sf):
    t = tr.translate_requests(_requests(spark, sf), ["doc_id"], "route", inp.active_forms(spark), _bound(spark), _unsteady, hops=1)
    return t.select("doc_id", "translated", *tr.STATS, "cache_hits")


@query
def translated_through_pivot(spark, sf):
    d = inp.texts(spark, sf, "documents")
    last = F.when(F.col("lang") == "es", "fr").otherwise("es")
    route = F.when(F.col("lang") == "en", F.array("lang", last)).otherwise(F.array(F.col("lang"), F.lit("en"), last))
    r = d.select("doc_id", route.alias("route"), F.col("source").alias("stream_id"), F.col("doc_id").alias("revision"), "text", F.lit(True).alias("is_final"))
    t = tr.translate_requests(r, ["doc_id"], "route", inp.active_forms(spark), _bound(spark), tr.echo, fallback=False)
    return t.select("doc_id", "translated", "matches", "hops")


@query
def translation_stats(spark, sf):
    t = tr.translate_requests(_requests(spark, sf), ["doc_id"], "route", inp.active_forms(spark), _bound(spark), tr.echo, hops=1, fallback=False)
    return t.groupBy("stream_id").agg(*[F.sum(c).alias(c) for c in (*tr.STATS, "cache_hits")])


# Revision streams -------------------------------------------------------------------------------


@query
def latest_partials(spark, sf):
    b = inp.busy_streams(spark, sf)
    slot = F.concat_ws("-", F.col("turn").cast("string"), F.col("utt").cast("string"), F.floor(F.unix_millis("at") / 2000).cast("string"))
    d = rv.latest_partials(b, "stream_id", slot, "revision")
    return d.select("conv_id", "turn", "utt", "revision", "is_final", F.size("tokens").alias("n_tokens"), "coalesced")


@query
def revision_guard(spark, sf):
    b = inp.busy_streams(spark, sf)
    shuffled = b.withColumn("result", F.col("seq") - F.when(F.col("seq") % 4 == 0, 3).otherwise(0))
    d = rv.revision_guard(shuffled, "stream_id", "seq", "result")
    return d.groupBy("conv_id").agg(F.count_if("stale").alias("stale"), F.count("*").alias("n"))


@query
def changed_only(spark, sf):
    b = inp.busy_streams(spark, sf).withColumn("shown", F.floor(F.size("tokens") / 12))
    d = rv.changed_only(b, "stream_id", "seq", "shown")
    return d.select("conv_id", "turn", "utt", "revision", "shown")


@query
def revision_numbers(spark, sf):
    d = rv.revise_numbers(inp.busy_streams(spark, sf).drop("revision"), "stream_id", "seq", "number")
    return d.select("conv_id", "seq", "number")


@query
def utterance_ids(spark, sf):
    d = rv.utterances(inp.busy_streams(spark, sf), "stream_id", "seq")
    return d.select("conv_id", "turn", "utt", "revision", "utterance")


@query
def elapsed_since_previous(spark, sf):
    d = ev.elapsed_since_previous(inp.busy_streams(spark, sf), "stream_id", "seq", "at")
    return d.select("conv_id", "seq", F.round("elapsed_ms", 3).alias("elapsed_ms"))


@query
def overload_generations(spark, sf):
    e = inp.event_log(spark, sf)
    d = rv.overload_generations(e, "session_id", "event_id", (F.col("type") == "error") & (F.col("value") > 100))
    kept = rv.drop_stale_generations(d, "session_id")
    return kept.groupBy("session_id", "generation").agg(F.count("*").alias("n"))


@query
def frozen_partials(spark, sf):
    h = inp.hypotheses(spark, sf)
    ends = h.filter("not is_final").groupBy("stream_id").agg(F.min(F.when(F.size("tokens") >= 10, F.col("revision"))).alias("endpoint"))
    d = rv.freeze_after_endpoint(h.join(ends, "stream_id", "left"), "stream_id", "endpoint")
    return d.groupBy("stream_id").agg(F.count("*").alias("n"), F.max("revision").alias("last"))


@query
def finals_in_order(spark, sf):
    b = inp.busy_streams(spark, sf).filter("is_final")
    d = ordered.numbered(b, ["stream_id"], ["seq"], "place")
    return d.select("conv_id", "turn", "utt", "place")


@query
def stable_prefix(spark, sf):
    d = rv.stable_prefix(inp.hypotheses(spark, sf), ["stream_id"], "revision")
    return d.select("stream_id", "revision", F.size("stable").alias("n_stable"))


@query
def sentence_of_token(spark, sf):
    d = inp.conversations(spark, sf)
    ends = tx.sentence_token_ends("text")
    d = d.select("conv_id", "turn", F.size(tx.tokenize("text")).alias("n"), ends.alias("ends")).filter("n > 0")
    d = d.select("conv_id", "turn", F.posexplode(tx.sentence_of_token(F.col("ends"), F.col("n"))).alias("pos", "sentence_end"))
    return d.select("conv_id", "turn", (F.col("pos") + 1).alias("token_no"), "sentence_end")


@query
def revision_rates(spark, sf):
    d = rv.revision_rates(inp.hypotheses(spark, sf), "stream_id")
    return d.select("stream_id", "partials", "finals", "revisions", F.round("per_second", 4).alias("per_second"))


@query
def once_per_key(spark, sf):
    e = inp.event_log(spark, sf)
    return e.select("session_id", "type", "message").dropDuplicates(["session_id", "type", "message"])


@query
def committed(spark, sf):
    c = rv.commit(inp.hypotheses(spark, sf), inp.active_prefixes(spark))
    return c.select("stream_id", "in_revision", "revision", "text", "is_final", "hold_events", "flushes")


@query
def mt_schedule(spark, sf):
    c = rv.commit(inp.hypotheses(spark, sf))
    r = rv.schedule_requests(c)
    return r.select("stream_id", "in_revision", "revision", "is_final", F.size("tokens").alias("n_tokens"))


@query
def endpoint(spark, sf):
    c = rv.commit(inp.hypotheses(spark, sf), endpoint=2)
    return c.filter("is_endpoint or is_final").select("stream_id", "in_revision", "text", "is_endpoint", "is_final", "n_frozen")


@query
def phrases(spark, sf):
    c = rv.commit(inp.hypotheses(spark, sf))
    u = c.select(
        "stream_id", F.col("revision").alias("seq"), "text", "lang", F.col("revision").alias("source_revision"), "is_final", F.timestamp_millis("at_ms").alias("at"),
    )
    d = rv.phrases(u, inp.active_prefixes(spark), low=4, high=12, mode="stable_sentence")
    return d.select("stream_id", "phrase_no", "source_revision", "text", "is_final", "shifts")


@query
def final_chunks(spark, sf):
    d = inp.conversations(spark, sf)
    c = rv.chunk_finals(d, ["stream_id"], "text", "lang", inp.active_prefixes(spark))
    return c.select("stream_id", "phrase_no", "text", "is_final", "shifts", "oversized")


@query
def frame_runs(spark, sf):
    return sg.frame_runs(inp.frames(spark, sf))


SHORT = dict(padding=2, min_speech=3, end_silence=5, emit=6, longest=60)


@query
def segments(spark, sf):
    d = sg.segments(inp.frames(spark, sf), **SHORT)
    return d.select("stream_id", "first_frame", "from_frame", "end_frame", "n_frames", "at_frame", "is_final")


@query
def cut_segments(spark, sf):
    f = inp.frames(spark, sf)
    cuts = f.filter("voiced and frame_no % 17 = 5").select(
        "stream_id", F.col("frame_no").alias("at_frame"), F.lit(None).cast("bigint").alias("first_frame"), F.lit(4).cast("bigint").alias("frames")
    )
    d = sg.segments(f, cuts, **SHORT, context=1)
    return d.select("stream_id", "first_frame", "end_frame", "n_frames", "at_frame", "is_final", "is_cut", "context_frames")


# Audio ------------------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of uneven length: event values as samples, one to four per chunk."""
    e = inp.table(spark, sf, "events")
    n = F.col("event_id") % 4 + 1
    return e.select(
        F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("sequence"),
        F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: (F.col("value") * i).cast("float")).alias("samples"),
    )


@query
def rechunked(spark, sf):
    d = sg.rechunk(_samples(spark, sf), 8)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return d.select("stream_id", "frame_no", F.size("samples").alias("n"), F.round(total, 2).alias("total"))


@query
def phrase_audio(spark, sf):
    s = _samples(spark, sf).withColumn("phrase_no", F.floor(F.col("sequence") / 100)).withColumn("rate", F.lit(16000))
    d = ev.phrase_audio(s, ["stream_id", "phrase_no"], "sequence", "samples", "rate")
    first, last = F.get("samples", F.lit(0)), F.get("samples", F.size("samples") - 1)
    return d.select(
        "stream_id", "phrase_no", "n_samples", F.round("duration_s", 6).alias("duration_s"),
        F.round(first.cast("double"), 2).alias("first_sample"), F.round(last.cast("double"), 2).alias("last_sample"),
    )


# Events -----------------------------------------------------------------------------------------


@query
def event_json(spark, sf):
    e = inp.event_log(spark, sf).select("event_id", "type", "session_id", "message", F.array(F.col("value")).alias("samples"))
    j = eventlog.to_event_json(e)
    return j.select(F.from_json("value", "event_id long, type string, sample_count int").alias("v")).select("v.*")


@query
def lossless_events(spark, sf):
    e = inp.event_log(spark, sf)
    yes = ev.is_lossless(F.col("type"), F.lit(False), F.col("value") > 50)
    return e.groupBy("type").agg(F.count_if(yes).alias("lossless"), F.count("*").alias("n"))


@query
def counters(spark, sf):
    e = inp.event_log(spark, sf).select(F.col("type").alias("name"), F.floor("value").alias("amount"))
    return ev.sum_counters(e)


@query
def windowed_metrics(spark, sf):
    e = inp.event_log(spark, sf).select(F.col("type").alias("name"), F.floor("value").alias("amount"), "ts")
    return ev.windowed_counters(e, "ts", "1 hour")


@query
def sliding_metrics(spark, sf):
    e = inp.event_log(spark, sf).select(F.col("type").alias("name"), F.floor("value").alias("amount"), "ts")
    return ev.windowed_counters(e, "ts", "6 hours", "2 hours")


@query
def stage_latency(spark, sf):
    d = ev.stage_latency(inp.event_log(spark, sf), "type")
    cols = [F.round(c, 4).alias(c) for c in ("avg", "min", "max")]
    return d.select("type", "name", "n", *cols, "p50", "p95")


@query
def session_report(spark, sf):
    d = ev.session_report(inp.event_log(spark, sf), inp.sessions(spark, sf))
    return d.select("session_id", *[F.round(c, 3).alias(c) for c in d.columns if c != "session_id"])


@query
def history(spark, sf):
    c = inp.texts(spark, sf, "conversations").withColumn("is_final", F.lit(True))
    d = ev.history(c, "conv_id", ["turn"], "text")
    return d.select("conv_id", "part", "n_texts", _hash(F.col("history")).alias("text_md5"))


@query
def last_warnings(spark, sf):
    d = ev.last_messages(inp.event_log(spark, sf), "session_id", 5, ("error",))
    return d.select("session_id", "rank", "event_id", "message")


@query
def oldest_events(spark, sf):
    return ev.read_ahead(inp.event_log(spark, sf), 100).select("event_id", "type", "session_id")


@query
def playback(spark, sf):
    e = inp.event_log(spark, sf).withColumn("d_ms", F.round(F.col("value") * 100).cast("bigint"))
    d = ev.playback(e, "session_id", "event_id", F.unix_millis("emitted_at"), F.col("d_ms"))
    return d.select("session_id", "event_id", F.col("start").alias("start_ms"), F.col("finish").alias("finish_ms"))


@query
def pacing(spark, sf):
    e = inp.event_log(spark, sf).withColumn("d_ms", F.round(F.col("value") * 100000).cast("bigint"))
    started = F.lit(1704067200000).cast("bigint")
    d = ev.pacing(e, "session_id", "event_id", F.unix_millis("emitted_at"), F.col("d_ms"), started)
    return d.select("session_id", "event_id", "media", "delay", "drift")


# Quality ----------------------------------------------------------------------------------------


def _cases(spark: SparkSession, sf: str):
    """Expected terms are what the matcher finds; observed ones miss some and hold extra ones."""
    docs = inp.texts(spark, sf, "documents")
    m = ir.best_terms(docs, ["doc_id"], "text", "lang", inp.active_forms(spark)).select(F.col("doc_id").alias("case_id"), "term_id")
    order = F.when(F.col("term_id") == "the_word", 1).when(F.col("term_id") == "of_word", 2).otherwise(3)
    seen = m.filter((F.col("case_id") + order) % 4 != 0)
    extra = docs.filter("doc_id % 6 = 1").select(F.col("doc_id").alias("case_id"), F.lit("other_word").alias("term_id"))
    banned = docs.filter("doc_id % 12 = 1").select(F.col("doc_id").alias("case_id"), F.lit("other_word").alias("term_id"))
    cases = docs.select(F.col("doc_id").alias("case_id"), "lang", "source", (F.col("n_chars") / 900.0).alias("minutes"))
    return cases, m, seen.unionByName(extra), banned


@query
def term_outcomes(spark, sf):
    _, want, got, banned = _cases(spark, sf)
    return ql.term_outcomes(want, got, banned)


@query
def term_quality(spark, sf):
    cases, want, got, banned = _cases(spark, sf)
    d = ql.term_accuracy(ql.term_outcomes(want, got, banned), cases, "lang", "source", minutes="minutes")
    rounded = [F.round(c, 6).alias(c) for c in ("recall", "precision", "false_per_minute")]
    return d.select("lang", "source", "hit", "miss", "extra", *rounded)


@query
def character_error_rate(spark, sf):
    h = inp.hypotheses(spark, sf)
    ref = h.filter("is_final").select("stream_id", F.array_join("tokens", " ").alias("ref"))
    d = h.join(ref, "stream_id").withColumn("hyp", F.array_join("tokens", " "))
    d = d.withColumn("errors", ql.character_errors(F.col("hyp"), F.col("ref"))).withColumn("size", F.length("ref"))
    g = ql.corpus_rate(d, "errors", "size", "stream_id")
    return g.select("stream_id", "errors", "size", F.round("rate", 6).alias("rate"))


@query
def word_error_rate(spark, sf):
    h = inp.hypotheses(spark, sf)
    ref = h.filter("is_final").select("stream_id", F.col("tokens").alias("ref"))
    d = h.join(ref, "stream_id")
    d = d.withColumn("errors", ql.word_errors(F.col("tokens"), F.col("ref"))).withColumn("size", F.size("ref"))
    g = ql.corpus_rate(d, "errors", "size", "stream_id")
    return g.select("stream_id", "errors", "size", F.round("rate", 6).alias("rate"))
