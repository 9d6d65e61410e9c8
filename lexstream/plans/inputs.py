"""Tables the queries run on, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_sentences, tokenize
from ..operators import matching as mt
from ..operators import ordered
from ..operators.glossary import activate
from ..session import written
from ..sources.glossary import FORMS, SPOKEN, TERMS, Glossary

LANGS = ("en", "fr", "de", "es")
STEP = 5

# The sample dictionary: (id, domains, priority, policy, {lang: (canonical, aliases)}, {lang: spoken}).
ENTRIES = [
    ("and_the", ["general", "grammar"], 100, "preferred_term",
     {"en": ("and the", ["to the", "by the"]), "fr": ("de la", ["dans la"]), "de": ("in der", ["und die"]),
      "es": ("de la", ["en la"])}, {"en": "an thee", "fr": "deu la"}),
    ("the_word", ["general"], 40, "preferred_term",
     {"en": ("the", []), "fr": ("la", []), "de": ("der", []), "es": ("la", [])}, {"en": "thee"}),
    ("that_word", ["grammar"], 70, "preserve",
     {"en": ("that", ["this"]), "fr": ("que", ["qui"]), "de": ("das", ["ein"]), "es": ("que", ["los"])}, {}),
    ("of_word", ["general"], 60, "display_preserve_speech_override",
     {"en": ("of", ["Of the"]), "fr": ("des", []), "de": ("mit", []), "es": ("del", [])}, {"en": "ov", "es": "dell"}),
    ("other_word", ["biology"], 70, "preferred_term", {"en": ("with", []), "fr": ("avec", [])}, {}),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts.  One that comes as fewer splits than there are cores, such as a single small
    file, is spread over them, since text work costs far more than moving the rows."""
    d = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def instant(c: str) -> Column:
    """A stored wall time as the UTC instant it means, whatever the time zone of the session."""
    return F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())


def sample_rows() -> tuple[list, list, list]:
    terms, forms, spoken = [], [], []
    for i, (tid, domains, priority, policy, langs, voices) in enumerate(ENTRIES):
        terms.append((tid, domains, priority, policy, i))
        for lang, (canonical, aliases) in langs.items():
            boost = 1.8 if tid == "and_the" and lang == "en" else None
            for j, form in enumerate([canonical, *aliases]):
                forms.append((tid, lang, form, j, canonical, j > 0, boost))
        spoken += [(tid, lang, s) for lang, s in voices.items()]
    return terms, forms, spoken


def glossary(spark: SparkSession) -> Glossary:
    terms, forms, spoken = sample_rows()
    return Glossary(
        spark.createDataFrame(terms, TERMS), spark.createDataFrame(forms, FORMS), spark.createDataFrame(spoken, SPOKEN),
        ["general", "grammar"],
    )


def active_forms(spark: SparkSession) -> DataFrame:
    """Matching-ready forms of the default domains."""
    g = glossary(spark)
    return mt.prepare_forms(g.forms, activate(g.terms, g.default_domains))


def active_prefixes(spark: SparkSession) -> DataFrame:
    g = glossary(spark)
    return mt.prefix_table(g.forms.join(activate(g.terms, g.default_domains), "term_id", "left_semi"))


def bigram_glossary(docs: DataFrame, min_support: int = 10) -> DataFrame:
    """Every word pair that a language holds ``min_support`` times, as a dictionary that grows with the corpus."""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.lower(w))
    d = docs.select("lang", words.alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    d = d.select("lang", F.explode(F.array_compact(pairs)).alias("form")).groupBy("lang", "form").agg(F.count("*").alias("n"))
    # Counted once: terms and forms are made of it, and the forms are looked at before they are stored.
    return written(d.filter(F.col("n") >= min_support), "bigrams")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = texts(spark, sf, "conversations")
    stream = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", stream.alias("stream_id"), "text", F.lit("en").alias("lang"))


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Growing hypotheses of every sentence of every turn, ``STEP`` tokens more each time, the last final and whole.

    Odd partials end in a wrong token.  Revisions are half a second apart, sentences a minute, turns an hour.
    """
    d = conversations(spark, sf).select("conv_id", "turn", "lang", F.posexplode(split_sentences("text")).alias("utt", "sentence"))
    stream = F.concat_ws("-", *[F.col(c).cast("string") for c in ("conv_id", "turn", "utt")])
    d = d.withColumn("stream_id", stream).withColumn("all", tokenize("sentence")).filter("size(all) > 0")
    d = d.withColumn("k_max", F.ceil(F.size("all") / STEP).cast("int"))
    d = d.withColumn("revision", F.explode(F.sequence(F.lit(1), F.col("k_max"))))
    final = F.col("revision") == F.col("k_max")
    size = F.least(F.size("all"), STEP * F.col("revision"))
    whole = F.slice("all", F.lit(1), size)
    wrong = F.concat(F.slice("all", F.lit(1), size - 1), F.array(F.lit("zz")))
    at = F.timestamp_millis(
        F.lit(1704067200000) + F.col("conv_id") * 1000 + F.col("turn") * 3600000 + F.col("utt") * 60000 + F.col("revision") * 500
    )
    return d.select(
        "conv_id", "turn", "utt", "stream_id", "revision", "lang",
        F.when(~final & (F.col("revision") % 2 == 1), wrong).otherwise(whole).alias("tokens"),
        final.alias("is_final"), at.alias("at"),
    )


def busy_streams(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with one stream per conversation: many utterances, ``seq`` over all of them."""
    h = hypotheses(spark, sf).drop("stream_id")
    h = h.withColumn("stream_id", F.col("conv_id"))
    return ordered.numbered(h, ["stream_id"], ["turn", "utt", "revision"], "seq")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as numbered frames, voiced above a value of 35."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("stream_id"), "ts", "event_id", "value")
    d = ordered.numbered(e, ["stream_id"], ["ts", "event_id"], "n")
    return d.select("stream_id", (F.col("n") - 1).alias("frame_no"), (F.col("value") > 35).alias("voiced"))


# Event kinds of the given table, read as pipeline events.
KINDS = {
    "click": "asr_partial", "view": "asr_final", "signup": "translation_final", "purchase": "tts_final",
    "error": "error",
}


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.lit("status")
    for name, to in KINDS.items():
        kind = F.when(F.col("event_type") == name, to).otherwise(kind)
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), kind.alias("type"), instant("ts").alias("emitted_at"),
        instant("ts").alias("completed_at"), "ts", F.col("props").alias("message"), "value",
        F.create_map(F.lit("latency_ms"), F.col("value")).alias("metrics"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One session per user: input from the first event for 20 days, media of a third of that."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min(instant("ts")).alias("input_started_at"))
    return e.select(
        "session_id", "input_started_at", (F.col("input_started_at") + F.expr("interval 20 days")).alias("input_finished_at"),
        F.lit(576000.0).alias("input_duration_s"),
    )


def timed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with one timed word per lexical token, four words a second."""
    d = conversations(spark, sf).withColumn("tokens", tokenize("text"))
    lexical = F.filter("tokens", lambda t: t.rlike(r"[\p{L}\p{N}]"))
    words = F.transform(
        lexical,
        lambda t, i: F.struct(
            t.alias("text"), (i / F.lit(4.0)).alias("start"), ((i + 1) / F.lit(4.0)).alias("end"),
            (F.lit(1.0) / (i + 1)).alias("confidence"),
        ),
    )
    return d.withColumn("words", words)


def sentence_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents")
    return d.select("doc_id", "lang", F.posexplode(split_sentences("text")).alias("pos", "sentence"))
