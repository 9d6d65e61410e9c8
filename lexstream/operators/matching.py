"""Find glossary terms in texts: joins of text n-grams with dictionary n-grams.

A text is cut into chunks of a fixed number of units, each with its character offset and a little
of the following chunk.  A unit is a word with what follows it (forms that start and end with a
word character and must stand alone) or one visible character with the white space after it (all
other forms).  A bitmap over the hashes of all first words, of bounded size whatever the dictionary, rules out
most units inside the row of their chunk; what is left becomes a row with the units of the longest form, is joined
with the first words and then, extended to n-grams, with whole forms.  The dictionary side is broadcast while its
counted size allows it; beyond that these short rows are shuffled, never the chunks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import patterns as p
from ..functions.text import count_up, let, prefix_sums, tokenize
from ..session import MAX_BROADCAST_BYTES, hint, small_side, width, written
from .overlaps import chosen

_WORD_UNIT = f"[{p.WORD}]++[^{p.WORD}]*+"
_CHAR_UNIT = f"[^{p.SPACE}][{p.SPACE}]*+"
_CHUNK = 128
#: Bits of the largest bitmap over first words; it travels as a constant of the plan.
MAX_BITS = 1 << 22
#: Bytes of token prefixes that every task may hold beside its rows.
MAX_IN_ROW = 4 << 20


@dataclass(frozen=True)
class _Branch:
    unit: str
    head: str
    lead: str
    tail: str
    checks_edges: bool


_WORDS = _Branch(_WORD_UNIT, f"[{p.WORD}]++", f"[^{p.WORD}]++", f"[^{p.WORD}]++\\z", False)
_CHARS = _Branch(_CHAR_UNIT, p.CHAR_TOKEN, f"[{p.SPACE}]++", f"[{p.SPACE}]++\\z", True)


def prepare_forms(forms: DataFrame, terms: DataFrame, case_sensitive_codes: bool = True) -> DataFrame:
    """Dictionary rows ready for matching: normalized form, join key, branch and rank columns."""
    sensitive = nz.looks_code_like("form") if case_sensitive_codes else F.lit(False)
    d = forms.join(terms.select("term_id", "priority", "policy", "declaration_order"), "term_id")
    d = d.withColumn("sensitive", sensitive)
    # A dictionary of plain forms, the usual case, needs no Python worker.
    plain = d.filter(~nz.is_plain(F.col("form"), words=True)).isEmpty()
    norm = (lambda fold: nz.normalize_plain("form", fold)) if plain else (lambda fold: nz.normalize("form", fold))
    d = d.withColumn("folded_norm", norm(True)).withColumn("cased_norm", norm(False))
    chosen = F.when(F.col("sensitive"), F.col("cased_norm")).otherwise(F.col("folded_norm"))
    d = d.withColumn("norm", chosen).filter("norm <> ''")
    edges = f"^[{p.WORD}](?s:.*)(?<=[{p.WORD}])\\z"
    d = d.withColumn("bounded", nz.needs_boundaries("form", "lang"))
    d = d.withColumn("by_word", F.col("bounded") & F.col("norm").rlike(edges))
    key = F.when(F.col("sensitive"), nz.plain_lower(F.col("norm"))).otherwise(F.col("norm"))
    unit = lambda pat: F.regexp_extract_all("key", F.lit(pat), F.lit(0))
    d = d.withColumn("key", key)
    d = d.withColumn("units", F.when(F.col("by_word"), unit(_WORD_UNIT)).otherwise(unit(_CHAR_UNIT)))
    head = F.get("units", F.lit(0))
    tail = F.when(F.col("by_word"), F.regexp_replace(head, _WORDS.tail, "")).otherwise(
        F.regexp_replace(head, _CHARS.tail, "")
    )
    d = d.select(
        "term_id", "lang", "form", "canonical", "is_alias", "policy", "priority", "sensitive", "bounded",
        "by_word", "norm", "key", tail.alias("head"), F.size("units").alias("n_units"),
        (F.col("declaration_order").cast("long") * (1 << 32) + F.col("form_order")).alias("rank"),
        F.length("norm").alias("norm_len"),
    )
    # Compiled once: the joins below read it several times, and its rules stay out of their plans.
    return written(d, "forms")


def _normalized_texts(docs: DataFrame, keys: list[str], text: str, lang: str, langs: list[str], words: bool) -> DataFrame:
    """(keys, lang, mode, body[, starts, ends]); only texts that are not plain pass through Python."""
    base = docs.select(*keys, F.col(lang).alias("lang"), F.col(text).alias("body")).filter(F.col("lang").isin(langs))
    other = F.when(~nz.is_plain(F.col("body"), words), F.col("body"))
    d = base.withColumn("folded", nz.align_folded(other)).withColumn("cased", nz.align_cased(other))
    none = F.lit(None).cast("array<int>")
    plain = F.struct(F.lit("both").alias("mode"), F.col("body"), none.alias("starts"), none.alias("ends"))
    aligned = lambda mode: F.struct(
        F.lit(mode).alias("mode"), F.col(f"{mode}.text").alias("body"),
        F.col(f"{mode}.starts").alias("starts"), F.col(f"{mode}.ends").alias("ends"),
    )
    views = F.when(F.col("folded").isNull() | F.col("folded.text").isNull(), F.array(plain)).otherwise(
        F.array(aligned("folded"), aligned("cased"))
    )
    return d.select(*keys, "lang", F.explode(views).alias("v")).select(*keys, "lang", "v.*")


def _chunks(texts: DataFrame, keys: list[str], br: _Branch, k_max: int) -> DataFrame:
    """One row per chunk: offset, own text, the start of what follows, the character before."""
    pattern = f"(?:{br.unit}){{1,{max(_CHUNK, k_max + 1)}}}+|{br.lead}"
    ahead = f"^(?:{br.unit}){{0,{k_max + 1}}}+"

    def rows(cs: Column) -> Column:
        return let(
            prefix_sums(F.transform(cs, lambda c: F.length(c))),
            lambda ends: F.transform(
                cs,
                lambda c, i: F.struct(
                    (F.get(ends, i) - F.length(c)).cast("int").alias("base"),
                    c.alias("own"),
                    F.coalesce(F.regexp_extract(F.get(cs, i + 1), ahead, 0), F.lit("")).alias("after"),
                    F.coalesce(F.right(F.get(cs, i - 1), F.lit(1)), F.lit("")).alias("before"),
                ),
            ),
        )

    cut = let(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), rows)
    c = texts.select(*keys, "lang", "mode", "starts", "ends", F.explode(cut).alias("c"))
    span = F.length("c.own") + F.length("c.after")
    part = lambda a: F.when(F.col("mode") != "both", F.slice(a, F.col("c.base") + 1, span))
    return c.select(*keys, "lang", "mode", "c.*", part("starts").alias("starts"), part("ends").alias("ends"))


def head_filter(heads: DataFrame) -> Callable[[Column, Column], Column]:
    """A test whether (lang, head) may be among ``heads``: a bitmap over hashes, never wrong about one that is."""
    n, bits = heads.count(), 1 << 12
    while bits < min(16 * n, MAX_BITS):
        bits *= 2
    place = lambda lang, head: F.pmod(F.xxhash64(lang, head), F.lit(bits))
    at = heads.select(place(F.col("lang"), F.col("head")).alias("at"))
    # At most bits / 64 rows.
    held = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).collect()
    words = [0] * (bits >> 6)
    for r in held:
        words[r["word"]] = r["b"]
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def may_hold(lang: Column, head: Column) -> Column:
        def bit(x: Column) -> Column:
            return F.get(table, F.shiftright(x, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))) != 0

        return F.coalesce(let(place(lang, head), bit), F.lit(False))

    return may_hold


def heads_of(body: Column, mode: Column, fold: Callable[[Column], Column], br: _Branch) -> Column:
    """The folded heads of all units.  Cased texts are folded head by head, as one that folds to two characters, such
    as sharp s, would shift those behind it."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(br.head), F.lit(0))
    return F.when(mode == "cased", F.transform(cut(body), fold)).otherwise(cut(fold(body)))


def _hits(chunks: DataFrame, keys: list[str], br: _Branch, k_max: int, may_hold: Callable[[Column, Column], Column]) -> DataFrame:
    """One row for each unit that may begin a form: its place ``s`` in the chunk, its first word, the units from it on
    that the longest form may need, the character before, and, for aligned texts, the original places of these units."""
    fold = lambda c: F.when(F.col("mode") == "folded", c).otherwise(nz.plain_lower(c))
    own = F.col("own")
    heads = heads_of(nz.plain_normalize(own) if br.checks_edges else own, F.col("mode"), fold, br)
    units = F.regexp_extract_all(F.concat("own", "after"), F.lit(br.unit), F.lit(0))

    def rows(hs: Column, at: Column, us: Column) -> Column:
        def gap(i: Column, k: Column) -> Column:
            prev = F.coalesce(F.get(at, k - 1), F.lit(0))
            return F.length(F.array_join(F.slice(us, prev + 1, i - prev), ""))

        def one(i: Column, k: Column, starts: Column) -> Column:
            prev = F.coalesce(F.when(i > 0, F.get(us, i - 1)), F.col("before"))
            return F.struct(
                F.get(starts, k).cast("int").alias("s"), F.get(hs, i).alias("head"), F.slice(us, i + 1, F.lit(k_max + 1)).alias("us"),
                F.right(prev, F.lit(1)).alias("prev"),
            )

        return let(prefix_sums(F.transform(at, gap)), lambda starts: F.transform(at, lambda i, k: one(i, k, starts)))

    def of(hs: Column) -> Column:
        at = F.filter(count_up(F.size(hs)), lambda i: may_hold(F.col("lang"), F.get(hs, i)))
        return let(at, lambda xs: F.when(F.size(xs) > 0, let(units, lambda us: rows(hs, xs, us))))

    d = chunks.select(*keys, "lang", "mode", "base", "starts", "ends", F.explode(let(heads, of)).alias("x"))
    d = d.select(*keys, "lang", "mode", "base", "starts", "ends", "x.*")
    span = F.length(F.array_join("us", ""))
    part = lambda a: F.when(F.col("mode") != "both", F.slice(a, F.col("s") + 1, span))
    return d.withColumns({"starts": part("starts"), "ends": part("ends")})


def _matches(texts: DataFrame, keys: list[str], forms: DataFrame, br: _Branch, k_max: int, size: int, limit: int) -> DataFrame:
    bare = lambda c: F.regexp_replace(c, f"(?<!{br.lead[:-2]}){br.tail}", "")
    # Join keys are never null, so that no null check with a copy of them is pushed below the join.
    fold = lambda c: F.coalesce(F.when(F.col("mode") == "folded", c).otherwise(nz.plain_lower(c)), F.lit(""))
    heads = forms.groupBy("lang", "head").agg(F.sort_array(F.collect_set("n_units")).alias("sizes"))
    w = _hits(_chunks(texts, keys, br, k_max), keys, br, k_max, head_filter(heads.select("lang", "head")))
    w = w.withColumn("head", F.coalesce("head", F.lit(""))).join(hint(heads, size, limit), ["lang", "head"]).drop("head")
    w = w.withColumn("n_units", F.explode("sizes")).drop("sizes").filter(F.col("n_units") <= F.size("us"))
    w = w.withColumn("raw", bare(F.array_join(F.slice("us", F.lit(1), F.col("n_units")), "")))
    w = w.withColumn("gram", F.when(nz.is_normal(F.col("raw")), F.col("raw")).otherwise(nz.plain_normalize(F.col("raw"))))
    w = w.withColumn("key", fold(F.col("gram")))
    m = w.join(hint(forms.drop("head", "by_word"), size, limit), ["lang", "key", "n_units"])
    fits = (
        F.when(F.col("mode") == "folded", ~F.col("sensitive"))
        .when(F.col("mode") == "cased", F.col("sensitive") & (F.col("gram") == F.col("norm")))
        .otherwise(~F.col("sensitive") | (F.col("gram") == F.col("norm")))
    )
    if br.checks_edges:
        # Units end where the next begins, so what follows the form is found behind its characters.
        tail = F.array_join(F.slice("us", F.lit(1), F.col("n_units") + 1), "")
        follow = F.substring(tail, F.length("raw") + 1, F.lit(1))
        word = lambda c: c.rlike(f"[{p.WORD}]\\z")
        fits = fits & (~F.col("bounded") | (~word(F.col("prev")) & ~word(follow)))
    m = m.filter(fits).withColumn("n", F.length("raw"))
    plain = F.col("mode") == "both"
    start = F.when(plain, F.col("base") + F.col("s")).otherwise(F.get("starts", F.lit(0)))
    end = F.when(plain, F.col("base") + F.col("s") + F.col("n")).otherwise(F.get("ends", F.col("n") - 1))
    return m.select(
        *keys, "lang", "term_id", "form", "canonical", "is_alias", "policy", "priority", "rank", "norm_len",
        start.cast("int").alias("start"), end.cast("int").alias("end"), "mode",
    )


def find_terms(
    docs: DataFrame, keys: list[str], text: str, lang: str, forms: DataFrame, limit: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Every occurrence of every form, overlaps included, with half-open 0-based character spans.

    ``forms`` comes from ``prepare_forms``.  ``keys`` must identify a row of ``docs``.  A dictionary of more than
    ``limit`` bytes is not broadcast.
    """
    size = F.sum(width("form", "canonical", "norm", "key", "head"))
    branches = forms.groupBy("by_word").agg(
        F.max("n_units").alias("k"), F.collect_set("lang").alias("langs"), size.alias("size")
    ).collect()
    out = None
    for row in branches:
        br = _WORDS if row["by_word"] else _CHARS
        texts = _normalized_texts(docs, keys, text, lang, row["langs"], row["by_word"])
        found = _matches(texts, keys, forms.filter(F.col("by_word") == row["by_word"]), br, row["k"], row["size"], limit)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return _no_matches(docs, keys, lang, forms)
    # Only aligned texts can yield one original span twice, when a character folds to several.
    # No-boundary branches only; whole words cannot start inside a character.
    return out.drop("mode") if all(r["by_word"] for r in branches) else _distinct_spans(out, keys)


def _no_matches(docs: DataFrame, keys: list[str], lang: str, forms: DataFrame) -> DataFrame:
    """What an empty dictionary finds: no row, in the columns of all others."""
    none = docs.select(*keys, F.col(lang).alias("lang")).where(F.lit(False))
    held = ("term_id", "form", "canonical", "is_alias", "policy", "priority", "rank", "norm_len")
    typed = [F.lit(None).cast(forms.schema[c].dataType).alias(c) for c in held]
    return none.select("*", *typed, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))


def _distinct_spans(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.drop("mode").dropDuplicates([*keys, "term_id", "start", "end", "form"])


def in_order(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Number the matches of each text by start, longest, highest priority, declared first."""
    w = Window.partitionBy(*keys).orderBy("start", F.desc("norm_len"), F.desc("priority"), "rank", "end", "term_id")
    return matches.withColumn("pos", F.row_number().over(w))


def _clusters(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Name the cluster of overlapping spans each row belongs to.

    The windows run per text.  A text is one row of the corpus, so its matches stay within what a
    row can hold, however skewed the corpus is.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("__reach").isNull() | (F.col("start") >= F.col("__reach"))
    d = spans.withColumn("__reach", reach).withColumn("__opens", F.when(opens, F.col("start")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("__cluster", F.max("__opens").over(upto)).drop("__reach", "__opens")


def best_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Non-overlapping matches: longest, then highest priority, declared first, leftmost.

    Only matches that touch through others compete, so the choice runs per cluster.
    """
    d = _clusters(matches, keys)
    item = F.struct(
        "start", "end", "norm_len", "priority", "rank", "term_id", "form", "canonical", "is_alias", "policy", "lang",
    )
    g = d.groupBy(*keys, "__cluster").agg(F.array_sort(F.collect_list(item)).alias("ms"))
    g = g.withColumn("m", F.explode(chosen(F.col("ms"))))
    return g.select(
        *keys, "m.lang", "m.term_id", "m.form", "m.canonical", "m.is_alias", "m.policy", "m.priority", "m.rank", "m.norm_len",
        "m.start", "m.end",
    )


# Token level ------------------------------------------------------------------------------------


def prefix_table(forms: DataFrame) -> DataFrame:
    """Every token prefix of every form: (lang, n, key, head, is_term, is_open)."""
    plain = forms.filter(~nz.is_plain(F.col("form"), words=True)).isEmpty()
    norm = nz.normalize_plain("form") if plain else nz.normalize("form")
    toks = F.transform(tokenize(norm, F.col("lang")), lambda t: F.lower(t))
    f = forms.select("lang", toks.alias("t")).filter("size(t) > 0")
    n = F.explode(F.sequence(F.lit(1), F.size("t")))
    f = f.select("lang", "t", n.alias("n"))
    sep = "\x1f"
    g = f.groupBy(
        "lang", "n", F.array_join(F.slice("t", F.lit(1), F.col("n")), sep).alias("key"),
        F.get("t", F.lit(0)).alias("head"),
    ).agg(F.max(F.col("n") == F.size("t")).alias("is_term"), F.max(F.col("n") < F.size("t")).alias("is_open"))
    return written(g, "prefixes")


def prefix_hits(
    rows: DataFrame, keys: list[str], tokens: str, lang: str, prefixes: DataFrame, limit: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Token spans that equal a dictionary prefix: (keys, start, end, n_tokens, is_term, is_open).

    Tokens that begin no form are ruled out inside the row (``head_filter``); the others become a row with as many
    tokens as the longest prefix has.
    """
    stats = prefixes.agg(F.sum(width("key", "head")).alias("size"), F.max("n").alias("longest")).first()
    size, longest = stats["size"], stats["longest"] or 1
    heads = prefixes.groupBy("lang", "head").agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    may_hold = head_filter(heads.select("lang", "head"))

    def rows_of(low: Column) -> Column:
        at = F.filter(count_up(F.size(low)), lambda i: may_hold(F.col("lang"), F.get(low, i)))
        return F.transform(at, lambda i: F.struct(i.alias("start"), F.slice(low, i + 1, F.lit(longest)).alias("win")))

    w = rows.select(*keys, F.col(lang).alias("lang"), F.col(tokens).alias("__ts"))
    low = F.transform("__ts", lambda t: F.coalesce(F.lower(t), F.lit("")))
    w = w.select(*keys, "lang", F.size("__ts").alias("n_tokens"), F.explode(let(low, rows_of)).alias("x"))
    w = w.select(*keys, "lang", "n_tokens", "x.*").withColumn("head", F.coalesce(F.get("win", F.lit(0)), F.lit("")))
    w = w.join(hint(heads, size, limit), ["lang", "head"]).withColumn("n", F.explode("sizes")).filter(F.col("n") <= F.size("win"))
    w = w.withColumn("key", F.coalesce(F.array_join(F.slice("win", F.lit(1), F.col("n")), "\x1f"), F.lit(""))).drop("win")
    # Several forms may share a prefix; the table holds each prefix once.
    side = prefixes.select("lang", "n", "key", "is_term", "is_open")
    return w.join(hint(side, size, limit), ["lang", "n", "key"]).select(
        *keys, "start", (F.col("start") + F.col("n")).alias("end"), "n_tokens",
        "is_term", "is_open",
    )


def prefix_spans(tokens: str, lang: str, prefixes: DataFrame, which: str, limit: int = MAX_IN_ROW) -> Column | None:
    """The (start, end) of ``prefix_hits`` for which ``which`` holds, as an array found inside the row.

    The prefixes travel with the plan as a hash table by first token; None if they take more than ``limit`` bytes.
    """
    if (prefixes.agg(F.sum(width("key", "head")).alias("n")).first()["n"] or 0) > limit:
        return None
    rows = prefixes.filter(which).select("lang", "n", "key", "head", F.xxhash64("lang", "head").alias("hash")).collect()
    buckets = 1024
    while buckets < 16 * len(rows):
        buckets *= 2
    slots: list[list[dict]] = [[] for _ in range(buckets)]
    for r in rows:
        slots[r["hash"] % buckets].append({c: r[c] for c in ("lang", "n", "key", "head")})
    held = F.from_json(F.lit(json.dumps([x or None for x in slots])), "array<array<struct<lang:string,n:int,key:string,head:string>>>")
    slot = lambda head: F.get(held, F.pmod(F.xxhash64(F.col(lang), head), F.lit(buckets)).cast("int"))

    def rows_of(low: Column) -> Column:
        def at(head: Column, i: Column) -> Column:
            def same(e: Column) -> Column:
                near = (e["lang"] == F.col(lang)) & (e["head"] == head) & (i + e["n"] <= F.size(low))
                return near & (F.array_join(F.slice(low, i + 1, e["n"]), "\x1f") == e["key"])

            spans = lambda es: F.transform(F.filter(es, same), lambda e: F.struct(i.alias("start"), (i + e["n"]).alias("end")))
            return let(slot(head), spans)

        return F.flatten(F.array_compact(F.transform(low, at)))

    return let(F.transform(F.col(tokens), lambda t: F.coalesce(F.lower(t), F.lit(""))), rows_of)


def token_spans(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Whole terms by tokens, left to right, the longest at each place, without overlap."""
    longest = hits.filter("is_term").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    clusters = _clusters(longest, keys).groupBy(*keys, "__cluster")
    spans = clusters.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    none = F.filter(F.col("s"), lambda x: F.lit(False))
    chosen = F.aggregate(
        F.col("s"),
        F.struct(none.alias("out"), F.lit(0).alias("free")),
        lambda a, x: F.when(
            x["start"] >= a["free"],
            F.struct(F.concat(a["out"], F.array(x)).alias("out"), x["end"].alias("free")),
        ).otherwise(a),
        lambda a: a["out"],
    )
    return spans.select(*keys, F.explode(chosen).alias("s")).select(*keys, "s.start", "s.end")


def open_suffix(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest start from which all remaining tokens are the beginning of a longer form."""
    return hits.filter("is_open and end = n_tokens").groupBy(*keys).agg(F.min("start").alias("open_start"))


def prefix_flags(rows: DataFrame, keys: list[str], tokens: str, lang: str, prefixes: DataFrame) -> DataFrame:
    """For whole token arrays: is it a prefix of a form, a form, the beginning of a longer form."""
    low = F.transform(F.col(tokens), lambda t: F.lower(t))
    q = rows.select(*keys, F.col(lang).alias("lang"), F.size(tokens).alias("n"),
                    F.array_join(low, "\x1f").alias("key"))
    side = small_side(prefixes.select("lang", "n", "key", "is_term", "is_open"), "key")
    j = q.join(side, ["lang", "n", "key"], "left")
    empty = F.col("n") == 0
    return j.select(
        *keys,
        (empty | F.col("is_term").isNotNull()).alias("is_prefix"),
        F.coalesce("is_term", F.lit(False)).alias("is_term"),
        (empty | F.coalesce("is_open", F.lit(False))).alias("is_open"),
    )
