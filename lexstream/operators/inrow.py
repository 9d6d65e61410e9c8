"""Terms found, chosen and replaced inside the row of their text: the text is never shuffled.

Plain texts, which are most, pass a small function in Arrow batches that looks up their words, and the characters that
may begin a form that is not whole words, and gives (start, end, number of the form); only these numbers come back.  For
texts that need normalization the dictionary is a hash table, an array of buckets that travels as a constant of the plan,
searched by array functions: words are looked up by the bucket of their hash, and only the places that hold the first word
of a form are extended to whole forms.  Either way a rewrite of a corpus is a scan and a projection.  ``fits`` says whether a dictionary is small enough to travel like this;
larger ones are joined (``matching.find_terms``).
"""

from __future__ import annotations

import json
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as nz
from ..functions import patterns as p
from ..functions.text import count_up, let, prefix_sums
from ..session import width
from . import matching
from .matching import _CHARS, _WORDS, _Branch
from .overlaps import chosen

#: Bytes of dictionary that every task may hold beside its rows.
MAX_DICTIONARY = 4 << 20
_FIELDS = ["n_units", "key", "norm", "sensitive", "bounded", "term_id", "form", "canonical", "is_alias", "policy", "priority", "rank", "norm_len"]


@dataclass
class Dictionary:
    """The compiled table as a column: array of (lang, by_word, buckets of (head, forms), held: which are not empty).

    ``entries`` holds the forms in the order in which matches of one span are listed; ``words`` the numbers of those of
    whole words and what decides about a match, by language and first word; ``chars`` the same of the others, by language.
    """

    tables: Column
    buckets: int
    langs: list[str]
    kinds: list[bool]
    extra: list[T.StructField]
    entries: Column
    words: dict[str, dict[str, list[dict]]]
    chars: dict[str, Characters]


@dataclass
class Characters:
    """Forms that are no whole words: what they may begin with, and by their first two characters the lengths and forms."""

    heads: re.Pattern
    sizes: dict[str, list[int]]
    forms: dict[str, list[dict]]

    @classmethod
    def of(cls, forms: list[dict]) -> Characters:
        sizes: dict[str, set[int]] = {}
        by_key: dict[str, list[dict]] = {}
        for f in forms:
            sizes.setdefault(f["key"][:2], set()).add(len(f["key"]))
            by_key.setdefault(f["key"], []).append(f)
        # A lookahead gives every place, also inside what another one has matched.
        heads = re.compile("(?=({}))".format("|".join(map(re.escape, sorted(sizes, reverse=True)))), re.DOTALL)
        single = {h: n for h, n in sizes.items() if len(h) == 1}
        # A form of one character may begin where longer ones do.
        return cls(heads, {h: sorted(n | single.get(h[:1], set())) for h, n in sizes.items()}, by_key)


def fits(forms: DataFrame, limit: int = MAX_DICTIONARY) -> bool:
    """Whether the prepared forms may travel with the tasks."""
    size = forms.agg(F.sum(width("form", "canonical", "norm", "key", "head")).alias("n")).first()["n"]
    return (size or 0) <= limit


def compiled(forms: DataFrame, extra: list[str] | None = None) -> Dictionary:
    """Hash table of prepared forms; ``extra`` names further columns that matches are to carry."""
    extra = extra or []
    rows = forms.select("lang", "by_word", "head", F.xxhash64("head").alias("hash"), F.to_json(F.struct(*_FIELDS, *extra)).alias("form")).collect()
    listed = [x["form"] for x in rows]
    read = {x: json.loads(x) for x in listed}
    # As in Spark, null comes first.
    at = lambda x, sign=1: (x is not None, sign * (x or 0))
    listed.sort(key=lambda x: ([at(read[x].get(c)) for c in ("norm_len", "priority", "rank")], read[x]["term_id"], read[x]["form"], x))
    known = {x: i for i, x in enumerate(listed)}
    words: dict[str, dict[str, list[dict]]] = {}
    chars: dict[str, list[dict]] = {}
    for r in rows:
        f = read[r["form"]]
        by = (-f["norm_len"], at(f.get("priority"), -1), at(f.get("rank"))), (f["term_id"], f["form"])
        held = {"n": f["n_units"], "key": f["key"], "exact": f["norm"] if f["sensitive"] else None, "no": known[r["form"]], "by": by}
        if r["by_word"]:
            words.setdefault(r["lang"], {}).setdefault(r["head"], []).append(held)
        else:
            chars.setdefault(r["lang"], []).append({**held, "bounded": f["bounded"]})
    tables: dict[tuple, dict] = {}
    for r in sorted(rows):
        tables.setdefault((r["lang"], r["by_word"]), {}).setdefault((r["hash"], r["head"]), []).append(r["form"])
    # Most words are in no form: a sparse table rules them out by their hash alone.
    buckets = 1024
    while buckets < 16 * max(map(len, tables.values()), default=1):
        buckets *= 2
    texts = []
    for (lang, by_word), heads in tables.items():
        slots: list[list[str]] = [[] for _ in range(buckets)]
        for (value, head), found_forms in heads.items():
            slots[value % buckets].append(f'{{"head": {json.dumps(head)}, "forms": [{", ".join(found_forms)}]}}')
        texts.append(
            f'{{"lang": {json.dumps(lang)}, "by_word": {json.dumps(by_word)}, '
            f'"buckets": [{", ".join(f"[{", ".join(x)}]" if x else "null" for x in slots)}], "held": {json.dumps([bool(x) for x in slots])}}}'
        )
    item = T.StructType([forms.schema[c] for c in (*_FIELDS, *extra)])
    entry = T.StructType([T.StructField("head", T.StringType()), T.StructField("forms", T.ArrayType(item))])
    kind = T.ArrayType(T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("by_word", T.BooleanType()),
        T.StructField("buckets", T.ArrayType(T.ArrayType(entry))), T.StructField("held", T.ArrayType(T.BooleanType())),
    ]))
    # Spark folds this to one constant; subqueries may not stand in array functions, and a joined column would be
    # copied into every row.
    return Dictionary(
        F.from_json(F.lit(f"[{', '.join(texts)}]"), kind), buckets, sorted({lang for lang, _ in tables}),
        sorted({by_word for _, by_word in tables}), [forms.schema[c] for c in extra],
        F.from_json(F.lit(f"[{', '.join(listed)}]"), T.ArrayType(item)), words, {x: Characters.of(c) for x, c in chars.items()},
    )


_WORD = re.compile(r"\w+")
_SPACED = re.compile(r"[\t-\r\x1c-\x20\x85\xa0\u2028\u2029\u202f\u205f\u3000]+")
_JOINED = str.maketrans(dict.fromkeys(p.HYPHENS, "-"))
#: The same, and every white space of a plain text as a space.
_EVEN = {**_JOINED, **{i: " " for i in range(0x3001) if _SPACED.fullmatch(chr(i))}}


def places(text: str, forms: dict[str, list[dict]], best: bool, chars: Characters | None = None) -> list[tuple[int, int, int]]:
    """(start, end, number) of the forms in a plain text, by place; with ``best`` those that do not overlap.

    Words are in Python's sense, which is that of the patterns over plain characters.
    """
    low = text.lower()
    sharp = "ß" in low
    out, by = [], {}
    for m in _WORD.finditer(low):
        head = m.group()
        for f in forms.get(head.replace("ß", "ss") if sharp else head, ()):
            start, end = m.span()
            for _ in range(f["n"] - 1):
                more = _WORD.search(low, end)
                end = more.end() if more else -1
                if not more:
                    break
            if end < 0:
                continue
            if f["n"] > 1 or f["exact"] is not None:
                gram = _SPACED.sub(" ", text[start:end]).translate(_JOINED)
                if gram.casefold() != f["key"] or f["exact"] not in (None, gram):
                    continue
            out.append((start, end, f["no"]))
            by[out[-1]] = (*f["by"][0], start, end, *f["by"][1])
    for start, end, f in _inside(text, chars) if chars else ():
        out.append((start, end, f["no"]))
        by[out[-1]] = (*f["by"][0], start, end, *f["by"][1])
    out.sort()
    return _disjoint(out, by) if best and any(a[1] > b[0] for a, b in zip(out, out[1:])) else out


_RUN = re.compile(r"  +")


def _inside(text: str, chars: Characters) -> Iterator[tuple[int, int, dict]]:
    """(start, end, form) of the forms that are no whole words, in a plain text, where all characters fold one by one."""
    even = text.translate(_EVEN)
    at = None
    if "  " in even:
        # Places of the text in which a run of white space counts as one.
        keep = np.ones(len(even) + 1, bool)
        for m in _RUN.finditer(even):
            keep[m.start() + 1 : m.end()] = False
        at, even = np.flatnonzero(keep).tolist(), _RUN.sub(" ", even)
    low = even.lower()
    word = lambda c: c.isalnum() or c == "_"
    for m in chars.heads.finditer(low):
        start = m.start()
        for n in chars.sizes[m.group(1)]:
            end = start + n
            for f in chars.forms.get(low[start:end], ()):
                if f["exact"] not in (None, even[start:end]):
                    continue
                if f["bounded"] and (word(low[start - 1 : start]) or word(low[end : end + 1])):
                    continue
                yield (start, end, f) if at is None else (at[start], at[end - 1] + 1, f)


def _disjoint(found: list[tuple[int, int, int]], by: dict[tuple, tuple]) -> list[tuple[int, int, int]]:
    """The choice of ``overlaps.chosen``: a match is taken unless one that ranks before it overlaps it."""
    taken: list[tuple[int, int, int]] = []
    for x in sorted(found, key=by.__getitem__):
        at = bisect(taken, x)
        if (at == 0 or taken[at - 1][1] <= x[0]) and (at == len(taken) or x[1] <= taken[at][0]):
            taken.insert(at, x)
    return taken


_PLACES = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "no")]))


def _placed(text: Column, lang: Column, dictionary: Dictionary, best: bool) -> Column:
    """Matches of plain texts, one Arrow batch at a time; none for null."""
    words, chars, none = dictionary.words, dictionary.chars, {}

    def of(texts: pa.Array, langs: pa.Array) -> pa.Array:
        rows = [
            places(t, words.get(x, none), best, chars.get(x)) if t is not None and (x in words or x in chars) else []
            for t, x in zip(texts.to_pylist(), langs.to_pylist())
        ]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.array([x for r in rows for x in r], np.int32).reshape(-1, 3)
        items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "end", "no"])
        return pa.ListArray.from_arrays(pa.array(ends), items)

    return F.arrow_udf(of, _PLACES)(text, lang)


def _as_matches(found: Column, dictionary: Dictionary) -> Column:
    """Places with the columns of their forms."""
    held = ("norm_len", "priority", "rank", "term_id", "form", "canonical", "is_alias", "policy", *[x.name for x in dictionary.extra])
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), *[F.get(dictionary.entries, m["no"])[c].alias(c) for c in held],
    ))


def _slot(head: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(head), F.lit(buckets)).cast("int")


def views_of(docs: DataFrame, text: str, dictionary: Dictionary, name: str) -> DataFrame:
    """Add the views of a text that are searched: itself if it is plain, else its two normalized forms."""
    body = F.col(text)
    other = F.when(~nz.is_plain(body, all(dictionary.kinds)), body)
    none = F.lit(None).cast("array<int>")
    plain = F.struct(F.lit("both").alias("mode"), body.alias("body"), none.alias("starts"), none.alias("ends"))
    folded, cased = f"{name}_f", f"{name}_c"
    d = docs.withColumn(folded, nz.align_folded(other)).withColumn(cased, nz.align_cased(other))
    aligned = lambda mode, c: F.struct(
        F.lit(mode).alias("mode"), F.col(f"{c}.text").alias("body"), F.col(f"{c}.starts").alias("starts"), F.col(f"{c}.ends").alias("ends"),
    )
    views = F.when(F.col(folded).isNull() | F.col(f"{folded}.text").isNull(), F.array(plain)).otherwise(
        F.array(aligned("folded", folded), aligned("cased", cased))
    )
    return d.withColumn(name, views).drop(folded, cased)


def _found(view: Column, table: Column, n_buckets: int, br: _Branch, extra: list[T.StructField]) -> Column:
    """All matches of one branch in one view, in the order of their places.

    First words are folded with the whole text and looked up by their bucket; the text is cut into units, and places
    are turned into characters, only for texts with a hit.
    """
    body, mode = view["body"], view["mode"]
    folded = mode == "folded"
    fold = lambda c: F.when(folded, c).otherwise(nz.plain_lower(c))
    lead = F.length(F.regexp_extract(body, f"^{br.lead}", 0))
    bare = lambda c: F.regexp_replace(c, f"(?<!{br.lead[:-2]}){br.tail}", "")
    word = lambda c: c.rlike(f"[{p.WORD}]\\z")
    heads = matching.heads_of(nz.plain_normalize(body) if br.checks_edges else body, mode, fold, br)
    units = F.regexp_extract_all(body, F.lit(br.unit), F.lit(0))

    def in_heads(hs: Column) -> Column:
        hits = F.filter(count_up(F.size(hs)), lambda i: F.get(table["held"], _slot(F.get(hs, i), n_buckets)))
        return let(hits, lambda at: F.when(F.size(at) > 0, let(units, lambda us: in_units(hs, at, us))))

    def in_units(hs: Column, at: Column, us: Column) -> Column:
        def gap(i: Column, k: Column) -> Column:
            prev = F.coalesce(F.get(at, k - 1), F.lit(0))
            return F.length(F.array_join(F.slice(us, prev + 1, i - prev), ""))

        def one(z: Column) -> Column:
            i, start = z["i"], z["start"]

            def forms_at(h: Column) -> Column:
                entries = F.filter(F.get(table["buckets"], _slot(h, n_buckets)), lambda e: e["head"] == h)
                return F.filter(F.flatten(F.transform(entries, lambda e: e["forms"])), lambda f: i + f["n_units"] <= F.size(us))

            def judged(f: Column) -> Column:
                raw = bare(F.array_join(F.slice(us, i + 1, f["n_units"]), ""))

                def spelled(g: Column) -> Column:
                    return (
                        F.when(folded, ~f["sensitive"])
                        .when(mode == "cased", f["sensitive"] & (g == f["norm"]))
                        .otherwise(~f["sensitive"] | (g == f["norm"]))
                    )

                def fit(r: Column) -> Column:
                    gram = F.when(nz.is_normal(r), r).otherwise(nz.plain_normalize(r))

                    def same(g: Column) -> Column:
                        ok = (fold(g) == f["key"]) & spelled(g)
                        if br.checks_edges:
                            tail = F.array_join(F.slice(us, i + 1, f["n_units"] + 1), "")
                            follow = F.substring(tail, F.length(r) + 1, F.lit(1))
                            prev = F.coalesce(F.when(i > 0, F.get(us, i - 1)), F.lit(""))
                            ok = ok & (~f["bounded"] | (~word(prev) & ~word(follow)))
                        return F.when(ok, F.length(r))

                    if br.checks_edges:
                        return let(gram, same)
                    # A form of one word is its own first word, which has been compared.
                    return F.when(f["n_units"] == 1, F.when(spelled(r), F.length(r))).otherwise(let(gram, same))

                return let(raw, fit)

            def match(f: Column) -> Column:
                def placed(n: Column) -> Column:
                    plain = mode == "both"
                    s = F.when(plain, start).otherwise(F.get(view["starts"], start.cast("int")))
                    e = F.when(plain, start + n).otherwise(F.get(view["ends"], (start + n - 1).cast("int")))
                    return F.when(n.isNotNull(), F.struct(
                        s.cast("int").alias("start"), e.cast("int").alias("end"), f["norm_len"].alias("norm_len"),
                        f["priority"].alias("priority"), f["rank"].alias("rank"), f["term_id"].alias("term_id"),
                        f["form"].alias("form"), f["canonical"].alias("canonical"), f["is_alias"].alias("is_alias"),
                        f["policy"].alias("policy"), *[f[x.name].alias(x.name) for x in extra],
                    ))

                return let(judged(f), placed)

            return F.array_compact(F.transform(let(F.get(hs, i), forms_at), match))

        def placed(starts: Column) -> Column:
            return F.flatten(F.transform(F.arrays_zip(at.alias("i"), starts.alias("start")), one))

        # What stands before the first unit counts as the length before the first hit.
        gaps = F.transform(at, lambda i, k: gap(i, k) + F.when(k == 0, lead).otherwise(F.lit(0)))
        return let(prefix_sums(gaps), placed)

    return let(heads, in_heads)


def found(lang: Column, views: Column, dictionary: Dictionary) -> Column:
    """All matches of the row, overlaps included, ordered by start and end."""

    def searched(tables: Column) -> Column:
        def of(t: Column, v: Column) -> Column:
            one = lambda br: _found(v, t, dictionary.buckets, br, dictionary.extra)
            if len(dictionary.kinds) == 1:
                return one(_WORDS if dictionary.kinds[0] else _CHARS)
            return F.when(t["by_word"], one(_WORDS)).otherwise(one(_CHARS))

        every = F.flatten(F.array_compact(F.flatten(F.transform(tables, lambda t: F.transform(views, lambda v: of(t, v))))))
        if all(dictionary.kinds):
            return every
        # Only aligned texts can yield one original span twice, when a character folds to several.
        return F.when(F.size(views) > 1, F.array_distinct(every)).otherwise(every)

    tables = F.when(lang.isin(dictionary.langs), F.filter(dictionary.tables, lambda t: t["lang"] == lang))
    return F.sort_array(F.coalesce(let(tables, searched), _none(dictionary)))


def match_type(dictionary: Dictionary) -> T.ArrayType:
    kinds = {"start": "int", "end": "int", "norm_len": "int", "priority": "int", "rank": "long", "term_id": "string", "form": "string",
             "canonical": "string", "is_alias": "boolean", "policy": "string"}
    fields = T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in kinds.items())).fields
    return T.ArrayType(T.StructType([*fields, *dictionary.extra]))


def _none(dictionary: Dictionary) -> Column:
    return F.array().cast(match_type(dictionary))


def with_matches(docs: DataFrame, text: str, lang: str, dictionary: Dictionary, name: str, best: bool = True) -> DataFrame:
    """Add the matches of each row under ``name``; with ``best`` only those that do not overlap."""
    # Sharp s folds to two letters, which moves the characters behind it, but not their words.
    plain = nz.is_plain(F.col(text), True)
    if dictionary.chars:
        plain = F.when(F.col(lang).isin(list(dictionary.chars)), nz.is_plain(F.col(text))).otherwise(plain)
    plain = F.coalesce(plain, F.lit(False))
    d = docs.withColumn("__places", _placed(F.when(plain, F.col(text)), F.col(lang), dictionary, best))
    # Plain texts are null to the array functions, and have no views.
    d = views_of(d.withColumn("__odd", F.when(~plain, F.col(text))), "__odd", dictionary, "__views")
    every = found(F.col(lang), F.col("__views"), dictionary)
    odd = F.col("__odd").isNotNull()
    ms = F.when(odd, chosen(every) if best else every).otherwise(_as_matches(F.col("__places"), dictionary))
    # Generators keep Spark from copying the search into every expression that reads it.
    return d.select("*", F.explode(F.array(ms)).alias(name)).drop("__views", "__odd", "__places")


def best_terms(docs: DataFrame, keys: list[str], text: str, lang: str, forms: DataFrame) -> DataFrame:
    """The matches of ``matching.best_matches``, found in the rows where the dictionary fits beside them."""
    if not fits(forms):
        return matching.best_matches(matching.find_terms(docs, keys, text, lang, forms), keys)
    return _listed(docs, keys, text, lang, forms, True)


def all_terms(docs: DataFrame, keys: list[str], text: str, lang: str, forms: DataFrame) -> DataFrame:
    """The matches of ``matching.find_terms``, found in the rows where the dictionary fits beside them."""
    return _listed(docs, keys, text, lang, forms, False) if fits(forms) else matching.find_terms(docs, keys, text, lang, forms)


def _listed(docs: DataFrame, keys: list[str], text: str, lang: str, forms: DataFrame, best: bool) -> DataFrame:
    """The matches in the rows, one row each."""
    d = with_matches(docs, text, lang, compiled(forms), "__ms", best)
    m = d.select(*keys, F.col(lang).alias("lang"), F.explode("__ms").alias("m"))
    held = ("term_id", "form", "canonical", "is_alias", "policy", "priority", "rank", "norm_len", "start", "end")
    return m.select(*keys, "lang", *[f"m.{c}" for c in held])
