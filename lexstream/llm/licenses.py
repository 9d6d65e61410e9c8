"""Operator 5: license scans as an exact set-similarity join of templates and text blocks.

Tokens are ordered by their frequency over the whole corpus, rare ones first.  A template whose block
must hold ``o`` of its ``n`` tokens is indexed under its first ``n - o + 1`` tokens; the length filter
asks for ``o`` template tokens in the block, the positional filter for ``o`` matches still possible from
the first shared token on; what remains is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, table, utf8, words

#: Phrases that must stand word by word, with their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Notices found by containment.
NOTICES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
)
#: Words of a block, and the step from one to the next: every passage of 33 words lies within a block.
BLOCK, STEP = 64, 32


@dataclass
class Template:
    label: str
    phrase: list[bytes]
    consecutive: bool
    need: int
    tokens: list[bytes]
    members: frozenset[bytes]


def _templates(share: float, frequency: dict[bytes, int]) -> tuple[list[Template], dict[bytes, list[tuple[int, int]]]]:
    """Templates with tokens in global order, and the index of their prefixes."""
    out, index = [], {}
    for label, text, consecutive in [(*p, True) for p in PHRASES] + [(*n, False) for n in NOTICES]:
        phrase = words(text.encode())
        tokens = sorted(set(phrase), key=lambda w: (frequency.get(w, 0), w))
        need = len(tokens) if consecutive else -(-len(tokens) * int(share * 100) // 100)
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            index.setdefault(token, []).append((len(out), place))
        out.append(Template(label, phrase, consecutive, need, tokens, frozenset(tokens)))
    return out, index


def scan(text: list[bytes], templates: list[Template], index: dict, known: dict[bytes, int]) -> tuple[list, list]:
    """Places (label, start) of phrases and blocks (label, start, end, containment) of notices."""
    heads = [k for k, w in enumerate(text) if w in index]
    if not heads:
        return [], []
    last = max(0, -(-(len(text) - BLOCK) // STEP)) * STEP
    starts = sorted({s for k in heads for s in (k // STEP * STEP, k // STEP * STEP - STEP) if 0 <= s <= last} | {last for k in heads if k >= last})
    places, blocks = set(), []
    for start in starts:
        block = text[start : start + BLOCK]
        held = set(block) & known.keys()
        ranks = sorted(known[w] for w in held)
        first: dict[int, int] = {}
        for w in held:
            for number, place in index.get(w, ()):
                first[number] = min(place, first.get(number, place))
        for number, place in sorted(first.items()):
            t = templates[number]
            if len(held) < t.need or len(t.tokens) - place < t.need:
                continue
            at = known[t.tokens[place]]
            if sum(r >= at for r in ranks) < t.need:
                continue
            shared = len(t.members & held)
            if shared < t.need:
                continue
            if t.consecutive:
                n = len(t.phrase)
                places.update((t.label, start + k) for k in range(len(block) - n + 1) if block[k : k + n] == t.phrase)
            else:
                blocks.append((t.label, start, start + len(block), shared / len(t.tokens)))
    return sorted(places, key=lambda p: (p[1], p[0])), blocks


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8) -> DataFrame:
    """(id, n_words, places, blocks) for every row of ``docs``.

    ``places`` are the phrases, word by word; ``blocks`` the blocks of 64 words, one from every 32nd
    word on, that hold at least ``share`` of the distinct words of a notice.  Null and empty texts have
    no words and no findings; repeated rows give theirs each.  The first pass counts in how many rows
    each template word stands, over all rows; these counts, one for each template word, are all that is
    collected.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    vocabulary = frozenset(w for _, t in PHRASES + NOTICES for w in words(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(vocabulary.intersection(words(text)))
        yield {"token": list(n), "n": list(n.values())}

    counts = arrow_pass(texts.select("text"), count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["token"]): r["n"] for r in counts.collect()}
    known = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    templates, index = _templates(share, frequency)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n, places, blocks = [], [], []
            for text in batch.column(1).to_pylist():
                split = words(text)
                p, b = scan(split, templates, index, known)
                n.append(len(split))
                places.append([{"label": x, "start": s} for x, s in p])
                blocks.append([dict(zip(("label", "start", "stop", "share"), x)) for x in b])
            yield {"id": batch.column(0), "n_words": n, "places": places, "blocks": blocks}

    schema = (
        f"id {kind}, n_words long, places array<struct<label:string,start:long>>,"
        " blocks array<struct<label:string,start:long,stop:long,share:double>>"
    )
    return arrow_pass(texts, step, schema).withColumnRenamed("id", id_col)


def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licenses in every whole text of ``documents``."""
    found = license_blocks(table(spark, sf, "documents"))
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        joined(names("places")).alias("base_labels"), joined(F.concat(names("places"), names("blocks"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
