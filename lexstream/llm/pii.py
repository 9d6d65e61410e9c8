"""Operator 1: personal data by bootstrapped contextual extraction.

Seeds are what fixed formats find.  Each seed, each other token with a digit or an at sign, and each
run of digit groups that spreads over tokens is a mention with induced patterns: one to three words before it, one
or two after it, with a free place among them or with the shape of the mention.  Patterns and instances (the
normalized tokens) form a graph that Spark scores in rounds: a pattern is as good as the share of its instances that
are known, an instance as good as its patterns together make it.  Instances that good patterns carry
are unseen identifiers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_pass, table

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "+")
#: Longer words stand in patterns by their hash, longer instances have no shape of their own.
LONG_WORD = 40
#: Groups of digits, as phones and cards are written.
_RUN = re.compile(r"(?<![0-9])\+?[0-9]++(?:[ ().-]++[0-9]++)+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An at sign with local characters right before it, since the last match, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the seeds, in that order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between white space that hold a digit or an at sign, without punctuation at their ends."""
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        raw = text[start:end]
        left = start + len(raw) - len(raw.lstrip(_EDGE))
        right = left + len(raw.strip(_EDGE))
        if right > left:
            yield left, right
        m = _MARK.search(text, end)


def _words(tokens: list[str]) -> list[str]:
    """Tokens without the punctuation at their ends, lower-cased; a very long one by its hash."""
    out = [t.strip(_EDGE).lower() for t in tokens]
    return [w if len(w) <= LONG_WORD else f"#{_name(w)}" for w in out if w]


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The three whole words before a place and the two after it, however long they or the gaps are."""
    width, before = 64, []
    while True:
        at = max(0, start - width)
        # A word that the piece cuts is left out; a wider piece holds it whole.
        tokens = text[at:start].split()[(at > 0 and not text[at - 1].isspace()):]
        before = _words(tokens)[-3:]
        if len(before) == 3 or at == 0:
            break
        width *= 4
    width = 64
    while True:
        piece = text[end:end + width]
        tokens = piece.split()
        whole = end + width >= len(text) or text[end + width].isspace()
        after = _words(tokens if whole else tokens[:-1])[:2]
        if len(after) == 2 or end + width >= len(text):
            return before, after
        width *= 4


_DIGIT, _LETTERS, _JOINTS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+"), re.compile(r"[ ().-]+")


def _shape(instance: str) -> str:
    """Digit groups by their lengths, letters as one, joints alike."""
    if len(instance) > LONG_WORD:
        return "long"
    return _JOINTS.sub("-", _LETTERS.sub("a", _DIGIT.sub("9", instance)))


def _around(text: str, start: int, end: int) -> list[str]:
    """Patterns of a place: words on either side, with one of them free, and with the shape of what stands there.

    The first letter is the template, a capital one for three families: words before (A, B), words behind or on both
    sides (C, D), and the form with a word (E, F, G).
    """
    before, after = _near(text, start, end)
    shape = _shape(text[start:end])
    out = []
    if len(before) == 3:
        out.append(f"A{before[0]} {before[1]} {before[2]} _")
    if len(before) >= 2:
        out += [f"B{before[-2]} {before[-1]} _", f"E{before[-2]} * _ {shape}"]
    if before:
        out.append(f"F{before[-1]} _ {shape}")
        if after:
            out.append(f"C{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"D_ {after[0]} {after[1]}")
    if after:
        out.append(f"G_ {shape} {after[0]}")
    return out


def mentions_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, list[str]]]]:
    """Seeds, and the mentions (start, end, kind or -1, instance, patterns) of a text."""
    if not text or not _MARK.search(text):
        return [], []
    seeds = base_spans(text)
    found = [(a, b, kind, text[a:b].lower(), _around(text, a, b)) for a, kind, b in seeds]
    taken = sorted((a, b) for a, _, b in seeds)
    runs = list(_runs(text, taken))
    k, reach, j = 0, 0, 0
    for a, b in _tokens(text):
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        while j < len(runs) and runs[j][1] <= a:
            j += 1
        # Tokens of a run are spoken for by the run.
        if a >= reach and not (j < len(runs) and runs[j][0] < b):
            found.append((a, b, -1, text[a:b].lower(), _around(text, a, b)))
    found += [(a, b, -1, text[a:b].lower(), _around(text, a, b)) for a, b in runs]
    return seeds, found


def _runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs of digit groups between the seeds that hold a blank; others are within one token."""
    at = 0
    for start, end in [*taken, (len(text), len(text))]:
        for m in _RUN.finditer(text, at, max(at, start)):
            if " " in m[0]:
                yield m.span()
        at = max(at, end)


def _name(instance: str) -> int:
    """64-bit hash of a whole instance."""
    return int.from_bytes(hashlib.blake2b(instance.encode(), digest_size=8).digest(), "little", signed=True)


def _score(edges: DataFrame, scratch: Scratch, rounds: int, support: float, trust: float) -> DataFrame:
    """(instance, kind) that good patterns carry, beyond the seeds.

    Hot patterns and instances are summed before they are shuffled; joins split skewed keys.
    """
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct()
    graph = scratch.put(edges.select("pattern", "template", "instance").distinct())
    # How many contexts of a template an instance has.
    contexts = scratch.put(graph.groupBy("instance", "template").agg(F.count("*").alias("contexts")))
    family = F.when(F.col("template") < "C", 0).when(F.col("template") < "E", 1).otherwise(2)
    totals = scratch.put(graph.groupBy("pattern").agg(F.count("*").alias("n")))
    known = scratch.put(seeds.withColumn("score", F.lit(1.0)))
    base = known
    for _ in range(rounds):
        good = graph.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        good = good.where(F.col("s") >= support).join(totals, "pattern")
        good = good.withColumn("p", F.col("s") / F.col("n")).where(F.col("p") >= 0.5)
        # An instance is as good as its contexts are on average, so one that stands everywhere is not made good by a few.
        # Templates of one family tell the same; the best of each family counts, and families together.
        carried = graph.join(good.select("pattern", "kind", "p"), "pattern").groupBy("instance", "kind", "template").agg(F.sum("p").alias("p"))
        carried = carried.join(contexts, ["instance", "template"]).withColumn("p", F.col("p") / F.col("contexts"))
        carried = carried.groupBy("instance", "kind", family.alias("family")).agg(F.max("p").alias("p"))
        carried = carried.groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("score")
        )
        new = carried.join(base.select("instance"), "instance", "left_anti")
        now = scratch.put(base.unionByName(new))
        if known is not base:
            scratch.drop(known)
        known = now
    best = known.where(F.col("score") >= trust).join(base.select("instance"), "instance", "left_anti")
    return best.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select(
        "instance", (-F.col("b.k")).alias("kind")
    )


def extract_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: float = 3.0, trust: float = 0.9,
) -> DataFrame:
    """(row, id, base, spans) for every row: arrays of (start, kind, end) in code points, end exclusive.

    ``base`` holds the seeds, ``spans`` the seeds and what the patterns discover: instances whose score
    reaches ``trust``, carried by patterns of at least ``support`` known instances.  Null and empty
    texts have no spans; repeated rows give their spans each; an instance that two kinds claim alike
    takes the kind listed first.  A token that meets a run of digit groups is not listed by itself.  Without
    seeds nothing is discovered.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    kind = dict(docs.dtypes)[id_col]
    span = "array<struct<start:int,kind:int,end:int>>"
    mention = "array<struct<start:int,end:int,kind:int,instance:long,patterns:array<string>>>"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(2).to_pylist():
                seeds, mentions = mentions_of(text or "")
                base.append([dict(zip(("start", "kind", "end"), s)) for s in seeds])
                found.append([
                    {"start": a, "end": b, "kind": kind, "instance": _name(instance), "patterns": patterns}
                    for a, b, kind, instance, patterns in mentions
                ])
            yield {"row": batch.column(0), "id": batch.column(1), "base": base, "mentions": found}

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    read = scratch.put(arrow_pass(texts, step, f"row long, id {kind}, base {span}, mentions {mention}"))
    each = read.where("size(mentions) > 0").select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = each.select("instance", "kind", F.explode("patterns").alias("pattern")).withColumns(
        {"template": F.left("pattern", F.lit(1)), "pattern": F.xxhash64("pattern")}
    )
    unseen = _score(edges, scratch, rounds, support, trust)
    new = each.where("kind < 0").drop("kind").join(unseen, "instance").groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("new")
    )
    out = read.select("row", "id", "base").join(new, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(span))))
    return out.select("row", F.col("id").alias(id_col), "base", spans.alias("spans"))


def _listed(column: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = extract_pii(table(spark, sf, "documents"))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans")
    )
