"""Operator 6: benchmark decontamination with a generalised suffix automaton of the test items.

The automaton reads the words of all items.  Training words are streamed through it and the longest
match that ends at each word is tracked; where it reaches the length of a window, the window's words
are hit.  A word that no item holds resets the automaton, and so does a pair of words that no item
holds side by side, hence stretches without such runs are skipped whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_pass, flags, fresh, share, shared, table, utf8, words

#: Item bytes held by one automaton; larger benchmarks are read in blocks of this size.
BLOCK_BYTES = 4 << 20
_WORD_AT = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass
class Automaton:
    """Suffix automaton over word numbers; state 0 is the root."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    items: list[set[int]] = field(default_factory=lambda: [set()])
    #: Items shorter than a window, at the state of their whole text.
    short: dict[int, list[int]] = field(default_factory=dict)
    shortest: int = 1 << 30
    pairs: np.ndarray | None = None

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.step) - 1

    def _grow(self, last: int, word: int) -> int:
        """The state of the item read so far with one word more."""
        there = self.step[last].get(word)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        new = None if there is not None else self._state(self.length[last] + 1, {}, 0)
        at = last
        while new is not None and at != -1 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at == -1:
            return new
        target = self.step[at][word]
        if self.length[target] != self.length[at] + 1:
            copy = self._state(self.length[at] + 1, dict(self.step[target]), self.link[target])
            self.link[target] = copy
            while at != -1 and self.step[at].get(word) == target:
                self.step[at][word] = copy
                at = self.link[at]
            target = copy
        if new is None:
            return target
        self.link[new] = target
        return new

    def read(self, items: list[list[bytes]]) -> None:
        """Take in all items, mark their ends, hand items of longer matches down the links, list neighbours."""
        numbered = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item] for item in items]
        for item in numbered:
            last = 0
            for word in item:
                last = self._grow(last, word)
        for number, item in enumerate(numbered):
            if not item:
                continue
            self.shortest = min(self.shortest, len(item), self.window)
            at = 0
            for place, word in enumerate(item, 1):
                at = self.step[at][word]
                if place >= self.window:
                    self.items[at].add(number)
            if len(item) < self.window:
                self.short.setdefault(at, []).append(number)
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            above = self.link[state]
            if above > 0 and self.length[above] >= self.window:
                self.items[above] |= self.items[state]
        n = len(self.vocabulary)
        self.pairs = np.array(sorted({a * n + b for item in numbered for a, b in zip(item, item[1:])}), np.int64)

    def spans(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of word places (end exclusive, in order, merged) and the numbers of the items."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in text), np.int64, len(text))
        return self._runs(ids)

    def _runs(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        known = ids >= 0
        if int(known.sum()) < self.shortest:
            return [], set()
        if self.shortest > 1:
            code = ids[:-1] * len(self.vocabulary) + ids[1:]
            place = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
            joined = known[:-1] & known[1:] & (self.pairs[place] == code if len(self.pairs) else False)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
            bounds = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b + 1 - a >= self.shortest]
        else:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
            bounds = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in bounds:
            self._scan(ids[a:b].tolist(), a, found, items)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def _scan(self, run: list[int], offset: int, found: list, items: set) -> None:
        step, length, link, window = self.step, self.length, self.link, self.window
        state = matched = 0
        for place, word in enumerate(run, offset + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items |= self.items[at]
                if found and found[-1][1] >= place - window and found[-1][0] <= place - window:
                    found[-1] = (found[-1][0], place)
                else:
                    found.append((place - window, place))
            if self.short:
                at = state if length[state] <= matched else link[state]
                while at > 0:
                    if at in self.short:
                        items.update(self.short[at])
                        found.append((place - length[at], place))
                    at = link[at]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, each read by itself."""
    sized = items.select(F.col(id_col).cast("string").alias("id"), utf8(text_col).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total) * 2 // block_bytes))
    for k in range(parts):
        part = sized if parts == 1 else sized.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        yield [(r["id"], bytes(r["text"])) for r in part.where("text is not null").collect()]


def _automata(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[tuple[Automaton, list]]:
    for block in _blocks(items, id_col, text_col, block_bytes):
        split = [words(t) for _, t in block]
        automaton = Automaton(window)
        automaton.read(split)
        yield automaton, [i for i, _ in block]


def matches(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row, id, n_words, spans, items) for every row of ``docs``.

    ``spans`` are the hit places of words, ``items`` the ids of the items found, null ids as 'null'.
    A text or item that is null or holds no word hits nothing; repeated items are found together;
    without items nothing is hit.  A benchmark beyond ``block_bytes`` is read in blocks, with a pass over
    the documents for each, whose spans are united by row.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    schema = f"row long, id {kind}, n_words long, spans array<struct<a:int,b:int>>, items array<string>"
    parts = []
    automata = _automata(items, item_id, item_text, window, block_bytes)
    first = [next(automata)]
    second = list(islice(automata, 1))
    if second:
        # Several passes are united by the row number, so rows are numbered once and stored.
        texts = Scratch(docs.sparkSession, "decontamination").put(texts)
    for automaton, ids in chain(first, second, automata):
        held = share(docs.sparkSession, (automaton, ["null" if i is None else i for i in ids]))
        parts.append(arrow_pass(texts, lambda batches, held=held: _find(batches, held), schema))
    if len(parts) == 1:
        return parts[0].withColumnRenamed("id", id_col)
    united = parts[0]
    for p in parts[1:]:
        united = united.union(p)
    return united.groupBy("row").agg(
        F.first("id").alias(id_col), F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def _find(batches: Iterator[pa.RecordBatch], held) -> Iterator[dict]:
    automaton, ids = shared(held)
    for batch in batches:
        counts, spans, items = [], [], []
        for text in batch.column(2).to_pylist():
            split = words(text)
            got, numbers = automaton.spans(split) if automaton.shortest <= len(split) else ([], set())
            counts.append(len(split))
            spans.append([{"a": a, "b": b} for a, b in got])
            items.append(sorted({ids[n] for n in numbers}))
        yield {"row": batch.column(0), "id": batch.column(1), "n_words": counts, "spans": spans, "items": items}


def _packed(spans: list[tuple[int, int]], before: bytes | None) -> bytes | None:
    """Spans of a block, behind those of the blocks before it."""
    return (before or b"") + np.array(spans, np.int64).tobytes() if spans else before


def _united(spans: list[tuple[int, int]], before: bytes | None) -> list[tuple[int, int]]:
    """Spans of all blocks in order, merged where they overlap or touch."""
    if before is None:
        return spans
    merged: list[tuple[int, int]] = []
    for a, b in sorted([*spans, *map(tuple, np.frombuffer(before, np.int64).reshape(-1, 2).tolist())]):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD_AT.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.2, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the spans that match a window, and without documents hit beyond ``max_coverage``.

    Rows keep all their columns; rows without a hit, null and empty texts included, come back unchanged.
    Each block of a large benchmark reads the whole text and hands its spans on; the last one judges
    coverage and cuts by the spans of all blocks.
    """
    columns, spans = docs.columns, fresh(docs, "spans")
    out = docs
    at = columns.index(text_col)
    held = [share(docs.sparkSession, (automaton, None)) for automaton, _ in _automata(items, item_id, item_text, window, block_bytes)]
    handed = T.StructType([*docs.schema.fields, T.StructField(spans, T.BinaryType())])
    for k, block in enumerate(held):

        def run(batches: Iterator[pa.RecordBatch], block=block, first=not k, last=k == len(held) - 1) -> Iterator[pa.RecordBatch]:
            automaton = shared(block)[0]
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                before = [None] * len(texts) if first else batch.column(len(columns)).to_pylist()
                keep = np.ones(len(texts), bool)
                for k, text in enumerate(texts):
                    split = words(text)
                    found = automaton.spans(split)[0] if automaton.shortest <= len(split) else []
                    if not last:
                        before[k] = _packed(found, before[k])
                        continue
                    found = _united(found, before[k])
                    if found:
                        keep[k] = sum(b - a for a, b in found) <= max_coverage * len(split)
                        texts[k] = without_spans(text, found)
                if last:
                    column = pa.array(texts, pa.binary()).cast(batch.column(at).type)
                    yield flags(batch.set_column(at, columns[at], column), keep, columns)
                else:
                    held_columns = [batch.column(c) for c in range(len(columns))]
                    yield pa.RecordBatch.from_arrays([*held_columns, pa.array(before, pa.binary())], names=[*columns, spans])

        out = out.mapInArrow(run, docs.schema if k == len(held) - 1 else handed)
    return out


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of ten words of ``benchmark`` in every whole text of ``documents``."""
    found = matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    # Spans of several blocks may overlap: count words by running maximum of their ends.
    hit = F.expr(
        "aggregate(array_sort(spans), struct(0 as n, 0 as e),"
        " (s, x) -> struct(cast(s.n + greatest(0, x.b - greatest(x.a, s.e)) as int) as n, greatest(s.e, x.b) as e), s -> cast(s.n as bigint))"
    )
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)
