"""Operator 13: URL rules as a bit-parallel wildcard automaton over canonical URLs.

Every rule is a glob.  The positions of all globs are packed, one behind the other, into the bits of
machine words; one step of the automaton reads a byte of the URL and moves all globs at once:

    state = (state << 1) & ENTER[byte]  |  state & STAY[byte]

``ENTER[byte]`` holds the positions that accept the byte, ``STAY[byte]`` those behind a wildcard that may
swallow it.  Words of a whole batch of URLs move together, so a step is a handful of numpy operations.

A canonical URL is ``.host``, the byte FF (which no text holds) and the path; the dot in front lets a rule
``.org`` fit the host itself and its subdomains alike.  Nothing is shuffled: rules travel to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, share, shared, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_WORDS = 1024
STATE_BYTES = 16 << 20
LONG_URL = 4096
END = 0xFF


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start with ``path``.

    ``*`` stands for any run of characters (in a host: up to its end), ``?`` for one; the path ends in ``*``.
    """

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
BASE = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)
#: What the method judges where none of them fits: hosts and files that carry no prose.
JUNK = tuple(
    [Rule("block", h, "") for h in ("*casino*", "*poker*", "*pills*", "*viagra*", "*-bets*", "ads.*", "ads-*")]
    + [Rule("block", "*", p) for p in ("*/wp-login", "*/cart/", "*/login/", "*.zip", "*.exe", "*.jpg", "*.png", "*.css", "*.js")]
)


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """All globs of one block: ``ENTER`` and ``STAY`` by byte, the final bits of each group of rules."""

    def __init__(self, rules: list[tuple[int, int, Rule]]) -> None:
        """``rules``: (number, group, rule) in the order in which they win."""
        enter: list[list[int]] = [[] for _ in range(256)]
        stay: list[list[int]] = [[] for _ in range(256)]
        every, in_host = range(256), range(END)
        start, final, owner, at = [], ([], []), {}, 0

        def loop(bit: int, over) -> None:
            for b in over:
                stay[b].append(bit)

        for number, group, rule in rules:
            start.append(at)
            # A host rule fits behind any dot of the host.
            loop(at, in_host)
            at += 1
            host = "." + rule.host.translate(str.maketrans(UPPER, LOWER))
            for ch, over in [*((c, in_host) for c in host), (None, every), *((c, every) for c in rule.path)]:
                if ch is None:
                    enter[END].append(at)
                    at += 1
                elif ch == "*":
                    loop(at - 1, over)
                elif ch == "?":
                    for b in over:
                        if not 0x80 <= b < 0xC0:
                            enter[b].append(at)
                    loop(at, range(0x80, 0xC0))
                    at += 1
                else:
                    for b in ch.encode():
                        enter[b].append(at)
                        at += 1
            loop(at - 1, every)
            final[group].append(at - 1)
            owner[at - 1] = number
        self.words = -(-at // 64)
        self.owner = np.full(self.words * 64, -1, np.int64)
        self.owner[list(owner)] = list(owner.values())
        self.enter = np.array([self._packed(bits) for bits in enter])
        self.stay = np.array([self._packed(bits) for bits in stay])
        self.start, self.final = self._packed(start), [self._packed(bits) for bits in final]

    def _packed(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for bit in bits:
            out[bit >> 6] |= np.uint64(1 << (bit & 63))
        return out

    def states(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The words of each URL after its last byte; URLs are given longest first."""
        state = np.tile(self.start, (len(size), 1))
        one, top = np.uint64(1), np.uint64(63)
        # Number of URLs with more than t bytes, for every t.
        active = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")
        for t, k in enumerate(active):
            byte = data[first[:k] + t]
            now = state[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.enter[byte]
            now &= self.stay[byte]
            now |= moved
        return state

    def state_of_long(self, url: bytes) -> np.ndarray:
        """The same for one long URL, all words as one integer."""
        if not hasattr(self, "wide"):
            self.wide = [[int.from_bytes(row.tobytes(), "little") for row in side] for side in (self.enter, self.stay)]
        enter, stay = self.wide
        state = int.from_bytes(self.start.tobytes(), "little")
        for b in url:
            state = (state << 1) & enter[b] | state & stay[b]
        return np.frombuffer(state.to_bytes(self.words * 8, "little"), np.uint64)

    def winners(self, state: np.ndarray, group: int) -> np.ndarray:
        """The first rule of a group that fits each URL, or -1: the lowest final bit that is set."""
        hit = state & self.final[group]
        word = (hit != 0).argmax(axis=1)
        value = hit[np.arange(len(hit)), word]
        bit = np.log2((value & (~value + np.uint64(1))).astype(np.float64), where=value != 0, out=np.zeros(len(value)))
        return np.where(value != 0, self.owner[word * 64 + bit.astype(np.int64)], -1)


class Matcher:
    """Both groups of rules, in blocks of words that keep the tables small whatever the number of rules."""

    def __init__(self, rules: list[Rule], others: list[Rule]) -> None:
        every = [(0, r) for r in rules] + [(1, r) for r in others]
        # Longest first; of two as long, block wins, then the smaller text.
        every.sort(key=lambda x: (-len(x[1].text), x[1].verdict != "block", x[1].text))
        self.rules = [r for _, r in every]
        self.blocks, block, bits = [], [], 0
        for number, (group, rule) in enumerate(every):
            need = len(rule.text.encode()) + 3
            if block and bits + need > BLOCK_WORDS * 64:
                self.blocks.append(block)
                block, bits = [], 0
            block.append((number, group, rule))
            bits += need
        if block:
            self.blocks.append(block)

    def winners(self, urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of the winning rule of each group for each canonical URL, -1 where none fits."""
        if not hasattr(self, "automata"):
            self.automata = [Automaton(b) for b in self.blocks]
        urls = urls.cast(pa.large_binary())
        offsets = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset:urls.offset + len(urls) + 1] if len(urls) else np.zeros(1, np.int64)
        raw = urls.buffers()[2] if len(urls) else None
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        best = np.full((2, len(urls)), len(self.rules), np.int64)
        for automaton in self.automata:
            step = max(1, STATE_BYTES // (automaton.words * 8))
            order = np.argsort(-size, kind="stable")
            n_long = int((size > LONG_URL).sum())
            groups = [order[i:i + 1] for i in range(n_long)] + [order[i:i + step] for i in range(n_long, len(order), step)]
            for place, rows in enumerate(groups):
                if place < n_long:
                    at = rows[0]
                    state = automaton.state_of_long(data[offsets[at]:offsets[at + 1]].tobytes())[None, :]
                else:
                    state = automaton.states(data, offsets[rows], size[rows])
                for group in (0, 1):
                    won = automaton.winners(state, group)
                    best[group, rows] = np.minimum(best[group, rows], np.where(won < 0, len(self.rules), won))
        best[best == len(self.rules)] = -1
        return best[0], best[1]


def url_verdicts(
    pages: DataFrame, keep: list[str], rules: list[Rule] | tuple = BASE, others: list[Rule] | tuple = JUNK,
    default: str = "allow", url_col: str = "url",
) -> DataFrame:
    """The columns ``keep`` and ``host``, ``path``, ``rule``, ``verdict``, ``pattern``.

    The longest of ``rules`` that fits gives ``rule`` and the verdict; of equally long ones block wins, then
    the smaller text.  Where none fits, the longest of ``others`` gives ``pattern`` and the verdict, else
    ``default``.  Null URLs and those without ``://`` have an empty host and path, which a rule may fit only by
    wildcards.  URLs are read whole whatever their length; rows that repeat are judged alike; an empty table
    gives no rows.  A column in ``keep`` that is named like a new one comes back with ``_`` in front.
    """
    new = ["host", "path", "rule", "verdict", "pattern"]
    kept, seen = [], list(new)
    for c in keep:
        name = c
        while name in seen:
            name = f"_{name}"
        seen.append(name)
        kept.append(F.col(f"`{c}`").alias(name))
    d = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    url = fresh(d, "url")
    end = F.lit(bytes([END]))
    d = d.withColumn(url, F.concat(F.lit(b"."), F.col("host").cast("binary"), end, F.col("path").cast("binary")))
    out = T.StructType(d.schema.fields[:-1] + [T.StructField(c, T.StringType()) for c in ("rule", "verdict", "pattern")])
    arrow = to_arrow_schema(out)
    packed = share(pages.sparkSession, Matcher(list(rules), list(others)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared(packed)
        texts = [r.text for r in matcher.rules] + [None]
        verdicts = [r.verdict for r in matcher.rules] + [default]
        for batch in batches:
            first, second = matcher.winners(batch.column(batch.num_columns - 1))
            second = np.where(first >= 0, -1, second)
            won = np.where(first >= 0, first, second)
            columns = [
                pa.array([t[i] for i in at], pa.string()) for t, at in ((texts, first), (verdicts, won), (texts, second))
            ]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*batch.columns[:-1], *columns], arrow)], schema=arrow
            )

    return d.mapInArrow(judged, out)


def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every URL of ``pages``; ``pattern`` is the method's own rule where it decides."""
    return url_verdicts(table(spark, sf, "pages"), ["page_id"])
