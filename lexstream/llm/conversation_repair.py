"""Operator 11: conversation structure repair by a Viterbi search whose survivors coalesce.

Roles of a repaired conversation read ``(s?(ua)+)?``.  Keeping, re-roling, deleting and inserting turns
moves an automaton of four states, and the cheapest edits are the shortest path through it.  Each row
extends the survivor of every state by one node of a backpointer tree with reference counts.  A survivor
that loses drops its references, and as soon as all survivors descend from one child of the root, that
child's edits are final and leave the tree: what is held is only the stretch on which survivors still
differ.  Of equally cheap paths the one with the ASCII-least edits wins, so ties compare these stretches whole.

Rows are dealt by conversation and sorted; a conversation with more rows than a part may have is cut into
parts.  A first pass sums up a part of such a conversation as the cheapest cost between every two states, a
product that the parts of one conversation combine to the states at their borders; a second pass
then repairs all parts apart.  Repeats are found beforehand, by grouped minima.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import PART, Layout, layout
from .common import share, shared, table

BLANK = " \t\n\x0b\x0c\r"
PART_ROWS = 1 << 16
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, UNCUT = 0, 2, 3, 2, 1
#: Inserts that end a conversation, by state.
ENDING = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}


class Node:
    """Edits of one row (``label``), the node before, and how many nodes and survivors refer to it."""

    __slots__ = ("parent", "label", "refs")

    def __init__(self, parent: Node | None, label: str) -> None:
        self.parent, self.label, self.refs = parent, label, 0
        if parent is not None:
            parent.refs += 1


def _next(state: int) -> int:
    """The state behind an inserted or re-roled turn."""
    return ASSISTANT if state == USER else USER


def _edits(state: int, role: str, fault: str) -> list[tuple[str, int, int]]:
    """(label, cost, state behind) of the edits a row allows; an insert goes before the row's own edit."""
    out = [("D", DELETE, state)]
    if fault in ("blank", "duplicate"):
        return out
    extra = UNCUT if fault == "truncated" else 0
    for before, cost in (("", 0), ("I", INSERT)):
        at = _next(state) if before else state
        if role == "s" and at == START:
            out.append((before + "K", cost + KEEP + extra, SYSTEM))
        if role == ("a" if at == USER else "u"):
            out.append((before + "K", cost + KEEP + extra, _next(at)))
        out.append((before + "R", cost + REROLE + extra, _next(at)))
    return out


class Search:
    """The survivors of one run of rows from one state; ``step`` returns the edits that became final.

    A survivor is given up once another one can follow all that may come for less.  Rows that must go are no
    nodes: every survivor deletes them, so a level of the tree only counts those behind it.  Edits of two
    survivors are never a beginning of one another, so their order, once known, holds whatever follows: tied
    paths compare their whole unresolved stretches by the places of the survivors they extend.
    """

    moves: dict = {}

    def __init__(self, start: int = START) -> None:
        self.root = Node(None, "")
        self.root.refs = 1
        #: (cost, place of the edits among all survivors in ASCII order, node) by state.
        self.alive: dict[int, tuple[int, int, Node]] = {start: (0, 0, self.root)}
        self.forced: deque[int] = deque()

    @staticmethod
    def _release(node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            node = node.parent

    def step(self, role: str, fault: str) -> list[str]:
        if fault in ("blank", "duplicate"):
            self.alive = {s: (cost + DELETE, place, node) for s, (cost, place, node) in self.alive.items()}
            if not self.forced:
                return ["D"]
            self.forced[-1] += 1
            return []
        best: dict[int, tuple[int, int, str, Node]] = {}
        for state, (cost, place, node) in self.alive.items():
            key = (state, role, fault)
            edits = self.moves.get(key)
            if edits is None:
                edits = self.moves[key] = _edits(state, role, fault)
            for label, price, to in edits:
                new, now = (cost + price, place, label), best.get(to)
                if now is None or new < now[:3]:
                    best[to] = (*new, node)
        self._give_up(best)
        before = [node for _, _, node in self.alive.values()]
        self.alive = {}
        for place, (state, (cost, _, label, node)) in enumerate(sorted(best.items(), key=lambda x: x[1][1:3])):
            new = Node(node, label)
            new.refs = 1
            self.alive[state] = (cost, place, new)
        for node in before:
            self._release(node)
        self.forced.append(0)
        return self._settled()

    @staticmethod
    def _give_up(best: dict[int, tuple]) -> None:
        """Drop survivors that another one beats whatever follows.

        An insert leads from user to assistant and back.  Behind the assistant all is allowed that is behind the
        system turn, and what is allowed at the start but for a system turn, which can be deleted.
        """
        cost = {s: x[0] for s, x in best.items()}
        user, assistant = cost.get(USER, 1 << 60), cost.get(ASSISTANT, 1 << 60)
        reach = min(assistant, user + INSERT)
        if user > assistant + INSERT:
            best.pop(USER, None)
        if assistant > user + INSERT:
            best.pop(ASSISTANT, None)
        if START in best and cost[START] > reach + DELETE:
            del best[START]
        if SYSTEM in best and (cost[SYSTEM] > reach or (cost[SYSTEM] == assistant and best[ASSISTANT][1:3] < best[SYSTEM][1:3])):
            del best[SYSTEM]

    def _settled(self) -> list[str]:
        """Labels below the root that all survivors share; they leave the tree."""
        if self.root.refs > 1:
            return []
        path, node = [], next(iter(self.alive.values()))[2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = []
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            out.append(self.root.label)
            out += ["D"] * self.forced.popleft()
        return out

    def pending(self, node: Node) -> list[str]:
        labels = []
        for forced in reversed(self.forced):
            labels += ["D"] * forced
            labels.append(node.label)
            node = node.parent
        return labels[::-1]

    def finish(self, end: int | None = None) -> tuple[list[str], str]:
        """Edits not final yet and the inserts behind the last row, for the end of a conversation or a state."""
        if end is not None:
            return self.pending(self.alive[end][2]), ""
        state = min(self.alive, key=lambda s: (self.alive[s][0] + INSERT * len(ENDING[s]), self.alive[s][1]))
        return self.pending(self.alive[state][2]), ENDING[state]

    def ranked(self) -> dict[int, tuple[int, int]]:
        """(cost, place of the edits among all states) by state, the summary of a part."""
        return {s: (cost, place) for s, (cost, place, _) in self.alive.items()}


def chained(parts: list[dict[int, dict[int, tuple[int, int]]]]) -> list[tuple[int, int]]:
    """(state before, state behind) of each part on the cheapest, then ASCII-least path of a conversation.

    ``parts`` hold (cost, rank) by state before and behind.  Edits of a part from one state are never a
    beginning of one another, so the first part in which two paths part decides which is less.
    """
    left = [{s: INSERT * len(e) for s, e in ENDING.items()}]
    for part in reversed(parts):
        left.append({s: min((c + left[-1][to] for to, (c, _) in ends.items()), default=1 << 60) for s, ends in part.items()})
    left.reverse()
    out, state = [], START
    for k, part in enumerate(parts):
        to = min(part[state], key=lambda t: (part[state][t][0] + left[k + 1][t], part[state][t][1]))
        out.append((state, to))
        state = to
    return out


# Rows --------------------------------------------------------------------------------------------

#: What a task reads: a row (kind 2), the place of a first occurrence (1), or only that a conversation exists (0).
_KIND = "__kind"


def _last_mark(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends without a mark."""
    kept = F.rtrim(text, F.lit(BLANK))
    return kept == "", ~F.coalesce(F.right(kept, F.lit(1)).isin(".", "!", "?"), F.lit(False))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with the digest and the flaw of their text."""
    digest = F.unhex(F.md5(F.encode("text", "utf-8")))
    blank, cut = _last_mark(F.col("text"))
    return rows.select(
        "conv", "turn", "role", digest.alias("digest"), F.lit(2).cast("tinyint").alias(_KIND), "text",
        F.when(blank, 1).when(cut, 2).otherwise(0).cast("tinyint").alias("flaw"),
    )


def _stream(r: DataFrame, present: DataFrame | None) -> DataFrame:
    """Rows, first occurrences and present conversations under one schema."""
    first = r.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("at")).select(
        "conv", F.col("at.turn").alias("turn"), "role", "digest", F.lit(1).cast("tinyint").alias(_KIND),
        F.lit(None).cast("string").alias("text"), F.lit(0).cast("tinyint").alias("flaw"),
    )
    out = r.unionByName(first)
    if present is not None:
        there = present.select("conv").distinct()
        for name, kind in r.dtypes[1:]:
            there = there.withColumn(name, F.lit(0).cast(kind) if name == _KIND else F.lit(None).cast(kind))
        out = out.unionByName(there)
    return out


_ORDER = ["turn", "role", "digest"]
_NONE = object()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, part, new run, kind, turn, role, fault, text) in order, repeats marked."""
    run, firsts, used = _NONE, None, False
    for batch in batches:
        for conv, part, turn, role, digest, kind, text, flaw in zip(*(c.to_pylist() for c in batch.columns)):
            opens = (conv, part) != run
            run = (conv, part)
            if opens:
                firsts, used = None, False
            if kind == 1:
                firsts, used = (turn, role, digest), False
            elif kind == 0:
                yield conv, part, opens, 0, None, None, None, None
                continue
            else:
                seen = firsts != (turn, role, digest) or used
                used = True
                fault = "blank" if flaw == 1 else "duplicate" if seen else "truncated" if flaw == 2 else ""
                yield conv, part, opens, 2, turn, role, fault, text
                continue
            if opens:
                yield conv, part, True, 1, None, None, None, None


def _initial(role: str) -> str:
    return role[:1]


def _borders(stream: DataFrame, cut: Layout) -> dict[tuple, tuple[int, int]]:
    """The states before and behind each part of the conversations that are cut."""
    kind = stream.schema["conv"].dataType
    out = T.StructType([
        T.StructField("conv", kind), T.StructField("part", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("rank", T.IntegerType()),
    ])
    arrow = to_arrow_schema(out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        searches, at = [], None

        def close() -> None:
            for start, search in enumerate(searches):
                found.extend((*at, start, end, cost, rank) for end, (cost, rank) in search.ranked().items())

        for conv, part, opens, kind, _, role, fault, _ in _runs(batches):
            if opens:
                if at is not None:
                    close()
                at, searches = (conv, part), [Search(s) for s in range(4)]
            if kind == 2:
                for search in searches:
                    search.step(_initial(role), fault)
        if at is not None:
            close()
        yield _arrow_rows(found, arrow)

    dealt = _dealt(cut.only_hot(stream).withColumn("text", F.lit(None).cast("string")), cut)
    # At most 16 small rows for each part of a cut conversation, and the layout bounds the parts.
    by_conv: dict = {}
    for r in dealt.mapInArrow(summed, out).collect():
        ends = by_conv.setdefault(r["conv"], {}).setdefault(r["part"], {s: {} for s in range(4)})
        ends[r["start"]][r["end"]] = (r["cost"], r["rank"])
    borders = {}
    for conv, parts in by_conv.items():
        numbers = sorted(parts)
        for n, (start, end) in zip(numbers, chained([parts[n] for n in numbers])):
            borders[(conv, n)] = (start, end, n == numbers[-1])
    return borders


def _dealt(stream: DataFrame, cut: Layout) -> DataFrame:
    """Rows by conversation and part, sorted."""
    d = cut.parted(stream).select("conv", PART, *_ORDER, _KIND, "text", "flaw")
    return d.repartition(F.col("conv"), F.col(PART)).sortWithinPartitions("conv", PART, *_ORDER, _KIND)


EDITS = "part int, place long, edit string, turn long, role string, text string, fault string, new_role string"


def _repaired(rows: DataFrame, present: DataFrame | None, part_rows: int) -> tuple[DataFrame, Layout]:
    """Edits of all conversations, those of a part in order and next to each other."""
    marked = _numbered(rows)
    stream = _stream(marked, present)
    cut = layout(marked.select("conv", *_ORDER), ["conv"], _ORDER, part_rows)
    borders = share(rows.sparkSession, _borders(stream, cut) if cut.hot else {})
    out = T.StructType([rows.schema["conv"], *T._parse_datatype_string(EDITS)])
    arrow = to_arrow_schema(out)
    names = ["user", "assistant"]

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(borders)
        done: list[tuple] = []
        at, search, state, place, waiting, last = None, None, START, 0, deque(), (START, None, True)

        def emit(label: str, row: tuple | None) -> None:
            nonlocal state, place
            for edit in label:
                turn, role, text, fault = row if edit != "I" else (None, None, "", None)
                text = None if edit == "D" else text
                new = None
                if edit in "RI":
                    state = _next(state)
                    new = names[state == ASSISTANT]
                elif edit == "K":
                    state = SYSTEM if role[:1] == "s" else _next(state)
                    new = role
                done.append((*at, place, edit, turn, role, text, fault, new))
                place += 1

        def close() -> None:
            labels, ending = search.finish(None if last[2] else last[1])
            for label in labels:
                emit(label, waiting.popleft())
            emit(ending, None)
            if place == 0:
                done.append((*at, 0, None, None, None, None, None, None))

        for conv, part, opens, kind, turn, role, fault, text in _runs(batches):
            if opens:
                if at is not None:
                    close()
                at, place = (conv, part), 0
                last = known.get((conv, part), (START, None, True))
                state, search, waiting = last[0], Search(last[0]), deque()
            if kind == 2:
                waiting.append((turn, role, None if fault in ("blank", "duplicate") else text, fault))
                for label in search.step(role[:1], fault):
                    emit(label, waiting.popleft())
            if len(done) >= 4096:
                yield _arrow_rows(done, arrow)
        if at is not None:
            close()
        yield _arrow_rows(done, arrow)

    return _dealt(stream, cut).mapInArrow(repaired, out), cut


def repaired(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: DataFrame | None = None, part_rows: int = PART_ROWS,
) -> tuple[DataFrame, Layout]:
    """The cheapest edits of each conversation, one row an edit: (conv, part, place, edit, turn, role, text, fault, new_role).

    Also returns where conversations of more than ``part_rows`` rows were cut.  ``part`` and ``place`` give the order; ``edit`` is K, R, D or I, ``new_role`` the role after it (null
    with the text where a row is deleted), ``fault`` the row's first fault (blank, duplicate, truncated, or empty).  Rows are taken by turn, nulls first, then by
    role and the MD5 digest of the text; equal rows follow each other and all but the first are duplicates.  Null
    roles and texts read as one space; a role that does not begin with s, u or a can only be re-roled or
    deleted.  A null conversation is one of its own.  Ids in ``present`` (one column) without rows come back with
    one row of null edits; an empty table gives none.  Other columns are left out.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"),
    )
    if present is not None:
        present = present.select(F.col(f"`{present.columns[0]}`").cast(rows.schema["conv"].dataType).alias("conv"))
    return _repaired(rows, present, part_rows)


# Reports -----------------------------------------------------------------------------------------

REPORT = (
    "part int, piece int, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, first_role string, last_role string, audit string, body binary, digest string"
)
DIGEST = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
#: Text that is held at once.
PIECE = 4 << 20
_LEGAL = ("su", "ua", "au")
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_PRICE = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


class Chain:
    """SHA-256 of lines joined by newlines."""

    def __init__(self) -> None:
        self.sha, self.some = hashlib.sha256(), False

    def add(self, lines: bytes) -> None:
        if self.some:
            self.sha.update(b"\n")
        self.sha.update(lines)
        self.some = True


class Report:
    """Counts over edits in order, their letters and the lines they leave."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.first_role = self.last_role = None
        self.turns, self.audit, self.lines, self.size = 0, [], [], 0

    def add(self, edit: str, turn: int | None, role: str | None, text: str, fault: str | None, new: str | None) -> None:
        counts = self.counts
        counts["cost"] += _PRICE[edit]
        self.audit.append(edit)
        if edit != "I":
            if turn is not None and turn != self.last:
                self.turns += 1
                self.first = turn if self.first is None else self.first
                self.last = turn
            if fault:
                counts[fault] += 1
                counts["cost"] += UNCUT * (fault == "truncated" and edit != "D")
            initial = role[:1]
            if self.last_role is None:
                self.first_role = initial
            elif self.last_role + initial not in _LEGAL:
                counts["illegal"] += 1
            self.last_role = initial
        if edit != "D":
            self.lines.append(f"{new}:{text}".encode())
            self.size += len(self.lines[-1])
        self.size += 16

    def taken(self) -> bytes | None:
        """The lines so far, which are not held any longer; None without any."""
        body = b"\n".join(self.lines) if self.lines else None
        self.lines, self.size = [], 0
        return body


def _arrow_rows(done: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*done)) if done else [()] * len(arrow)
    done.clear()
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _pieces(edits: DataFrame, cut: Layout) -> DataFrame:
    """A report with its digest for each conversation that lies whole in a task; bounded pieces of the others."""
    packed = share(edits.sparkSession, {key for (key,), _ in cut.hot})
    out = T.StructType([edits.schema["conv"], *T._parse_datatype_string(REPORT)])
    arrow = to_arrow_schema(out)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, done, held = shared(packed), [], 0
        at, report, chain, piece = None, None, None, 0

        def close() -> None:
            nonlocal piece, held
            body = report.taken()
            if chain is not None and body is not None:
                chain.add(body)
            held += len(body or b"") + len(report.audit)
            done.append((
                *at, piece, report.first, report.last, report.turns, *(report.counts[c] for c in _COUNTS), report.first_role,
                report.last_role, "".join(report.audit), body if chain is None else None, chain and chain.sha.hexdigest(),
            ))
            piece += 1

        for b in batches:
            for conv, part, _, edit, turn, role, text, fault, new in zip(*(c.to_pylist() for c in b.columns)):
                if (conv, part) != at:
                    if at is not None:
                        close()
                    at, report, piece = (conv, part), Report(), 0
                    chain = None if conv in hot else Chain()
                elif report.size >= PIECE:
                    if chain is None:
                        close()
                        report = Report()
                    elif (body := report.taken()) is not None:
                        chain.add(body)
                if edit is not None:
                    report.add(edit, turn, role, text, fault, new)
                if held >= PIECE or len(done) >= 1024:
                    held = 0
                    yield _arrow_rows(done, arrow)
        if at is not None:
            close()
        yield _arrow_rows(done, arrow)

    return edits.mapInArrow(told, out)


def _digests(pieces: DataFrame) -> DataFrame:
    """Pieces of a conversation, which follow each other in a task, as one report with the digest of its text."""
    out = T.StructType([pieces.schema["conv"], *T._parse_datatype_string(DIGEST)])
    arrow = to_arrow_schema(out)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, r = _NONE, None

        def close() -> None:
            gaps = r["last"] - r["first"] + 1 - r["turns"] if r["first"] is not None else 0
            done.append((conv, gaps, *r["counts"], "".join(r["audit"]), r["digest"] or r["chain"].sha.hexdigest()))

        for b in batches:
            for c, _, _, first, last, turns, *counts, one, end, audit, body, digest in zip(*(x.to_pylist() for x in b.columns)):
                if c != conv:
                    if conv is not _NONE:
                        close()
                    conv = c
                    r = dict(first=None, last=None, turns=0, counts=[0] * len(_COUNTS), end=None, audit=[], chain=Chain(), digest=None)
                if first is not None:
                    # A turn may go on behind a border.
                    r["turns"] += turns - (first == r["last"])
                    r["first"] = first if r["first"] is None else r["first"]
                    r["last"] = last
                if one is not None:
                    counts[_COUNTS.index("illegal")] += r["end"] is not None and r["end"] + one not in _LEGAL
                    r["end"] = end
                r["counts"] = [x + y for x, y in zip(r["counts"], counts)]
                r["audit"].append(audit)
                r["digest"] = digest
                if body is not None:
                    r["chain"].add(body)
            yield _arrow_rows(done, arrow)
        if conv is not _NONE:
            close()
        yield _arrow_rows(done, arrow)

    return pieces.mapInArrow(told, out)


def reports(edits: DataFrame, cut: Layout) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``repaired`` edits.

    Conversations are summed up where they lie.  Only the pieces of those that were cut carry text to the task
    that chains their digest: SHA-256 has one chain over the whole text, which no split can shorten.
    """
    pieces = _pieces(edits, cut)
    if cut.hot:
        pieces = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return _digests(pieces)


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults of the contract, by crc32 of ``conv_id:turn``: rows dropped, emptied, stripped, repeated, re-roled."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    d = conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fate.alias("__fate"),
    ).where("__fate <> 0")
    times = F.when(F.col("__fate") == 3, 2).otherwise(1)
    return d.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).drop("__copy", "__fate")


def op11_conversation_repair(spark: SparkSession, sf: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Reports of all ``conversations`` after the damage of the contract."""
    source = table(spark, sf, "conversations")
    rows = damaged(source)
    edits, cut = repaired(rows, present=source.select("conv_id"), part_rows=part_rows)
    return reports(edits, cut).withColumnRenamed("conv", "conv_id")
