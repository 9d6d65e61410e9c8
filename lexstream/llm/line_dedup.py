"""Operator 9: line dedup by range-partitioned hashes, returning compressed keep bitmaps.

The keys of long lines are hashed to 128 bits and range-partitioned by (hash, document), so a line
that a third of all documents hold spreads over many ranges.  Each range is sorted by hash, document
(largest first) and position and streamed: the first document of a hash keeps its lines, the others
lose theirs once enough documents hold the hash.  Only the runs that touch an end of their range may go
on in another one; they are settled with the sums of those runs, of which there are two to a range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import MAX_BROADCAST_BYTES
from .common import Scratch, arrow_pass, table, utf8

BLANK = b" \t\n\x0b\x0c\r"


def _long_lines(texts: DataFrame, kind: str, min_chars: int) -> DataFrame:
    """A row for each line whose key has enough code points."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import xxhash

        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or len(text) < min_chars:
                    continue
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    line = line.strip(BLANK).lower()
                    if len(line) < min_chars or (not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars):
                        continue
                    h = xxhash.xxh3_128_intdigest(line)
                    for column, value in zip(out, ((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), i, key, pos)):
                        column.append(value)
            yield dict(zip(("h1", "h2", "id", "key", "pos"), out))

    return arrow_pass(texts, step, f"h1 long, h2 long, id {kind}, key long, pos int")


def _streamed(ranges: DataFrame, kind: str, min_docs: int) -> DataFrame:
    """Rows of kind 'drop' (a line to drop), 'open' (a line not settled here), 'sum' (a run at an end).

    Holds the lines of fewer than ``min_docs`` documents of one hash at a time.
    """
    names = ("what", "h1", "h2", "id", "key", "pos", "docs")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, at_start, docs, first, last = None, True, 0, None, None
        waiting: list[tuple] = []
        out: list[tuple] = []

        def columns() -> dict:
            cols = dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}
            out.clear()
            return cols

        for batch in batches:
            for h1, h2, i, key, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if (h1, h2) != current:
                    if current is not None and at_start:
                        out.append(("sum", *current, first, None, None, docs))
                        at_start = False
                    current, docs, first = (h1, h2), 0, i
                    waiting.clear()
                if docs == 0 or i != last:
                    docs += 1
                    last = i
                    if docs == min_docs and not at_start:
                        out.extend(("drop", *x, None) for x in waiting if x[2] != first)
                        waiting.clear()
                line = (h1, h2, i, key, pos)
                if at_start:
                    out.append(("open", *line, None))
                elif docs < min_docs:
                    waiting.append(line)
                elif i != first:
                    out.append(("drop", *line, None))
            yield columns()
        if current is not None:
            out.append(("sum", *current, first, None, None, docs))
            out.extend(("open", *x, None) for x in waiting)
        yield columns()

    return arrow_pass(ranges, step, f"what string, h1 long, h2 long, id {kind}, key long, pos int, docs long")


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
) -> DataFrame:
    """(id, key, keep) for each document that loses lines; the others keep all of theirs.

    ``key`` is ``xxhash64`` of the text, since rows may share an id; ``keep`` is a compressed bitmap
    with a bit for each line up to the last dropped one.  Documents are counted by id: rows that share
    one count once, and null is an id of its own, smaller than all others.  Null and empty texts have no
    long line; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), utf8(text_col).alias("text"))
    scratch = Scratch(spark, "lines")
    order = ("h1", "h2", F.col("id").desc_nulls_last())
    ranges = _long_lines(texts, kind, min_chars).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    found = scratch.put(_streamed(ranges.sortWithinPartitions(*order, "key", "pos"), kind, min_docs))
    # Two runs to a range: at most twice as many rows as there are ranges.
    whole = F.broadcast(
        found.where("what = 'sum'").groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.max("id").alias("keeper"))
    )
    settled = found.where("what = 'open'").select("h1", "h2", "id", "key", "pos").join(whole, ["h1", "h2"])
    settled = settled.where((F.col("total") >= min_docs) & ~F.col("id").eqNullSafe(F.col("keeper")))
    drops = found.where("what = 'drop'").select("id", "key", "pos").union(settled.select("id", "key", "pos"))
    listed = drops.groupBy("id", "key").agg(F.collect_set("pos").alias("pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keep = []
            for positions in batch.column(2).to_pylist():
                bits = np.ones(-(-(max(positions) + 1) // 8) * 8, np.uint8)
                bits[positions] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield {"id": batch.column(0), "key": batch.column(1), "keep": keep}

    return arrow_pass(listed, pack, f"id {kind}, key long, keep binary").withColumnRenamed("id", id_col)


def kept_text(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines and what stays of a text under its bitmap."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    stays = np.ones(len(lines), bool)
    stays[: len(bits)] = bits == 1
    return len(lines), int((~stays).sum()), b"\n".join(x for x, s in zip(lines, stays.tolist()) if s)


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Line dedup of every whole text of ``documents``; the texts meet their bitmaps again here."""
    docs = table(spark, sf, "documents")
    marks = Scratch(spark, "bitmaps").put(keep_bitmaps(docs))
    size = marks.agg(F.sum(F.octet_length("keep") + F.lit(64)).alias("b")).first()["b"] or 0
    marks = F.broadcast(marks) if size <= MAX_BROADCAST_BYTES else marks
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), utf8("text").alias("text")).alias("d")
    joined = texts.join(marks.alias("m"), F.expr("d.doc_id <=> m.doc_id and d.key = m.key"), "left")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            got = [kept_text(t or b"", k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield {
                "doc_id": batch.column(0), "n_lines": [g[0] for g in got], "n_dropped": [g[1] for g in got],
                "kept_sha256": [hashlib.sha256(g[2]).hexdigest() for g in got],
            }

    return arrow_pass(joined.select("d.doc_id", "d.text", "m.keep"), step, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
