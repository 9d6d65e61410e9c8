"""Helpers of the training-data operators: byte-level words, Arrow passes, stored steps, components."""

from __future__ import annotations

import atexit
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import MAX_BROADCAST_BYTES, work_dir

# A-Z become a-z; digits, a-z and all bytes of code points from U+0080 on belong to words; the rest parts them.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text whose A-Z are lower-cased."""
    return text.translate(_WORD).split() if text else []


def spaced(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text whose A-Z are lower-cased."""
    return text.lower().split() if text else []


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def utf8(name: str):
    """A text column as bytes for Arrow."""
    return F.col(f"`{name}`").cast("string").cast("binary")


def arrow_pass(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a step that yields columns as dicts of lists or arrays."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in step(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def grouped_pass(df: DataFrame, keys: list[str], step: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``applyInArrow`` for a step that returns columns as a dict of lists or arrays."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(group: pa.Table) -> pa.Table:
        columns = step(group)
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.groupBy(*keys).applyInArrow(run, kind)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package with its class, so executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(packed: Broadcast):
    """The object of ``share``, unpacked once in a worker process."""
    if not hasattr(packed, "unpacked"):
        packed.unpacked = pickle.loads(packed.value)
    return packed.unpacked


def flags(batch: pa.RecordBatch, mask: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """The rows of a batch that the mask keeps, in the named columns."""
    kept = batch.filter(pa.array(mask, pa.bool_()))
    return pa.RecordBatch.from_arrays([kept.column(batch.schema.get_field_index(c)) for c in columns], names=columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Steps stored in the shared folder, so that they run once and outlive lost executors.

    ``drop`` removes what no later step reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.paths = spark, {}
        self.folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and id(df) in self.paths:
            self._remove(self.paths.pop(id(df))[1])

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._remove(self.folder)


def fits(rows: int, width: int) -> bool:
    """Whether so many rows of so many bytes may be broadcast."""
    return rows * width <= MAX_BROADCAST_BYTES


def sized(df: DataFrame, width: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast where the counted rows stay below the limit; else the join shuffles."""
    return F.broadcast(df) if fits(df.count() if rows is None else rows, width) else df


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable by links (a, b) among n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _settled(links: DataFrame) -> bool:
    """Whether every node of the links (a, b) has one parent, and parents have none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("top"))
    return seen.where("ups > 1 or (ups = 1 and top = 0)").limit(1).count() == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b); root is the smallest node reachable.

    Repeated edges count once; edges with a null end and those of a node to itself link nothing, so a node with no other
    edge is not returned; no edges give no rows.

    Alternates the large-star and small-star steps until the links form stars: logarithmically many
    rounds, each a grouped minimum and a join.  While the minima may be broadcast they are; beyond
    that they are stored first, so that both sides of the join are shuffled for it and adaptive
    execution can split a hub's links.
    """
    now = scratch.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _settled(now):
        small_enough = fits(2 * now.count(), 48)
        held = [now]

        def side(least: DataFrame) -> DataFrame:
            if small_enough:
                return F.broadcast(least)
            held.append(scratch.put(least))
            return held[-1]

        both = now.union(now.select("b", "a"))
        lowest = side(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.put(large.where("a <> b").distinct())
        held.append(large)
        nearest = side(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(nearest, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")),
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = scratch.put(small)
        for step in held:
            scratch.drop(step)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
