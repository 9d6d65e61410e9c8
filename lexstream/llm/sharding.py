"""Operator 10: two-pass external shuffle into shards.

Pass one numbers the rows, scatters them over memory-sized buckets of their shard by seeded hashes and
stores them; pass two runs a Fisher-Yates shuffle (numpy's ``Generator.permutation``) over each bucket.  A
shard is the sequence of its buckets, so slots are gapless and the order is uniform given the hashes.  Sizes and
rows of the buckets come from the same stored rows: an input behind a shuffle may be split anew each time it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, fits, fresh, sized, table

BUCKET_BYTES = 8 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the key is highest, so one more shard only takes rows for itself."""
    ranks = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(shards)]
    return (F.greatest(*ranks) if shards > 1 else ranks[0])["k"]


def two_pass_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 20,
    bucket_bytes: int = BUCKET_BYTES, path: str | None = None,
) -> DataFrame:
    """All columns of ``docs`` and ``shard``, ``slot``, ``grown_shard``; written to ``path`` by shard if given.

    The id and the number of shards alone decide the shard (law ``key``); ``grown_shard`` is that of one
    shard more.  Null ids are a key like any other.  A bucket also depends on the number that a row got when
    it was stored, so rows that share an id, which must share a shard, still spread over its buckets.  Equal
    texts are not kept together.  Columns of ``docs`` named like the new ones come back with ``_`` in front.
    Buckets are sized by the bytes of all texts, at least one to a task of the session; an empty table gives no
    rows.  Shards are the same in every run; slots follow the stored numbers.
    """
    spark = docs.sparkSession
    for name in ("shard", "slot", "grown_shard"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, fresh(docs, f"_{name}"))
    total = docs.agg(F.sum(F.octet_length(text_col) + F.lit(64)).alias("b")).first()["b"] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = max(1, -(-int(total) // (shards * bucket_bytes)), -(-tasks // shards))
    number, bucket = fresh(docs, "number"), fresh(docs, "bucket")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    place = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(number)), F.lit(per)).cast("int")
    scattered = Scratch(spark, "shards").put(
        numbered.withColumn("shard", shard_of(F.col(id_col), shards, seed))
        .withColumn("grown_shard", shard_of(F.col(id_col), shards + 1, seed))
        .withColumn(bucket, F.col("shard") * per + place)
    )
    sizes = scattered.groupBy("shard", bucket).count()
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = fresh(scattered, "first")
    offsets = sizes.select(bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    # At most shards * per rows, a number the driver has chosen itself.
    offsets = sized(offsets, 16, shards * per) if fits(shards * per, 16) else offsets

    placed = scattered.withColumn("slot", F.lit(0).cast("long"))
    arrow = to_arrow_schema(placed.schema)
    at = placed.columns.index(bucket)

    def fisher_yates(group: pa.Table) -> pa.Table:
        # Rows arrive in any order: sorting by their stored number makes the seeded shuffle repeatable.
        group = group.sort_by(number)
        order = np.random.default_rng([seed, group.column(at)[0].as_py()]).permutation(group.num_rows)
        group = group.take(pa.array(order))
        return group.set_column(group.schema.get_field_index("slot"), "slot", pa.array(np.arange(len(order), dtype=np.int64))).cast(arrow)

    shuffled = placed.groupBy(bucket).applyInArrow(fisher_yates, placed.schema)
    out = shuffled.join(offsets, bucket).withColumn("slot", F.col("slot") + F.col(first))
    out = out.select(*[c for c in placed.columns if c not in (bucket, number)])
    if path:
        out.write.partitionBy("shard").parquet(path)
        return spark.read.parquet(path)
    return out


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shards 0 to 7 of all ``documents``; the digest columns come from the shards' rows."""
    out = two_pass_shards(table(spark, sf, "documents"))
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )
