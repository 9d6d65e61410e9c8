"""Operator 2: embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample give balanced binary codes.  Substrings of the codes index
tables; vectors that share a bucket of a table are compared by their original vectors.  Buckets that
are too large for a task are cut into blocks whose pairs are compared one by one, and a pair that
shares buckets of several tables counts in the first one only, so links are counted, never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_pass, components, grouped_pass, local_roots, share, shared, sized, table

#: Vectors the rotations are learned on at most.
SAMPLE = 20_000
#: Vectors of a block; larger buckets are cut into blocks.
BLOCK = 1024
#: Vectors of a group of buckets, about.
GROUP = 8192
#: Pairs at the threshold that the tables are measured on, and groups of them by closeness to the mean.
PAIRS, GROUPS = 8000, 10


@dataclass
class Codes:
    """Rotations of centered vectors, and the bits of each table."""

    mean: np.ndarray
    rotations: np.ndarray
    tables: list[np.ndarray]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table."""
        bits = (x - self.mean) @ self.rotations >= 0
        out = np.empty((len(x), len(self.tables)), np.int64)
        for t, places in enumerate(self.tables):
            out[:, t] = bits[:, places] @ (1 << np.arange(len(places), dtype=np.int64))
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _pairs(sample: np.ndarray, mean: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled vectors with partners at the threshold, and the group of each pair.

    Half of the partners lie in any direction, half towards a near one of 32 vectors of the same group.
    """
    ranked = sample[np.argsort(sample @ mean, kind="stable")]
    n = len(ranked)
    place = np.sort(rng.integers(0, n, PAIRS))
    group = place * GROUPS // n
    first = ranked[place]
    aside = rng.normal(size=first.shape)
    for k in range(0, PAIRS, 2):
        low, high = -(-group[k] * n // GROUPS), -(-(group[k] + 1) * n // GROUPS)
        others = ranked[rng.integers(low, high, 32)]
        near = others @ first[k]
        at = int(np.argmax(np.where(near < 1 - 1e-9, near, -2.0)))
        if near[at] < 1 - 1e-9:
            aside[k] = others[at]
    aside = _unit(aside - (aside * first).sum(1, keepdims=True) * first)
    second = _unit(threshold * first + np.sqrt(max(0.0, 1 - threshold**2)) * aside)
    return first, second, group * 2 + np.arange(PAIRS) % 2


def _asked(first: np.ndarray, second: np.ndarray, group: np.ndarray, bits: int, recall: float) -> int:
    """Tables of random planes that find the pairs of the worst group with the recall."""
    cos = np.clip((_unit(first) * _unit(second)).sum(1), -1, 1)
    missed = 1 - np.minimum((1 - np.arccos(cos) / np.pi) ** bits, 1 - 1e-12)
    size = np.maximum(np.bincount(group, minlength=2 * GROUPS), 1)
    tables = 1
    while (np.bincount(group, missed**tables, minlength=2 * GROUPS) / size).max() > 1 - recall and tables < 1 << 20:
        tables *= 2
    low, high = tables // 2, tables
    while high - low > 1:
        middle = (low + high) // 2
        enough = (np.bincount(group, missed**middle, minlength=2 * GROUPS) / size).max() <= 1 - recall
        low, high = (low, middle) if enough else (middle, high)
    return high


def learn_codes(sample: np.ndarray, vectors: int, threshold: float, recall: float, seed: int = 2, rounds: int = 30) -> Codes:
    """Iterative quantisation on the sample; as many tables as the recall at the threshold asks for.

    A bit differs between vectors with probability angle / pi, and centering widens the angle of vectors
    close to the mean.  So the tables are measured on pairs at the threshold: there are as many as the
    angles ask for without centering, and more until the worst group of pairs has the recall.  Where the
    angles after centering ask for over four times the tables, the vectors are not centered.  Substrings have about log2 of the
    number of vectors bits less six, so buckets hold some tens of unrelated vectors.
    """
    dim = sample.shape[1]
    mean = sample.mean(0)
    rng = np.random.default_rng(seed)
    bits = int(min(dim, max(6, np.ceil(np.log2(max(vectors, 2))) - 6)))
    first, second, group = _pairs(sample, mean, threshold, np.random.default_rng(seed + 1))
    wanted, plain = _asked(first - mean, second - mean, group, bits, recall), _asked(first, second, group, bits, recall)
    if wanted > 4 * plain:
        mean, wanted = np.zeros(dim), plain
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x / len(x))
    per = max(1, dim // bits)
    size = np.maximum(np.bincount(group, minlength=2 * GROUPS), 1)
    found = np.zeros(PAIRS, bool)
    rotations, tables = [], []
    while True:
        turn, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        v = x @ axes.T
        # Rotations beyond the expected number stay random, so that each new one adds to the recall.
        for _ in range(rounds if len(tables) < wanted else 0):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        order = rng.permutation(dim)
        rotations.append(axes.T @ turn)
        alike = ((first - mean) @ rotations[-1] >= 0) == ((second - mean) @ rotations[-1] >= 0)
        for i in range(per):
            places = order[i * bits : (i + 1) * bits]
            tables.append(places + dim * (len(rotations) - 1))
            found |= alike[:, places].all(1)
            missed = (np.bincount(group, ~found, minlength=2 * GROUPS) / size).max()
            if len(tables) >= plain and missed <= 1 - recall:
                return Codes(mean, np.hstack(rotations), tables)


def _units(packed: list[bytes], dtype: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(packed), dtype).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame, id_kind: str, dtype: str) -> DataFrame:
    """(id, class, raw) of every row; class and numbers of a vector that links with nothing are null."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            packed = []
            for v in batch.column(1).to_pylist():
                x = None if not v or any(c is None for c in v) else np.array(v, dtype) + 0.0
                packed.append(None if x is None or not np.isfinite(x).all() or not x.any() else x.astype(dtype).tobytes())
            names = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in packed]
            yield {"id": batch.column(0), "class": names, "raw": packed}

    return arrow_pass(vectors, step, f"id {id_kind}, class binary, raw binary")


def _compare(bucket: dict, threshold: float) -> tuple[list, list]:
    """Counts and spanning edges of the links within a block, or between two blocks of a bucket."""
    x, w, codes, t, left, names = (bucket[c] for c in ("unit", "weight", "codes", "table", "left", "class"))
    counts = np.zeros(len(x), np.int64)
    first, second = [], []
    for at in range(0, len(x), 512):
        a, b = np.nonzero(x[at : at + 512] @ x.T >= threshold)
        a = a + at
        keep = a < b
        if left is not None:
            keep &= left[a] != left[b]
        a, b = a[keep], b[keep]
        if t:
            fresh_pair = ~(codes[a, :t] == codes[b, :t]).any(1)
            a, b = a[fresh_pair], b[fresh_pair]
        np.add.at(counts, a, w[b])
        np.add.at(counts, b, w[a])
        first.append(a)
        second.append(b)
    a, b = np.concatenate(first), np.concatenate(second)
    root = local_roots(len(x), a, b) if len(a) else np.arange(len(x))
    hit = np.flatnonzero(counts)
    away = np.flatnonzero(root != np.arange(len(x)))
    return [(names[k], int(counts[k])) for k in hit], [(names[k], names[root[k]]) for k in away]


def _links(reps: DataFrame, dim: int, dtype: str, vectors: int, threshold: float, recall: float, sample: int, scratch: Scratch) -> DataFrame:
    """Rows (what, class, other, n): counts of linked vectors by class, and spanning edges."""
    spark = reps.sparkSession
    # A bounded sample, the classes of the smallest digests.
    drawn = reps.select("class", "raw").orderBy("class").limit(sample).collect()
    learned = learn_codes(_units([bytes(r["raw"]) for r in drawn], dtype, dim), vectors, threshold, recall)
    codes, tables = share(spark, learned), len(learned.tables)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                packed = part.column(1).to_pylist()
                own = shared(codes).buckets(_units(packed, dtype, dim))
                n = len(own)
                yield {
                    "table": np.tile(np.arange(tables), n), "bucket": own.ravel(),
                    "class": [c for c in part.column(0).to_pylist() for _ in range(tables)],
                    "raw": [x for x in packed for _ in range(tables)], "weight": np.repeat(part.column(2).to_numpy(), tables),
                    "codes": [row for row in (r.tobytes() for r in own) for _ in range(tables)],
                }

    placed = arrow_pass(
        reps.select("class", "raw", "weight"), place, "table int, bucket long, class binary, raw binary, weight long, codes binary"
    )

    def codes_only(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = shared(codes).buckets(_units(batch.column(0).to_pylist(), dtype, dim))
            yield {"table": np.tile(np.arange(tables), len(own)), "bucket": own.ravel()}

    sizes = arrow_pass(reps.select("raw"), codes_only, "table int, bucket long").groupBy("table", "bucket").agg(F.count("*").alias("n"))
    large = scratch.put(sizes.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    groups = max(1, vectors * tables // GROUP)
    cut = placed.join(sized(large, 32), ["table", "bucket"], "left")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    partner = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = cut.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(partner))
    cut = cut.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    cut = cut.withColumn("group", F.pmod(F.xxhash64("table", "bucket", "low", "high"), F.lit(groups)))

    def compare(group: pa.Table) -> dict:
        key = np.stack([group.column(c).to_numpy() for c in ("table", "bucket", "low", "high")])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        edge = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        names, raw, packed = (group.column(c).to_pylist() for c in ("class", "raw", "codes"))
        weight, own = group.column("weight").to_numpy(), group.column("own").to_numpy()
        out: list[tuple] = []
        for a, b in zip(edge, np.append(edge[1:], len(order))):
            if b - a < 2:
                continue
            rows = order[a:b]
            bucket = {
                "unit": _units([raw[r] for r in rows], dtype, dim), "weight": weight[rows],
                "codes": np.frombuffer(b"".join([packed[r] for r in rows]), np.int64).reshape(-1, tables),
                "table": int(key[0, a]), "left": own[rows] if key[2, a] != key[3, a] else None, "class": [names[r] for r in rows],
            }
            counts, edges = _compare(bucket, threshold)
            out += [("n", c, None, n) for c, n in counts] + [("e", c, o, None) for c, o in edges]
        cols = list(zip(*out)) or [[], [], [], []]
        return dict(zip(("what", "class", "other", "n"), map(list, cols)))

    return grouped_pass(cut.drop("blocks", "other"), ["group"], compare, "what string, class binary, other binary, n long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
    recall: float = 0.95, sample: int = SAMPLE,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are equal number by number form a class that is compared once and counted as often as
    it occurs.  ``recall`` is what the tables are sized for at the threshold itself; closer pairs are found
    more surely, and no pair below the threshold is linked.  Vectors that are null, empty, zero, or hold
    null or non-finite numbers link with nothing; vectors of unlike length do not link.  Rows that share
    an id count as vectors each; null ids rank above all others.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = dict(vectors.dtypes)[id_col]
    dtype, numbers = ("<f4", "array<float>") if dict(vectors.dtypes)[vector_col] == "array<float>" else ("<f8", "array<double>")
    rows = scratch.put(_classes(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(numbers).alias("v")), kind, dtype))
    reps = scratch.put(
        rows.where("class is not null").groupBy("class").agg(F.first("raw").alias("raw"), F.count("*").alias("weight"), F.min("id").alias("least"))
    )
    found = None
    for r in reps.groupBy(F.octet_length("raw").alias("b")).count().collect():  # one row for each length of vectors
        alike = reps.where(F.octet_length("raw") == r["b"])
        part = _links(alike, r["b"] // int(dtype[-1]), dtype, r["count"], threshold, recall, sample, scratch)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.put(found)
    edges = found.where("what = 'e'").select(F.col("class").alias("a"), F.col("other").alias("b"))
    roots = scratch.put(components(edges, scratch))
    counts = found.where("what = 'n'").groupBy("class").agg(F.sum("n").alias("n"))
    named = reps.select("class", "weight", "least").join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    named = scratch.put(named)
    # A component may hold a third of all classes: stored sides are shuffled apart, so the join can split it.
    least = scratch.put(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = named.join(least, "root").select(
        "class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("id", "class").join(scratch.put(named), "class", "left")
    component = F.coalesce("component_id", "id").cast("long")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op2_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all rows of ``embeddings`` at cosine 0.9."""
    return near_vectors(table(spark, sf, "embeddings"))
