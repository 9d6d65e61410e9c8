"""Operator 3: quality classifier on random-indexing word vectors.

Words fall into hashed classes.  A class has a sparse random index vector; its word vector is the sum
of the index vectors of its neighbours over the whole corpus.  A document pools both over its words,
and a two-layer numpy network with a fitted temperature turns the pooled vector into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, flags, fresh, grouped_pass, share, shared, table, utf8

CLASSES, DIM, NONZERO, PARTS = 8192, 32, 2, 16
#: Labelled rows that the network is fitted on at most.
MAX_LABELLED = 20_000
_REPEAT = 0

# Byte kinds: 0 white space, 1 letters, digits and bytes of other scripts, 2 the rest.
_KIND = np.array(
    [0 if b in b" \t\n\x0b\x0c\r" else 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2 for b in range(256)],
    np.uint8,
)


def word_classes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word of the texts ``raw[bounds[i]:bounds[i + 1]]`` and the first word of each text.

    Words are runs of one byte kind; a word like the one before it falls into a class of its own.  The
    hash is the polynomial of the bytes, whatever the place of the word.
    """
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(kind)) + 1
    cuts = np.union1d(edge, bounds).astype(np.int64)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    starts, ends = cuts[:-1], cuts[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = np.full(len(raw), base, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        # Times the highest power over the word's own: the same word gives the same value at any place.
        h = (sums[ends] - sums[starts]) * power[len(raw) - 1 - starts]
        lift = np.uint64(pow(int(base), -(len(raw) - 1), 1 << 64))
        h = h * lift
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
    out = (h >> np.uint64(51)).astype(np.int64) % (CLASSES - 1) + 1
    first = np.searchsorted(starts, bounds)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[first < len(same)]] = False
    out[same] = _REPEAT
    return out, first


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a binary column; null counts as empty."""
    column = pa.array(column.fill_null(b"")) if column.null_count else column
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def index_vectors(seed: int = 3) -> np.ndarray:
    """A sparse row of +1 and -1 for each class."""
    rng = np.random.default_rng(seed)
    out = np.zeros((CLASSES, DIM), np.float32)
    places = rng.random((CLASSES, DIM)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.float32([-1, 1]), (CLASSES, NONZERO)), 1)
    return out


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """Word vector of each class: a matrix of fixed size, summed over all documents.

    Each task sums its own matrix; these are added in two steps, so that no group holds more than about
    the square root of the number of tasks.
    """
    index = index_vectors()
    rows = CLASSES // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(CLASSES * DIM)
        places = np.argsort(-np.abs(index), 1)[:, :NONZERO]
        signs = np.take_along_axis(index, places, 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                raw, bounds = _texts(batch.column(0).slice(at, 512))
                if not len(raw):
                    continue
                ids, first = word_classes(raw, bounds)
                if len(ids) < 2:
                    continue
                inner = np.ones(len(ids) - 1, bool)
                cut = first[(first > 0) & (first < len(ids))] - 1
                inner[cut] = False
                left, right = ids[:-1][inner], ids[1:][inner]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIM + places[b, k], signs[b, k], CLASSES * DIM)
        parts = total.astype(np.float32).reshape(PARTS, rows * DIM)
        yield {"part": list(range(PARTS)), "sums": [p.tobytes() for p in parts]}

    def add(group: pa.Table) -> dict:
        sums = np.sum([np.frombuffer(b, np.float64 if len(b) == rows * DIM * 8 else np.float32) for b in group.column("sums").to_pylist()], 0, np.float64)
        return {"part": [group.column("part")[0].as_py()], "sums": [sums.tobytes()]}

    each = arrow_pass(docs.select(utf8(text_col).alias("text")), count, "part int, sums binary")
    # The salt must not depend on order: take it from the matrix itself.
    salted = each.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(64)))
    halves = grouped_pass(salted, ["part", "salt"], add, "part int, sums binary")
    whole = grouped_pass(halves, ["part"], add, "part int, sums binary").collect()
    out = np.zeros((CLASSES, DIM))
    for r in whole:
        out[r["part"] * rows : (r["part"] + 1) * rows] = np.frombuffer(r["sums"], np.float64).reshape(rows, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean index and word vector of each text, and the logarithm of its length."""
    out = np.zeros((len(column), vectors.shape[1] + 1), np.float32)
    for at in range(0, len(column), 64):
        raw, bounds = _texts(column.slice(at, 64))
        n = len(bounds) - 1
        if not len(raw):
            continue
        ids, first = word_classes(raw, bounds)
        length = np.diff(np.append(first[:n], len(ids)))
        counts = np.bincount(np.repeat(np.arange(n), length) * CLASSES + ids, minlength=n * CLASSES).reshape(n, CLASSES)
        share = counts.astype(np.float32) / np.maximum(length, 1)[:, None]
        out[at : at + n, :-1] = share @ vectors
        out[at : at + n, -1] = np.log1p(length)
    return out


@dataclass
class Network:
    """Two layers with tanh between; ``temperature`` divides the logit."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, column: pa.Array) -> np.ndarray:
        z = self.logits(pooled(column, self.vectors).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 11, hidden: int = 32) -> Network:
    """Adam on the rows not held, then the temperature on the held ones."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    xs, t = (x - mean) / scale, 0
    train = np.flatnonzero(~held)
    epochs = max(20, min(400, 400_000 // max(len(train), 1)))
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 256):
            rows = train[at : at + 256]
            a = np.tanh(xs[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - a * a)
            grad = [xs[rows].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    rows = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = net.logits(x[rows])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, z / g) - y[rows] * z / g) for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def learn(docs: DataFrame, labels: DataFrame, learn_rows: Column, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Network:
    """Word vectors from all of ``docs``; the network from at most ``max_labelled`` labelled rows.

    ``labels`` has ``doc_id`` and ``quality``; of several labels of one id the largest counts, null ones
    do not.  ``learn_rows`` tells which labels may be learned from.  The sample takes the smallest hashes
    of the ids; a fifth of it, by another hash, fits the temperature.  Without a label the score is 0.5;
    with labels of one kind it is near that kind.
    """
    vectors = np.hstack([index_vectors(), word_vectors(docs, text_col)])
    chosen = labels.where("doc_id is not null and quality is not null").where(learn_rows)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most max_labelled rows of two numbers.
    held = (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 0).alias("held")
    rows = docs.select("doc_id", utf8(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality", held, "doc_id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = pooled(batch.column(0), vectors)
            yield {"x": [r.tobytes() for r in x], "y": batch.column(1), "held": batch.column(2), "id": batch.column(3)}

    # Of rows that share an id the one with the least features counts, so there are max_labelled at most.
    sample = arrow_pass(rows, step, f"x binary, y int, held boolean, id {dict(docs.dtypes)['doc_id']}")
    sample = [r["row"] for r in sample.groupBy("id").agg(F.min(F.struct("x", "y", "held")).alias("row")).collect()]
    sample.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    if not sample:
        dim = vectors.shape[1] + 1
        return Network(vectors, np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in sample])
    y = np.array([float(r["y"] >= 1) for r in sample])
    return _fit(vectors, x, y, np.array([r["held"] for r in sample]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; null and empty texts are scored as texts without words."""
    held = share(docs.sparkSession, network)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"id": batch.column(0), "score": shared(held).score(batch.column(1))}

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return arrow_pass(texts, step, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score reaches the threshold.

    Null and empty texts are judged as texts without words; equal texts alike; an empty table gives no rows.
    """
    held = share(docs.sparkSession, network)
    columns = docs.columns
    raw = fresh(docs, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield flags(batch, shared(held).score(batch.column(len(columns))) >= threshold, columns)

    return docs.withColumn(raw, utf8(text_col)).mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every whole text of ``documents``; a third of the ids, by checksum, is never learned from."""
    docs = table(spark, sf, "documents")
    network = learn(docs, table(spark, sf, "labels"), ~held_out())
    return quality_scores(docs, network).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
