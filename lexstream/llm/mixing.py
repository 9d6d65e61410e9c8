"""Operator 4: soft-membership mixing to target weights.

A classifier learned from the labels table gives each document a posterior over domains.  Document
rates start at one and follow projected gradient steps of a least-squares problem: the expected domain
token totals, sums of rate x tokens x posterior, should meet the targets, and rates should stay near
one.  A step needs only a few sums, so each is one distributed aggregate; rates are projected to stay between
zero and a bound of repetition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_pass, fresh, grouped_pass, share, shared, sized, table, utf8, words

#: Domains that the labels table tells apart, and the weights of the registered query.
DOMAINS = ("good", "low", "toxic")
TARGETS = (0.98, 0.01, 0.01)
HASHES, SELECTED = 1 << 16, 512
MAX_LABELLED = 20_000
#: No row is taken more often than this on average, and thinning leaves so much of the leading domain at least.
MAX_RATE, MIN_LEAD = 4.0, 0.5


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Place in DOMAINS of a labelled row; null without a quality."""
    return F.when(F.coalesce(F.col(toxic), F.lit(0)) == 1, 2).when(F.col(quality) == 1, 0).when(F.col(quality) == 0, 1)


_MARKS = re.compile(rb"[!$%&*#|@~^=+<>]{1,3}(?=\s|$)")
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))


def _pieces(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the words of a text, of the marks before white space, of repeats and capitals."""
    if not text:
        return np.zeros(0, np.int64)
    split = words(text)
    found = set(split)
    if len(split) >= 20 and len(found) * 6 <= len(split):
        found.add(b" repeats")
    found.update(_MARKS.findall(text))
    capitals, small = (len(text) - len(text.translate(None, letters)) for letters in (_CAPITALS, _SMALL))
    if capitals > small:
        found.add(b" capitals")
    return np.unique(np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % HASHES)


@dataclass
class Membership:
    """Softmax regression on the presence of selected hashes."""

    place: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def posterior(self, text: bytes | None) -> np.ndarray:
        at = self.place[_pieces(text)]
        z = self.bias + self.weight[at[at >= 0]].sum(0)
        e = np.exp(z - z.max())
        return e / e.sum()


def learn_membership(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Membership:
    """Fit on all labelled rows for the choice of hashes, on at most ``max_labelled`` for the weights.

    Of several labels of one id the one of the highest domain counts.  Domains without a row get a
    posterior near zero; without labels all are alike.
    """
    k = len(DOMAINS)
    marked = labels.withColumn("domain", domain_of()).where("doc_id is not null and domain is not null")
    marked = marked.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    rows = docs.select("doc_id", utf8(text_col).alias("text")).join(sized(marked, 16), "doc_id").select("doc_id", "text", "domain")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((k, HASHES + 1), np.int64)
        for batch in batches:
            for text, domain in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total[domain, _pieces(text)] += 1
                total[domain, HASHES] += 1
        yield {"domain": list(range(k)), "counts": [zlib.compress(row.tobytes(), 1) for row in total]}

    def add(group: pa.Table) -> dict:
        total = np.sum([np.frombuffer(zlib.decompress(c), np.int64) for c in group.column("counts").to_pylist()], 0)
        return {"domain": [group.column("domain")[0].as_py()], "counts": [zlib.compress(total.tobytes(), 1)]}

    # Each task sends one row of sums for each domain; they are added in two steps, and k rows reach the driver.
    parts = arrow_pass(rows, count, "domain int, counts binary").withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64)))
    parts = grouped_pass(parts, ["domain", "salt"], add, "domain int, counts binary")
    counts = np.zeros((k, HASHES + 1))
    for r in grouped_pass(parts, ["domain"], add, "domain int, counts binary").collect():
        counts[r["domain"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    size, counts = counts[:, HASHES], counts[:, :HASHES]
    seen, total = counts.sum(0), max(size.sum(), 1)
    gain = np.zeros(HASHES)
    for d in range(k):
        for cell, row, col in ((counts[d], size[d], seen), (size[d] - counts[d], size[d], total - seen)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += np.where(cell > 0, cell * np.log(cell * total / np.maximum(row * col, 1e-9)), 0)
    best = np.sort(np.argsort(-gain, kind="stable")[:SELECTED])
    place = np.full(HASHES, -1)
    place[best] = np.arange(len(best))

    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at = [place[_pieces(t)] for t in batch.column(1).to_pylist()]
            yield {"id": batch.column(0), "x": [a[a >= 0].astype(np.int16).tobytes() for a in at], "y": batch.column(2)}

    few = docs.select("doc_id", utf8(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "domain")
    # Of rows that share an id the one with the least features counts, so there are max_labelled at most.
    sample = arrow_pass(few, features, f"id {dict(docs.dtypes)['doc_id']}, x binary, y int")
    sample = sample.groupBy("id").agg(F.min(F.struct("x", "y")).alias("row"))
    sample = sorted((bytes(r["row"]["x"]), r["row"]["y"]) for r in sample.collect())
    weight, bias = np.zeros((SELECTED, k)), np.log(size + 0.5)
    if sample:
        x = np.zeros((len(sample), SELECTED), np.float32)
        for i, (held, _) in enumerate(sample):
            x[i, np.frombuffer(held, np.int16)] = 1
        y = np.eye(k, dtype=np.float32)[[d for _, d in sample]]
        weight, bias = weight.astype(np.float32), np.log(y.mean(0) + 1e-3).astype(np.float32)
        m, v = np.zeros((SELECTED + 1, k), np.float32), np.zeros((SELECTED + 1, k), np.float32)
        for t in range(1, 201):
            z = x @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - y) / len(x)
            g = np.vstack([x.T @ d + 1e-4 * weight, d.sum(0)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            weight, bias = weight - move[:-1].astype(np.float32), bias - move[-1].astype(np.float32)
    return Membership(place, weight, bias)


def members_of(docs: DataFrame, membership: Membership, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, posterior) for every row; null and empty texts have no tokens and the prior."""
    kind = dict(docs.dtypes)[id_col]
    held = share(docs.sparkSession, membership)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield {
                "id": batch.column(0), "tokens": [len(t.split()) if t else 0 for t in texts],
                "posterior": [shared(held).posterior(t) for t in texts],
            }

    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return arrow_pass(texts, step, f"id {kind}, tokens long, posterior array<double>").withColumnRenamed("id", id_col)


def replay(posteriors: np.ndarray, steps: list[np.ndarray], max_rate: float = MAX_RATE) -> np.ndarray:
    """Rates of rows: one, after projected steps along each row's own gradient."""
    rate = np.ones(len(posteriors))
    for s in steps:
        rate = np.clip(rate - posteriors @ s, 0.0, max_rate)
    return rate


def _sums(members: DataFrame, steps: list[np.ndarray], k: int, max_rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Domain totals at the current rates, the Gram matrix of the rows whose rate can move, and each domain's own
    tokens: its part of the rows where it has the largest posterior."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(2 * k + k * k)
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = np.array(batch.column(1).to_pylist(), float).reshape(-1, k)
            rate = replay(p, steps, max_rate)
            total[:k] += (tokens * rate) @ p
            total[k:-k] += ((p * (tokens * ((rate > 0) & (rate < max_rate)))[:, None]).T @ p).ravel()
            if len(p):
                total[-k:] += np.bincount(p.argmax(1), tokens * p.max(1), k)
        yield {"place": list(range(len(total))), "value": total}

    parts = arrow_pass(members.select("tokens", "posterior"), step, "place int, value double")
    out = np.zeros(2 * k + k * k)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out[:k], out[k:-k].reshape(k, k), out[-k:]


def fit_rates(
    members: DataFrame, targets: tuple[float, ...], tolerance: float = 1e-4, rounds: int = 20, max_rate: float = MAX_RATE,
    min_lead: float = MIN_LEAD,
) -> tuple[list[np.ndarray], dict]:
    """Steps for ``replay``, and the totals before, wanted and got.

    Minimizes the squared distance of the expected totals ``S_k = sum_d r_d * tokens_d * p_dk`` from the
    targets over 0 <= r <= ``max_rate``, starting from r = 1.  The gradient of a row depends on the row by its
    posterior only; it is scaled by the Gram matrix of the rows that are not at a bound, so a few steps do.

    A domain reaches its own tokens ``max_rate`` times and what it has in rows of others once.  The domain that is
    scarcest against its weight decides the size of the mix, by thinning the domain of the largest weight, but not
    below ``min_lead`` of its tokens.  What a scarce domain then lacks it misses: ``missed`` holds by how much the share
    that is aimed at falls short of the weight.  A weight of zero asks for none of a domain.  Without tokens
    there is no step.
    """
    k = len(targets)
    have, gram, own = _sums(members, [], k, max_rate)
    want = np.array(targets, float)
    if not have.sum() or not want.sum():
        return [], {"have": have, "target": have, "got": have, "missed": np.zeros(k)}
    want = want / want.sum()
    lead = int(np.argmax(want))
    reach = have - own + max_rate * own
    full = have[lead] / want[lead]
    scarce = min((reach[d] / want[d] for d in range(k) if want[d] > 0), default=full)
    size = min(full, max(scarce, min_lead * full)) or have.sum()
    target = np.minimum(want * size, reach)
    steps: list[np.ndarray] = []
    got, best = have, (np.inf, 0)
    for _ in range(rounds):
        miss = float(np.abs(got - target).max())
        best = min(best, (miss, len(steps)))
        if miss <= tolerance * target.sum():
            break
        ridge = 1e-6 * max(np.trace(gram), 1.0) / k
        steps.append(np.linalg.solve(gram + ridge * np.eye(k), got - target))
        got, gram, _ = _sums(members, steps, k, max_rate)
    else:
        best = min(best, (float(np.abs(got - target).max()), len(steps)))
    steps = steps[: best[1]]
    got = _sums(members, steps, k, max_rate)[0]
    gap = want - target / max(target.sum(), 1e-300)
    # Shares that differ by rounding are met.
    return steps, {"have": have, "target": target, "got": got, "missed": np.where(gap > 1e-12, gap, 0)}


def copies(rates: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Whole copies with the rates as their mean."""
    return np.floor(rates + draws).astype(np.int64)


def draw(id_col: str, text_col: str, seed: int = 4) -> Column:
    """A repeatable number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mixed(
    docs: DataFrame, membership: Membership, steps: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text",
    max_rate: float = MAX_RATE,
) -> DataFrame:
    """The rows of ``docs``, all columns kept, as often as their rate tells: ``max_rate`` times, rounded up, at most.

    Null and empty texts have the prior as their posterior and are kept or left by its rate.  Equal rows have equal
    rates and numbers, so all of them come as often; an empty table gives no rows.
    """
    held = share(docs.sparkSession, (membership, steps))
    columns, raw, times = docs.columns, fresh(docs, "raw"), fresh(docs, "times")
    counted = T.StructType([*docs.schema.fields, T.StructField(times, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, moves = shared(held)
        for batch in batches:
            p = np.array([model.posterior(t) for t in batch.column(len(columns)).to_pylist()]).reshape(-1, len(DOMAINS))
            n = copies(replay(p, moves, max_rate), batch.column(len(columns) + 1).to_numpy(zero_copy_only=False))
            rows = batch.select(range(len(columns))).append_column(times, pa.array(n, pa.int64()))
            yield rows.filter(pa.array(n > 0))

    drawn = docs.withColumn(raw, utf8(text_col)).withColumn(times, draw(id_col, text_col))
    taken = drawn.mapInArrow(run, counted)
    # Copies are made by the plan, a row at a time.
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"`{times}`")))).select(
        *[F.col(f"`{c}`") for c in columns]
    )


def fitted(
    docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, max_rate: float = MAX_RATE,
) -> tuple[Membership, list[np.ndarray], DataFrame, dict]:
    """Membership, steps, the stored members and the totals for ``docs``.

    Null and empty texts have no tokens and count for nothing; rows that repeat count each; without rows or labels
    there is no step or one prior for all.
    """
    membership = learn_membership(docs, labels)
    members = Scratch(docs.sparkSession, "members").put(members_of(docs, membership))
    steps, totals = fit_rates(members, targets, max_rate=max_rate)
    return membership, steps, members, totals


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Rate and copies of every row of ``documents`` under the weights of DOMAINS.

    Null and empty texts have no tokens and the prior; rows that repeat come back each.
    """
    _, steps, members, _ = fitted(table(spark, sf, "documents"), table(spark, sf, "labels"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            p = np.array(batch.column(2).to_pylist(), float).reshape(-1, len(DOMAINS))
            rate = replay(p, steps)
            yield {
                "doc_id": batch.column(0), "n_tokens": batch.column(1), **{f"p_{d}": p[:, k] for k, d in enumerate(DOMAINS)},
                "rate": rate, "copies": copies(rate, batch.column(3).to_numpy(zero_copy_only=False)),
            }

    schema = f"doc_id long, n_tokens long, {', '.join(f'p_{d} double' for d in DOMAINS)}, rate double, copies long"
    return arrow_pass(members.withColumn("draw", draw("doc_id", "tokens")), step, schema)
