"""Ordered scans against loops: one hot key, sparse, textual and null orders; exchanges counted in the plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexstream.operators import events as ev
from lexstream.operators import ordered
from lexstream.operators import revision as rv
from lexstream.operators import segments as sg
from lexstream.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Exchanges of rows, broadcasts left out, as the planner wants them."""
    return sum(line.strip(" +-:").split("(")[0].strip() == "Exchange" or "Exchange " in line.strip(" +-:")[:10] for line in plan_of(df).splitlines())


def table_of(spark, order):
    """A key with most rows, sparse in its order, small keys, a null key."""
    rng = random.Random(4)
    places = rng.sample(range(10**9), 1200)
    rows = [("hot", p, rng.randint(-9, 9), rng.randint(0, 50)) for p in places[:900]]
    rows += [(rng.choice(["a", "b", "c", None]), p, rng.randint(-9, 9) if rng.random() < 0.8 else None, 3) for p in places[900:]]
    rng.shuffle(rows)
    as_order = {
        "long": lambda p: p, "string": lambda p: f"{p:012d}", "timestamp": lambda p: T0 + dt.timedelta(microseconds=p),
    }[order]
    rows = [(k, as_order(p) if p != min(places) else None, v, d) for k, p, v, d in rows]
    return rows, spark.createDataFrame(rows, f"k string, i {order}, v long, d long").repartition(5)


@pytest.mark.parametrize("order", ["long", "string", "timestamp"])
@pytest.mark.parametrize("size", [100, 1 << 20])
def test_running_values_equal_the_loop(spark, order, size):
    rows, d = table_of(spark, order)
    cut = ordered.layout(d, ["k"], ["i"], size)
    assert (("hot",) in [k for k, _ in cut.hot]) == (size == 100)
    got = ordered.scan(d, ["k"], ["i"], {
        "total": ordered.Sum(F.col("v")), "before": ordered.Sum(F.col("d"), inclusive=False), "high": ordered.Max(F.col("v")),
        "high_before": ordered.Max(F.col("v"), inclusive=False), "known": ordered.Last(F.col("v")),
        "done": ordered.Finish(F.col("d") * 7, F.col("d")),
    }, cut=cut)
    got = ordered.previous(got, ["k"], ["i"], {"was": F.col("v"), "any": F.lit(1)}, rows=size)
    got = ordered.numbered(got, ["k"], ["i"], "n", rows=size)
    assert set(got.columns) == {"k", "i", "v", "d", "total", "before", "high", "high_before", "known", "done", "was", "any", "n"}
    got = {(r["k"], r["i"]): r for r in got.collect()}
    assert len(got) == len(rows)
    for key in {k for k, *_ in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0))
        seen, spent, end, last = [], 0, -(10**18), None
        for n, (k, i, v, d) in enumerate(mine):
            r = got[k, i]
            high = max((x for x in seen if x is not None), default=None)
            assert (r["before"], r["high_before"], r["was"], r["any"], r["n"]) == (spent, high, seen[-1] if seen else None, 1 if seen else None, n + 1)
            seen.append(v)
            spent, end, last = spent + d, max(7 * d, end) + d, v if v is not None else last
            assert (r["total"], r["high"], r["known"], r["done"]) == (
                sum(x or 0 for x in seen), max((x for x in seen if x is not None), default=None), last, end)


def test_rows_of_equal_order_stay_together(spark):
    rows = [(1, i // 100, i) for i in range(2000)]
    d = spark.createDataFrame(rows, "k int, i int, v int")
    got = ordered.scan(d, ["k"], ["i"], {"s": ordered.Sum(F.lit(1))}, rows=30).collect()
    assert sorted(r["s"] for r in got) == list(range(1, 2001))
    assert all(100 * r["i"] < r["s"] <= 100 * (r["i"] + 1) for r in got)
    same = spark.createDataFrame([(1, 5)] * 300, "k int, i int")
    assert sorted(r["n"] for r in ordered.numbered(same, ["k"], ["i"], "n", rows=20).collect()) == list(range(1, 301))


def test_nothing_to_scan(spark):
    d = spark.createDataFrame([], "k int, i int, v int")
    out = ordered.scan(d, ["k"], ["i"], {"s": ordered.Sum(F.col("v")), "f": ordered.Finish(F.col("v"), F.col("v"))})
    assert out.count() == 0 and out.columns == ["k", "i", "v", "s", "f"]


def test_a_hot_key_is_split_over_tasks(spark):
    """Rows cross one exchange, keyed by part; what is carried over has a row for each part."""
    d = spark.createDataFrame([(1, 10**6 * i, i) for i in range(5000)], "k long, i long, v long")
    cut = ordered.layout(d, ["k"], ["i"], 250)
    sizes = [r["count"] for r in cut.parted(d).groupBy(ordered.PART).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1000
    out = ordered.scan(d, ["k"], ["i"], {"s": ordered.Sum(F.col("v"))}, cut=cut)
    assert out.agg(F.sum("s")).first()[0] == sum(i * (i + 1) // 2 for i in range(5000))
    hashed = [x for x in plan_of(out).splitlines() if "Exchange hashpartitioning" in x]
    assert len(hashed) == 3 and sum("__part" in x for x in hashed) == 2


@pytest.mark.parametrize(("name", "most"), [
    ("playback", 1), ("pacing", 1), ("frame_runs", 2), ("segments", 6), ("elapsed_since_previous", 2), ("revision_numbers", 2),
    ("overload_generations", 3), ("rechunked", 2),
])
def test_exchanges_of_the_queries(spark, name, most):
    got = exchanges(QUERIES[name](spark, SF))
    assert 1 <= got <= most


def test_segments_of_a_hot_stream(spark):
    """Cut streams give the segments of whole ones."""
    rng = random.Random(3)
    frames, n = [], 0
    while n < 6000:
        for voiced, length in ((True, rng.randint(1, 40)), (False, rng.randint(1, 60))):
            frames += [("hot", n + i, voiced) for i in range(length)]
            n += length
    frames += [(s, i, (i // 7) % 2 == 0) for s in ("a", "b") for i in range(50)]
    d = spark.createDataFrame(frames, "stream_id string, frame_no long, voiced boolean")
    key = lambda r: str(sorted(r.asDict().items()))
    for cuts in (None, d.where("voiced and frame_no % 97 = 5").select(
        "stream_id", F.col("frame_no").alias("at_frame"), F.lit(None).cast("long").alias("first_frame"), F.lit(4).cast("long").alias("frames")
    )):
        whole = sorted(map(key, sg.segments(d, cuts).drop("part").collect()))
        assert sorted(map(key, sg.segments(d, cuts, rows=200).drop("part").collect())) == whole and len(whole) > 30
    runs = sorted(map(key, sg.frame_runs(d).collect()))
    assert sorted(map(key, sg.frame_runs(d, rows=200).collect())) == runs


def test_revision_jobs_on_a_hot_stream(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("s", i * 1000, rng.randint(0, 30), rng.random() < 0.2) for i in range(800)]
    d = spark.createDataFrame(rows, "stream_id string, seq long, revision long, is_final boolean").withColumn("at", F.timestamp_millis("seq"))

    def jobs():
        return [
            sorted(map(str, x.collect())) for x in (
                rv.utterances(d, "stream_id", "seq"), rv.revise_numbers(d.drop("revision"), "stream_id", "seq"),
                rv.revision_guard(d, "stream_id", "seq", "revision"), rv.changed_only(d, "stream_id", "seq", "is_final"),
                rv.overload_generations(d, "stream_id", "seq", F.col("is_final")), ev.elapsed_since_previous(d, "stream_id", "seq", "at"),
                ev.playback(d, "stream_id", "seq", F.col("seq"), F.col("revision") * 100),
            )
        ]

    whole = jobs()
    real = ordered.layout
    monkeypatch.setattr(ordered, "layout", lambda df, keys, order, rows=0: real(df, keys, order, 50))
    assert jobs() == whole
