"""The choice between overlapping matches of one text, as column functions over an array of matches.

A match is a struct with at least start, end, norm_len, priority, rank, term_id and form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_up, let, prefix_maxima

#: Clusters of more matches than this are resolved in rounds instead of one by one.
_ONE_BY_ONE = 32


def _rank(m: Column) -> Column:
    """What decides between overlapping matches, the least first."""
    return F.struct(-m["norm_len"], -m["priority"], m["rank"], m["start"], m["end"], m["term_id"], m["form"])


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _one_by_one(ms: Column) -> Column:
    ranked = F.sort_array(F.transform(ms, lambda m: F.struct(_rank(m).alias("by"), m.alias("m"))))
    return F.aggregate(
        F.transform(ranked, lambda x: x["m"]), F.filter(ms, lambda x: F.lit(False)),
        lambda kept, m: F.when(F.exists(kept, lambda y: _overlap(m, y)), kept).otherwise(F.concat(kept, F.array(m))),
    )


def _sweep(xs: Column, near: Column) -> Column:
    """Settle what can be settled from one end of the cluster to the other.

    Each open match looks at its neighbours, those behind it as this sweep has left them: it is lost if one that
    overlaps it has won, and wins if no open one that overlaps it ranks higher.
    """
    none = F.filter(xs, lambda x: F.lit(False))

    def step(a: Column, i: Column) -> Column:
        def judge(x: Column) -> Column:
            beside = F.concat(a["recent"], F.slice(xs, i + 2, near))

            def state(ys: Column) -> Column:
                met = lambda y: _overlap(y["m"], x["m"])
                lost = F.exists(ys, lambda y: (y["state"] == 1) & met(y))
                beaten = F.exists(ys, lambda y: (y["state"] == 0) & (y["by"] < x["by"]) & met(y))
                return F.when(x["state"] != 0, x["state"]).when(lost, 2).when(~beaten, 1).otherwise(0)

            return F.struct(x["m"].alias("m"), x["by"].alias("by"), let(beside, state).alias("state"))

        def put(z: Column) -> Column:
            recent, now = F.concat(a["recent"], F.array(z)), F.concat(a["now"], F.array(z))
            full = F.size(a["now"]) >= 255
            return F.struct(
                F.when(F.size(a["recent"]) >= near, F.slice(recent, F.lit(2), near)).otherwise(recent).alias("recent"),
                F.when(full, none).otherwise(now).alias("now"),
                F.when(full, F.concat(a["done"], F.array(now))).otherwise(a["done"]).alias("done"),
            )

        return let(let(F.get(xs, i), judge), put)

    # Blocks keep the copying of a growing array short.
    start = F.struct(none.alias("recent"), none.alias("now"), F.filter(F.array(none), lambda x: F.lit(False)).alias("done"))
    return F.aggregate(count_up(F.size(xs)), start, step, lambda a: F.concat(F.flatten(a["done"]), a["now"]))


def _in_rounds(ms: Column, reach: Column) -> Column:
    """Sweeps back and forth until every match has won or lost; the outcome is that of one by one in rank order.

    Overlapping matches stand close together in the order of their starts, so a match looks at its neighbours only.
    Runs of falling or rising rank settle within one sweep of either direction.
    """
    n = F.size(ms)
    near = F.lit(None).cast("int")

    def apart(w: int) -> Column:
        return F.forall(count_up(n), lambda i: F.coalesce(F.get(ms, i + w)["start"] >= F.get(reach, i), F.lit(True)))

    for w in (4096, 512, 64, 8):
        near = F.when(apart(w), F.lit(w)).otherwise(near)

    def rounds(near: Column) -> Column:
        # Every match with its state: 0 open, 1 won, 2 lost.
        first = F.transform(ms, lambda m: F.struct(m.alias("m"), _rank(m).alias("by"), F.lit(0).alias("state")))

        def step(a: Column, _: Column) -> Column:
            left = let(_sweep(a["xs"], near), lambda ys: F.reverse(F.filter(ys, lambda y: y["state"] != 2)))
            after = let(left, lambda ys: F.struct(ys.alias("xs"), F.exists(ys, lambda y: y["state"] == 0).alias("open")))
            return F.when(a["open"], after).otherwise(a)

        return F.aggregate(
            count_up(n), F.struct(first.alias("xs"), F.lit(True).alias("open")), step, lambda a: F.transform(a["xs"], lambda x: x["m"]),
        )

    return let(F.coalesce(near, n), rounds)


def chosen(matches: Column) -> Column:
    """Non-overlapping matches: longest, then highest priority, declared first, leftmost; ordered by place.

    ``matches`` come in order.  Only matches that touch through others compete, so the choice runs by cluster.
    """

    def resolve(ms: Column) -> Column:
        def clusters(reach: Column) -> Column:
            opens = F.filter(count_up(F.size(ms)), lambda i: (i == 0) | (F.get(reach, i - 1) <= F.get(ms, i)["start"]))

            def each(os: Column) -> Column:
                def one(at: Column, c: Column) -> Column:
                    size = F.coalesce(F.get(os, c + 1), F.size(ms)) - at
                    group, far = F.slice(ms, at + 1, size), F.slice(reach, at + 1, size)
                    return F.when(size == 1, group).when(size <= _ONE_BY_ONE, let(group, _one_by_one)).otherwise(
                        let(group, lambda g: let(far, lambda r: _in_rounds(g, r)))
                    )

                return F.sort_array(F.flatten(F.transform(os, one)))

            return let(opens, each)

        ends = F.transform(ms, lambda m: m["end"].cast("bigint"))
        return F.when(F.size(ms) <= 1, ms).otherwise(let(prefix_maxima(ends), clusters))

    return let(matches, resolve)
