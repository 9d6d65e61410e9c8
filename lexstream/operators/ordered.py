"""Running values over the rows of a key in their order, in one pass over the rows.

A plain window sorts each key in one task.  Here the keys with more rows than a part may have are cut at
places of their own order: a bounded sample of the rows tells which keys these are and where they divide
into parts of about equal size, whatever type the order has and however sparse it is.  The window runs
inside (key, part), which is the only exchange of the rows; a hot key's parts give one summary each, the
summaries are combined in the order of the parts by the operation of the value (sum, maximum, last value, or
the pair of a sum and a maximum), and what comes before a part is joined back by broadcast.  Keys of usual
size have one part and no summary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key that one task sorts; keys with more are cut.
PART_ROWS = 1 << 20
#: A key has at most about so many parts, so that the sample and the summaries stay bounded.
MAX_PARTS = 4096
#: Sampled rows for each part.
SAMPLED = 16
_GROUP = 64
PART = "__part"


def order_of(order: list[str]) -> Column:
    """The order columns as one comparable value, nulls first."""
    return F.struct(*[F.col(f"`{c}`") for c in order])


def _same(keys: list[str], other: list[str]) -> Column:
    same = F.lit(True)
    for k, o in zip(keys, other):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(o))
    return same


@dataclass
class Layout:
    """Where the keys with many rows are cut: (key values, order values of the cuts, ascending)."""

    keys: list[str]
    order: list[str]
    hot: list[tuple[tuple, list[tuple]]] = field(default_factory=list)

    def parted(self, df: DataFrame) -> DataFrame:
        """Add ``__part``: the number of cuts of the row's key up to its place, 0 for keys that are not cut."""
        if not self.hot:
            return df.withColumn(PART, F.lit(0))
        place = T.StructType([T.StructField(f"o{i}", df.schema[c].dataType) for i, c in enumerate(self.order)])
        group = T.StructType([T.StructField("base", T.IntegerType()), T.StructField("at", T.ArrayType(place))])
        names = [f"__cut{i}" for i in range(len(self.keys))]
        fields = [T.StructField(n, df.schema[k].dataType) for n, k in zip(names, self.keys)]
        rows = [
            (*key, [(i, cuts[i:i + _GROUP]) for i in range(0, len(cuts), _GROUP)]) for key, cuts in self.hot
        ]
        cuts = df.sparkSession.createDataFrame(rows, T.StructType([*fields, T.StructField("__cuts", T.ArrayType(group))]))
        # Cuts of all keys together are at most the sample, some MAX_PARTS entries.
        d = df.join(F.broadcast(cuts), _same(self.keys, names), "left").drop(*names)
        here = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(self.order)])
        before = F.filter("__cuts", lambda g: F.get(g["at"], F.lit(0)) <= here)
        last = F.get(before, F.size(before) - 1)
        part = last["base"] + F.size(F.filter(last["at"], lambda c: c <= here))
        return d.withColumn(PART, F.coalesce(part, F.lit(0))).drop("__cuts")

    def only_hot(self, df: DataFrame) -> DataFrame:
        """The rows of the keys that are cut."""
        names = [f"__cut{i}" for i in range(len(self.keys))]
        fields = [T.StructField(n, df.schema[k].dataType) for n, k in zip(names, self.keys)]
        keys = df.sparkSession.createDataFrame([k for k, _ in self.hot], T.StructType(fields))
        return df.join(F.broadcast(keys), _same(self.keys, names), "left_semi")


def layout(df: DataFrame, keys: list[str], order: list[str], rows: int = PART_ROWS) -> Layout:
    """Count the rows, and where a key may have too many of them, sample keys and order by a hash.

    The sample holds some ``SAMPLED * MAX_PARTS`` rows at most, whatever the size of the table; it decides
    only where keys are cut, not what comes out.  Nothing is sampled where all rows fit in one part.
    """
    out = Layout(keys, order)
    total = df.count()
    if total <= rows:
        return out
    every = max(1, max(rows, total // MAX_PARTS) // SAMPLED)
    columns = list(dict.fromkeys([*keys, *order]))
    picked = df.select(*[F.col(f"`{c}`") for c in columns]).where(
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(every)) == 0
    )
    places: dict[tuple, list] = {}
    listed = picked.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.array_sort(F.collect_set(order_of(order))).alias("__places"), F.count("*").alias("__n")
    ).where(F.col("__n") > SAMPLED)
    for row in listed.collect():
        at = row["__places"]
        step = max(1, round(len(at) * SAMPLED / row["__n"]))
        places[tuple(row[k] for k in keys)] = [tuple(p) for p in at[step // 2::step]]
    out.hot = [(k, v) for k, v in places.items() if v]
    return out


# Values ------------------------------------------------------------------------------------------


class Running:
    """A value over the rows of a key up to a row; ``inclusive`` counts the row itself."""

    def __init__(self, value: Column, inclusive: bool = True) -> None:
        self.value, self.inclusive = value, inclusive

    def prepare(self, d: DataFrame, name: str, window) -> DataFrame:
        return d.withColumn(f"__v_{name}", self.value)

    def frame(self, window):
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow if self.inclusive else -1)


class Sum(Running):
    """Running sum, 0 before the first value."""

    def local(self, d, name, window):
        inner = F.sum(f"__v_{name}").over(self.frame(window))
        return d.withColumn(name, F.coalesce(inner, F.lit(0)))

    def summary(self, name, place):
        return [F.sum(f"__v_{name}").alias(f"__s_{name}")]

    def carry(self, d, name, before):
        return d.withColumn(f"__c_{name}", F.sum(f"__s_{name}").over(before))

    def joined(self, name):
        return F.col(name) + F.coalesce(f"__c_{name}", F.lit(0))


class Max(Running):
    """Running maximum, null before the first value."""

    def local(self, d, name, window):
        return d.withColumn(name, F.max(f"__v_{name}").over(self.frame(window)))

    def summary(self, name, place):
        return [F.max(f"__v_{name}").alias(f"__s_{name}")]

    def carry(self, d, name, before):
        return d.withColumn(f"__c_{name}", F.max(f"__s_{name}").over(before))

    def joined(self, name):
        return F.greatest(name, f"__c_{name}")


class Last(Running):
    """The last value that is not null; a struct keeps nulls of its fields."""

    def local(self, d, name, window):
        return d.withColumn(name, F.last(f"__v_{name}", ignorenulls=True).over(self.frame(window)))

    def summary(self, name, place):
        seen = F.col(f"__v_{name}").isNotNull()
        return [F.max_by(f"__v_{name}", F.when(seen, place)).alias(f"__s_{name}")]

    def carry(self, d, name, before):
        return d.withColumn(f"__c_{name}", F.last(f"__s_{name}", ignorenulls=True).over(before))

    def joined(self, name):
        return F.coalesce(name, f"__c_{name}")


class Finish(Running):
    """When things that wait for each other are done: finish = max(available, finish before) + duration.

    With S the running sum of durations this is S + running maximum of (available - S before the row);
    a part is summarised by its sum and that maximum, and two parts combine by adding and shifting.
    """

    def __init__(self, available: Column, duration: Column) -> None:
        super().__init__(available)
        self.duration = duration

    def prepare(self, d, name, window):
        d = d.withColumn(f"__v_{name}", self.value).withColumn(f"__d_{name}", self.duration)
        d = d.withColumn(f"__t_{name}", F.sum(f"__d_{name}").over(self.frame(window)))
        slack = F.col(f"__v_{name}") - (F.col(f"__t_{name}") - F.col(f"__d_{name}"))
        return d.withColumn(f"__v_{name}", slack)

    def local(self, d, name, window):
        return d.withColumn(name, F.max(f"__v_{name}").over(self.frame(window)))

    def summary(self, name, place):
        return [F.sum(f"__d_{name}").alias(f"__s_{name}"), F.max(f"__v_{name}").alias(f"__m_{name}")]

    def carry(self, d, name, before):
        d = d.withColumn(f"__c_{name}", F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)))
        # A part sees its slack from its own start; seen from the start of the key it shrinks by what came before.
        d = d.withColumn(f"__m_{name}", F.col(f"__m_{name}") - F.col(f"__c_{name}"))
        return d.withColumn(f"__m_{name}", F.max(f"__m_{name}").over(before))

    def joined(self, name):
        spent = F.coalesce(f"__c_{name}", F.lit(0))
        return F.greatest(F.col(name) - spent, F.col(f"__m_{name}")) + spent + F.col(f"__t_{name}")


def scan(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running], rows: int = PART_ROWS,
    cut: Layout | None = None,
) -> DataFrame:
    """Add the running ``values`` to the rows.  ``cut`` reuses the layout of rows with the same keys and order;
    rows that still hold their part from ``cut.parted`` stay where they are, so scans in a row share an exchange.

    Null keys are a key; null orders come first.  Rows of equal order count in any order among themselves.
    """
    cut = cut or layout(df, keys, order, rows)
    given = PART in df.columns
    d = df if given else cut.parted(df)
    quoted = [F.col(f"`{k}`") for k in keys]
    inner = Window.partitionBy(*quoted, *([PART] if cut.hot else [])).orderBy(*[F.col(f"`{c}`") for c in order])
    for name, value in values.items():
        d = value.prepare(d, name, inner)
    base = d
    for name, value in values.items():
        d = value.local(d, name, inner)
    helpers = [] if given else [PART]
    if cut.hot:
        place = order_of(order)
        sums = cut.only_hot(base).groupBy(*quoted, PART).agg(*[c for n, v in values.items() for c in v.summary(n, place)])
        before = Window.partitionBy(*quoted).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        for name, value in values.items():
            sums = value.carry(sums, name, before)
        names = [f"__on{i}" for i in range(len(keys))]
        carried = [c for n in values for c in (f"__c_{n}", f"__m_{n}") if c in sums.columns]
        side = sums.select(
            *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(PART).alias("__on_part"), *carried
        )
        # One row for each part of a cut key, some MAX_PARTS at most.
        d = d.join(F.broadcast(side), _same(keys, names) & (F.col(PART) == F.col("__on_part")), "left")
        helpers += [*names, "__on_part", *carried]
        d = d.withColumns({n: v.joined(n) for n, v in values.items()})
    else:
        d = d.withColumns({n: F.col(n) + F.col(f"__t_{n}") for n, v in values.items() if isinstance(v, Finish)})
    helpers += [f"__{kind}_{n}" for n in values for kind in "vdt"]
    return d.drop(*helpers)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, **options) -> DataFrame:
    """``row_number`` from 1."""
    return scan(df, keys, order, {name: Sum(F.lit(1).cast("bigint"))}, **options)


def previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], **options) -> DataFrame:
    """``lag`` by one row of several columns, under the given names."""
    row = F.struct(*[c.alias(n) for n, c in values.items()])
    d = scan(df, keys, order, {"__row": Last(row, inclusive=False)}, **options)
    return d.withColumns({n: F.col("__row")[n] for n in values}).drop("__row")
