"""Operator 7: n-gram Jaccard join on token-combination prefixes.

The tokens of a document are its distinct word shingles.  Rare tokens come first in the global order;
of a document's prefix, rare tokens are indexed one by one, frequent ones in pairs within hashed classes.
The prefix grows until every similar document must share an index entry: with ``p`` rare tokens and
``q_c`` frequent ones in class c it must reach ``p + sum(max(0, q_c - 1)) > n - ceil(t n)``, since that
many tokens may be missing from the other document.  Tokens that one document alone holds count for
the prefix and need no entry, so most documents leave the join before any pair is formed.

Document frequencies are counted over a fixed share of the hash space that comes first in the order
and holds every prefix; a document with too few tokens there uses all of its tokens.  Documents with
equal token sets are one class.  Entries join classes into clusters, a class is compared with the first
class of its entries, and what is not yet linked within a cluster is compared in blocks, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_pass, components, fresh, grouped_pass, local_roots, sized, spaced, table, utf8

#: Tokens of at most so many classes are rare: an entry of theirs never joins more classes.
RARE = 64
#: Tokens of more classes than this, and than a thousandth of all, are counted and told apart beforehand.
HEAVY = 4096
#: Classes of a block of a cluster.
BLOCK = 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``size`` make one shingle."""
    import xxhash

    split = spaced(text)
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    take = min(size, len(h))
    n = len(h) - take + 1
    total = np.full(n, take, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(take):
            total = _mix(total * _ODD[k % len(_ODD)] + h[k : k + n])
    return np.unique(total)


def _missing(n: int, percent: int) -> int:
    """Tokens of n that a similar document may lack."""
    return n - -(-percent * n // 100)


def _bands(n: int, percent: int) -> list[int]:
    """Powers of two that a similar document's size may fall into."""
    low, high = -(-percent * n // 100), n * 100 // percent
    return list(range(max(low, 1).bit_length() - 1, high.bit_length()))


def _classes_of(band: int, percent: int) -> int:
    """Hashed classes of frequent tokens in a band: about a quarter of the tokens that may be missing."""
    return max(1, (100 - percent) * (1 << band) // 400)


def _need(n: int, percent: int) -> int:
    return _missing(n, percent) + 1 + max(_classes_of(b, percent) for b in _bands(n, percent))


def _edge(percent: int) -> np.uint64:
    """Tokens below this hash come first in the order; they hold the prefix of all but small documents."""
    return np.uint64(min(int(min(1.0, (100 - percent) / 100 * 1.7) * 2**64), 2**64 - 1))


def entries(n: int, alone: tuple[int, int], tokens: np.ndarray, df: np.ndarray, percent: int) -> list[int]:
    """Index entries of a document of n tokens.

    ``tokens`` are those that other documents count too, with the number ``df`` of documents, in the
    global order: first those below the edge, then the others, each by frequency and hash.  ``alone``
    tells how many tokens of either part no other document counts; these come first in their part.
    """
    must = _missing(n, percent) + 1
    if alone[0] >= must:
        return []
    inside = int((tokens < _edge(percent)).sum())
    out: set[int] = set()
    for band in _bands(n, percent):
        classes, reach, held = _classes_of(band, percent), alone[0], {}
        for place, (token, count) in enumerate(zip(tokens.tolist(), df.tolist())):
            reach += alone[1] if place == inside else 0
            if reach >= must:
                break
            if count <= RARE:
                reach += 1
                out.add(hash((band, token)))
            else:
                group = held.setdefault(token % classes, [])
                reach += bool(group)
                out.update(hash((band, other, token)) for other in group)
                group.append(token)
    return list(out)


def _by_number(number: np.ndarray, count: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Columns split by the number of each row; numbers that do not occur are left out."""
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(count + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[k] : cuts[k + 1]]
        yield (k, *(c[rows].tobytes() for c in columns))


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _read(texts: DataFrame, kind: str, size: int, percent: int) -> DataFrame:
    """(row, id, n, name, countable) of every row: number, digest and countable part of its tokens."""
    edge = _edge(percent)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                numbers, names, countable = [], [], []
                for text in part.column(2).to_pylist():
                    u = shingles(text, size)
                    numbers.append(len(u))
                    if not len(u):
                        names.append(None)
                        countable.append(None)
                        continue
                    names.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    first = u[: np.searchsorted(u, edge)]
                    countable.append((first if len(first) >= _need(len(u), percent) else u).tobytes())
                yield {"row": part.column(0), "id": part.column(1), "n": numbers, "name": names, "countable": countable}

    return arrow_pass(texts, step, f"row long, id {kind}, n long, name binary, countable binary")


def _heavy(classes: DataFrame, ranges: int, above: int) -> dict[int, int]:
    """Tokens of more than ``above`` classes with that number.

    Each task sums its batches first.  There are at most (all countable tokens) / above such tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            tokens, n = np.unique(_joined(batch.column(0), np.uint64), return_counts=True)
            parts = list(_by_number((tokens % np.uint64(ranges)).astype(np.int64), ranges, tokens, n.astype(np.int64)))
            yield dict(zip(("range", "tokens", "n"), map(list, zip(*parts)))) if parts else {"range": [], "tokens": [], "n": []}

    def add(group: pa.Table) -> dict:
        tokens, n = _joined(group.column("tokens"), np.uint64), _joined(group.column("n"), np.int64)
        distinct, place = np.unique(tokens, return_inverse=True)
        total = np.bincount(place, n).astype(np.int64)
        keep = total > above
        return {"token": distinct[keep].view(np.int64), "n": total[keep]}

    parts = arrow_pass(classes.select("countable"), count, "range int, tokens binary, n binary")
    found = grouped_pass(parts, ["range"], add, "token long, n long").collect()
    return {r["token"]: r["n"] for r in found}


def _entries(classes: DataFrame, ranges: int, homes: int, heavy: dict[int, int], percent: int) -> DataFrame:
    """(entry, rep): the index entries of the classes that may have a partner."""
    sc = classes.sparkSession.sparkContext
    listed = np.array(sorted(heavy), np.int64)
    known = sc.broadcast((listed.view(np.uint64), np.array([heavy[t] for t in listed.tolist()], np.int64)))
    names = ("range", "tokens", "reps")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        order = np.sort(known.value[0])
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            tokens = np.frombuffer(b"".join(blobs), np.uint64)
            reps = np.repeat(batch.column(0).to_numpy(), [len(b) // 8 for b in blobs])
            light = ~np.isin(tokens, order) if len(order) else np.ones(len(tokens), bool)
            tokens, reps = tokens[light], reps[light]
            parts = list(_by_number((tokens % np.uint64(ranges)).astype(np.int64), ranges, tokens, reps))
            yield dict(zip(names, map(list, zip(*parts)))) if parts else {n: [] for n in names}

    def home(reps: np.ndarray) -> np.ndarray:
        return (_mix(reps.view(np.uint64)) % np.uint64(homes)).astype(np.int64)

    def shared(group: pa.Table) -> dict:
        """Tokens of two classes and more, sent back to the homes of their classes."""
        tokens, reps = _joined(group.column("tokens"), np.uint64), _joined(group.column("reps"), np.int64)
        _, place, n = np.unique(tokens, return_inverse=True, return_counts=True)
        keep = n[place] > 1
        parts = list(_by_number(home(reps[keep]), homes, reps[keep], tokens[keep], n[place][keep].astype(np.int64)))
        return _sent(parts, "token")

    def _sent(parts: list, what: str) -> dict:
        cols = list(zip(*parts)) if parts else [[], [], [], []]
        return {"home": list(cols[0]), "what": [what] * len(parts), "reps": list(cols[1]), "a": list(cols[2]), "b": list(cols[3])}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Sizes of the classes with their countable tokens below and beyond the edge; their heavy tokens."""
        keys, counts = known.value
        rank = np.argsort(keys)
        keys, counts = keys[rank], counts[rank]
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            reps, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            held = np.array([len(b) // 8 for b in blobs], np.int64)
            below = np.array([np.searchsorted(np.frombuffer(b, np.uint64), _edge(percent)) for b in blobs], np.int64)
            yield _sent(list(_by_number(home(reps), homes, reps, n, below << 32 | (held - below))), "size")
            if not len(keys):
                continue
            tokens, owner = np.frombuffer(b"".join(blobs), np.uint64), np.repeat(reps, held)
            place = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
            hot = keys[place] == tokens
            yield _sent(list(_by_number(home(owner[hot]), homes, owner[hot], tokens[hot], counts[place[hot]])), "token")

    def choose(group: pa.Table) -> dict:
        what = np.array(group.column("what").to_pylist())
        sizes, links = group.filter(pa.array(what == "size")), group.filter(pa.array(what == "token"))
        reps, n, held = (_joined(sizes.column(c), np.int64) for c in ("reps", "a", "b"))
        owner, df = _joined(links.column("reps"), np.int64), _joined(links.column("b"), np.int64)
        tokens = _joined(links.column("a"), np.uint64)
        order = np.lexsort((tokens, df, tokens >= _edge(percent), owner))
        owner, df, tokens = owner[order], df[order], tokens[order]
        left, right = np.searchsorted(owner, reps), np.searchsorted(owner, reps, side="right")
        out_entry, out_rep = [], []
        for rep, size, parts, a, b in zip(reps.tolist(), n.tolist(), held.tolist(), left.tolist(), right.tolist()):
            if b == a:
                continue
            inside = int((tokens[a:b] < _edge(percent)).sum())
            alone = ((parts >> 32) - inside, (parts & 0xFFFFFFFF) - (b - a - inside))
            found = entries(size, alone, tokens[a:b], df[a:b], percent)
            out_entry += found
            out_rep += [rep] * len(found)
        return {"entry": out_entry, "rep": out_rep}

    dealt = arrow_pass(classes.select("rep", "countable"), deal, "range int, tokens binary, reps binary")
    schema = "home int, what string, reps binary, a binary, b binary"
    back = grouped_pass(dealt, ["range"], shared, schema)
    sent = back.union(arrow_pass(classes.select("rep", "countable", "n"), own, schema))
    return grouped_pass(sent, ["home"], choose, "entry long, rep long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose token sets are similar."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("s"), F.col("n").alias("na")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("t"), F.col("n").alias("nb")), "b")
    both = both.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = (batch.column(c).to_pylist() for c in (2, 3))
            keep = np.array([_similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent) for s, t in zip(*sets)], bool)
            yield {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    return arrow_pass(both.select("a", "b", "s", "t"), step, "a long, b long")


def _block_links(rest: list[np.ndarray], all_: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``rest``, the places in ``all_`` it is similar to, by counts over shared tokens."""
    sizes = np.array([len(s) for s in all_], np.int64)
    tokens = np.concatenate(all_)
    owner = np.repeat(np.arange(len(all_)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for k, own in enumerate(rest):
        a, b = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
        length = b - a
        total = int(length.sum())
        if not total:
            continue
        place = np.arange(total) + np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        both = np.bincount(owner[place], minlength=len(all_))
        yield k, np.flatnonzero((both > 0) & (100 * both >= percent * (len(own) + sizes - both)))


def _rest_links(clusters: DataFrame, linked: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between what a cluster's largest component holds and the rest, and within the rest.

    A cluster is cut into blocks: parts of the rest against parts of all.  Blocks of small clusters share
    a group.  Only spanning edges leave a block.
    """
    roots = scratch.put(components(linked, scratch))
    labelled = scratch.put(
        clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("root", "rep")).drop("root")
    )
    parts = labelled.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    shape = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("top"))
    shape = scratch.put(shape.where(F.col("n") > F.col("top.n")).select(
        "cluster", F.col("top.part").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("cuts"),
        F.ceil(F.col("n") / BLOCK).alias("slices"),
    ))
    placed = labelled.join(shape, "cluster")
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = placed.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).withColumn("slice", spread("slices"))
    rest = placed.where("part <> main").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("cut", spread("cuts"))
    columns = ["rep", "part", "cluster", "cut", "slice"]
    rows = every.select(*columns, F.lit(False).alias("rest")).union(rest.select(*columns, F.lit(True).alias("rest")))
    rows = scratch.put(rows)
    groups = max(int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // (2 * BLOCK))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("cluster", "cut", "slice"), F.lit(groups)))

    def compare(group: pa.Table) -> dict:
        key = np.stack([group.column(c).to_numpy() for c in ("cluster", "cut", "slice")])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        edge = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        part = group.column("part").to_numpy()[order]
        is_rest = group.column("rest").to_numpy(zero_copy_only=False)[order]
        blobs = group.column("tokens").take(pa.array(order)).to_pylist()
        out_a, out_b = [], []
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
            r, e = a + np.flatnonzero(is_rest[a:b]), a + np.flatnonzero(~is_rest[a:b])
            if not len(r) or not len(e):
                continue
            sets = {k: np.frombuffer(blobs[k], np.uint64) for k in range(a, b)}
            # A part is named by its first class, and its classes are linked already: parts are what is joined here.
            names, place = np.unique(part[a:b], return_inverse=True)
            left, right = [], []
            for k, hits in _block_links([sets[k] for k in r], [sets[k] for k in e], percent):
                own, met = place[r[k] - a], np.unique(place[e[hits] - a])
                met = met[met != own]
                left.append(np.full(len(met), own))
                right.append(met)
            if not left:
                continue
            root = local_roots(len(names), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(names)))
            out_a += names[moved].tolist()
            out_b += names[root[moved]].tolist()
        return {"a": out_a, "b": out_b}

    return grouped_pass(rows.join(sets.select("rep", "tokens"), "rep"), ["group"], compare, "a long, b long")


def near_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85,
) -> DataFrame:
    """(row, id, n_shingles, component_id, kept) for every row.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets; ``component_id``
    is the smallest id reachable by links.  A text without words, null included, has the empty set and
    links with nothing.  ``kept`` marks one row of each component, the first by id (null first) and row,
    and every row without words.  Rows that share an id are documents each; null ids rank above all others in
    ``component_id``.  ``row`` is a number that each row gets once, stored with its text, so that later jobs
    read the same rows under it however ``docs`` is split then.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "texts")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return _near(scratch.put(texts), size, percent, scratch).withColumnRenamed("id", id_col)


def _near(texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """``near_texts`` of stored rows (row, id, text)."""
    spark = texts.sparkSession
    read = scratch.put(_read(texts, dict(texts.dtypes)["id"], size, percent))
    classes = read.where("n > 0").groupBy("name").agg(
        F.first("n").alias("n"), F.first("countable").alias("countable"), F.min("row").alias("row"), F.min("id").alias("least")
    )
    classes = scratch.put(classes.withColumn("rep", F.monotonically_increasing_id()))
    total = classes.agg(F.count("*").alias("n"), F.sum(F.octet_length("countable")).alias("b")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(tasks, (total["b"] or 0) // (16 << 20))
    homes = max(tasks, total["n"] // 20_000)
    heavy = _heavy(classes, ranges, max(HEAVY, total["n"] // 1000))
    found = scratch.put(_entries(classes, ranges, homes, heavy, percent))
    shared = scratch.put(found.groupBy("entry").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    stars = scratch.put(found.join(shared, "entry").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct())
    scratch.drop(found)
    clusters = scratch.put(components(stars, scratch))
    wanted = clusters.select(F.col("node").alias("rep")).join(classes.select("rep", "row"), "rep")
    wanted = scratch.put(wanted)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield {"rep": batch.column(0), "n": [len(s) for s in sets], "tokens": [s.tobytes() for s in sets]}

    again = texts.select("row", "text").join(sized(wanted, 32), "row").select("rep", "text")
    sets = scratch.put(arrow_pass(again, whole, "rep long, n long, tokens binary"))
    nearest = stars.groupBy("a").agg(F.min("b").alias("b"))
    linked = scratch.put(_verified(nearest, sets, percent))
    more = scratch.put(_rest_links(clusters, linked, sets, percent, scratch))
    roots = scratch.put(components(linked.union(more), scratch))
    named = classes.select("name", "rep", "least").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.put(named.withColumn("root", F.coalesce("root", "rep")))
    least = scratch.put(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = scratch.put(named.join(least, "root").select("name", "root", "component_id"))
    rows = read.select("row", "id", "n", "name").join(named, "name", "left")
    rows = scratch.put(rows)
    for step in (sets, read, texts):
        scratch.drop(step)
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "row")).alias("f")).select(F.col("f.row").alias("keeper"))
    rows = rows.join(scratch.put(first), F.col("row") == F.col("keeper"), "left")
    return rows.select(
        "row", "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        (F.col("keeper").isNotNull() | (F.col("n") == 0)).alias("kept"),
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_texts`` keeps, all columns kept."""
    row, scratch = fresh(docs, "row"), Scratch(docs.sparkSession, "kept")
    stored = scratch.put(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = stored.select(F.col(f"`{row}`").alias("row"), F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    found = scratch.put(_near(texts, size, percent, scratch).where("not kept").select(F.col("row").alias(row)))
    return stored.join(sized(found, 16), row, "left_anti").drop(row).select(docs.columns)


def op7_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all ``documents`` at a Jaccard similarity of 0.85 on four-word shingles."""
    found = near_texts(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")
