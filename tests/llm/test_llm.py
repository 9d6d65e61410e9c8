"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstream.llm import (
    common, decontamination, embedding_dedup, licenses, line_dedup, mixing, ngram_join, pii, quality, sharding, token_counts,
)
from lexstream.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f g"), (4, "word " * 3000), (5, "x" * 40000), (6, "a b c d e f g"),
    (6, "a b c d e f g"), (7, "Ünï cödé — 　 日本語 \U0001f600 \xa0 é \x1c \x85 end"), (8, "<|startoftext|>hi<|endoftext|> it's 42"),
    (9, "A  B\r\nC\n\nD"), (10, "\n"), (11, "aaaa@" * 50), (12, "1" * 5000 + ".1.1.1"),
]


# 8: token counts

def library_counts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_memo_is_bounded():
    """Texts without spaces are counted whole and not remembered."""
    import sys

    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("日本語の文章"), 3000)) for _ in range(40)] + ["a b c " * 100]
    count = token_counts.counter(token_counts.VOCABULARY)
    assert count([t.encode() for t in texts]) == library_counts(texts)
    memo = sys.modules[f"_token_memo_{token_counts.VOCABULARY}"]["memo"]
    assert max(map(len, memo), default=0) <= token_counts.MEMO_CHUNK and len(memo) <= token_counts.MEMO



def test_token_counts(spark, rows):
    got = {r["doc_id"]: r for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    want = library_counts([t for _, t in rows])
    for (i, t), n in zip(rows, want):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 2048)


def test_token_counts_odd(spark):
    out = token_counts.token_prefixes(docs_of(spark, ODD)).collect()
    want = Counter((i, len((t or "").encode()), n) for (i, t), n in zip(ODD, library_counts([t for _, t in ODD])))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want


def test_every_prefix(spark):
    text = "It's  Überraschung,\n1234 <|endoftext|>ok é́ the end"
    packed = bytes(token_counts.token_prefixes(docs_of(spark, [(1, text)])).first()["prefixes"])
    ends = range(len(text) + 1)
    want = library_counts([text[:k] for k in ends])
    assert [token_counts.tokens_of_prefix(text, packed, k) for k in ends] == want
    for budget in range(want[-1] + 2):
        k = token_counts.prefix_within(text, packed, budget)
        assert want[k] <= budget
        nxt = [e for e in ends if e > k and (e == len(text) or text[e].isspace()) and not text[e - 1].isspace()]
        assert not nxt or want[nxt[0]] > budget


def test_packed_counts():
    for counts in ([], [0, 3], [1, 255, 7, 70000], [254]):
        assert token_counts.unpacked(token_counts._packed(np.array(counts, np.int64))).tolist() == counts


# 10: sharding

def check_shards(out, ids, shards=8):
    assert Counter(r["doc_id"] for r in out) == Counter(ids)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards) and 0 <= r["shard"] < shards
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, rows):
    out = QUERIES["op10_sharding"](spark, SF).collect()
    check_shards(out, [i for i, _ in rows])
    text = dict(rows)
    for r in out:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
    again = QUERIES["op10_sharding"](spark, SF).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_sharding_grows(spark, docs):
    small = {r["doc_id"]: r for r in sharding.two_pass_shards(docs, 5).collect()}
    grown = {r["doc_id"]: r["shard"] for r in sharding.two_pass_shards(docs, 6).collect()}
    assert all(r["grown_shard"] == grown[i] for i, r in small.items())
    order = [r["doc_id"] for r in sorted(small.values(), key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)


def test_sharding_odd(spark, folder):
    clash = docs_of(spark, ODD + [(6, "same")] * 40).withColumn("bucket", F.lit("b")).withColumn("slot", F.lit(9)).withColumn("first", F.lit(1))
    out = sharding.two_pass_shards(clash, bucket_bytes=1000, path=f"{folder}/out")
    assert {"bucket", "first"} <= set(out.columns)
    check_shards(out.collect(), [i for i, _ in ODD] + [6] * 40)
    assert {r["_slot"] for r in out.collect()} == {9}
    assert sharding.two_pass_shards(clash.limit(0)).count() == 0


def test_sharding_of_derived_tables(spark, docs, rows):
    """Inputs behind a shuffle are split anew by each read; their slots have no gaps all the same."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    ids = [i for i, _ in rows]
    other = docs.select("doc_id", F.col("n_chars").alias("size"))
    for made in (docs.repartition("source", "doc_id"), docs.join(other.hint("merge"), "doc_id"), docs.orderBy("text", "doc_id")):
        out = sharding.two_pass_shards(made, bucket_bytes=20_000).collect()
        check_shards(out, ids)
        again = sharding.two_pass_shards(made, bucket_bytes=20_000).collect()
        assert {(r["doc_id"], r["shard"]) for r in out} == {(r["doc_id"], r["shard"]) for r in again}
    for c, v in old.items():
        spark.conf.set(c, v)


# 9: line dedup

def brute_lines(rows, min_chars=40, min_docs=5):
    blank = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(blank))
            if len(key) >= min_chars:
                held[key].add(i)
    low = lambda i: (i is not None, i or 0)
    last = {k: max(v, key=low) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [lower(x.strip(blank)) for x in lines]
        stay = [x for x, k in zip(lines, keys) if k not in last or last[k] == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def line_rows(spark, docs):
    marks = line_dedup.keep_bitmaps(docs)
    key = {(r["doc_id"], r["key"]): bytes(r["keep"]) for r in marks.collect()}
    out = []
    for r in docs.select("doc_id", F.xxhash64("text").alias("key"), "text").collect():
        n, dropped, stay = line_dedup.kept_text((r["text"] or "").encode(), key.get((r["doc_id"], r["key"])))
        out.append((r["doc_id"], n, dropped, hashlib.sha256(stay).hexdigest()))
    return Counter(out)


def test_line_dedup(spark, rows):
    got = Counter(tuple(r) for r in QUERIES["op9_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == brute_lines(rows)


def test_line_dedup_hot(spark):
    """One line in most documents spans many ranges; some lines repeat within a document."""
    hot, other = "the very same long line of more than forty characters", "Ä" * 41
    made = [(k, f"  {hot.upper() if k % 2 else hot}\t\nunique {k}\n{other if k % 50 == 0 else 'x'}\n{hot}") for k in range(300)]
    made += [(i, f"{t or ''}\n{hot}" if t else t) for i, t in ODD] + [(299, made[7][1]), (3, "y" * 39 + "\n" + "z" * 40)]
    made += [(k, "four documents hold this line, which is one too few for it") for k in (400, 401, 402, 403, 403)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert line_rows(spark, docs_of(spark, made)) == brute_lines(made)
        assert line_dedup.keep_bitmaps(docs_of(spark, made).limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# 6: decontamination

def brute_hits(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        x = words(t)
        size = min(window, len(x))
        if not size:
            continue
        grams = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add("null" if i is None else str(i))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit)


def test_decontamination(spark, rows):
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op6_decontamination"](spark, SF).collect()}
    assert got == {i: brute_hits(t, items) for i, t in rows}
    assert sum(v[4] for v in got.values()) > 0


ITEMS = [
    (1, "a b c d e f g h i j k l"), (2, "c d e f g h i j k l m n"), (3, "x y"), (4, "y"), (5, None), (6, ""), (7, "a b a b a b a b a b a b"),
    (8, "p q r"), (8, "q r s"), (None, "b a b"), (9, "Z z z z z z z z z z z"),
]
HIT = [
    (1, "0 a b c d e f g h i j k l m n 0"), (2, "a b c d e f g h i"), (3, "X, y!"), (4, "a b a b a b a b a b"), (5, "p q r s"),
    (6, None), (7, ""), (8, "z " * 30), (9, "x x y y"), (9, "x x y y"), (None, "q r s"), (10, "b a b a b"), (11, "c d e f g h i j k l " * 500),
]


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_decontamination_odd(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.matches(docs_of(spark, HIT), items, block_bytes=block).collect()
    got = Counter()
    for r in found:
        hit = {k for s in r["spans"] for k in range(s["a"], s["b"])}
        digest = hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()
        got[(r["doc_id"], r["n_words"], len(hit), len(r["items"]), digest, bool(hit))] += 1
    assert got == Counter((i, *brute_hits(t, ITEMS)) for i, t in HIT)


def test_blocks_of_items_over_a_derived_table(spark):
    """Several passes over rows behind a shuffle, split anew by each read, are united row by row."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    made = docs_of(spark, HIT * 30)
    made = made.join(made.select(F.col("doc_id").alias("other")).distinct(), F.col("doc_id").eqNullSafe(F.col("other"))).repartition("text")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    one, many = (
        Counter((r["doc_id"], r["n_words"], tuple(sorted(r["items"]))) for r in decontamination.matches(made, items, block_bytes=b).collect())
        for b in (4 << 20, 100)
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert one == many and sum(one.values()) == 30 * len(HIT)


def test_random_automaton():
    rng = np.random.default_rng(1)
    for _ in range(60):
        items = [[b"%d" % x for x in rng.integers(0, 3, rng.integers(0, 12))] for _ in range(5)]
        automaton = decontamination.Automaton(4)
        automaton.read(items)
        text = [b"%d" % x for x in rng.integers(0, 4, 60)]
        spans, found = automaton.spans(text)
        plain = [(k, " ".join(x.decode() for x in item)) for k, item in enumerate(items)]
        n, hit, count, digest, _ = brute_hits(" ".join(x.decode() for x in text), plain, 4)
        assert (sum(b - a for a, b in spans), len(found)) == (hit, count)
        assert hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest() == digest


def test_spans_removed(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    long = "Clean start, " + "pad " * 200 + "One two, three four five six seven eight nine ten! " + "more " * 200
    made = docs_of(spark, [(1, long), (2, "one two three four five six seven eight nine ten and more"), (3, None), (4, "clean")])
    out = {r["doc_id"]: r["text"] for r in decontamination.decontaminated(made, items).collect()}
    assert set(out) == {1, 3, 4} and out[3] is None and out[4] == "clean"
    assert out[1] == long.replace("One two, three four five six seven eight nine ten", "")
    assert decontamination.decontaminated(made, items.limit(0)).count() == 4


def test_decontaminated_in_blocks(spark):
    """A benchmark in blocks cuts and drops as one block does."""
    items = [(k, " ".join(f"w{k * 7 + j}" for j in range(20))) for k in range(12)]
    items = spark.createDataFrame(items, "item_id long, text string")
    run = lambda a, b: " ".join(f"w{j}" for j in range(a, b))
    pads = lambda n: " ".join(f"p{j}" for j in range(n))
    made = [(1, f"{pads(50)} {run(0, 90)} {pads(400)}"), (2, f"{run(0, 11)} {pads(80)} {run(40, 51)}"), (3, f"{run(7, 12)} {run(0, 20)} {run(12, 27)} {pads(300)}")]
    made = docs_of(spark, made + HIT).withColumn("spans", F.lit("s"))
    for window, coverage in ((10, 0.2), (10, 0.01), (5, 0.5), (10, 1.0)):
        one, many = (decontamination.decontaminated(made, items, window, coverage, block_bytes=b) for b in (4 << 20, 100))
        assert many.columns == made.columns
        assert Counter(tuple(r) for r in many.collect()) == Counter(tuple(r) for r in one.collect())


# 1: personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    text, out = text or "", []
    for m in EMAIL.finditer(text):
        out.append((m.start(), 0, m.end()))
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 4000) and all(len(p) < 4000 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(spark, rows):
    got = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute_pii(t)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in want) for x in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_pii_formats():
    rng = np.random.default_rng(5)
    alphabet = list("aZ0019.@-_+% ()4,é")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert pii.base_spans(text) == brute_pii(text), text
    for text in ("a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (437) 555-0689", "999.1.1.1", "x@y", "a@b.c."):
        assert pii.base_spans(text) == brute_pii(text)


def test_pii_patterns(spark):
    """Numbers after words that known phones follow are found; numbers elsewhere are not."""
    known = [(k, f"please call me at +1 (437) 555-0{k:03d} today or mail") for k in range(100, 120)]
    made = known + [(1, "please call me at 555-0777 today or mail"), (2, "there were 12345 sheep in 1999"), (3, None), (4, "")] + ODD
    out = pii.extract_pii(docs_of(spark, made)).collect()
    assert len(out) == len(made)
    new = {(r["doc_id"], s["start"], s["kind"], s["end"]) for r in out for s in r["spans"] if s not in r["base"]}
    assert new == {(1, 18, 3, 26)}
    assert pii.extract_pii(docs_of(spark, made).limit(0)).count() == 0
    assert pii.extract_pii(docs_of(spark, ODD[:6])).count() == 6


def test_pii_of_several_tokens(spark):
    known = [(k, f"please call me at +1 (437) 555-0{k:03d} today or mail") for k in range(100, 120)]
    long = "7" + "x" * 80
    made = known + [(1, "please call me at 030 1234 5678 today or mail"), (2, f"please call me at {long} today or mail")]
    out = pii.extract_pii(docs_of(spark, made)).collect()
    new = {(r["doc_id"], s["start"], s["kind"], s["end"]) for r in out for s in r["spans"] if s not in r["base"]}
    assert new == {(1, 18, 3, 31), (2, 18, 3, 18 + len(long))}


def test_pii_contexts_of_whole_words():
    """Words and gaps of any length are walked; shapes keep the lengths of digit groups."""
    long, gap = "w" * 500, " " * 700
    text = f"one two{gap}{long} 555-0777{gap}after, {long}!"
    at = text.index("555")
    assert pii._near(text, at, at + 8) == (["one", "two", f"#{pii._name(long)}"], ["after", f"#{pii._name(long)}"])
    assert pii._near("x 1", 2, 3) == (["x"], []) and pii._near("1", 0, 1) == ([], [])
    assert pii._near("-- a ... b , 7 !!! c", 13, 14) == (["a", "b"], ["c"])
    assert [pii._shape(x) for x in ("+1 (437) 555-0123", "ab12.x9", "9" * 60)] == ["+9-999-999-9999", "a99-a9", "long"]


def test_pii_induced_patterns(spark):
    """A free place, the shape and words behind tell unseen identifiers from other numbers."""
    rng = np.random.default_rng(3)
    fill = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    known = [(k, f"{fill()} {fill()} card {fill()} 4111 1111 1111 {n} is {fill()}") for k, n in enumerate(range(1111, 9999, 7), 100)]
    known = [(k, t) for k, t in known if pii.base_spans(t)][:40]
    made = known + [(1, f"{fill()} card {fill()} 4111 1111 1111 1112 is {fill()}"), (2, f"{fill()} room {fill()} 4111 is {fill()}")]
    made += [(k, f"{fill()} page {fill()} {k} is {fill()}") for k in range(1000, 1060)]
    out = pii.extract_pii(docs_of(spark, made)).collect()
    new = {(r["doc_id"], s["kind"], s["end"] - s["start"]) for r in out for s in r["spans"] if s not in r["base"]}
    assert new == {(1, 2, 19)}


# 5: licenses

def brute_phrases(text):
    w = words(text)
    out = []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        out += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), sorted(out)


def brute_blocks(text, share=0.8):
    w = words(text)
    last = max(0, -(-(len(w) - 64) // 32)) * 32
    out = set()
    for start in range(0, last + 1, 32):
        block = set(w[start : start + 64])
        for label, notice in licenses.NOTICES:
            t = set(notice.split())
            if len(t & block) * 100 >= share * 100 * len(t):
                out.add((label, start, len(t & block) / len(t)))
    return out


def test_licenses(spark, rows):
    got = {r["doc_id"]: r for r in QUERIES["op5_licenses"](spark, SF).collect()}
    for i, t in rows:
        n, places = brute_phrases(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert r["labels"] == ",".join(sorted(base | {b[0] for b in brute_blocks(t)})) and 0 <= r["score"] <= 1


def test_licenses_odd(spark):
    notice = licenses.NOTICES[2][1]
    made = [
        (1, "the MIT\nLicense; " * 3), (2, "pad " * 31 + notice + " pad" * 100), (3, "pad " * 60 + "gnu general public license"),
        (4, " ".join(notice.split()[:-4])), (5, " ".join(notice.split()[:-2])), (6, "cc by " * 200), (7, "by cc, license mit gnu public general license"),
    ] + ODD
    out = licenses.license_blocks(docs_of(spark, made)).collect()
    got = Counter((r["doc_id"], r["n_words"], tuple((p["start"], p["label"]) for p in r["places"]), tuple(sorted((b["label"], b["start"], b["share"]) for b in r["blocks"]))) for r in out)
    assert got == Counter((i, n, tuple(p), tuple(sorted(brute_blocks(t)))) for i, t in made for n, p in [brute_phrases(t)])
    assert licenses.license_blocks(docs_of(spark, made).limit(0)).count() == 0


# 3: quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97


def test_quality_odd(spark, docs):
    made = docs_of(spark, ODD).withColumn("raw", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.learn(made, none, ~quality.held_out())
    assert [r["score"] for r in quality.quality_scores(made, net).collect()] == [0.5] * len(ODD)
    some = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    net = quality.learn(made, some, F.lit(True))
    out = quality.quality_scores(made, net).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.accepted(made, net).columns == made.columns
    empty = made.limit(0)
    assert quality.quality_scores(empty, quality.learn(empty, some, F.lit(True))).count() == 0


def test_word_classes_do_not_depend_on_the_place():
    texts = [b"", b"one two  two, one", b" two", b"one", b"one!!", b"\xc3\xa9 one"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    ids, first = quality.word_classes(raw, bounds)
    parts = [ids[a:b].tolist() for a, b in zip(first, list(first[1:-1]) + [len(ids)])]
    single = [quality.word_classes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist() for t in texts]
    assert parts == single
    one, two = single[3][0], single[2][0]
    assert parts[1][0] == one and parts[1][1] == two and parts[1][2] == 0 and parts[1][4] == one and parts[5][1] == one


# 4: mixing

def test_mixing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    membership, steps, members, totals = mixing.fitted(docs, labels)
    got = {r["doc_id"]: r for r in QUERIES["op4_mixing"](spark, sf).collect()}
    assert len(got) == docs.count() and min(r["rate"] for r in got.values()) >= 0
    for k, d in enumerate(mixing.DOMAINS):
        total = sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got.values())
        assert abs(total - totals["target"][k]) <= 2e-3 * totals["target"].sum()
    true = {r["doc_id"]: r["d"] for r in labels.withColumn("d", mixing.domain_of()).collect()}
    best = [int(np.argmax([r[f"p_{d}"] for d in mixing.DOMAINS])) == true[i] for i, r in got.items() if i in true]
    assert np.mean(best) > 0.95
    out = mixing.mixed(docs, membership, steps)
    n = Counter(r["doc_id"] for r in out.collect())
    kept = [i for i, d in true.items() if d == 0 and n[i]]
    assert out.columns == docs.columns and len(kept) >= 0.97 * sum(d == 0 for d in true.values())


def test_mixing_odd(spark):
    made = docs_of(spark, ODD).withColumn("draw", F.lit("d"))
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, None), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        membership, steps, members, _ = mixing.fitted(made, given)
        assert members.count() == len(ODD)
        out = mixing.mixed(made, membership, steps)
        assert out.columns == made.columns and out.count() >= 0
    membership, steps, members, totals = mixing.fitted(made.limit(0), labels)
    assert not steps and mixing.mixed(made.limit(0), membership, steps).count() == 0


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(int(t), [float(x) for x in p]) for t, p in zip(rng.integers(1, 500, 400), rng.dirichlet([0.3, 0.3, 0.3], 400))]
    members = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    steps, totals = mixing.fit_rates(members, (0.6, 0.3, 0.1))
    rate = mixing.replay(np.array([p for _, p in rows]), steps)
    got = (np.array([t for t, _ in rows]) * rate) @ np.array([p for _, p in rows])
    assert rate.min() >= 0 and np.abs(got - totals["target"]).max() <= 1e-3 * totals["target"].sum()


def test_scarce_domains_meet_their_weights(spark):
    rng = np.random.default_rng(9)
    alpha = [[200, 0.02, 0.3]] * 500 + [[0.5, 20, 0.5]] * 2 + [[0.5, 0.5, 20]] * 3
    rows = [(int(t), [float(x) for x in rng.dirichlet(a)]) for t, a in zip(rng.integers(50, 500, len(alpha)), alpha)]
    members = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    weights = np.array([0.7, 0.2, 0.1])
    p = np.array([p for _, p in rows])
    steps, totals = mixing.fit_rates(members, tuple(weights), max_rate=200.0, min_lead=0.0)
    got = (np.array([t for t, _ in rows]) * mixing.replay(p, steps, 200.0)) @ p
    assert totals["have"][1] < 0.05 * totals["have"].sum() and not totals["missed"].any()
    assert np.abs(got / got.sum() - weights).max() <= 1e-3
    # The scarce domain decides: the lead is thinned until rates within the bound meet the weights.
    steps, totals = mixing.fit_rates(members, tuple(weights), min_lead=0.0)
    rate = mixing.replay(p, steps)
    got = (np.array([t for t, _ in rows]) * rate) @ p
    assert 0 <= rate.min() and rate.max() <= mixing.MAX_RATE and np.abs(got / got.sum() - weights).max() <= 0.02
    # Thinning has a floor; below it the weight is missed, and said to be.
    steps, totals = mixing.fit_rates(members, tuple(weights))
    rate = mixing.replay(p, steps)
    got = (np.array([t for t, _ in rows]) * rate) @ p
    assert rate.max() <= mixing.MAX_RATE and totals["missed"][1] > 0.1 and got[0] >= 0.45 * totals["have"][0]
    # One row more does not switch anything.
    more = members.union(spark.createDataFrame([(5, [0.3, 0.68, 0.02])], members.schema))
    _, after = mixing.fit_rates(more, tuple(weights))
    assert np.abs(after["target"] - totals["target"]).max() < 30
    steps, totals = mixing.fit_rates(members, (0.99, 0.0, 0.01))
    got = (np.array([t for t, _ in rows]) * mixing.replay(p, steps)) @ p
    assert got[1] < totals["have"][1] and abs(got[2] / got.sum() - 0.01) < 5e-3


def test_copies_have_their_rates_as_mean():
    draws = np.arange(1000) / 1000
    for rate in (0.0, 0.03, 0.97, 1.03, 7.5):
        assert abs(mixing.copies(np.full(1000, rate), draws).mean() - rate) <= 1e-3


# 2: vectors

def brute_vectors(vectors):
    unit = {}
    for k, (_, v) in enumerate(vectors):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64) / np.abs(v).max()
            unit[k] = x / np.linalg.norm(x)
    links = defaultdict(set)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a].add(b)
                links[b].add(a)
    return links


def reach(n, links):
    seen, out = {}, []
    for k in range(n):
        if k not in seen:
            stack, group = [k], []
            seen[k] = k
            while stack:
                x = stack.pop()
                group.append(x)
                for y in links[x]:
                    if y not in seen:
                        seen[y] = k
                        stack.append(y)
            out.append(group)
    return out


def check_vectors(got, vectors):
    links = brute_vectors(vectors)
    want = Counter()
    for group in reach(len(vectors), links):
        least = min(vectors[k][0] for k in group)
        want.update((vectors[k][0], len(links[k]), least, vectors[k][0] == least) for k in group)
    assert Counter(tuple(r) for r in got) == want


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24))
    group = rng.normal(size=24)
    made = [*base, *(group + 0.05 * rng.normal(size=(150, 24))), *[base[7]] * 90, *(base[:60] + 0.1 * rng.normal(size=(60, 24)))]
    vectors = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(made)]
    vectors += [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] * 24), (905, [float("inf")] * 24)]
    vectors += [(906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1.0, -2.0]), (0, vectors[0][1]), (3, [-x for x in vectors[0][1]])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumn("class", F.lit(1)).repartition(5)
        check_vectors(embedding_dedup.near_vectors(df, recall=0.9999).collect(), vectors)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vector_recall(spark):
    """Pairs right above the threshold, the hardest ones, are found with the recall the tables are sized for."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(600, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9005, 0.93, (600, 1))
    made = np.vstack([a, cos * a + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(made)], "vec_id long, embedding array<double>")
    out = embedding_dedup.near_vectors(df).collect()
    assert sum(r["n_links"] for r in out) >= 0.9 * 1200


@pytest.mark.parametrize("kind", ["hot", "mean"])
def test_recall_away_from_the_mean(kind):
    """Tables are sized for vectors that centering turns apart: a hot group, or a mean that all share."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    made, centre = unit(rng.normal(size=(3000, 64))), unit(rng.normal(size=64))
    hot = slice(0, 1000)
    if kind == "hot":
        made[hot] = unit(np.sqrt(0.9) * centre + np.sqrt(0.1) * made[hot])
    else:
        made = unit(0.6 * centre + 0.8 * made)
    codes = embedding_dedup.learn_codes(made, 1_000_000, 0.9, 0.95)
    a = made[hot]
    aside = rng.normal(size=a.shape) if kind == "mean" else np.roll(a, 1, 0)
    b = 0.9 * a + np.sqrt(1 - 0.81) * unit(aside - (aside * a).sum(1, keepdims=True) * a)
    assert (codes.buckets(a) == codes.buckets(b)).any(1).mean() >= 0.92


def test_vector_query(spark):
    vectors = [tuple(r) for r in common.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    check_vectors(QUERIES["op2_embedding_dedup"](spark, SF).collect(), vectors)


# 7: n-gram join

def brute_near(rows, size, percent):
    sets = []
    for _, t in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    links, tried = defaultdict(set), set()
    for v in holders.values():
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        links[a].add(b)
                        links[b].add(a)
    return sets, reach(len(rows), links)


def check_near(got, rows, size=4, percent=85):
    sets, groups = brute_near(rows, size, percent)
    want = Counter()
    for group in groups:
        ids = [rows[k][0] for k in group]
        least = min([i for i in ids if i is not None], default=None)
        want.update((rows[k][0], len(sets[k]), least) for k in group)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_near_texts(spark, docs, rows):
    check_near(ngram_join.near_texts(docs).collect(), rows)


def test_near_copies_of_many_kinds(spark, monkeypatch):
    """Groups around the threshold, with frequent tokens, chains, and blocks smaller than the groups."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "RARE", 4)
    monkeypatch.setattr(ngram_join, "HEAVY", 25)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(400)]
    made = list(ODD)
    common_part = rng.choice(vocabulary, 60).tolist()
    for g in range(12):
        text = rng.choice(vocabulary, rng.integers(5, 120)).tolist()
        for k in range(int(rng.integers(2, 40))):
            if g % 3 == 0 and k % 2:
                text = list(text)
            copy = list(text)
            for _ in range(int(rng.integers(0, 1 + len(copy) // 25 + 1))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(vocabulary))
            if g % 3 == 0:
                text = copy
            made.append((100 * (g + 1) + k, " ".join(copy + (common_part if g % 4 == 1 else []))))
    made += [(5000 + k, "the same text in many copies of it") for k in range(50)] + [(6000 + k, "one") for k in range(3)]
    order = rng.permutation(len(made))
    made = [made[k] for k in order]
    df = docs_of(spark, made).withColumn("row", F.lit("r")).withColumn("rep", F.lit(1))
    for size, percent in ((4, 85), (5, 80), (2, 60)):
        check_near(ngram_join.near_texts(df, size=size, percent=percent).collect(), made, size, percent)
    out = ngram_join.without_near_copies(df)
    assert out.columns == df.columns
    assert out.count() == len(brute_near(made, 5, 80)[1])
    assert ngram_join.near_texts(df.limit(0)).count() == 0


def test_rows_keep_their_numbers(spark, folder, monkeypatch):
    """Files that later jobs deal to other partitions change no result."""
    made = [(k, " ".join(f"w{k // 2 * 40 + j}" for j in range(40)) + " x" * (k % 2)) for k in range(200)]
    docs_of(spark, made).repartition(12).write.parquet(f"{folder}/docs")
    df, plain, name = spark.read.parquet(f"{folder}/docs"), ngram_join.components, "spark.sql.files.minPartitionNum"

    def dealt_anew(edges, scratch):
        spark.conf.set(name, "1")
        return plain(edges, scratch)

    monkeypatch.setattr(ngram_join, "components", dealt_anew)
    try:
        check_near(ngram_join.near_texts(df).collect(), made)
        spark.conf.unset(name)
        out = ngram_join.without_near_copies(df).collect()
    finally:
        spark.conf.unset(name)
    assert sorted(r["doc_id"] // 2 for r in out) == list(range(100))


# All

def test_components(spark):
    scratch = common.Scratch(spark, "test")
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 100)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in (100, 101, 102, 200)} | {300 + k: 300 for k in range(30)}
    assert got == want


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
