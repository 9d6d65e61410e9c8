"""Golden rows of the text functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexstream.functions import normalize as nz
from lexstream.functions import patterns as pt
from lexstream.functions import text as tx
from lexstream.functions import timing as tm
from lexstream.operators import quality as ql


def one(spark, value, *cols, schema="c string"):
    return spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema).select(*cols).first()


@pytest.mark.parametrize(
    "text,lang,tokens",
    [
        ("Mưa to quá, về nhà!", "vi", ["Mưa", "to", "quá", ",", "về", "nhà", "!"]),
        ("雨停了吗？", "zh", list("雨停了吗？")),
        ("she's far-off ’twas", "en", ["she's", "far-off", "’", "twas"]),
        ("", "en", []),
    ],
)
def test_tokens_and_back(spark, text, lang, tokens):
    toks = tx.tokenize("c", F.lit(lang))
    got, back = one(spark, text, toks, tx.detokenize(toks, F.lit(lang)))
    assert got == tokens
    assert back == (text if "’" not in text else "she's far-off ’ twas")


@pytest.mark.parametrize(
    "text,n",
    [
        ("Why not?!", 1), ("天黑了，", 0), ("他来了；", 0), ("A tale told by J. R. Lind.", 1),
        ("Mrs. Lee woke at 6.15 a.m.", 1), ("Dr. Ito wrote to Prof. Klein.", 1), ("It weighs 2.75.", 1),
        ("They flew to the U.K.", 1), ("Nr.Four is a room.", 1), ("PGS. TS. Lê Minh trả lời.", 1),
        ("They flew to the U.K. She stayed.", 2), ("Go. Stay? maybe", 2),
    ],
)
def test_sentence_counts(spark, text, n):
    assert one(spark, text, tx.count_sentences("c"))[0] == n


def test_sentence_pieces(spark):
    split = tx.split_sentences("c")
    assert one(spark, "雨停了。”走吧？好！", split)[0] == ["雨停了。”", "走吧？", "好！"]
    assert one(spark, "Snow fell.  Did it melt?\nperhaps", split)[0] == ["Snow fell.", "Did it melt?", "perhaps"]
    assert one(spark, "Go. Stay? maybe", tx.sentence_token_ends("c"))[0] == [2, 4]
    assert one(spark, "Ready. ", tx.ends_sentence("c"))[0] is True
    assert one(spark, "Ready. set", tx.ends_sentence("c"))[0] is False


@pytest.mark.parametrize(
    "source,translated,lang,want",
    [("Finished!", "Xong rồi", "vi", "Xong rồi!"), ("Run.)", "Chạy)", "vi", "Chạy.)"), ("Run.", "跑", "zh", "跑。"),
     ("so", " y ", "en", "y"), ("p!", "q?", "en", "q?")],
)
def test_restore(spark, source, translated, lang, want):
    got = one(spark, (source, translated), tx.restore_punctuation("s", "t", F.lit(lang)), schema="s string, t string")
    assert got[0] == want


def test_common_prefix(spark):
    got = one(spark, (["a", "b", "x"], ["a", "b", "y"]), tx.common_prefix("a", "b"), schema="a array<string>, b array<string>")
    assert got[0] == ["a", "b"]


def test_prefix_sums_over_many_blocks(spark):
    d = spark.range(1).select(tx.prefix_sums(F.sequence(F.lit(1), F.lit(1000))).alias("p"))
    assert d.first()[0] == [n * (n + 1) // 2 for n in range(1, 1001)]


def test_cut_equals_slice(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab😀é ") for _ in range(3000))
    spans = [(rng.randrange(3000), rng.randrange(1, 1200)) for _ in range(40)]
    spans = [(a, min(n, 3000 - a)) for a, n in spans]
    d = spark.createDataFrame([(text, spans)], "t string, s array<struct<a:int,n:int>>")
    got = d.select(tx.let(tx.pieces(F.col("t")), lambda ps: F.transform("s", lambda x: tx.cut(ps, x["a"], x["n"])))).first()[0]
    assert got == [text[a : a + n] for a, n in spans]


def test_normalize(spark):
    cols = (nz.normalize("c"), nz.normalize("c", False), nz.align_folded("c"))
    apart = lambda t: unicodedata.normalize("NFD", t)
    folded, cased, a = one(spark, apart("  tệp mới  "), *cols)
    assert folded == cased == "tệp mới"
    assert (a.starts[1], a.ends[1]) == (3, 6)
    assert one(spark, "Bay C4–09", nz.normalize("c", False))[0] == "Bay C4-09"
    assert one(spark, apart("도시"), nz.normalize("c"))[0] == "도시"
    assert one(spark, "Straße ΣΑΣ", nz.normalize("c"))[0] == "strasse σασ"


def test_native_normalization_equals_python(spark):
    rng = random.Random(1)
    chars = "aZéßÄ ŞşŁ \t\n–—-Ạ国비！1_.,’"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in d.select("c", nz.normalize("c").alias("f"), nz.normalize("c", False).alias("k")).collect():
        assert r.f == nz.align(r.c, True)[0] and r.k == nz.align(r.c, False)[0], r.c


def test_code_like(spark):
    d = spark.createDataFrame([(x,) for x in ["L8Wing", "HTTP", "FireWire", "kettle", "QWERTYUIO", "山", "y2"]], "c string")
    assert [r[0] for r in d.select(nz.looks_code_like("c")).collect()] == [True, True, True, False, False, False, True]


def test_sentence_case(spark):
    assert one(spark, "HELLO THERE. YES", tx.sentence_case("c", F.lit("en")))[0] == "Hello there. Yes"
    assert one(spark, "HELLO There.", tx.sentence_case("c", F.lit("en")))[0] == "HELLO There."
    assert one(spark, "HELLO.", tx.sentence_case("c", F.lit("zh")))[0] == "HELLO."


WORDS = "w array<struct<text:string,start:double,end:double,confidence:double>>"


def test_words(spark):
    w = [("b", 1.0, 2.0, None), (" a ", 0.0, 0.5, 0.9), ("x", -1.0, 1.0, None), ("y", 2.0, 2.0, None), ("z", float("nan"), 1.0, None)]
    got = one(spark, (w,), tm.valid_words(F.col("w")), schema=WORDS)[0]
    assert [(x.text, x.start, x.end, x.confidence) for x in got] == [("a", 0.0, 0.5, 0.9), ("b", 1.0, 2.0, None)]
    s = one(spark, (w[:2],), tm.strip_context(F.col("w"), F.lit("en"), F.lit(1.0)), schema=WORDS)[0]
    assert s.text == "b" and s.words[0].start == 0.0


def test_words_from_pieces(spark):
    rows = [(0, "▁he", 0.0), (1, "llo", 0.2), (2, "<unk>", 0.3), (3, "▁", 0.5), (4, "you", 0.6), (5, "▁!", 0.8)]
    d = spark.createDataFrame([(1, p, x, t, "en", 1.0) for p, x, t in rows],
                              "id int, pos int, piece string, at double, lang string, duration_s double")
    got = [(r.text, r.start, round(r.end, 3)) for r in tm.words_from_pieces(d, ["id"]).orderBy("pos").collect()]
    assert got == [("hello", 0.0, 0.44), ("you", 0.5, 1.0)]


def test_merge_lines(spark):
    s = "l array<struct<start:double,text:string>>"
    assert one(spark, ([(2.0, " b "), (1.0, "a"), (3.0, " ")],), tm.merge_lines(F.col("l")), schema=s)[0] == "a b"
    assert one(spark, ([(None, "new"), (None, "old")],), tm.merge_lines(F.col("l")), schema=s)[0] == "old new"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_equal_edit_distance(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    pairs = [(a, a[: rng.randint(0, 60)] + b) for a, b in zip(texts, reversed(texts))]
    d = spark.createDataFrame(pairs, "a string, b string")
    d = d.withColumn("x", F.split("a", " ")).withColumn("y", F.split("b", " "))
    for r in d.select("*", ql.character_errors(F.col("a"), F.col("b")).alias("c"), ql.word_errors(F.col("x"), F.col("y")).alias("w")).collect():
        assert r.c == distance(r.a, r.b) and r.w == distance(r.x, r.y)


def test_noncharacters_end_no_sentence(spark):
    got = one(spark, "one\uffff two. three", tx.split_sentences("c"))[0]
    assert got == ["one\uffff two.", "three"]


def test_context_strip_keeps_own_text(spark):
    words = [("a", 0.0, 0.5, None), ("b", 1.5, 2.0, None)]
    strip = lambda context: tm.strip_context(F.col("w"), F.lit("en"), F.lit(context), F.lit("Own text."))
    assert one(spark, (words,), strip(0.0), schema=WORDS)[0]["text"] == "Own text."
    assert len(one(spark, (words,), strip(0.0), schema=WORDS)[0]["words"]) == 2
    assert one(spark, ([],), strip(1.0), schema=WORDS)[0]["text"] == "Own text."
    assert one(spark, (words,), strip(1.0), schema=WORDS)[0]["text"] == "b"


def test_ends_of_texts_are_read_from_the_end(spark):
    """Long runs of closing marks and white space at the end give what a search of the whole text gives."""
    space, closers = " \u3000\t", ")\u201d]"
    rows = ["", " ", ")", "a", " a ", "\u3000a\t", *[f"ab.{x * n}{y * m}" for x in closers for n in (0, 1, 15, 16, 40) for y in space for m in (0, 1, 17)]]
    d = spark.createDataFrame([(t,) for t in [*rows, None]], "t string")
    whole = f"([^{pt.SPACE}{pt.CLOSERS}])[{pt.SPACE}{pt.CLOSERS}]*\\z"
    d = d.select("t", tx.strip("t").alias("s"), tx.rstrip("t").alias("r"), tx._last_mark(F.col("t")).alias("m"), F.regexp_extract("t", whole, 1).alias("w"),
                 tx.restore_punctuation(F.lit("x!"), F.regexp_replace("t", r"\.", ""), F.lit("en")).alias("p"))
    white = " \u3000\t"
    for r in d.collect():
        if r["t"] is None:
            assert list(r) == [None] * 6
            continue
        assert (r["s"], r["r"], r["m"]) == (r["t"].strip(white), r["t"].rstrip(white), r["w"])
        bare = r["t"].replace(".", "").rstrip(white)
        body = bare.rstrip(closers)
        assert r["p"] == body + "!" + bare[len(body):]
    slow = d._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in slow
