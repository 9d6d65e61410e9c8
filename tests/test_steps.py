"""Golden sequences of the stateful operators through their batch jobs, and brute-force checks of their parts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexstream.functions.text import tokenize
from lexstream.operators import agreement, chunking
from lexstream.operators import matching as mt
from lexstream.operators import revision as rv
from lexstream.operators import segments as sg
from lexstream.sources.glossary import FORMS

T0 = dt.datetime(2024, 1, 1)


def hyps(spark, texts, final_from=None, cut=False, step_ms=100, lang="en", words=None):
    n = len(texts)
    final_from = n if final_from is None else final_from
    rows = [
        ("s", i + 1, lang, t, i >= final_from, cut and i >= final_from, T0 + dt.timedelta(milliseconds=step_ms * i))
        for i, t in enumerate(texts)
    ]
    d = spark.createDataFrame(
        rows, "stream_id string, revision int, lang string, text string, is_final boolean, is_endpoint_cut boolean, at timestamp"
    )
    return d.withColumn("tokens", tokenize("text", F.col("lang"))).drop("text")


def committed(df):
    return [(r.in_revision, r.text, r.is_final) for r in df.orderBy("in_revision").collect()]


def terms(spark, forms):
    rows = [(f"t{i}", "en", f, 0, f, False, None) for i, f in enumerate(forms)]
    return mt.prefix_table(spark.createDataFrame(rows, FORMS))


def test_agreement_and_final(spark):
    h = hyps(spark, ["open the", "open the gate", "shut every door", "open the gate now."], 3)
    assert committed(rv.commit(h)) == [(2, "open", False), (4, "open the gate now.", True)]


def test_agreed_sentence_is_shown_whole(spark):
    assert committed(rv.commit(hyps(spark, ["Rain fell."] * 2))) == [(2, "Rain fell.", False)]


def test_final_without_its_start(spark):
    whole = "the river rose over its banks."
    got = committed(rv.commit(hyps(spark, [whole, whole, "over its banks."], 2)))
    assert got == [(2, whole, False), (3, whole, True)]


def test_fixed_sentence_is_not_rewritten(spark):
    a, b = "We left at dawn. Then the", "they left at dawn then the road went north again"
    got = committed(rv.commit(hyps(spark, [a, a, b, b])))
    assert got == [(2, "We left at dawn. Then", False), (4, "We left at dawn. then the road went north", False)]


def test_cut_final_keeps_fixed_sentences(spark):
    got = committed(rv.commit(hyps(spark, ["Stop. half a word"] * 2 + ["Stop."], 2, cut=True)))
    assert got == [(2, "Stop. half a", False), (3, "Stop.", True)]


def test_open_term_waits(spark):
    p = terms(spark, ["blast furnace door", "blast furnace"])
    o = dict(agreement=1, hold_tokens=0)
    out = rv.commit(hyps(spark, ["seal blast", "seal blast furnace", "seal blast furnace door today"]), p, **o)
    assert committed(out) == [(1, "seal", False), (3, "seal blast furnace door today", False)]
    assert out.agg(F.sum("hold_events"), F.sum("hold_ms")).first()[:] == (2, 200)
    other = rv.commit(hyps(spark, ["seal blast", "seal the hatch"]), p, **o)
    assert committed(other) == [(1, "seal", False), (2, "seal the hatch", False)]
    out = rv.commit(hyps(spark, ["seal blast"]), p, term_timeout_ms=0, **o)
    assert [(r.text, r.flushes, r.hold_events) for r in out.collect()] == [("seal blast", 1, 1)]


def test_endpoint_freezes_until_the_final(spark):
    texts = ["Halt. Wait.", "Halt. Wait.", "Halt. Wait. Go", "Halt. Wait. Go"]
    got = rv.commit(hyps(spark, texts, 3, cut=True), endpoint=2).orderBy("in_revision").collect()
    assert [(r.in_revision, r.text, r.is_endpoint, r.is_final, r.n_frozen) for r in got] == [
        (2, "Halt. Wait.", True, False, 0), (4, "Halt. Wait.", False, True, 1)
    ]


def test_endpoint_by_word_times(spark):
    h = hyps(spark, ["Halt. Wait. Nex", "Halt. Wait. Next"])
    w = F.expr("array(struct('Halt' as text, 0.0D as start, 0.4D as end, null as confidence), "
               "struct('Wait' as text, 0.5D as start, 0.9D as end, null as confidence))")
    got = rv.commit(h.withColumn("words", w), endpoint=2).collect()
    assert [(r.text, r.is_endpoint, r.cut_s) for r in got] == [("Halt. Wait.", True, 0.9)]


@pytest.mark.parametrize("step", [-1, 1])
def test_match_lengths(step):
    rng = random.Random(step)
    for _ in range(300):
        keys = rng.choices("ab", k=rng.randint(0, 9))
        near = rng.choices("ab", k=rng.randint(0, 4))
        got = agreement.match_lengths(keys, near, step).tolist()
        for place, n in enumerate(got):
            beside = keys[:place][::-1] if step < 0 else keys[place:]
            assert n == max(k for k in range(len(near) + 1) if beside[:k] == near[:k])


def schedule(spark, rows, **options):
    """rows: (ms, n tokens, text end, final)."""
    data = [
        ("s", 0, i + 1, i + 1, "en", ["w"] * (n - len(end)) + list(end), final, ms, 0, False)
        for i, (ms, n, end, final) in enumerate(rows)
    ]
    d = spark.createDataFrame(
        data, "stream_id string, utterance long, in_revision int, revision int, lang string, tokens array<string>, "
        "is_final boolean, at_ms long, since_ms long, is_endpoint boolean"
    ).withColumn("text", F.array_join("tokens", " "))
    return sorted(r.revision for r in rv.schedule_requests(d, **options).collect())


def test_wait_k(spark):
    o = dict(wait=2, update=2, timeout_ms=10**9, interval_ms=0)
    rows = [(0, 1, "", False), (1, 2, "", False), (2, 3, "", False), (3, 5, "", False), (4, 5, "", True)]
    assert schedule(spark, rows, **o) == [2, 4, 5]
    assert schedule(spark, [(0, 5, "", False), (1, 6, ".", False)], sentences_only=True, **o) == [2]
    rows = [(0, 7, ""), (300, 12, ""), (700, 12, ""), (900, 14, "."), (1500, 15, ""), (2200, 15, "")]
    assert schedule(spark, [(*r, False) for r in rows]) == [1, 3, 4, 6]


def updates(spark, rows):
    """rows: (text, final)."""
    data = [("s", i, x, "en", i, f, T0) for i, (x, f) in enumerate(rows)]
    return spark.createDataFrame(
        data, "stream_id string, seq int, text string, lang string, source_revision int, is_final boolean, at timestamp"
    )


def spoken(df):
    return [(r.source_revision, r.text) for r in df.orderBy("phrase_no").collect()]


def test_phrases_follow_agreement(spark):
    rows = [("close the left valve", False), ("close the left valve slowly", False), ("close the left valve slowly.", True)]
    got = rv.phrases(updates(spark, rows), low=2, high=4, mode="stable_phrase")
    assert spoken(got) == [(1, "close the left valve"), (2, "slowly.")]


def test_contradicted_phrases_are_withdrawn(spark):
    rows = [(f"red lamp {x}", False) for x in ("on", "on", "off", "off")]
    got = rv.phrases(updates(spark, rows), low=1, high=3, mode="stable_phrase")
    assert spoken(got) == [(1, "red lamp on"), (2, "red lamp"), (3, "off")]


def test_phrases_by_sentence(spark):
    rows = [("five six seven eight", False), ("five six seven eight.", False)]
    got = rv.phrases(updates(spark, rows), low=2, high=4, agreement=1, mode="stable_sentence")
    assert spoken(got) == [(1, "five six seven"), (1, "eight.")]


def test_a_final_ends_its_stream(spark):
    assert spoken(rv.phrases(updates(spark, [("all clear.", True)] * 2))) == [(0, "all clear.")]


def finals(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, words string, lang string")


def test_chunks_of_finals(spark):
    p = terms(spark, ["blast furnace door"])
    long, term = " ".join(["z"] * 50), "seal blast furnace door today"
    d = finals(spark, [("x", None, long, "en"), (None, "x", term, "en"), ("n", "n", None, "en"), ("e", "e", "", "en")])
    got = rv.chunk_finals(d, ["a", "b"], "words", "lang", p).orderBy("a", "phrase_no").collect()
    assert [(r.a, r.b, len(r.tokens), r.is_final) for r in got] == [
        (None, "x", 5, True), ("x", None, 24, False), ("x", None, 24, False), ("x", None, 2, True)
    ]
    texts = lambda **o: [
        (r.text, r.shifts, r.oversized)
        for r in rv.chunk_finals(d.filter("a is null"), ["b"], "words", "lang", p, **o).orderBy("phrase_no").collect()
    ]
    assert texts(low=2, high=3) == [("seal blast furnace door", 1, 0), ("today", 0, 0)]
    assert texts(low=1, high=3) == [("seal", 1, 0), ("blast furnace door", 0, 0), ("today", 0, 0)]
    assert texts(low=2, high=2) == [("seal blast furnace door", 1, 1), ("today", 0, 0)]


def one_cut(at, n, ends, commas, spans, low, high, mode, final):
    """The next cut from ``at``, by looking at every length."""
    fits = [k for k in range(at + 1, n + 1) if k - at <= high]
    end = min((e for e in ends if at < e <= n), default=None)
    if end in fits:
        cut = end
    elif end is None and mode == "stable_sentence" and not final:
        return None
    elif end == fits[-1] + 1 and len(fits) > low:
        cut = fits[-2]
    elif fits[-1] < n:
        cut = max((k for k in fits if k in commas and k - at >= low), default=fits[-1])
    elif final or mode == "stable_phrase":
        cut = n
    else:
        return None
    for a, b in spans:
        if a < cut < b:
            a = max(a, at)
            return (a, 1, 0) if a - at >= low else (b, 1, int(b - a > high))
    return cut, 0, 0


@pytest.mark.parametrize("seed", range(5))
def test_table_of_cuts(seed):
    rng = random.Random(seed)
    for _ in range(200):
        n = rng.randint(0, 40)
        some = lambda k: sorted(rng.sample(range(1, n + 1), min(n, rng.randint(0, k))))
        ends, commas, edges = some(5), some(8), some(8)
        spans = chunking.disjoint([{"start": a, "end": b} for a, b in zip(edges, edges[1:])], n)
        low = rng.randint(1, 4)
        args = (ends, commas, spans, low, low + rng.randint(0, 8), rng.choice(["stable_sentence", "stable_phrase"]), rng.random() < 0.5)
        table = chunking.cut_table(n, *args)
        for at in range(n):
            want = one_cut(at, n, *args)
            assert tuple(table[at].tolist()) == want if want else table[at, 0] == -1


def frame_rows(spark, pattern):
    return spark.createDataFrame(
        [("s", i, c == "x") for i, c in enumerate(pattern)], "stream_id string, frame_no long, voiced boolean"
    )


def naive_segments(pattern, o):
    """Frame-by-frame restatement of the segmentation rules."""
    hist, cand, utt, out, quiet, since, active, first = [], [], [], [], 0, 0, False, None
    for f, c in enumerate(pattern):
        v = c == "x"
        if not active:
            if v:
                first = f if not cand else first
                cand.append(f)
                if len(cand) >= o["min_speech"]:
                    active, utt, cand, quiet = True, hist + cand, [], 0
                    since = len(utt)
            else:
                cand = []
                hist = (hist + [f])[-o["padding"]:]
            continue
        utt.append(f)
        since += 1
        quiet = 0 if v else quiet + 1
        done = len(utt) >= o["longest"]
        if not done and quiet >= o["end_silence"]:
            done, utt = True, utt[: len(utt) - max(0, quiet - o["padding"])]
        if done:
            out.append((first, tuple(utt), True))
            hist, cand, utt, active = [], [], [], False
        elif since >= o["emit"]:
            out.append((first, tuple(utt), False))
            since = 0
    if active:
        out.append((first, tuple(utt), True))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_segments_equal_frame_by_frame(spark, seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choice("x.") * rng.choice([1, 2, 5, 9, 20]) for _ in range(400))
    o = dict(padding=3, min_speech=3, end_silence=7, emit=5, longest=40)
    got = []
    for r in sg.segments(frame_rows(spark, pattern), **o).orderBy("part", "at_frame").collect():
        frames = (*r.lead_frames, *range(r.from_frame, r.end_frame))
        assert len(frames) == r.n_frames
        got.append((r.first_frame, frames, r.is_final))
    assert got == naive_segments(pattern, o)


def cuts(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, at_frame long, first_frame long, frames long")


def test_cut_carries_the_rest_over(spark):
    o = dict(min_speech=1, padding=1, emit=2, end_silence=50)
    f = frame_rows(spark, "xxxxxx")
    got = sg.segments(f, cuts(spark, [("s", 3, 0, 2)]), **o).orderBy("at_frame").collect()
    assert [(r.n_frames, r.is_final, r.is_cut, r.context_frames) for r in got] == [
        (2, False, False, 0), (2, True, True, 0), (3, False, False, 0), (4, True, False, 0)
    ]
    other = sg.segments(f, cuts(spark, [("s", 3, 77, 2)]), **o)
    assert other.filter("is_cut").count() == 0
    ctx = sg.segments(f, cuts(spark, [("s", 3, 0, 2)]), **{**o, "context": 1}).orderBy("at_frame").collect()
    assert [r.context_frames for r in ctx if not r.is_cut][-1] == 1


def test_rechunk_crosses_rows(spark):
    rng = random.Random(1)
    rows, flat = [], []
    for i in range(60):
        x = [float(rng.randint(0, 99)) for _ in range(rng.randint(0, 9))]
        rows.append(("s", i, x))
        flat += x
    d = spark.createDataFrame(rows, "stream_id string, sequence long, samples array<float>")
    got = [list(r.samples) for r in sg.rechunk(d, 7, rows=9).orderBy("frame_no").collect()]
    assert got == [flat[i : i + 7] for i in range(0, len(flat), 7)]
    assert sg.rechunk(d, 7, keep_tail=False).count() == len(flat) // 7


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_commits_cross_one_exchange(spark):
    """Streams of usual size are folded whole, long ones by utterance; terms are found in the row either way."""
    rng = random.Random(8)
    rows = []
    for s in range(4):
        n = 0
        for _ in range(12):
            said = rng.choices(["seal", "blast", "furnace", "door", "Halt", ".", "today", "mr"], k=rng.randint(1, 14))
            for k in range(1, len(said), 2):
                n += 1
                rows.append((f"s{s}", n, "en", said[:k] + ["zz"] * (k % 3 == 0), False, T0 + dt.timedelta(milliseconds=300 * n)))
            n += 1
            rows.append((f"s{s}", n, "en", said, True, T0 + dt.timedelta(milliseconds=300 * n)))
    h = spark.createDataFrame(rows, "stream_id string, revision int, lang string, tokens array<string>, is_final boolean, at timestamp")
    p = terms(spark, ["blast furnace door", "blast furnace"])
    whole, parts = rv.commit(h, p, endpoint=2), rv.commit(h, p, rows=20, endpoint=2)
    assert plan_of(whole).count("Exchange ") == 1 and "Join" not in plan_of(whole) and "Window" in plan_of(parts)
    got = sorted(map(str, whole.collect()))
    assert got == sorted(map(str, parts.collect())) and len(got) > 100
    assert whole.agg(F.max("utterance")).first()[0] == 11


def test_requests_read_their_commits_once(spark):
    c = rv.commit(hyps(spark, ["open the gate now and then close it again slowly"] * 3, 2))
    plan = plan_of(rv.schedule_requests(c))
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_phrases_read_their_rows_once(spark):
    c = rv.commit(hyps(spark, ["seal the blast furnace door today."] * 3, 2))
    u = c.select("stream_id", F.col("revision").alias("seq"), "text", "lang", F.col("revision").alias("source_revision"), "is_final", F.timestamp_millis("at_ms").alias("at"))
    out = rv.phrases(u, terms(spark, ["blast furnace door"]), low=2, high=3, mode="stable_sentence")
    assert plan_of(out).count("MapInArrow") == 2 and "Join" not in plan_of(out)
    assert [(r.text, r.shifts) for r in out.orderBy("phrase_no").collect()] == [("seal the", 1), ("blast furnace door", 0), ("today.", 0)]


def test_prefixes_found_in_the_row(spark):
    """The array gives the spans of the join; a table over the limit is left to the join."""
    rng = random.Random(3)
    p = terms(spark, ["blast furnace door", "blast furnace", "door", "Door blast"])
    rows = [(i, rng.choice(["en", "fr", None]), rng.choices(["Blast", "furnace", "door", "x", None], k=rng.randrange(9))) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, lang string, t array<string>")
    for which in ("is_term", "is_open"):
        want = sorted((r.id, r.start, r.end) for r in mt.prefix_hits(d, ["id"], "t", "lang", p).filter(which).collect())
        got = d.select("id", F.explode(mt.prefix_spans("t", "lang", p, which)).alias("x")).collect()
        assert sorted((r.id, r.x.start, r.x.end) for r in got) == want and want
    assert mt.prefix_spans("t", "lang", p, "is_term", limit=10) is None


def test_batches_as_python_values():
    import pyarrow as pa

    from lexstream.operators import keyed

    words = pa.array([["a", None], None, [], ["b"]])
    deep = pa.array([[{"t": ["x"], "e": 1.5}], None, [], [None]])
    columns = [words, deep, pa.array([1, None, 3, 4]), pa.array([True, False, True, True]), pa.array([None] * 4), pa.array(["ß", None, "", "x"])]
    for c in columns:
        for part in (c, c[1:], c[1:3], c[:0]):
            assert keyed.values(part) == part.to_pylist()
