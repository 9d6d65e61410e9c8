"""Matching against brute force; glossary files, rewriting and translation golden rows."""

import random

import pytest
import yaml
from pyspark.sql import functions as F

from lexstream.functions import normalize as nz
from lexstream.functions import patterns as p
from lexstream.operators import glossary as gl
from lexstream.operators import inrow
from lexstream.operators import matching as mt
from lexstream.operators import overlaps
from lexstream.operators import rewrite as rw
from lexstream.operators import translate as tr
from lexstream.plans import inputs as inp
from lexstream.sources import glossary as sg

BUNDLE = {
    "bundle_id": "sample", "schema_version": 1, "default_domains": ["factory"],
    "entries": [
        {"id": "emergency_stop_button", "domain": ["factory"], "priority": 100, "translation_policy": "preferred_term",
         "forms": {"en": {"canonical": "emergency stop button", "aliases": ["E-stop button", "emergency-stop button"], "asr_boost": 1.8},
                   "vi": {"canonical": "nút dừng khẩn cấp", "aliases": ["nút E-stop", "E-stop"]},
                   "zh": {"canonical": "紧急停止按钮", "aliases": ["急停按钮"]},
                   "ko": {"canonical": "비상 정지 버튼", "aliases": ["비상정지 버튼"]}},
         "tts": {"vi": {"spoken_form": "nút dừng khẩn cấp"}}},
        {"id": "stop_button", "domain": ["factory"], "priority": 40, "translation_policy": "preferred_term",
         "forms": {"en": {"canonical": "stop button"}, "vi": {"canonical": "nút dừng"}, "zh": {"canonical": "停止按钮"},
                   "ko": {"canonical": "정지 버튼"}}},
        {"id": "m5stack", "domain": ["maintenance"], "priority": 90, "translation_policy": "display_preserve_speech_override",
         "forms": {"en": {"canonical": "M5Stack", "aliases": ["M 5 Stack"]}, "vi": {"canonical": "M5Stack"}},
         "tts": {"vi": {"spoken_form": "em năm stack"}}},
        {"id": "windsurfing", "domain": ["factory"], "priority": 100, "translation_policy": "preserve",
         "forms": {"en": {"canonical": "windsurfing", "aliases": ["wind surfing", "winssurfing"]}, "vi": {"canonical": "windsurfing"}},
         "tts": {"vi": {"spoken_form": "lướt ván buồm"}}, "odd": 1},
    ],
}


@pytest.fixture(scope="module")
def bundle(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/terms.yaml"
    with open(path, "w") as f:
        yaml.safe_dump(BUNDLE, f, allow_unicode=True, sort_keys=False)
    return path


@pytest.fixture(scope="module")
def g(spark, bundle):
    return sg.load_glossary(spark, bundle)


@pytest.fixture(scope="module")
def forms(g):
    return mt.prepare_forms(g.forms, g.terms)


def docs(spark, rows):
    return spark.createDataFrame(rows, "id int, lang string, text string")


def found(df):
    return sorted((r.id, r.term_id) for r in df.collect())


def test_load_and_check(spark, bundle, g):
    assert g.default_domains == ["factory"]
    assert g.terms.count() == 4 and g.forms.count() == 21 and g.spoken.count() == 3
    assert [(r["at"], r["field"]) for r in sg.unknown_fields(sg.read_documents(spark, bundle)).collect()] == [("entries[3]", "odd")]
    assert gl.validate_glossary(g.terms, g.forms, g.spoken).isEmpty()
    assert len(sg.checksums(spark, bundle).first().sha256) == 64
    b = {r.text: r.score for r in gl.guidance_terms(g.terms, g.forms).filter("lang = 'en'").collect()}
    assert b["E-stop button"] == 1.8 and b["windsurfing"] == 1.5


def test_budget_passes_over_long_terms(spark):
    rows = [("en", f"t{i}", t, 1.5, i, 0) for i, t in enumerate(["a b c", "d e f g", "h", "i j", "k"])]
    d = spark.createDataFrame(rows, "lang string, term_id string, text string, score double, declaration_order int, form_order int")
    assert [r.text for r in gl.budgeted_terms(d, 10, 6).orderBy("pos").collect()] == ["a b c", "h", "i j"]
    assert [r.text for r in gl.budgeted_terms(d, 2, 60).orderBy("pos").collect()] == ["a b c", "d e f g"]


def test_routes(spark):
    pairs = spark.createDataFrame(gl.PAIRS, "source string, target string")
    ask = [("vi", "en"), ("vi", "zh"), ("ko", "vi"), ("en", "en"), ("zh", "vi")]
    r = gl.routes(spark.createDataFrame(ask, "source string, target string"), pairs)
    assert {(x.source, x.target): x.route for x in r.collect()} == {
        ("vi", "en"): ["vi", "en"], ("vi", "zh"): ["vi", "en", "zh"], ("ko", "vi"): ["ko", "en", "vi"], ("en", "en"): ["en"],
        ("zh", "vi"): ["zh", "vi"],
    }


def test_golden_matches(spark, g, forms):
    d = docs(spark, [(1, "vi", "Hãy nhấn nút dừng khẩn cấp ngay."), (2, "en", "Open m5stack."), (3, "zh", "请按下紧急停止按钮。"),
                     (4, "ko", "비상 정지 버튼을 누르세요."), (5, "en", "unstop buttons"), (6, "en", "EMERGENCY–STOP\tBUTTON")])
    m = mt.find_terms(d, ["id"], "text", "lang", forms)
    assert found(m) == [(1, "emergency_stop_button"), (1, "stop_button"), (3, "emergency_stop_button"), (3, "stop_button"),
                        (4, "emergency_stop_button"), (4, "stop_button"), (6, "emergency_stop_button"), (6, "stop_button")]
    best = mt.best_matches(m, ["id"])
    assert found(best) == [(i, "emergency_stop_button") for i in (1, 3, 4, 6)]
    loose = mt.prepare_forms(g.forms, g.terms, case_sensitive_codes=False)
    assert (2, "m5stack") in found(mt.find_terms(d, ["id"], "text", "lang", loose))


def naive(text, lang, rows, ranks):
    word = lambda c: bool(c) and (c.isalnum() or c == "_")
    def code(v):
        letters = [c for c in v if c.isalpha()]
        return any(c.isdigit() for c in v) or (any(c.isupper() for c in letters) and any(c.islower() for c in letters)) or (
            bool(letters) and len(letters) <= 8 and all(c.isupper() for c in letters))
    out = set()
    for fold in (True, False):
        n, s, e = nz.align(text, fold)
        for tid, flang, form, *_ in rows:
            if flang != lang or code(form) == fold:
                continue
            f = nz.align(form, fold)[0]
            edge = not (lang == "zh" or (lang == "ko" and not any(c.isascii() and c.isalnum() for c in form)))
            at = n.find(f)
            while at >= 0:
                end = at + len(f)
                if not edge or not (word(n[at - 1 : at]) or word(n[end : end + 1])):
                    out.add((-len(f), -ranks[tid][0], ranks[tid][1], s[at], e[end - 1], tid))
                at = n.find(f, at + 1)
    kept = []
    for x in sorted(out):
        if not any(x[3] < y[4] and y[3] < x[4] for y in kept):
            kept.append(x)
    return {(x[5], x[3], x[4]) for x in out}, {(x[5], x[3], x[4]) for x in kept}


def test_matching_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["stop", "Stop", "button", "E-stop", "em", "năm", "straße", "STRASSE", "M5", "a_b", "ß", "ss", "über", "über", "ﬁn", "3", "x"]
    chars = [*"紧急停止按钮急停a ß．", "ss", " "]
    gaps = [" ", "  ", "\n", ". ", "-", "–", ", ", "", " - "]
    spaced = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    packed = lambda n: "".join(rng.choice(chars) for _ in range(n))
    texts = [(i, rng.choice(["en", "zh", "ko"])) for i in range(60)]
    texts = [(i, lang, rng.choice(["", "  "]) + (packed if lang == "zh" else spaced)(rng.randint(0, 400))) for i, lang in texts]
    rows, ranks = [], {}
    for i in range(50):
        lang = rng.choice(["en", "zh", "ko"])
        form = (packed if lang == "zh" else spaced)(rng.randint(1, 4)).strip()
        form = form if rng.random() < 0.2 else form.strip(" .,-– \n")
        if form:
            rows.append((f"t{i}", lang, form, 0, form, False, None))
            ranks[f"t{i}"] = (rng.choice([1, 1, 2]), i * 1000)
    terms = spark.createDataFrame([(t, ["d"], r[0], "preserve", r[1] // 1000) for t, r in ranks.items()], sg.TERMS)
    m = mt.find_terms(docs(spark, texts), ["id"], "text", "lang", mt.prepare_forms(spark.createDataFrame(rows, sg.FORMS), terms))
    got = {(r.id, r.term_id, r.start, r.end) for r in m.collect()}
    best = {(r.id, r.term_id, r.start, r.end) for r in mt.best_matches(m, ["id"]).collect()}
    want = [(i, *naive(t, lang, rows, ranks)) for i, lang, t in texts]
    assert got == {(i, *x) for i, all_, _ in want for x in all_} and len(got) > 1000
    assert best == {(i, *x) for i, _, kept in want for x in kept}
    # A dictionary too large to broadcast: only short rows of possible beginnings are shuffled.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = mt.find_terms(docs(spark, texts), ["id"], "text", "lang", mt.prepare_forms(spark.createDataFrame(rows, sg.FORMS), terms), limit=0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and {(r.id, r.term_id, r.start, r.end) for r in joined.collect()} == got
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The same inside the row.
    prepared = mt.prepare_forms(spark.createDataFrame(rows, sg.FORMS), terms)
    assert inrow.fits(prepared) and not inrow.fits(prepared, 100)
    table = inrow.compiled(prepared)
    for kept, pairs in ((False, got), (True, best)):
        d = inrow.with_matches(docs(spark, texts), "text", "lang", table, "ms", kept).select("id", F.explode("ms").alias("m"))
        found = [(r["id"], r["m"]["term_id"], r["m"]["start"], r["m"]["end"]) for r in d.collect()]
        assert set(found) == pairs and len(found) == len(pairs)


def greedy(ms):
    kept = []
    for m in sorted(ms, key=lambda m: (-m[2], -m[3], m[4], m[0], m[1])):
        if not any(m[0] < k[1] and k[0] < m[1] for k in kept):
            kept.append(m)
    return sorted(kept)


def test_overlaps_in_clusters_of_all_sizes(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        n, reach = rng.choice([0, 1, 3, 40, 300]), rng.choice([5, 60, 100000])
        ms = []
        for k in range(n):
            s = rng.randint(0, reach)
            e = s + rng.randint(1, rng.choice([3, 12]))
            ms.append((s, e, e - s if rng.random() < 0.7 else rng.randint(1, 9), rng.randint(1, 2), rng.randint(0, 4), f"t{k}", "f", "c", False, "p"))
        rows.append((i, sorted(ms)))
    # A chain in which every match meets the next one.
    rows.append((99, [(k, k + 2, 2, 1, (k * 7919) % 1000, "t", "f", "c", False, "p") for k in range(3000)]))
    # Chains whose ranks fall to either side, as of one form that overlaps itself.
    for i, key in ((100, lambda k: 0), (101, lambda k: 2000 - k)):
        rows.append((i, [(k, k + 2, 2, 1, key(k), "t", "f", "c", False, "p") for k in range(2000)]))
    kind = "start int, end int, norm_len int, priority int, rank long, term_id string, form string, canonical string, is_alias boolean, policy string"
    fields = ", ".join(x.replace(" ", ":", 1) for x in kind.split(", "))
    d = spark.createDataFrame(rows, f"id int, ms array<struct<{fields}>>")
    got = {r["id"]: [tuple(m) for m in r["kept"]] for r in d.select("id", overlaps.chosen(F.col("ms")).alias("kept")).collect()}
    assert got == {i: greedy(ms) for i, ms in rows}
    flat = d.select("id", F.explode("ms").alias("m")).select("id", "m.*", F.lit("en").alias("lang"))
    best = {(r["id"], r["start"], r["end"], r["term_id"]) for r in mt.best_matches(flat, ["id"]).collect()}
    assert best == {(i, m[0], m[1], m[5]) for i, ms in rows for m in greedy(ms)}


def test_whole_words_are_looked_up_in_arrow_batches(spark, g):
    """Plain texts give what the joins find, null priorities, sharp s, wide gaps and hyphens included."""
    rows = [("a", "en", "Straße"), ("b", "en", "strasse of"), ("c", "en", "of  the"), ("d", "en", "M5"), ("e", "en", "the of"), ("e", "en", "the"), ("f", "en", "x-y")]
    f = spark.createDataFrame([(t, x, w, i, w, False, None) for i, (t, x, w) in enumerate(rows)], sg.FORMS)
    t = spark.createDataFrame([(x, ["d"], None if x in "be" else 3, "preserve", i) for i, x in enumerate("abcdef")], sg.TERMS)
    ready = mt.prepare_forms(f, t)
    rng = random.Random(5)
    words = ["straße", "STRASSE", "Of", "the", "M5", "m5", "x", "y", "x\u2010y", "ẞ", "zz"]
    texts = [(i, rng.choice(["en", "fr"]), "".join(rng.choice(words) + rng.choice([" ", "\u3000\t", "-", ", "]) for _ in range(rng.randrange(30)))) for i in range(300)]
    d = docs(spark, [*texts, (900, "en", None), (901, "en", ""), (902, "en", "the ﬁ of the"), (903, None, "the")])
    span = lambda r: (r["start"], r["end"], r["term_id"], r["form"])
    for best in (True, False):
        every = mt.find_terms(d, ["id"], "text", "lang", ready)
        want = sorted((r["id"], *span(r)) for r in (mt.best_matches(every, ["id"]) if best else every).collect())
        got = inrow.with_matches(d, "text", "lang", inrow.compiled(ready), "ms", best)
        assert sorted((r["id"], *span(m)) for r in got.collect() for m in r["ms"]) == want
        assert "of(CASE" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert inrow.places("the of the", inrow.compiled(ready).words["en"], True) == [(0, 6, mt_no(ready, "the of")), (7, 10, mt_no(ready, "the"))]


def mt_no(ready, form):
    """The number under which a form is listed."""
    return next(f["no"] for fs in inrow.compiled(ready).words["en"].values() for f in fs if f["key"] == form)


def test_texts_stay_in_their_rows(spark, forms, g):
    """Rewriting shuffles nothing while the dictionary fits beside the rows; the joined form gives the same."""
    rng = random.Random(2)
    words = ["wind", "surfing", "E-stop", "button", "wins", "serving", "Stop", "the", "\n", "M5"]
    texts = [(i, "en", " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    d = docs(spark, texts).withColumn("to", F.lit("vi"))
    bound = rw.bindings(g.forms, g.terms)
    jobs = (
        lambda: rw.canonicalize(d, ["id"], "text", "lang", forms), lambda: rw.speak(d, ["id"], "text", "lang", forms, g.spoken),
        lambda: rw.term_spans(d, ["id"], "text", "lang", "to", forms, bound),
    )
    inside = []
    for job in jobs:
        out = job()
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        inside.append(sorted(map(str, out.collect())))
    limit = inrow.MAX_DICTIONARY
    real = inrow.fits
    inrow.fits = lambda forms: real(forms, 0)
    try:
        for job, rows in zip(jobs, inside):
            out = job()
            assert "Exchange" in out._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, out.select(*docs_columns(out)).collect())) == rows
    finally:
        inrow.fits = real
    assert limit == inrow.MAX_DICTIONARY


def docs_columns(out):
    return [c for c in ("id", "lang", "text", "to", "spans", "canonical_text", "n_corrections", "spoken_text", "substitutions") if c in out.columns]


def test_prefixes(spark, g):
    prefixes = mt.prefix_table(g.forms)
    rows = [(1, "vi", ["nút", "dừng"]), (2, "vi", ["nút", "dừng", "khẩn", "cấp"]), (3, "vi", ["hãy", "nhấn", "nút", "dừng"]), (4, "vi", [])]
    d = spark.createDataFrame(rows, "id int, lang string, t array<string>")
    flags = {r.id: (r.is_prefix, r.is_term, r.is_open) for r in mt.prefix_flags(d, ["id"], "t", "lang", prefixes).collect()}
    assert flags == {1: (True, True, True), 2: (True, True, False), 3: (False, False, False), 4: (True, False, True)}
    hits = mt.prefix_hits(d, ["id"], "t", "lang", prefixes)
    assert {r.id: r.open_start for r in mt.open_suffix(hits, ["id"]).collect()} == {1: 0, 3: 2}
    assert {(r.id, r.start, r.end) for r in mt.token_spans(hits, ["id"]).collect()} == {(1, 0, 2), (2, 0, 4), (3, 2, 4)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = mt.prefix_hits(d, ["id"], "t", "lang", prefixes, limit=0)
    assert sorted(joined.collect()) == sorted(hits.collect()) and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_a_large_dictionary_shuffles(spark):
    """Rows that leave their chunk hold less than the text, and the bitmap forgets no first word."""
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(20000)]
    texts = [(i, "en", " ".join(words[i * 200:(i + 1) * 200])) for i in range(100)]
    rows = [(f"t{i}", "en", f"w{i * 9} w{i}", 0, "x", False, None) for i in range(300)]
    terms = spark.createDataFrame([(r[0], ["d"], 1, "preserve", i) for i, r in enumerate(rows)], sg.TERMS)
    forms = mt.prepare_forms(spark.createDataFrame(rows, sg.FORMS), terms)
    held = mt.head_filter(forms.select("lang", "head").distinct())
    every = forms.select(held(F.col("lang"), F.col("head")).alias("in"))
    assert every.filter("not in").isEmpty()
    d = docs(spark, texts)
    views = mt._normalized_texts(d, ["id"], "text", "lang", ["en"], True)
    hits = mt._hits(mt._chunks(views, ["id"], mt._WORDS, 2), ["id"], mt._WORDS, 2, held)
    moved = hits.agg(F.sum(F.length(F.array_join("us", "")) + F.length("head") + F.length("prev") + 24).alias("n")).first()["n"]
    assert 0 < moved < 2 * sum(len(t) for _, _, t in texts)


WORDS = "array<struct<text:string,start:double,end:double,confidence:double>>"


def test_aliases_and_word_timings(spark, forms):
    w = [("Try", 0.0, 0.2, None), ("wind", 0.3, 0.5, 0.8), ("surfing", 0.5, 0.9, 0.7), ("today", 1.0, 1.2, None)]
    rows = [(1, "en", "Try wind surfing today.", w), (2, "en", "winssurfing wind serving", []), (3, "en", "Use E-stop button", [("zzz", 0.0, 1.0, None)])]
    d = spark.createDataFrame(rows, f"id int, lang string, text string, words {WORDS}")
    fixed = {r.id: (r.canonical_text, r.n_corrections) for r in rw.canonicalize(d, ["id"], "text", "lang", forms).collect()}
    assert fixed == {1: ("Try windsurfing today.", 1), 2: ("windsurfing wind serving", 1), 3: ("Use emergency stop button", 1)}
    best = mt.best_matches(mt.find_terms(d, ["id"], "text", "lang", forms), ["id"])
    new = {r.id: r.new_words for r in rw.remap_words(d, ["id"], "text", "words", best).collect()}
    assert [(x.text, x.start, x.end, x.confidence) for x in new[1]][1] == ("windsurfing", 0.3, 0.9, 0.7)
    assert len(new[1]) == 3 and new[2] == [] and new[3] is None


def test_spoken(spark, g, forms):
    d = docs(spark, [(1, "vi", "Chơi windsurfing và M5Stack, nút dừng.")])
    r = rw.speak(d, ["id"], "text", "lang", forms, g.spoken).first()
    assert (r.spoken_text, r.substitutions) == ("Chơi lướt ván buồm và em năm stack, nút dừng.", 2)


@pytest.mark.parametrize(
    "output,fault,restored",
    [
        ("Hãy nhấn __TERM_0001__ ngay.", None, "Hãy nhấn nút dừng khẩn cấp ngay."), ("Hãy nhấn ngay.", "missing", None),
        ("__TERM_0001__ __TERM_0001__", "duplicate", None), ("__term_0001__", "missing", None), ("__TERM_ 0001__", "missing", None),
        ("__TERM_0001__ __TERM_9999__", "unexpected", None),
    ],
)
def test_placeholder_check(spark, output, fault, restored):
    d = spark.createDataFrame([(output, ["__TERM_0001__"], [(0, 1, "t", "nút dừng khẩn cấp")])],
                              "o string, m array<string>, s array<struct<start:int,end:int,term_id:string,target_form:string>>")
    put = tr.restore(F.col("o"), F.col("m"), F.col("s"))
    got = d.select(tr.check(F.col("o"), F.col("m"), put), put).first()
    assert got[0] == fault and (restored is None or got[1] == restored)


def test_placeholder_order(spark):
    d = spark.createDataFrame([("__TERM_0002__ then __TERM_0001__", ["__TERM_0001__", "__TERM_0002__"])], "o string, m array<string>")
    assert d.select(tr.check(F.col("o"), F.col("m"), F.lit("x")), tr.check(F.col("o"), F.col("m"), F.lit("x"), True)).first()[:] == (None, "order")


def requests(spark):
    rows = [(1, "s", 1, "Press the E-stop button now. Then go wind surfing! End", False),
            (2, "s", 2, "Press the E-stop button now. Fine.", True), (3, "q", 1, "   ", True)]
    return spark.createDataFrame(rows, "id int, stream_id string, revision int, text string, is_final boolean")


def run(spark, g, forms, fn, route=("en", "vi"), **options):
    t = tr.translate_requests(requests(spark), ["id"], list(route), forms, rw.bindings(g.forms, g.terms), fn, **options)
    return {r.id: r for r in t.collect()}


def test_translate_with_protection(spark, g, forms):
    out = run(spark, g, forms, tr.echo)
    assert out[1].translated == "[vi] Press the nút dừng khẩn cấp now. [vi] Then go windsurfing! [vi] End"
    assert (out[1].matches, out[1].hops, out[1].cache_hits, out[2].cache_hits) == (2, 3, 0, 1)


def test_batch_translator_sees_only_what_it_must(spark, g, forms):
    fn = tr.batch_translator(lambda text, source, target: "<" + text + ">")
    out = run(spark, g, forms, fn)
    assert out[2].translated == "<Press the nút dừng khẩn cấp now.>. <Fine.>."


def test_rewritten_placeholders_are_repaired(spark, g, forms):
    def fn(t, s, target):
        swapped = F.regexp_replace(F.regexp_replace(t, "__TERM_", "__term_ "), "OVT|ZX", "")
        return tr.echo(swapped, s, target)

    out = run(spark, g, forms, fn)
    assert out[2].translated.startswith("[vi] Press the nút dừng khẩn cấp now.")
    assert (out[2].fallbacks, out[2].retries) == (1, len(p.PLACEHOLDER_FORMATS) - 1)


def test_lost_placeholders_fall_back_to_pieces(spark, g, forms):
    def fn(t, s, target):
        return F.when(t.rlike("__TERM|OVT|ZX"), F.lit("lost")).otherwise(tr.echo(t, s, target))

    out = run(spark, g, forms, fn)
    assert out[2].translated == "[vi] Press the nút dừng khẩn cấp [vi] now. [vi] Fine."
    strict = run(spark, g, forms, fn, fallback=False)
    assert strict[2].translated is None and strict[2].faults == 1 and strict[3].translated is not None


def test_retry_takes_the_next_format(spark, g, forms):
    def fn(t, s, target):
        return F.when(t.contains("__TERM"), F.lit("lost")).otherwise(tr.echo(t, s, target))

    out = run(spark, g, forms, fn, fallback=False)
    assert out[2].translated == "[vi] Press the nút dừng khẩn cấp now. [vi] Fine." and out[2].retries == 1


def test_pivot_protects_on_every_hop(spark, g, forms):
    out = run(spark, g, forms, tr.echo, route=("en", "vi", "en"))
    assert out[2].translated == "[en] [vi] Press the emergency stop button now. [en] [vi] Fine."
    assert out[2].hops == 4


def test_empty_dictionary_changes_nothing(spark, g):
    d = docs(spark, [(1, "en", "press the stop button"), (2, "en", None)])
    none = mt.prepare_forms(g.forms, g.terms.limit(0))
    assert mt.find_terms(d, ["id"], "text", "lang", none).isEmpty()
    assert {r.id: r.text for r in rw.canonicalize(d, ["id"], "text", "lang", none).select("id", "text").collect()} == {
        1: "press the stop button", 2: None}


def test_many_forms_keep_the_declaration_order(spark):
    forms = [("a", "en", f"one {k}", k, "one 0", k > 0, None) for k in range(1002)] + [("b", "en", "two", 0, "two", False, None)]
    terms = [("a", ["x"], 1, "preserve", 0), ("b", ["x"], 1, "preserve", 1)]
    d = mt.prepare_forms(spark.createDataFrame(forms, sg.FORMS), spark.createDataFrame(terms, sg.TERMS))
    ranks = {r.form: r["rank"] for r in d.select("form", "rank").collect()}
    assert len(set(ranks.values())) == 1003 and max(ranks, key=ranks.get) == "two"


def test_blank_forms_of_any_white_space(spark, g):
    odd = spark.createDataFrame([("stop_button", "en", "\t\u00a0", 9, "stop button", True, None)], sg.FORMS)
    found = gl.validate_glossary(g.terms, g.forms.unionByName(odd), g.spoken)
    assert "blank_form" in {r.rule for r in found.collect()}


def test_a_final_ends_the_cache_and_routes_differ_by_row(spark, g, forms):
    rows = [(1, "s", 1, "Same here.", False, ["en", "vi"]), (2, "s", 2, "Same here.", True, ["en", "vi"]),
            (3, "s", 3, "Same here.", False, ["en", "vi"]), (4, "s", 4, "Same here.", False, ["vi", "en"]),
            (5, "s", 5, "Same here.", False, ["en", "vi"]), (6, "s", 6, "Same here.", False, None),
            (7, "s", 7, "Same here.", False, ["en", "vi", "zh"])]
    r = spark.createDataFrame(rows, "id int, stream_id string, revision long, text string, is_final boolean, path array<string>")
    t = tr.translate_requests(r, ["id"], "path", forms, rw.bindings(g.forms, g.terms), tr.echo)
    out = {x.id: x for x in t.collect()}
    assert [out[i].cache_hits for i in range(1, 8)] == [0, 1, 0, 0, 1, 0, 0]
    assert [out[i].hops for i in range(1, 8)] == [1, 1, 1, 1, 1, 0, 2]
    assert out[4].translated == "[en] Same here." and out[6].translated is None
    assert (out[4].source_language, out[4].target_language, out[7].target_language) == ("vi", "en", "zh")


def test_forms_within_words_are_found_in_arrow_batches(spark):
    """Forms that stand anywhere, with and without edges to check, give what the joins find."""
    rows = [("a", "zh", "the"), ("b", "zh", "t"), ("c", "zh", "he t"), ("d", "zh", "e-t"), ("e", "zh", "停 止"), ("f", "ko", "정지"), ("g", "en", "+x"), ("h", "en", "x+"),
            ("i", "en", "the x"), ("j", "ko", "la"), ("k", "zh", "tt"), ("l", "zh", "T5"), ("m", "en", "x++")]
    f = spark.createDataFrame([(t, x, w, i, w, False, None) for i, (t, x, w) in enumerate(rows)], sg.FORMS)
    t = spark.createDataFrame([(x[0], ["d"], None if x[0] in "be" else 3, "preserve", i) for i, x in enumerate(rows)], sg.TERMS)
    ready = mt.prepare_forms(f, t)
    rng = random.Random(9)
    bits = ["the", "T", "he", "e", "-", "‐", "停", "止", "정지", "la", "x", "+", " ", "　\t", "\n", "ß", "_", "T5", "t5", "ﬁ"]
    some = lambda plain: "".join(rng.choice(bits[:-1] if plain else bits) for _ in range(rng.randrange(40)))
    texts = [(i, rng.choice(["en", "zh", "ko", "fr", None]), some(i % 4)) for i in range(400)]
    d = docs(spark, [*texts, (900, "zh", None), (901, "zh", ""), (902, "zh", "  the  ")])
    span = lambda r: (r["id"], r["start"], r["end"], r["term_id"], r["form"])
    every = mt.find_terms(d, ["id"], "text", "lang", ready)
    for want, got in ((every, inrow.all_terms(d, ["id"], "text", "lang", ready)), (mt.best_matches(every, ["id"]), inrow.best_terms(d, ["id"], "text", "lang", ready))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "of(CASE" in plan and "Exchange" not in plan
        assert sorted(map(span, got.collect())) == sorted(map(span, want.collect()))
    assert every.count() > 500


def test_timed_words_stay_in_their_rows(spark, forms):
    rng = random.Random(4)
    said = ["Try", "wind", "surfing", "E-stop", "button", "today", "wins", "serving", "zzz"]
    rows = []
    for i in range(120):
        ws = rng.choices(said[:-1] if i % 10 else said, k=rng.randrange(12))
        gap = rng.choice([" ", ", ", "  "])
        rows.append((i, "en", gap.join(w for w in ws if w != "zzz"), [(w, k / 2, k / 2 + 0.4, rng.random()) for k, w in enumerate(ws)]))
    d = spark.createDataFrame([*rows, (900, "en", "wind surfing", None), (901, "en", None, [])], f"id int, lang string, text string, words {WORDS}")
    got = rw.retimed(d, ["id"], "text", "lang", "words", forms)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    joined = rw.remap_words(d, ["id"], "text", "words", mt.best_matches(mt.find_terms(d, ["id"], "text", "lang", forms), ["id"]))
    new = {r.id: r.new_words for r in got.collect()}
    assert new == {r.id: r.new_words for r in joined.collect()}
    assert sum(w is not None and w != r[3] for r in rows for w in [new[r[0]]]) > 5


@pytest.mark.parametrize("seed", range(3))
def test_words_covered_by_edits(seed):
    rng = random.Random(seed)
    for _ in range(300):
        words = ["".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(rng.randrange(8))]
        text = " ".join(words)
        edges = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(4))))
        edits = list(zip(edges[::2], edges[1::2]))
        spans, at = [], 0
        for w in words:
            at = text.index(w, at) + len(w)
            spans.append((at - len(w), at))
        over = [[i for i, (s, e) in enumerate(spans) if s < b and a < e] for a, b in edits]
        got = rw.covered(text, words, edits)
        if not all(over):
            assert got is None
            continue
        firsts, gone = {x[0]: (x[-1] + 1, k) for k, x in enumerate(over)}, set()
        want = []
        for i in range(len(words)):
            if i not in gone:
                hi, k = firsts.get(i, (i + 1, -1))
                want.append((i, hi, k))
            gone |= {j for x in over if x[0] == i for j in x[1:]}
        assert got == want
    assert rw.covered("a b", ["b", "a"], []) is None and rw.covered("a", [None], []) is None


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_sentences_cross_one_exchange_before_they_are_translated(spark, g, forms):
    t = tr.translate_requests(requests(spark), ["id"], ["en", "vi"], forms, rw.bindings(g.forms, g.terms), tr.echo).select("id", "translated")
    plan = t._jdf.queryExecution().executedPlan()
    moved = [n.output().mkString(" ") for n in _nodes(plan.initialPlan()) if n.nodeName() == "Exchange"]
    assert sum("sentence#" in x or "text#" in x for x in moved) == 1


def test_a_sentence_is_asked_for_once_a_hop(spark, g, forms, folder):
    """Also where routes of one and of two hops meet."""

    def noted(text, source, target):
        with open(f"{folder}/asked", "a") as f:
            f.write("".join(f"{x}>{t}\n" for x, t in zip(text, target)))
        return text

    rows = [(1, "s", 1, "Same here. Two. Same here.", False, ["en", "vi"]), (2, "s", 2, "Two. Same here. Open", True, ["en", "vi", "en"]),
            (3, "s", 3, "Same here.", False, ["en"]), (4, "s", 4, "Same here.", False, ["en", "vi", "en"]), (5, "s", 5, None, False, ["en", "vi"])]
    r = spark.createDataFrame(rows, "id int, stream_id string, revision long, text string, is_final boolean, path array<string>")
    fn = tr.batch_translator(noted)
    out = {x.id: x for x in tr.translate_requests(r, ["id"], "path", forms, rw.bindings(g.forms, g.terms), fn).collect()}
    assert sorted(open(f"{folder}/asked").read().split("\n")[:-1]) == sorted(
        ["Same here.>vi", "Two.>vi"] + ["Same here.>vi", "Two.>vi", "Open>vi", "Same here.>en", "Two.>en", "Open>en"])
    assert {i: (x.hops, x.cache_hits, x.translated) for i, x in out.items()} == {
        1: (3, 1, "Same here. Two. Same here."), 2: (6, 0, "Two. Same here. Open"), 3: (0, 0, "Same here."), 4: (2, 0, "Same here.")}


@pytest.mark.parametrize("in_order", [False, True])
def test_judged_in_batches_as_by_columns(spark, in_order):
    rng = random.Random(3)
    bits = ["__TERM_0001__", "__TERM_0002__", "__term_ 2 __", "a", " ", "<", "<term_3>", "OVT1ovt", "_", "ß", "\U0001f600", "ZX", "zxterm١5zx", "1"]
    forms = ["ü", "", None, "<term_3>", "__TERM_0002__", "b"]
    rows = [("".join(rng.choices(bits, weights=[4, 4] + [1] * 12, k=rng.randrange(7))), [rng.choice(forms) for _ in range(rng.randrange(1, 3))])
            for _ in range(1500)]
    d = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(rows)], "i int, t string, f array<string>")
    spans = F.transform("f", lambda x: F.struct(x.alias("target_form")))
    marks = rw.placeholders(spans, p.PLACEHOLDER_FORMATS[0])
    put = tr.restore(F.col("t"), marks, spans)
    want = d.select("i", put.alias("out"), tr.check(F.col("t"), marks, put, in_order).alias("fault")).collect()
    got = {i: tr.judged(t, [p.PLACEHOLDER_FORMATS[0] % (k + 1) for k in range(len(f))], f, in_order) for i, (t, f) in enumerate(rows)}
    assert {r.i: (r.out, r.fault) for r in want} == got
    assert {"missing", "duplicate", "unexpected", "residue", None} <= {x for _, x in got.values()}


def test_word_pairs_are_counted_once(spark):
    rows = [("en", "one two One two  three"), ("en", "One Two"), ("fr", "one two"), ("en", None), ("en", "one")]
    g = inp.bigram_glossary(spark.createDataFrame(rows, "lang string, text string"), 2)
    assert [tuple(r) for r in g.collect()] == [("en", "one two", 3)]
    assert "Aggregate" not in {n.nodeName()[-9:] for n in _nodes(g._jdf.queryExecution().sparkPlan())}
