r"""SQL counterparts of the registered queries, for DuckDB.

They restate each result from its rules and share no logic with the Spark plans.  Its regular
expressions have no look-around, so sentence boundaries are found by first marking every full stop
that is none (\x02), rule by rule.
"""

from __future__ import annotations

from . import inputs as inp

ORACLES: dict[str, str] = {}

# The rules in words of their own, so that a slip in the code's patterns shows: white space; characters of words;
# hyphens and dashes; marks that stand close to the word before or behind them; abbreviations that end in a full stop.
SP = r"\x09-\x0D\x1C-\x1F \x85\p{Z}"
WORD = r"_\p{N}\p{L}"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2212"
CL = r"""''"\)\]\}\x{2019}\x{201D}\x{FF09}\x{3011}\x{300B}\x{300D}\x{300F}"""
TOKEN = rf"[{WORD}]+([''\x{{2019}}-][{WORD}]+)*|[^{WORD}{SP}]"
CLOSE_BEHIND = r",.!?;:%\)\]\}\x{3001}\x{3002}\x{FF0C}\x{FF01}\x{FF1F}\x{FF1B}\x{FF1A}\x{2026}\x{FF09}\x{3011}\x{300B}\x{300D}\x{300F}"
CLOSE_BEFORE = r"\(\[\{\x{FF08}\x{3010}\x{300A}\x{300C}\x{300E}"
SHORT_WORDS = "mr|mrs|ms|dr|prof|sr|jr|st|pgs|gs|ts|ths|bs|tp"
SEP = "chr(65535)"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{SP}]+', ' ', 'g'))"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '{TOKEN}')"


def detok(ts: str) -> str:
    return (
        f"regexp_replace(regexp_replace(array_to_string({ts}, ' '), ' ([{CLOSE_BEHIND}])', '\\1', 'g'), "
        f"'([{CLOSE_BEFORE}]) ', '\\1', 'g')"
    )


def guarded(t: str) -> str:
    """Mark full stops that end no sentence."""
    rules = [
        (rf"\.([^{SP}{CL}])", r"\x02\1"),
        (rf"(^|[^\p{{L}}])((?i:{SHORT_WORDS}))\.([{SP}]*[^{SP}])", r"\1\2\x02\3"),
        (rf"([A-Za-z][.\x02][A-Za-z])\.([{SP}]*[^\p{{Lu}}{SP}])", r"\1\x02\2"),
        (rf"(^|[^\p{{L}}\x02]|[^A-Za-z]\x02)(\p{{Lu}})\.([{SP}]*\p{{Lu}})", r"\1\2\x02\3"),
    ]
    for pattern, to in rules:
        for _ in range(2):
            t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t.replace(r"\x02", "\x02")


def marked(t: str) -> str:
    """Put a separator behind every sentence boundary."""
    return f"regexp_replace({guarded(t)}, '[.!?。！？…][.!?。！？…\x02]*[{CL}]*', '\\0' || {SEP}, 'g')"


def sentences(t: str) -> str:
    cut = f"string_split(replace({marked(collapse(t))}, '\x02', '.'), {SEP})"
    return f"list_filter([trim(x) for x in {cut}], lambda x: x <> '')"


def lexical(ts: str) -> str:
    return f"list_filter({ts}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def values(rows: list[tuple], names: str) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


_T, _F, _S = inp.sample_rows()
ACTIVE = [t for t in _T if set(t[1]) & {"general", "grammar"}]
_RANKS = {t[0]: t for t in _T}


def _code_like(form: str) -> bool:
    return any(c.isupper() for c in form) and any(c.islower() for c in form)


FORM_ROWS = [
    (f[1], f[2] if _code_like(f[2]) else f[2].lower(), len(f[2].split()), _code_like(f[2]), f[0], f[2], f[4], f[5],
     _RANKS[f[0]][2], _RANKS[f[0]][4] * 2**32 + f[3], len(f[2]))
    for f in _F if f[0] in {t[0] for t in ACTIVE}
]
FORMS = values(FORM_ROWS, "lang, key, k, cased, term_id, form, canonical, is_alias, priority, rank, len")


def matches(src: str, keys: str, name: str = "m", extra: str = "") -> str:
    """CTEs that find all matches in ``src`` (keys, lang, text)."""
    return f"""
    {name}_l AS (SELECT {keys}, lang, regexp_extract_all(text, '[{WORD}]+|[^{WORD}]+') AS l FROM {src}),
    {name}_p AS (SELECT {keys}, lang, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM {name}_l),
    {name}_w AS (
      SELECT *, sum(length(piece)) OVER w - length(piece) AS off,
        regexp_replace(regexp_replace(piece, '[{SP}]+', ' ', 'g'), '[{HYPHENS}]', '-', 'g') AS g1,
        lead(piece, 1) OVER w AS p2, lead(piece, 2) OVER w AS p3
      FROM {name}_p WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
    {name}_g AS (
      SELECT {keys}, lang, off, 1 AS k, g1 AS g, length(piece) AS n FROM {name}_w
      UNION ALL
      SELECT {keys}, lang, off, 2, g1 || regexp_replace(regexp_replace(p2, '[{SP}]+', ' ', 'g'), '[{HYPHENS}]', '-', 'g') || p3,
        length(piece) + length(p2) + length(p3) FROM {name}_w WHERE p3 IS NOT NULL),
    {name} AS (
      SELECT {keys}, g.lang, f.term_id, f.form, f.canonical, f.is_alias, f.priority, f.rank, f.len,
        CAST(off AS BIGINT) AS s, CAST(off + n AS BIGINT) AS e
      FROM {name}_g g JOIN {FORMS} f ON f.lang = g.lang AND f.k = g.k
        AND f.key = CASE WHEN f.cased THEN g.g ELSE lower(g.g) END)"""


def best(keys: str, m: str = "m", name: str = "b") -> str:
    """The sample forms overlap only by one holding the other, so the longer one wins."""
    on = " AND ".join(f"o.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""
    {name} AS (SELECT * FROM {m} m WHERE NOT EXISTS (
      SELECT 1 FROM {m} o WHERE {on} AND o.s < m.e AND m.s < o.e AND o.e - o.s > m.e - m.s))"""


def spliced(src: str, keys: str, edits: str, name: str = "x") -> str:
    """Texts of ``src`` with the spans of ``edits`` (keys, s, e, rep) replaced."""
    on = " AND ".join(f"g.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    on1 = on.replace("g.", "e.")
    return f"""
    {name}_e AS (
      SELECT e.*, coalesce(lag(e.e) OVER (PARTITION BY {", ".join("e." + k.strip() for k in keys.split(","))} ORDER BY s), 0) AS prev,
        d.text FROM {edits} e JOIN {src} d ON {on1}),
    {name}_g AS (
      SELECT {keys}, count(*) AS n, max(e) AS last,
        string_agg(substring(text, CAST(prev + 1 AS BIGINT), CAST(s - prev AS BIGINT)) || rep, '' ORDER BY s) AS head
      FROM {name}_e GROUP BY {keys}),
    {name} AS (
      SELECT d.*, coalesce(g.n, 0) AS n_edits,
        coalesce(g.head, '') || substring(d.text, CAST(coalesce(g.last, 0) + 1 AS BIGINT)) AS new_text
      FROM {src} d LEFT JOIN {name}_g g ON {on})"""


# Text -------------------------------------------------------------------------------------------

oracle("collapsed_text", f"SELECT doc_id, md5({collapse('text')}) AS text_md5 FROM documents")
oracle("tokens_by_lang", f"""
  SELECT lang, lower(token) AS token, count(*) AS n FROM (SELECT lang, unnest({tokens('text')}) AS token FROM documents)
  GROUP BY ALL""")
oracle("tokens_table", f"""
  SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token
  FROM (SELECT conv_id, turn, {tokens('text')} AS l FROM conversations)""")
oracle("detokenize_roundtrip", f"""
  SELECT doc_id, md5(t) AS text_md5, t = {collapse('text')} AS same FROM (SELECT *, {detok(tokens('text'))} AS t FROM documents)""")
oracle("character_tokens", f"""
  SELECT item_id, len(l) AS n, md5(array_to_string(l, '')) AS text_md5
  FROM (SELECT item_id, regexp_extract_all(text, '[^{SP}]') AS l FROM benchmark)""")
oracle("sentences_by_doc", f"""
  SELECT doc_id, lang, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence
  FROM (SELECT doc_id, lang, {sentences('text')} AS l FROM documents)""")
oracle("sentence_counts", f"""
  SELECT doc_id, length(t) - length(replace(t, {SEP}, '')) AS n_sentences FROM (SELECT doc_id, {marked('text')} AS t FROM documents)""")
SENTENCE_ROWS = f"""
  sl AS (SELECT doc_id, lang, {sentences('text')} AS l, suffix({marked(collapse('text'))}, {SEP}) AS whole FROM documents),
  sr AS (SELECT doc_id, lang, unnest(l) AS text, generate_subscripts(l, 1) AS i, len(l) AS n, whole FROM sl)"""
oracle("sentence_token_ends", f"""
  WITH {SENTENCE_ROWS},
  c AS (SELECT *, sum(len({tokens('text')})) OVER (PARTITION BY doc_id ORDER BY i) AS n_tokens FROM sr)
  SELECT doc_id, i - 1 AS pos, CAST(n_tokens AS BIGINT) AS n_tokens FROM c WHERE i < n OR whole""")
oracle("ends_phrase", f"""
  SELECT conv_id, turn, t <> '' AND suffix({marked('t')}, {SEP}) AS complete
  FROM (SELECT *, regexp_replace(text, '[{SP}]+$', '') AS t FROM conversations)""")


def last_mark(t: str) -> str:
    return f"regexp_extract({t}, '([^{SP}{CL}])[{SP}{CL}]*$', 1)"


def restore(target_mark: str) -> str:
    body = f"regexp_replace(bare, '[{SP}]+$', '')"
    return f"""CASE WHEN regexp_matches(mark, '[.!?。！？…]') AND NOT regexp_matches({last_mark('bare')}, '[.!?。！？…]')
      THEN regexp_replace({body}, '[{CL}]+$', '') || {target_mark} || regexp_extract({body}, '[{CL}]*$')
      ELSE {strip('bare')} END"""


oracle("restore_punctuation", f"""
  WITH {SENTENCE_ROWS},
  q AS (SELECT doc_id, text AS sentence, regexp_replace(text, '[.!?。！？…]+$', '') AS bare, {last_mark('text')} AS mark FROM sr)
  SELECT doc_id, count(*) AS n, count_if({restore('mark')} = sentence) AS n_equal,
    count_if(regexp_matches({restore("CASE mark WHEN '.' THEN '。' WHEN '!' THEN '！' WHEN '?' THEN '？' ELSE mark END")}, '[。！？]$')) AS n_wide
  FROM q GROUP BY doc_id""")

HYP = f"""
  hs AS (SELECT conv_id, turn, {sentences('text')} AS l FROM conversations),
  hu AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS utt, unnest(l) AS s FROM hs),
  h0 AS (SELECT conv_id, turn, utt, conv_id || '-' || turn || '-' || utt AS stream_id, {tokens('s')} AS a FROM hu),
  h1 AS (SELECT *, 5 AS step FROM h0 WHERE len(a) > 0),
  h2 AS (SELECT *, CAST(ceil(len(a) * 1.0 / step) AS INT) AS kmax FROM h1),
  h3 AS (SELECT *, unnest(range(1, kmax + 1)) AS revision FROM h2),
  h4 AS (SELECT *, least(len(a), step * revision) AS sz, revision = kmax AS is_final FROM h3),
  h AS (SELECT conv_id, turn, utt, stream_id, revision, is_final, len(a) AS n_ref, sz, array_to_string(a, ' ') AS ref,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, utt, revision) AS seq,
    CASE WHEN NOT is_final AND revision % 2 = 1 THEN list_concat(a[1:sz - 1], ['zz']) ELSE a[1:sz] END AS tokens,
    1704067200000 + conv_id * 1000 + turn * 3600000 + utt * 60000 + revision * 500 AS ms FROM h4)"""


def lcp(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    diff = f"list_position([{a}[i] <> {b}[i] for i in range(1, {n} + 1)], true)"
    return f"coalesce(nullif({diff}, 0) - 1, {n})"


oracle("common_prefixes", f"""
  WITH {HYP}, j AS (SELECT x.stream_id, {lcp('x.tokens', 'y.tokens')} AS n FROM h x JOIN h y ON x.stream_id = y.stream_id AND y.revision = x.revision + 1)
  SELECT stream_id, CAST(sum(n) AS BIGINT) AS shared, max(n) AS longest FROM j GROUP BY stream_id""")
oracle("sentence_case", """
  WITH u AS (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS t FROM documents)
  SELECT doc_id, md5(CASE WHEN lower(t) = t THEN t ELSE array_to_string([
    regexp_extract(s, '(?s)^([^\\p{L}]*)', 1) || upper(regexp_extract(s, '(?s)^[^\\p{L}]*(\\p{L}?)', 1))
      || regexp_extract(s, '(?s)^[^\\p{L}]*\\p{L}?(.*)$', 1)
    for s in regexp_extract_all(lower(t), '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+')], '') END) AS text_md5 FROM u""")
oracle("normalized_docs", f"""
  WITH n AS (SELECT doc_id, regexp_replace({collapse('nfc_normalize(text)')}, '[{HYPHENS}]', '-', 'g') AS t FROM documents)
  SELECT doc_id, md5(replace(lower(t), 'ß', 'ss')) AS folded_md5, md5(t) AS cased_md5 FROM n""")
oracle("spoken_or_display", """
  SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 1 THEN lower(text) ELSE text END) AS text_md5 FROM conversations""")
oracle("derived_measures", """
  WITH d AS (SELECT event_id, greatest(0, round((value - 20) * 1000000) / 1000.0) AS ms, floor(value) * 160 / 16000 AS dur FROM events)
  SELECT event_id, round(ms, 3) AS latency_ms, round(dur, 6) AS duration_s,
    round(CASE WHEN dur > 0 THEN ms / 1000 / dur ELSE 0 END, 4) AS rtf FROM d""")

# Glossary ---------------------------------------------------------------------------------------

DOC_GLOSSARY = f"""
  gw AS (SELECT item_id AS i, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark),
  gd AS (SELECT *, CASE WHEN i % 10 = 3 THEN 'Term' || i ELSE 'term_' || i END AS term_id, array_to_string(w, ' ') AS canonical
    FROM gw WHERE len(w) > 0),
  gt AS (SELECT i, term_id, CASE WHEN i % 11 = 4 THEN [] WHEN i % 7 = 2 THEN ['a', 'a'] ELSE ['d' || (i % 3)] END AS domains,
    CASE WHEN i % 13 <> 5 THEN i % 4 END AS priority, CASE WHEN i % 9 = 1 THEN 'keep' ELSE 'preserve' END AS policy FROM gd),
  ga AS (SELECT *, CASE WHEN i % 5 = 0 THEN upper(canonical) WHEN i % 5 = 1 THEN left(w[1], 2) ELSE w[-1] END AS alias FROM gd),
  gf AS (SELECT i, term_id, CASE WHEN i % 8 = 6 THEN 'xx' ELSE 'en' END AS lang, u.form, u.form_order, canonical,
      CASE WHEN i % 12 = 7 THEN -1.0 WHEN i % 3 = 0 THEN 2.5 END AS boost, lower(u.form) AS norm
    FROM ga, LATERAL (SELECT canonical AS form, 0 AS form_order UNION ALL SELECT alias, 1) u),
  gs AS (SELECT term_id, CASE WHEN i % 8 = 4 THEN 'fr' ELSE 'en' END AS lang,
    CASE WHEN i % 16 = 8 THEN ' ' ELSE canonical END AS spoken_form FROM gd WHERE i % 4 = 0)"""


def clashes(domains: str, priority: str) -> str:
    return f"""
  cd AS (SELECT DISTINCT f.lang, f.norm, {priority} AS priority, unnest({domains}) AS domain, f.term_id
    FROM gf f JOIN gt t ON t.term_id = f.term_id),
  cf AS (SELECT lang, norm, priority, domain, min(term_id) AS term_a FROM cd WHERE priority IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
  cl AS (SELECT DISTINCT cd.lang, cd.norm, term_a, cd.term_id AS term_b FROM cd JOIN cf USING (lang, norm, priority, domain)
    WHERE cd.term_id <> term_a)"""


oracle("ambiguous_forms", f"WITH {DOC_GLOSSARY}, {clashes(chr(91) + repr('d') + chr(93), '1')} SELECT * FROM cl")
oracle("glossary_violations", f"""
  WITH {DOC_GLOSSARY}, {clashes('t.domains', 't.priority')},
  fl AS (SELECT DISTINCT term_id, lang FROM gf)
  SELECT 'term_id' AS rule, term_id, term_id AS detail FROM gt WHERE NOT regexp_matches(term_id, '^[a-z][a-z0-9_]*$')
  UNION ALL SELECT 'no_domain', term_id, '' FROM gt WHERE len(domains) = 0
  UNION ALL SELECT 'duplicate_domain', term_id, array_to_string(domains, ',') FROM gt WHERE len(domains) > len(list_distinct(domains))
  UNION ALL SELECT 'priority', term_id, '' FROM gt WHERE priority IS NULL
  UNION ALL SELECT 'policy', term_id, policy FROM gt WHERE policy = 'keep'
  UNION ALL SELECT 'duplicate_form', term_id, lang || ':' || norm FROM gf GROUP BY term_id, lang, norm HAVING count(*) > 1
  UNION ALL SELECT 'boost', term_id, form FROM gf WHERE boost <= 0
  UNION ALL SELECT 'language', term_id, lang FROM (SELECT * FROM fl UNION SELECT term_id, lang FROM gs) WHERE lang NOT IN ('en', 'fr')
  UNION ALL SELECT 'blank_spoken_form', term_id, lang FROM gs WHERE trim(spoken_form) = ''
  UNION ALL SELECT 'spoken_without_form', term_id, lang FROM gs WHERE (term_id, lang) NOT IN (SELECT (term_id, lang) FROM fl)
  UNION ALL SELECT 'ambiguous_form', term_a, lang || ':' || norm || ':' || term_b FROM cl""")
GUIDE = f"""{DOC_GLOSSARY},
  gg AS (SELECT * FROM gf QUALIFY row_number() OVER (PARTITION BY lang, norm ORDER BY i, form_order) = 1),
  gu AS (SELECT lang, term_id, form AS text, coalesce(boost, 1.5) AS score, i, form_order, norm FROM gg)"""
oracle("guidance_terms", f"WITH {GUIDE} SELECT lang, term_id, text, CAST(score AS DOUBLE) AS score FROM gu")
oracle("budgeted_terms", f"""
  WITH RECURSIVE {GUIDE},
  o AS (SELECT *, len({tokens('text')}) AS n_tokens, row_number() OVER (PARTITION BY lang ORDER BY i, form_order) AS r FROM gu
    WHERE len({tokens('text')}) > 0),
  walk AS (
    SELECT lang, 0 AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept, false AS took FROM (SELECT DISTINCT lang FROM o)
    UNION ALL
    SELECT o.lang, CAST(o.r AS INT), used + CASE WHEN kept < 30 AND used + n_tokens <= 50 THEN n_tokens ELSE 0 END,
      kept + CASE WHEN kept < 30 AND used + n_tokens <= 50 THEN 1 ELSE 0 END, kept < 30 AND used + n_tokens <= 50
    FROM walk JOIN o ON o.lang = walk.lang AND o.r = walk.r + 1)
  SELECT o.lang, kept - 1 AS pos, term_id, text, CAST(score AS DOUBLE) AS score, n_tokens FROM walk JOIN o ON o.lang = walk.lang AND o.r = walk.r WHERE took""")
oracle("domain_terms", f"""
  WITH {DOC_GLOSSARY} SELECT t.term_id, t.priority, count(*) AS n_forms FROM gt t JOIN gf USING (term_id)
  WHERE list_has_any(t.domains, ['d1', 'a']) GROUP BY ALL""")

PAIRS = values([("fr", "en"), ("en", "fr"), ("de", "en"), ("en", "de"), ("es", "en"), ("fr", "de")], "source, target")
ROUTES = f"""
  l AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang),
  q AS (SELECT lang AS source, t AS target, n_docs FROM l, (SELECT unnest(['en', 'fr', 'de', 'es']) AS t)),
  r AS (SELECT *, CASE WHEN source = target THEN [source]
      WHEN (source, target) IN (SELECT (source, target) FROM {PAIRS}) THEN [source, target]
      WHEN (source, 'en') IN (SELECT (source, target) FROM {PAIRS}) AND ('en', target) IN (SELECT (source, target) FROM {PAIRS})
        THEN [source, 'en', target] END AS route FROM q)"""
TERMS = values([(t[0], t[1], t[2], t[4]) for t in _T], "term_id, domains, priority, i")
ALL_FORMS = values([(f[0], f[1], f[2], f[3], f[4]) for f in _F], "term_id, lang, form, form_order, canonical")
SPOKEN = values([(s[0], s[1], s[2]) for s in _S], "term_id, lang, spoken_form")
oracle("routes", f"WITH {ROUTES} SELECT source, target, n_docs, array_to_string(route, '>') AS route FROM r")
oracle("route_coverage", f"""
  WITH {ROUTES}, n AS (SELECT source, target, n_docs, unnest(route) AS lang FROM r WHERE route IS NOT NULL)
  SELECT source, target, term_id, lang, n_docs FROM n, {TERMS} t
  WHERE (term_id, lang) NOT IN (SELECT (term_id, lang) FROM {ALL_FORMS})""")
oracle("profile_counts", f"""
  WITH {ROUTES}, t AS (SELECT * FROM {TERMS} WHERE list_has_any(domains, ['general', 'grammar'])),
  f AS (SELECT * FROM {ALL_FORMS} WHERE term_id IN (SELECT term_id FROM t)),
  a AS (SELECT lang, count(DISTINCT lower(form)) AS n FROM f GROUP BY lang),
  v AS (SELECT lang, count(*) AS n FROM {SPOKEN} WHERE term_id IN (SELECT term_id FROM t) GROUP BY lang),
  c AS (SELECT source, target, 1 AS profiles, (SELECT count(*) FROM t) AS entries, coalesce(a.n, 0) AS asr_terms,
    (len(route) - 1) * (SELECT count(*) FROM t) AS mt_bindings, coalesce(v.n, 0) AS spoken_forms
    FROM r LEFT JOIN a ON a.lang = source LEFT JOIN v ON v.lang = target WHERE route IS NOT NULL)
  SELECT * FROM c UNION ALL
  SELECT NULL, NULL, sum(profiles), sum(entries), sum(asr_terms), sum(mt_bindings), sum(spoken_forms) FROM c""")
oracle("bundle_violations", """
  WITH b AS (SELECT item_id AS i, 'item-' || item_id AS path FROM benchmark)
  SELECT path, 'bundle_id' AS rule, CASE i % 7 WHEN 1 THEN ' ' ELSE '' END AS detail FROM b WHERE i % 7 IN (1, 2)
  UNION ALL SELECT path, 'schema_version', CASE i % 5 WHEN 2 THEN '2' ELSE '' END FROM b WHERE i % 5 IN (2, 3)
  UNION ALL SELECT path, 'duplicate_default_domain', '["a","a"]' FROM b WHERE i % 6 = 3
  UNION ALL SELECT path, 'default_domains', '["a",""]' FROM b WHERE i % 6 = 4
  UNION ALL SELECT path, 'entries', '[]' FROM b WHERE i % 11 = 4
  UNION ALL SELECT path, 'unknown_field', 'bundle.odd' FROM b WHERE i % 9 = 5
  UNION ALL SELECT path, 'unknown_field', 'entries[0].extra' FROM b WHERE i % 11 <> 4 AND i % 4 = 0
  UNION ALL SELECT path, 'unknown_field', 'entries[0].forms.en.weight' FROM b WHERE i % 11 <> 4 AND i % 8 = 6
  UNION ALL SELECT path, 'unknown_field', 'entries[0].tts.en.voice' FROM b WHERE i % 11 <> 4 AND i % 4 <> 0 AND i % 10 = 3""")
oracle("auto_sources", "SELECT lang, count(*) AS n_docs FROM documents WHERE lang <> 'en' GROUP BY lang")
oracle("hotword_vocab", f"""
  WITH v AS (SELECT DISTINCT lower(t) AS t FROM (SELECT unnest({tokens('text')}) AS t FROM documents)),
  u AS (SELECT item_id, lower(unnest({tokens('text')})) AS t FROM benchmark)
  SELECT item_id AS term_id, bool_and(v.t IS NOT NULL) AS accepted FROM u LEFT JOIN v USING (t) GROUP BY item_id""")

# Matching ---------------------------------------------------------------------------------------

DOC_MATCHES = matches("documents", "doc_id")
oracle("term_matches", f'WITH {DOC_MATCHES} SELECT doc_id, lang, term_id, form, s AS start, e AS "end" FROM m')
oracle("best_matches", f'WITH {DOC_MATCHES}, {best("doc_id")} SELECT doc_id, lang, term_id, form, s AS start, e AS "end" FROM b')
oracle("match_order", f"""
  WITH {DOC_MATCHES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, len DESC, priority DESC, rank) AS pos,
    term_id, s AS start, e AS "end" FROM m""")
oracle("bigram_matches", f"""
  WITH w0 AS (SELECT doc_id, lang, regexp_extract_all(text, '[{WORD}]+|[^{WORD}]+') AS l,
      regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
  pr AS (SELECT lang, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS form FROM w0),
  top AS (SELECT lang, form FROM (SELECT lang, form, count(*) AS n FROM pr GROUP BY ALL)
    WHERE n >= 10),
  px AS (SELECT doc_id, lang, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM w0),
  g AS (SELECT doc_id, lang, lower(piece) || regexp_replace(lead(piece) OVER x, '[{SP}]+', ' ', 'g') || lower(lead(piece, 2) OVER x) AS form
    FROM px WINDOW x AS (PARTITION BY doc_id ORDER BY i))
  SELECT lang, form, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM g JOIN top USING (lang, form) GROUP BY ALL""")


_GRAMS = f"""
  w0 AS (SELECT doc_id, lang, regexp_extract_all(text, '[{WORD}]+|[^{WORD}]+') AS l,
      regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
  pr AS (SELECT lang, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS form FROM w0),
  top AS (SELECT lang, form FROM (SELECT lang, form, count(*) AS n FROM pr GROUP BY ALL) WHERE n >= 10),
  px AS (SELECT doc_id, lang, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM w0),
  po AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS s FROM px),
  g AS (SELECT doc_id, lang, s, s + length(piece) + length(lead(piece) OVER x) + length(lead(piece, 2) OVER x) AS e,
      lower(piece) || regexp_replace(lead(piece) OVER x, '[{SP}]+', ' ', 'g') || lower(lead(piece, 2) OVER x) AS form
    FROM po WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
  m AS (SELECT doc_id, lang, form, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM g JOIN top USING (lang, form)),
  cl AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM m),
  cn AS (SELECT *, count_if(opens) OVER (PARTITION BY doc_id ORDER BY s) AS c FROM cl)"""
oracle("best_bigrams", f"""
  WITH {_GRAMS},
  k AS (SELECT doc_id, lang, list_reduce(list([{{'s': s, 'e': e, 'form': form}}] ORDER BY length(form) DESC, length(form) % 2 DESC, s),
      lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN kept ELSE list_concat(kept, x) END) AS best
    FROM cn GROUP BY doc_id, lang, c),
  u AS (SELECT doc_id, lang, unnest(best) AS b FROM k)
  SELECT doc_id, lang, b.form AS form, count(*) AS n, min(b.s) AS first, max(b.s) AS last FROM u GROUP BY ALL""")
oracle("boundary_matches", f"""
  WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'zh' WHEN 'fr' THEN 'ko' ELSE lang END AS lang, text FROM documents),
  a AS (SELECT doc_id, lang, text, unnest(range(1, length(text) + 1)) AS i FROM d WHERE lang = 'zh'),
  z AS (SELECT doc_id, lang, form, i - 1 AS s, i - 1 + length(form) AS e FROM a, (VALUES ('the'), ('in')) v(form)
    WHERE lower(substring(text, i, length(form))) = form),
  l AS (SELECT doc_id, lang, regexp_extract_all(text, '[{WORD}]+|[^{WORD}]+') AS l FROM d WHERE lang <> 'zh'),
  q AS (SELECT doc_id, lang, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM l),
  w AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS s FROM q),
  v AS (SELECT w.*, [lower(piece), regexp_replace(lead(piece) OVER x, '[{SP}]+', ' ', 'g'), lower(lead(piece, 2) OVER x),
      regexp_replace(lead(piece, 3) OVER x, '[{SP}]+', ' ', 'g'), lower(lead(piece, 4) OVER x)] AS n,
      [length(piece), length(lead(piece) OVER x), length(lead(piece, 2) OVER x), length(lead(piece, 3) OVER x), length(lead(piece, 4) OVER x)] AS k
    FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
  y AS (SELECT doc_id, v.lang, form, CAST(s AS BIGINT) AS s, CAST(s + list_sum(k[1:c]) AS BIGINT) AS e
    FROM v JOIN (VALUES ('ko', 'la', 1), ('ko', 'de la', 3), ('de', 'in', 1), ('es', 'de la en', 5)) f(lang, form, c)
      ON f.lang = v.lang AND array_to_string(n[1:c], '') = form AND list_count(k[1:c]) = c)
  SELECT doc_id, lang, form, s AS start, e AS "end" FROM z UNION ALL SELECT * FROM y""")


def token_hits(src: str, keys: str) -> str:
    """Whole terms by tokens in ``src`` (keys, lang, ts); two-token forms end in words that start none."""
    return f"""
    tk AS (SELECT {keys}, lang, lower(unnest(ts)) AS t, generate_subscripts(ts, 1) - 1 AS i FROM {src}),
    tw AS (SELECT *, lead(t) OVER (PARTITION BY {keys} ORDER BY i) AS t2 FROM tk),
    th AS (SELECT DISTINCT {keys}, i AS a, i + k AS z FROM tw JOIN {FORMS} f ON f.lang = tw.lang
      AND lower(f.form) = CASE WHEN k = 1 THEN t ELSE t || ' ' || t2 END),
    tl AS (SELECT {keys}, a, max(z) AS z FROM th GROUP BY ALL),
    ts AS (SELECT * FROM (SELECT *, lag(z) OVER (PARTITION BY {keys} ORDER BY a) AS reach FROM tl) WHERE reach IS NULL OR a >= reach)"""


oracle("token_term_spans", f"""
  WITH {SENTENCE_ROWS}, src AS (SELECT doc_id, i - 1 AS pos, lang, {tokens('text')} AS ts FROM sr), {token_hits('src', 'doc_id, pos')}
  SELECT doc_id, pos, a AS start, z AS "end" FROM ts""")
oracle("turn_term_spans", f"""
  WITH src AS (SELECT conv_id, turn, 'en' AS lang, {tokens('text')} AS ts FROM conversations), {token_hits('src', 'conv_id, turn')}
  SELECT conv_id, turn, a AS start, z AS "end" FROM ts""")
_EN2 = sorted({f[2].lower() for f in _F if f[1] == "en" and " " in f[2]})
_EN1 = sorted({f[2].lower() for f in _F if f[1] == "en" and " " not in f[2] and f[0] != "other_word"})
_OPEN = sorted({f.split()[0] for f in _EN2})
_q = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
oracle("open_suffix", f"""
  WITH {HYP} SELECT stream_id, revision, len(tokens) - 1 AS open_start FROM h WHERE lower(tokens[-1]) IN {_q(_OPEN)}""")
oracle("prefix_flags", f"""
  WITH {HYP}, u AS (SELECT stream_id, revision, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM h),
  t AS (SELECT stream_id, revision, pos, lower(array_to_string(tokens[pos:pos + 1], ' ')) AS x FROM u)
  SELECT stream_id, revision, pos, x IN {_q(sorted({*_EN1, *_EN2, *_OPEN}))} AS is_prefix, x IN {_q(sorted({*_EN1, *_EN2}))} AS is_term,
    x IN {_q(_OPEN)} AS is_open FROM t""")

# Rewriting --------------------------------------------------------------------------------------


def canonical(src: str, keys: str, m: str = "m", b: str = "b", x: str = "x") -> str:
    surface = "substring(d.text, CAST(b.s + 1 AS BIGINT), CAST(b.e - b.s AS BIGINT))"
    on = " AND ".join(f"d.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""{matches(src, keys, m)}, {best(keys, m, b)},
    {x}_ed AS (SELECT b.*, b.canonical AS rep FROM {b} b JOIN {src} d ON {on} WHERE is_alias AND {surface} <> canonical),
    {spliced(src, keys, x + '_ed', x)}"""


oracle("canonicalized_docs", f"""
  WITH {canonical('documents', 'doc_id')} SELECT doc_id, n_edits AS n_corrections, md5(new_text) AS text_md5 FROM x""")
oracle("canonical_term_counts", f"""
  WITH {canonical('documents', 'doc_id')}, d2 AS (SELECT doc_id, lang, {collapse('new_text')} AS text FROM x),
  {matches('d2', 'doc_id', 'm2')}, {best('doc_id', 'm2', 'b2')}
  SELECT lang, term_id, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM b2 GROUP BY ALL""")
oracle("spoken_text", f"""
  WITH {DOC_MATCHES}, {best('doc_id')},
  ed AS (SELECT b.*, v.spoken_form AS rep FROM b JOIN {SPOKEN} v ON v.term_id = b.term_id AND v.lang = b.lang),
  {spliced('documents', 'doc_id', 'ed')}
  SELECT doc_id, n_edits AS substitutions, md5(new_text) AS text_md5 FROM x""")
TURNS = "turns AS (SELECT conv_id, turn, 'en' AS lang, text FROM conversations)"
oracle("word_timing_remap", f"""
  WITH {TURNS}, {matches('turns', 'conv_id, turn')}, {best('conv_id, turn')},
  ed AS (SELECT b.* FROM b JOIN turns d USING (conv_id, turn) WHERE is_alias
    AND substring(d.text, CAST(b.s + 1 AS BIGINT), CAST(b.e - b.s AS BIGINT)) <> canonical),
  pl AS (SELECT conv_id, turn, regexp_extract_all(text, '{TOKEN}|[{SP}]+') AS l FROM turns),
  pp AS (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM pl),
  po AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS z FROM pp),
  ws AS (SELECT conv_id, turn, word, z - length(word) AS a, z, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS n
    FROM po WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]')),
  wm AS (SELECT ws.*, ed.s, ed.canonical FROM ws LEFT JOIN ed ON ed.conv_id = ws.conv_id AND ed.turn = ws.turn AND ws.a < ed.e AND ed.s < ws.z),
  wg AS (SELECT conv_id, turn, CASE WHEN s IS NULL THEN word ELSE canonical END AS word, min(n) AS n1, max(n) AS n2
    FROM wm GROUP BY conv_id, turn, s, canonical, CASE WHEN s IS NULL THEN n END, CASE WHEN s IS NULL THEN word END, CASE WHEN s IS NULL THEN word ELSE canonical END)
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n1) - 1 AS pos, word,
    round(n1 / 4.0, 4) AS start_s, round((n2 + 1) / 4.0, 4) AS end_s, round(1.0 / (n2 + 1), 6) AS confidence FROM wg""")
oracle("cut_position", f"""
  WITH t AS (SELECT conv_id, turn, {tokens('text')} AS ts FROM conversations),
  m AS (SELECT *, string_split({marked(detok('ts'))}, {SEP}) AS parts FROM t),
  n AS (SELECT *, len({tokens("replace(array_to_string(parts[1:2], ' '), chr(2), '.')")}) AS k FROM m),
  c AS (SELECT conv_id, turn, len({lexical('ts')}) AS all_lex, CASE WHEN len(parts) > 2 THEN len({lexical('ts[1:k]')}) END AS lex FROM n)
  SELECT conv_id, turn, CASE WHEN lex > 0 THEN CAST(least(lex * 4000, all_lex * 4000 + 8000) AS BIGINT) END AS cut_sample FROM c""")
oracle("words_from_pieces", """
  WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS l FROM conversations),
  u AS (SELECT conv_id, turn, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM w),
  c AS (SELECT *, CASE WHEN length(text) > 3 THEN 2 ELSE 1 END AS np FROM u),
  s AS (SELECT *, sum(np) OVER x - np AS pos, sum(np) OVER (PARTITION BY conv_id, turn) AS total FROM c
    WINDOW x AS (PARTITION BY conv_id, turn ORDER BY i)),
  f AS (SELECT * FROM s WHERE regexp_matches(text, '[\\p{L}\\p{N}]')),
  n AS (SELECT *, lead(pos) OVER (PARTITION BY conv_id, turn ORDER BY pos) / 10.0 AS nxt, (pos + np - 1) / 10.0 AS last FROM f)
  SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, text, round(pos / 10.0, 4) AS start_s,
    round(CASE WHEN nxt IS NULL THEN total / 10.0 ELSE nxt - least(0.06, greatest(0, nxt - last) / 2) END, 4) AS end_s FROM n""")
oracle("stripped_context", f"""
  WITH t AS (SELECT conv_id, turn, text, {lexical(tokens('text'))} AS l FROM conversations),
  g AS (SELECT conv_id, turn, text, [i for i in range(0, len(l)) if i % 7 <> 3 and i % 11 <> 5] AS ok, l FROM t)
  SELECT conv_id, turn, len(ok) AS n_valid, CASE WHEN turn % 3 = 0 THEN len(ok) ELSE len(list_filter(ok, lambda i: i >= 4)) END AS n_kept,
    md5(CASE WHEN turn % 3 = 0 OR len(ok) = 0 THEN text
      ELSE coalesce(array_to_string([l[i + 1] for i in list_filter(ok, lambda i: i >= 4)], ' '), '') END) AS text_md5 FROM g""")
oracle("merged_lines", f"""
  WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1) // 4096 AS part FROM conversations)
  SELECT conv_id, part, md5(string_agg({strip('text')}, ' ' ORDER BY turn DESC)) AS text_md5 FROM n GROUP BY ALL""")

# Translation ------------------------------------------------------------------------------------

_CANON = {(f[0], f[1]): f[4] for f in _F}
BOUND = values(
    [(t[0], a, b, _CANON[t[0], a] if t[3] == "preserve" else _CANON[t[0], b])
     for t in ACTIVE for a in inp.LANGS for b in inp.LANGS],
    "term_id, source, target, target_form",
)
SENTENCE_BEST = f"""{SENTENCE_ROWS}, se AS (SELECT doc_id, i - 1 AS pos, lang, text FROM sr),
  {matches('se', 'doc_id, pos')}, {best('doc_id, pos')}"""
oracle("target_forms", f"""
  WITH {DOC_MATCHES}, {best('doc_id')}
  SELECT b.lang, b.term_id, t.target_form, count(*) AS n FROM b JOIN {BOUND} t ON t.term_id = b.term_id AND t.source = b.lang AND t.target = 'en'
  GROUP BY ALL""")
oracle("protected_text", f"""
  WITH {SENTENCE_BEST}, ed AS (SELECT *, printf('__TERM_%04d__', row_number() OVER (PARTITION BY doc_id, pos ORDER BY s)) AS rep FROM b),
  {spliced('se', 'doc_id, pos', 'ed')}
  SELECT doc_id, pos, n_edits AS n_terms, new_text AS protected FROM x""")
oracle("residue_faults", f"""
  WITH {SENTENCE_BEST}, c AS (SELECT doc_id, pos, bool_or(term_id = 'that_word') AS odd FROM b GROUP BY ALL)
  SELECT se.doc_id, CASE WHEN c.odd THEN 'residue' ELSE 'none' END AS fault, count(*) AS n
  FROM se LEFT JOIN c ON c.doc_id = se.doc_id AND c.pos = se.pos GROUP BY ALL""")
oracle("restored", f"""
  WITH {SENTENCE_BEST}, ed AS (SELECT b.*, t.target_form AS rep FROM b JOIN {BOUND} t ON t.term_id = b.term_id AND t.source = b.lang AND t.target = CASE b.lang WHEN 'fr' THEN 'en' ELSE 'fr' END),
  {spliced('se', 'doc_id, pos', 'ed')}
  SELECT doc_id, pos, new_text AS restored FROM x""")
oracle("validated", f"""
  WITH {SENTENCE_BEST}, c AS (SELECT doc_id, pos, count(*) AS n FROM b GROUP BY ALL),
  q AS (SELECT se.doc_id, coalesce(c.n, 0) AS n FROM se LEFT JOIN c ON c.doc_id = se.doc_id AND c.pos = se.pos)
  SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN CASE WHEN q.n > 0 THEN 'missing' ELSE 'none' END
      WHEN 2 THEN CASE WHEN q.n > 0 THEN 'duplicate' ELSE 'unexpected' END WHEN 3 THEN CASE WHEN q.n > 0 THEN 'missing' ELSE 'none' END
      WHEN 4 THEN 'unexpected' WHEN 5 THEN CASE WHEN q.n > 1 THEN 'order' ELSE 'none' END ELSE 'none' END AS fault, count(*) AS n
  FROM q GROUP BY ALL""")
oracle("translation_stats", f"""
  WITH {SENTENCE_BEST}, src AS (SELECT doc_id, source AS stream_id, coalesce(count_if(doc_id % 2 = 0) OVER (PARTITION BY source ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM documents),
  c AS (SELECT doc_id, pos, count(*) AS n FROM b GROUP BY ALL),
  done AS (SELECT doc_id, i - 1 AS pos, i < n OR whole AS done FROM sr),
  e AS (SELECT se.doc_id, se.pos, s.stream_id, coalesce(c.n, 0) AS n, d.done AND row_number() OVER (
      PARTITION BY s.stream_id, s.epoch, se.lang, se.text ORDER BY se.doc_id, se.pos) > 1 AS hit
    FROM se JOIN src s USING (doc_id) LEFT JOIN c ON c.doc_id = se.doc_id AND c.pos = se.pos
      JOIN done d ON d.doc_id = se.doc_id AND d.pos = se.pos),
  t AS (SELECT stream_id, sum(n) AS matches, count(*) AS hops, count_if(hit) AS cache_hits FROM e GROUP BY stream_id)
  SELECT stream_id, CAST(matches AS BIGINT) AS matches, CAST(0 AS BIGINT) AS retries, CAST(0 AS BIGINT) AS fallbacks, hops, cache_hits FROM t""")

# The sample translator puts the target language in front and, by the length of what it is given, spoils the marks of
# some formats: a text survives a format that it leaves as it was.
FORMATS = ("__TERM_%04d__", "OVT%04dOVT", "ZXTERM%04dZX")


def unsteady(t: str) -> str:
    return f"""CASE WHEN length({t}) % 5 = 1 AND contains({t}, '__TERM') THEN replace({t}, '__TERM_', '__term_ ')
      WHEN length({t}) % 5 = 2 AND contains({t}, 'TERM') THEN regexp_replace({t}, '(?i)term', 'T', 'g')
      WHEN length({t}) % 5 = 3 AND regexp_matches({t}, '__TERM|OVT') THEN regexp_replace({t}, '__|OVT', '', 'g') ELSE {t} END"""


def translated(fallback: bool) -> str:
    """Attempts by format; where none survives the whole request fails, or the stretches between terms are asked for."""
    cut = "substring(text, CAST(prev + 1 AS BIGINT), CAST(s - prev AS BIGINT))"
    tail = "substring(text, CAST(z + 1 AS BIGINT))"
    piece = lambda g: f"CASE WHEN {strip(g)} <> '' THEN '[' || target || '] ' || {unsteady(strip(g))} END"
    return f"""
  WITH {SENTENCE_ROWS}, se AS (SELECT doc_id, i - 1 AS pos, lang, text FROM sr
      UNION ALL SELECT doc_id, 0, lang, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sr)),
  {matches('se', 'doc_id, pos')}, {best('doc_id, pos')},
  bt AS (SELECT b.doc_id, b.pos, b.s, b.e, t.target, t.target_form, se.text, row_number() OVER w AS no, coalesce(lag(b.e) OVER w, 0) AS prev
    FROM b JOIN se ON se.doc_id = b.doc_id AND se.pos = b.pos JOIN {BOUND} t ON t.term_id = b.term_id AND t.source = b.lang
      AND t.target = CASE b.lang WHEN 'fr' THEN 'en' ELSE 'fr' END WINDOW w AS (PARTITION BY b.doc_id, b.pos ORDER BY b.s)),
  bg AS (SELECT doc_id, pos, count(*) AS n, max(e) AS z, string_agg({cut} || target_form, '' ORDER BY s) AS held,
      {", ".join(f"string_agg({cut} || printf('{f}', no), '' ORDER BY s) AS g{k}" for k, f in enumerate(FORMATS))},
      string_agg(concat_ws(' ', {piece(cut)}, target_form), ' ' ORDER BY s) AS around FROM bt GROUP BY doc_id, pos),
  q AS (SELECT se.doc_id, se.pos, se.text, CASE se.lang WHEN 'fr' THEN 'en' ELSE 'fr' END AS target, coalesce(n, 0) AS n,
      coalesce(z, 0) AS z, coalesce(held, '') AS held, coalesce(g0, '') AS g0, coalesce(g1, '') AS g1, coalesce(g2, '') AS g2, around
    FROM se LEFT JOIN bg ON bg.doc_id = se.doc_id AND bg.pos = se.pos),
  p AS (SELECT *, g0 || {tail} AS p0, g1 || {tail} AS p1, g2 || {tail} AS p2, held || {tail} AS ok FROM q),
  r AS (SELECT *, CASE WHEN n = 0 OR {unsteady('p0')} = p0 THEN 0 WHEN {unsteady('p1')} = p1 THEN 1 WHEN {unsteady('p2')} = p2 THEN 2 END AS tries FROM p),
  o AS (SELECT *, CASE WHEN n = 0 THEN '[' || target || '] ' || {unsteady('text')} WHEN tries IS NOT NULL THEN '[' || target || '] ' || ok
      {f"ELSE concat_ws(' ', around, {piece(tail)})" if fallback else ""} END AS body FROM r),
  src AS (SELECT doc_id, source AS stream_id, doc_id % 2 = 0 AS is_final, coalesce(count_if(doc_id % 2 = 0) OVER (PARTITION BY source ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM documents),
  dn AS (SELECT doc_id, i - 1 AS pos, i < n OR whole AS done FROM sr),
  ht AS (SELECT dn.doc_id, dn.pos, row_number() OVER (PARTITION BY stream_id, epoch, se.lang, se.text ORDER BY dn.doc_id, dn.pos) > 1 AS hit
    FROM dn JOIN src USING (doc_id) JOIN se ON se.doc_id = dn.doc_id AND se.pos = dn.pos WHERE done),
  mk AS (SELECT o.*, coalesce(ht.hit, false) AS hit, coalesce(dn.done, false) AS done, is_final, body AS bare, {last_mark('o.text')} AS mark
    FROM o JOIN src USING (doc_id) LEFT JOIN dn ON dn.doc_id = o.doc_id AND dn.pos = o.pos LEFT JOIN ht ON ht.doc_id = o.doc_id AND ht.pos = o.pos)
  SELECT doc_id, CASE WHEN count(body) = count(*) THEN string_agg(CASE WHEN done OR is_final THEN {restore('mark')} ELSE body END, ' ' ORDER BY pos) END AS translated,
    CAST(sum(n) AS BIGINT) AS matches, CAST(sum(CASE WHEN n = 0 THEN 0 ELSE coalesce(tries, 2) END) AS BIGINT) AS retries,
    {"count_if(n > 0 AND tries IS NULL)" if fallback else "CAST(0 AS BIGINT)"} AS fallbacks, count(*) AS hops, count_if(hit) AS cache_hits
    {"" if fallback else ", count_if(n > 0 AND tries IS NULL) AS faults"}
  FROM mk GROUP BY doc_id"""


oracle("translated", translated(False))
oracle("translated_with_fallback", translated(True))


def hop(src: str, target: str, name: str) -> str:
    """One steady translation of ``src`` (doc_id, pos, lang, text, ...): terms by their bound forms, the language in front."""
    return f"""
  {matches(src, 'doc_id, pos', name + 'm')}, {best('doc_id, pos', name + 'm', name + 'b')},
  {name}ed AS (SELECT b.doc_id, b.pos, b.s, b.e, t.target_form AS rep FROM {name}b b JOIN {src} d ON d.doc_id = b.doc_id AND d.pos = b.pos
    JOIN {BOUND} t ON t.term_id = b.term_id AND t.source = b.lang AND t.target = d.{target}),
  {spliced(src, 'doc_id, pos', name + 'ed', name + 'x')}"""


oracle("translated_through_pivot", f"""
  WITH {SENTENCE_ROWS}, s1 AS (SELECT doc_id, pos, lang, text, CASE lang WHEN 'es' THEN 'fr' ELSE 'es' END AS last,
      CASE WHEN lang <> 'en' THEN 'en' ELSE 'es' END AS target
    FROM (SELECT doc_id, i - 1 AS pos, lang, text FROM sr UNION ALL SELECT doc_id, 0, lang, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sr))),
  {hop('s1', 'target', 'one')},
  s2 AS (SELECT doc_id, pos, 'en' AS lang, '[en] ' || new_text AS text, last AS target, n_edits AS n1 FROM onex WHERE lang <> 'en'),
  {hop('s2', 'target', 'two')},
  o AS (SELECT doc_id, pos, '[' || target || '] ' || new_text AS bare, n_edits AS n, 1 AS hops FROM onex WHERE lang = 'en'
    UNION ALL SELECT doc_id, pos, '[' || target || '] ' || new_text, n1 + n_edits, 2 FROM twox),
  mk AS (SELECT o.*, {last_mark('s1.text')} AS mark FROM o JOIN s1 ON s1.doc_id = o.doc_id AND s1.pos = o.pos)
  SELECT doc_id, string_agg({restore('mark')}, ' ' ORDER BY pos) AS translated, CAST(sum(n) AS BIGINT) AS matches, CAST(sum(hops) AS BIGINT) AS hops
  FROM mk GROUP BY doc_id""")

# Revision streams -------------------------------------------------------------------------------

oracle("latest_partials", f"""
  WITH {HYP}, q AS (SELECT *, max(revision) OVER w AS top, max(CASE WHEN is_final THEN revision END) OVER w AS fin,
      count_if(NOT is_final) OVER w AS np FROM h WINDOW w AS (PARTITION BY conv_id, turn, utt, ms // 2000))
  SELECT conv_id, turn, utt, revision, is_final, len(tokens) AS n_tokens, np - CASE WHEN fin IS NULL OR fin < top THEN 1 ELSE 0 END AS coalesced
  FROM q WHERE is_final OR revision = top""")
oracle("revision_guard", f"""
  WITH {HYP}, q AS (SELECT conv_id, seq, seq - CASE WHEN seq % 4 = 0 THEN 3 ELSE 0 END AS r FROM h),
  s AS (SELECT *, max(r) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM q)
  SELECT conv_id, count_if(r < seen) AS stale, count(*) AS n FROM s GROUP BY conv_id""")
oracle("changed_only", f"""
  WITH {HYP}, q AS (SELECT conv_id, turn, utt, revision, len(tokens) // 12 AS shown, lag(len(tokens) // 12) OVER (PARTITION BY conv_id ORDER BY seq) AS was FROM h)
  SELECT conv_id, turn, utt, revision, shown FROM q WHERE was IS DISTINCT FROM shown""")
oracle("revision_numbers", f"WITH {HYP} SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS number FROM h")
oracle("utterance_ids", f"""
  WITH {HYP} SELECT conv_id, turn, utt, revision, coalesce(count_if(is_final) OVER (PARTITION BY conv_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS utterance FROM h""")
oracle("elapsed_since_previous", f"""
  WITH {HYP} SELECT conv_id, seq, CAST(ms - lag(ms) OVER (PARTITION BY conv_id ORDER BY seq) AS DOUBLE) AS elapsed_ms FROM h""")
oracle("overload_generations", """
  WITH g AS (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS generation FROM events),
  t AS (SELECT *, max(generation) OVER (PARTITION BY user_id) AS top FROM g)
  SELECT user_id AS session_id, generation, count(*) AS n FROM t WHERE generation = top GROUP BY ALL""")
oracle("frozen_partials", f"""
  WITH {HYP}, e AS (SELECT stream_id, min(CASE WHEN NOT is_final AND len(tokens) >= 10 THEN revision END) AS endpoint FROM h GROUP BY stream_id)
  SELECT stream_id, count(*) AS n, max(revision) AS last FROM h JOIN e USING (stream_id)
  WHERE is_final OR endpoint IS NULL OR revision <= endpoint GROUP BY stream_id""")
oracle("finals_in_order", f"""
  WITH {HYP} SELECT conv_id, turn, utt, row_number() OVER (PARTITION BY conv_id ORDER BY turn, utt) AS place FROM h WHERE is_final""")
oracle("stable_prefix", f"""
  WITH {HYP}, q AS (SELECT *, lag(tokens) OVER (PARTITION BY stream_id ORDER BY revision) AS was FROM h),
  a AS (SELECT stream_id, revision, CASE WHEN was IS NOT NULL THEN tokens[1:{lcp('tokens', 'was')}] END AS agreed FROM q)
  SELECT stream_id, revision, CASE WHEN agreed IS NULL THEN NULL WHEN suffix({marked(detok('agreed'))}, {SEP}) THEN len(agreed)
    ELSE greatest(len(agreed) - 1, 0) END AS n_stable FROM a""")
oracle("sentence_of_token", f"""
  WITH t AS (SELECT conv_id, turn, text, len({tokens('text')}) AS n, {marked(collapse('text'))} AS m FROM conversations),
  s AS (SELECT conv_id, turn, unnest(list_filter([trim(x) for x in string_split(replace(m, chr(2), '.'), {SEP})], lambda x: x <> '')) AS s,
      generate_subscripts(list_filter([trim(x) for x in string_split(replace(m, chr(2), '.'), {SEP})], lambda x: x <> ''), 1) AS i,
      len(list_filter([trim(x) for x in string_split(m, {SEP})], lambda x: x <> '')) AS k, suffix(m, {SEP}) AS whole FROM t),
  c AS (SELECT conv_id, turn, sum(len({tokens('s')})) OVER (PARTITION BY conv_id, turn ORDER BY i) AS z, i < k OR whole AS done FROM s),
  n AS (SELECT conv_id, turn, unnest(range(1, n + 1)) AS token_no FROM t)
  SELECT n.conv_id, n.turn, n.token_no, CAST(min(CASE WHEN done AND z >= token_no THEN z END) AS BIGINT) AS sentence_end
  FROM n LEFT JOIN c ON c.conv_id = n.conv_id AND c.turn = n.turn GROUP BY ALL""")
oracle("revision_rates", f"""
  WITH {HYP} SELECT stream_id, count_if(NOT is_final) AS partials, count_if(is_final) AS finals, count(*) AS revisions,
    round(CASE WHEN max(ms) > min(ms) THEN count(*) / ((max(ms) - min(ms)) / 1000.0) END, 4) AS per_second FROM h GROUP BY stream_id""")
KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in inp.KINDS.items()) + " ELSE 'status' END"
oracle("once_per_key", f"SELECT DISTINCT user_id AS session_id, {KIND} AS type, props AS message FROM events")
FRAMES = """
  fr AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
    value > 35 AS voiced FROM events)"""
oracle("frame_runs", f"""
  WITH {FRAMES}, i AS (SELECT *, frame_no - row_number() OVER (PARTITION BY stream_id, voiced ORDER BY frame_no) AS island FROM fr)
  SELECT stream_id, min(frame_no) AS start, count(*) AS n, voiced FROM i GROUP BY stream_id, voiced, island""")

# Audio ------------------------------------------------------------------------------------------

SAMPLES = """
  sm AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS sequence, unnest(range(1, event_id % 4 + 2)) AS k, value FROM events),
  sx AS (SELECT stream_id, sequence, k, CAST(value * k AS FLOAT) AS x, row_number() OVER (PARTITION BY stream_id ORDER BY sequence, k) - 1 AS off FROM sm)"""
oracle("rechunked", f"""
  WITH {SAMPLES} SELECT stream_id, off // 8 AS frame_no, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 2) AS total FROM sx GROUP BY ALL""")
oracle("phrase_audio", f"""
  WITH {SAMPLES} SELECT stream_id, sequence // 100 AS phrase_no, count(*) AS n_samples, round(count(*) / 16000.0, 6) AS duration_s,
    round(CAST(arg_min(x, (sequence, k)) AS DOUBLE), 2) AS first_sample, round(CAST(arg_max(x, (sequence, k)) AS DOUBLE), 2) AS last_sample
  FROM sx GROUP BY ALL""")

# Events -----------------------------------------------------------------------------------------

oracle("event_json", f"SELECT event_id, {KIND} AS type, 1 AS sample_count FROM events")
oracle("lossless_events", f"""
  SELECT {KIND} AS type, count_if({KIND} <> 'asr_partial') AS lossless, count(*) AS n FROM events GROUP BY ALL""")
oracle("counters", f"SELECT {KIND} AS name, CAST(sum(floor(value)) AS BIGINT) AS amount FROM events GROUP BY ALL")
oracle("windowed_metrics", f"""
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
    {KIND} AS name, CAST(sum(floor(value)) AS BIGINT) AS amount, count(*) AS n FROM events GROUP BY ALL""")
oracle("sliding_metrics", f"""
  WITH w AS (SELECT *, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 7200 * 7200 AS b, unnest([0, 1, 2]) AS k FROM events),
  s AS (SELECT to_timestamp(b - k * 7200) AT TIME ZONE 'UTC' AS window_start, event_type, value FROM w)
  SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, {KIND} AS name, CAST(sum(floor(value)) AS BIGINT) AS amount,
    count(*) AS n FROM s GROUP BY ALL""")
oracle("stage_latency", f"""
  SELECT {KIND} AS type, 'latency_ms' AS name, count(*) AS n, round(avg(value), 4) AS avg, round(min(value), 4) AS min,
    round(max(value), 4) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL""")
def tail(end: str, start: str) -> str:
    return f"round(CASE WHEN {end} IS NOT NULL AND {start} IS NOT NULL THEN greatest(0, (epoch_us({end}) - epoch_us({start})) / 1e6) END, 3)"


oracle("session_report", f"""
  WITH s AS (SELECT user_id, min(ts) AS t0, min(ts) + INTERVAL 20 DAY AS t1 FROM events GROUP BY user_id),
  e AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN ts END) AS a, max(CASE WHEN event_type = 'signup' THEN ts END) AS m,
    max(CASE WHEN event_type = 'purchase' THEN ts END) AS t FROM events GROUP BY user_id),
  j AS (SELECT *, greatest(a, m, t) AS z FROM s JOIN e USING (user_id))
  SELECT user_id AS session_id, {tail('a', 't1')} AS asr_tail_s, {tail('m', 'a')} AS mt_tail_s, {tail('t', 'm')} AS tts_tail_s,
    {tail('z', 't1')} AS post_input_s, {tail('t', 't0')} AS overall_s, round(1728000.0 - 576000.0, 3) AS feed_drift_s FROM j""")
oracle("history", f"""
  WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4096 AS part
    FROM conversations WHERE regexp_matches(text, '[^{SP}]'))
  SELECT conv_id, part, count(*) AS n_texts, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM n GROUP BY ALL""")
oracle("last_warnings", """
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, event_id, props AS message
  FROM events WHERE event_type = 'error' QUALIFY rank <= 5""")
oracle("oldest_events", f"SELECT event_id, {KIND} AS type, user_id AS session_id FROM events ORDER BY ts, event_id LIMIT 100")
oracle("playback", """
  WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS a, CAST(round(value * 100) AS BIGINT) AS d FROM events),
  s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM e),
  f AS (SELECT *, t + max(a - (t - d)) OVER (PARTITION BY user_id ORDER BY event_id) AS z FROM s)
  SELECT user_id AS session_id, event_id, CAST(z - d AS BIGINT) AS start_ms, CAST(z AS BIGINT) AS finish_ms FROM f""")
oracle("pacing", """
  WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS a, CAST(round(value * 100000) AS BIGINT) AS d FROM events),
  s AS (SELECT *, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS media FROM e)
  SELECT user_id AS session_id, event_id, media, greatest(1704067200000 + media - a, 0) AS delay, greatest(a - 1704067200000 - media, 0) AS drift FROM s""")

# Quality ----------------------------------------------------------------------------------------

CASES = f"""
  {DOC_MATCHES}, {best('doc_id')}, wt AS (SELECT DISTINCT doc_id, term_id FROM b),
  gt2 AS (SELECT doc_id, term_id FROM wt WHERE (doc_id + CASE term_id WHEN 'the_word' THEN 1 WHEN 'of_word' THEN 2 ELSE 3 END) % 4 <> 0
    UNION SELECT doc_id, 'other_word' FROM documents WHERE doc_id % 6 = 1),
  oc AS (SELECT coalesce(w.doc_id, g.doc_id) AS case_id, coalesce(w.term_id, g.term_id) AS term_id,
    CASE WHEN g.term_id = 'other_word' AND g.doc_id % 12 = 1 THEN 'excluded_hit' WHEN w.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 'hit'
      WHEN w.doc_id IS NOT NULL THEN 'miss' ELSE 'extra' END AS outcome
    FROM wt w FULL JOIN gt2 g ON w.doc_id = g.doc_id AND w.term_id = g.term_id)"""
oracle("term_outcomes", f"WITH {CASES} SELECT * FROM oc")
oracle("term_quality", f"""
  WITH {CASES}, c AS (SELECT doc_id, lang, source, n_chars / 900.0 AS minutes, count_if(outcome = 'hit') AS h, count_if(outcome = 'miss') AS m,
      count_if(outcome IN ('extra', 'excluded_hit')) AS x FROM documents LEFT JOIN oc ON case_id = doc_id GROUP BY ALL),
  g AS (SELECT lang, source, CAST(sum(h) AS BIGINT) AS hit, CAST(sum(m) AS BIGINT) AS miss, CAST(sum(x) AS BIGINT) AS extra, sum(minutes) AS mins
    FROM c GROUP BY GROUPING SETS ((lang), (source), ()))
  SELECT lang, source, hit, miss, extra, round(CASE WHEN hit + miss > 0 THEN hit / (hit + miss) END, 6) AS recall,
    round(CASE WHEN hit + extra > 0 THEN hit / (hit + extra) END, 6) AS precision,
    round(CASE WHEN mins > 0 THEN extra / mins END, 6) AS false_per_minute FROM g""")
# A right hypothesis lacks the rest of the characters; of a wrong token ``zz``, only letters z of the rest can be kept.
oracle("character_error_rate", f"""
  WITH {HYP},
  k AS (SELECT stream_id, tokens, ref, length(array_to_string(tokens, ' ')) AS n_hyp,
    substring(ref, length(array_to_string(tokens[1:len(tokens) - 1], ' ')) + CASE WHEN len(tokens) > 1 THEN 2 ELSE 1 END) AS rest FROM h),
  c AS (SELECT stream_id, length(ref) AS n, CASE WHEN tokens[-1] <> 'zz' THEN length(ref) - n_hyp
      ELSE greatest(length(rest), 2) - least(2, length(rest) - length(replace(rest, 'z', ''))) END AS d FROM k)
  SELECT stream_id, CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS size, round(sum(d) / sum(n), 6) AS rate FROM c GROUP BY stream_id""")
# A hypothesis of sz right tokens lacks the others; one that ends in a wrong token has one right token less.
oracle("word_error_rate", f"""
  WITH {HYP}, c AS (SELECT stream_id, n_ref, n_ref - sz + CASE WHEN tokens[-1] = 'zz' THEN 1 ELSE 0 END AS d FROM h)
  SELECT stream_id, CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n_ref) AS BIGINT) AS size, round(sum(d) / sum(n_ref), 6) AS rate
  FROM c GROUP BY stream_id""")

# Steps ------------------------------------------------------------------------------------------

# On these streams every text extends what was agreed, so agreed lengths tell all.
AGREED = f"""
  ga AS (SELECT *, lag(tokens) OVER (PARTITION BY stream_id ORDER BY revision) AS was FROM h),
  gb AS (SELECT *, CASE WHEN was IS NULL THEN [] ELSE tokens[1:{lcp('tokens', 'was')}] END AS same FROM ga),
  gc AS (SELECT *, CASE WHEN is_final THEN len(tokens) WHEN suffix({marked(detok('same'))}, {SEP}) THEN len(same)
    ELSE greatest(len(same) - 1, 0) END AS free FROM gb),
  gd AS (SELECT *, CASE WHEN NOT is_final AND free > 0 AND lower(tokens[free]) IN {_q(_OPEN)} THEN lower(tokens[free]) END AS term FROM gc),
  ge AS (SELECT *, term IS NOT NULL AND term IS DISTINCT FROM lag(term) OVER (PARTITION BY stream_id ORDER BY revision) AS opens FROM gd)"""


def shown(size: str) -> str:
    """Rows whose text has grown, numbered, with the terms that began to wait since the row before."""
    return f"""
  sa AS (SELECT *, {size} AS n, sum(CAST(opens AS INT)) OVER (PARTITION BY stream_id ORDER BY revision) AS waits FROM ge),
  sb AS (SELECT *, max(n) OVER (PARTITION BY stream_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sa),
  sc AS (SELECT *, row_number() OVER x AS no, waits - coalesce(lag(waits) OVER x, 0) AS events FROM sb
    WHERE is_final OR n > coalesce(before, 0) WINDOW x AS (PARTITION BY stream_id ORDER BY revision))"""


oracle("committed", f"""
  WITH {HYP}, {AGREED}, {shown('CASE WHEN term IS NULL THEN free ELSE free - 1 END')}
  SELECT stream_id, revision AS in_revision, no AS revision, {detok('tokens[1:n]')} AS text, is_final,
    CAST(events AS BIGINT) AS hold_events, 0 AS flushes FROM sc""")
oracle("mt_schedule", f"""
  WITH RECURSIVE {HYP}, {AGREED}, {shown('free')},
  q AS (SELECT stream_id, no, revision AS in_revision, is_final, n, ms,
    suffix({marked(detok('tokens[1:n]'))}, {SEP}) AS whole FROM sc),
  z AS (SELECT stream_id, min(ms) AS start FROM h GROUP BY stream_id),
  r AS (
    SELECT stream_id, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS in_revision, false AS is_final, CAST(0 AS BIGINT) AS n,
      CAST(0 AS BIGINT) AS known, CAST(start AS BIGINT) AS since, false AS any_before, false AS asked FROM z
    UNION ALL
    SELECT stream_id, no, in_revision, is_final, n, CASE WHEN ask THEN n ELSE known END, CASE WHEN ask THEN ms ELSE since END,
      any_before OR ask, ask
    FROM (SELECT q.stream_id, q.no, q.in_revision, q.is_final, q.n, q.ms, r.known, r.since, r.any_before,
        q.n > 0 AND (q.is_final OR q.n >= 6 AND (q.whole OR q.n - r.known >= 4 AND (NOT r.any_before OR q.ms - r.since >= 500)
          OR q.n > r.known AND q.ms - r.since >= 1200)) AS ask
      FROM r JOIN q ON q.stream_id = r.stream_id AND q.no = r.no + 1))
  SELECT stream_id, in_revision, no AS revision, is_final, n AS n_tokens FROM r WHERE asked""")
def chunks(low: int, high: int) -> str:
    """Phrases ``r`` of the final texts ``t`` (stream_id, text, words, m)."""
    return f"""
  s AS (SELECT stream_id, unnest(list_filter([trim(x) for x in string_split(replace(m, chr(2), '.'), {SEP})], lambda x: x <> '')) AS s,
      generate_subscripts(list_filter([trim(x) for x in string_split(replace(m, chr(2), '.'), {SEP})], lambda x: x <> ''), 1) AS i,
      len(list_filter([trim(x) for x in string_split(m, {SEP})], lambda x: x <> '')) AS k, suffix(m, {SEP}) AS whole FROM t),
  c AS (SELECT stream_id, sum(len({tokens('s')})) OVER (PARTITION BY stream_id ORDER BY i) AS z, i < k OR whole AS done FROM s),
  e AS (SELECT stream_id, list(CAST(z AS BIGINT)) AS ends FROM c WHERE done GROUP BY stream_id),
  src AS (SELECT stream_id, 'en' AS lang, words AS ts FROM t), {token_hits('src', 'stream_id')},
  p AS (SELECT stream_id, list({{'a': CAST(a AS BIGINT), 'z': CAST(z AS BIGINT)}}) AS spans FROM ts GROUP BY stream_id),
  w AS (SELECT t.stream_id, words, len(words) AS n, coalesce(ends, []) AS ends, coalesce(spans, []) AS spans,
      list_filter(range(1, len(words) + 1), lambda i: words[i] IN (',', ';', ':')) AS commas
    FROM t LEFT JOIN e USING (stream_id) LEFT JOIN p USING (stream_id)),
  r AS (
    SELECT stream_id, 0 AS no, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z, 0 AS shifts, 0 AS oversized FROM w
    UNION ALL
    SELECT stream_id, no + 1, here, CASE WHEN sp IS NULL THEN cut WHEN greatest(sp.a, here) - here >= {low} THEN greatest(sp.a, here) ELSE sp.z END,
      CASE WHEN sp IS NULL THEN 0 ELSE 1 END,
      CASE WHEN greatest(sp.a, here) - here < {low} AND sp.z - greatest(sp.a, here) > {high} THEN 1 ELSE 0 END
    FROM (SELECT *, list_filter(spans, lambda x: x.a < cut AND cut < x.z)[1] AS sp
      FROM (SELECT *, CASE WHEN stop <= top THEN stop WHEN stop = top + 1 AND top - 1 - here >= {low} THEN top - 1
          WHEN top < n THEN coalesce(list_max(list_filter(commas, lambda x: x <= top AND x - here >= {low})), top) ELSE n END AS cut
        FROM (SELECT w.*, r.no, r.z AS here, least(w.n, r.z + {high}) AS top, list_min(list_filter(w.ends, lambda x: x > r.z)) AS stop
          FROM r JOIN w ON w.stream_id = r.stream_id WHERE r.z < w.n))))"""


WORDS = f"{tokens('text')} AS words, {marked(collapse('text'))} AS m"
oracle("final_chunks", f"""
  WITH RECURSIVE t AS (SELECT conv_id || '-' || turn AS stream_id, text, {WORDS} FROM conversations), {chunks(8, 24)}
  SELECT w.stream_id, no AS phrase_no, {detok('words[a + 1:z]')} AS text, z = n AS is_final, shifts, oversized
  FROM r JOIN w ON w.stream_id = r.stream_id WHERE no > 0""")
# A sentence ends with its final only, so the final gives all phrases, and no partial has two sentences.
oracle("phrases", f"""
  WITH RECURSIVE {HYP}, {AGREED}, {shown('free')},
  f AS (SELECT stream_id, no AS source_revision, {detok('tokens')} AS text FROM sc WHERE is_final),
  t AS (SELECT stream_id, text, {WORDS} FROM f), {chunks(4, 12)}
  SELECT w.stream_id, r.no AS phrase_no, source_revision, {detok('words[a + 1:z]')} AS text, z = n AS is_final, shifts
  FROM r JOIN w ON w.stream_id = r.stream_id JOIN f ON f.stream_id = r.stream_id WHERE r.no > 0""")
oracle("endpoint", f"""
  WITH {HYP}, {AGREED}, {shown('free')},
  x AS (SELECT *, {detok('tokens[1:n]')} AS text FROM sc)
  SELECT stream_id, revision AS in_revision, text, NOT is_final AS is_endpoint, is_final, 0 AS n_frozen FROM x
  WHERE is_final OR len({marked('text')}) - len(replace({marked('text')}, {SEP}, '')) >= 2""")


def voiced(cut: str) -> str:
    """Segments frame by frame; a frame where ``cut`` holds asks to keep four frames and one of context."""
    return f"""
  WITH RECURSIVE {FRAMES},
  n AS (SELECT stream_id, max(frame_no) + 1 AS stop FROM fr GROUP BY stream_id),
  r AS (
    SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS f, false AS active, false AS asked, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS start,
      0 AS lead, 0 AS before, 0 AS cand, 0 AS size, 0 AS since, 0 AS quiet, 0 AS context,
      CAST(NULL AS BIGINT) AS o_first, CAST(0 AS BIGINT) AS o_from, 0 AS o_n, CAST(0 AS BIGINT) AS o_end, false AS o_final, false AS o_cut,
      0 AS o_context FROM fr
    UNION ALL
    SELECT stream_id, f, opens OR is_cut OR was AND NOT is_end, asked AND NOT was,
      CASE WHEN is_cut THEN first + begin ELSE first END, CASE WHEN is_cut THEN start + greatest(0, begin - lead) ELSE start END,
      CASE WHEN opens THEN before WHEN is_cut THEN greatest(0, lead - begin) ELSE lead END,
      CASE WHEN was OR opens THEN 0 WHEN speech THEN before ELSE least(2, before + 1) END, CASE WHEN was OR opens OR NOT speech THEN 0 ELSE cand END,
      CASE WHEN opens THEN before + cand WHEN is_cut THEN size - begin ELSE size END,
      CASE WHEN opens THEN before + cand WHEN is_cut THEN size - begin WHEN due THEN 0 ELSE since END,
      CASE WHEN opens OR is_cut THEN 0 ELSE quiet END, CASE WHEN opens THEN 0 WHEN is_cut THEN keep - begin ELSE context END,
      CASE WHEN is_cut OR is_end OR due THEN first END, start, CASE WHEN is_cut THEN keep ELSE size - trim END,
      start - lead + greatest(lead, CASE WHEN is_cut THEN keep ELSE size - trim END), is_cut OR is_end, is_cut, context
    FROM (SELECT *, keep - least(1, keep - 1) AS begin, was AND NOT is_end AND NOT is_cut AND since >= 6 AS due,
        CASE WHEN size < 60 AND quiet >= 5 THEN quiet - 2 ELSE 0 END AS trim
      FROM (SELECT *, least(4, size) AS keep, was AND asked AS is_cut, was AND NOT asked AND (size >= 60 OR quiet >= 5) AS is_end,
          NOT was AND cand >= 3 AS opens
        FROM (SELECT r.stream_id, fr.frame_no AS f, fr.voiced AS speech, r.active AS was, r.asked OR ({cut}) AS asked,
            CASE WHEN NOT r.active AND fr.voiced AND r.cand = 0 THEN fr.frame_no ELSE r.first END AS first,
            CASE WHEN NOT r.active AND fr.voiced AND r.cand = 0 THEN fr.frame_no ELSE r.start END AS start, r.lead, r.before,
            CASE WHEN fr.voiced THEN r.cand + 1 ELSE 0 END AS cand, r.size + 1 AS size, r.since + 1 AS since,
            CASE WHEN r.active AND NOT fr.voiced THEN r.quiet + 1 ELSE 0 END AS quiet, r.context
          FROM r JOIN fr ON fr.stream_id = r.stream_id AND fr.frame_no = r.f + 1)))),
  seg AS (
    SELECT stream_id, o_first AS first_frame, o_from AS from_frame, o_end AS end_frame, o_n AS n_frames, f + 1 AS at_frame,
      o_final AS is_final, o_cut AS is_cut, o_context AS context_frames FROM r WHERE o_first IS NOT NULL
    UNION ALL
    SELECT r.stream_id, first, start, start - lead + size, size, stop, true, false, context
    FROM r JOIN n ON n.stream_id = r.stream_id AND f + 1 = stop WHERE active)"""


oracle("segments", f"{voiced('false')} SELECT stream_id, first_frame, from_frame, end_frame, n_frames, at_frame, is_final FROM seg")
oracle("cut_segments", f"""{voiced('fr.voiced AND fr.frame_no % 17 = 5')}
  SELECT stream_id, first_frame, end_frame, n_frames, at_frame, is_final, is_cut, context_frames FROM seg""")
