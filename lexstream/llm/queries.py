"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .conversation_repair import op11_conversation_repair
from .decontamination import op6_decontamination
from .embedding_dedup import op2_embedding_dedup
from .licenses import op5_licenses
from .line_dedup import op9_line_dedup
from .mixing import op4_mixing
from .ngram_join import op7_ngram_join
from .pii import op1_pii
from .quality import op3_quality
from .sharding import op10_sharding
from .token_counts import op8_token_counts
from .url_filter import op13_url_filter
from .whitening import op12_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_licenses": op5_licenses,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_url_filter": op13_url_filter,
}
#: A-Z in lower case; null is no text.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op5_licenses": rf"""
      WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
      phrase AS (SELECT label, string_split(t, ' ') AS t FROM (VALUES ('gpl', 'gnu general public license'), ('apache', 'apache license'),
        ('cc-by', 'cc by'), ('mit', 'mit license')) AS v(label, t)),
      notice AS (SELECT row_number() OVER () AS no, label, list_distinct(string_split(t, ' ')) AS t FROM (VALUES
        ('agpl-3.0', 'licensed under the gnu affero general public license version 3'),
        ('apache-2.0', 'licensed under the apache license version 2 0'),
        ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
        ('cc-by-nc-4.0', 'licensed under cc by nc 4 0'),
        ('cc-by-sa-4.0', 'licensed under cc by sa 4 0'),
        ('gpl-3.0', 'licensed under the gnu general public license version 3'),
        ('lgpl', 'licensed under the gnu lesser general public license'),
        ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
        ('mit', 'released under the mit license'),
        ('mpl-2.0', 'subject to the terms of the mozilla public license v 2 0')) AS v(label, t)),
      x AS (SELECT doc_id, w, unnest(range(len(w))) AS k FROM d),
      p AS (SELECT doc_id, label, k FROM x JOIN phrase ON w[k + 1] = t[1] WHERE w[k + 1:k + len(t)] = t),
      base AS (SELECT doc_id, count(*) AS n, min(k) AS first_word, max(k) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
      blocks AS (SELECT doc_id, list_distinct(w[s + 1:s + 64]) AS block
        FROM (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 64) / 32) AS BIGINT)) * 32 + 1, 32)) AS s FROM d WHERE len(w) > 0)),
      held AS (SELECT doc_id, label, len(list_intersect(t, block)) AS n, len(t) AS size FROM blocks, notice),
      found AS (SELECT doc_id, label, n / size AS share FROM held WHERE 100 * n >= 80 * size),
      best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
      every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM found) GROUP BY doc_id)
      SELECT d.doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word, coalesce(base.labels, '') AS base_labels,
        coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END AS score
      FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id)""",
    "op6_decontamination": rf"""
      WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
      b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
      i AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0),
      v AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM i),
      s AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
      g AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM s),
      m AS (SELECT doc_id, g.k, p, item_id FROM g JOIN v ON g.k = v.k AND g.phrase = v.phrase),
      h AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS word FROM (SELECT DISTINCT doc_id, k, p FROM m)) GROUP BY doc_id),
      t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
      SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
      FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op7_ngram_join": rf"""
      WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
      x AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' ')) END)) AS s FROM d),
      k AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM x WHERE len(s) > 0 GROUP BY s),
      e AS (SELECT id, n, unnest(s) AS g FROM k),
      c AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.id < b.id
            GROUP BY a.id, b.id, a.n + b.n),
      l AS (SELECT a, b FROM c WHERE 100 * shared >= 85 * (n - shared)),
      f AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      r AS (SELECT id, id AS root FROM k UNION SELECT f.b, r.root FROM r JOIN f ON f.a = r.id),
      z AS (SELECT id, min(root) AS root FROM r GROUP BY id)
      SELECT x.doc_id, len(x.s) AS n_shingles, coalesce(z.root, x.doc_id) AS component_id
      FROM x LEFT JOIN k ON x.s = k.s LEFT JOIN z ON k.id = z.id""",
    "op9_line_dedup": """
      WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
      x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
      k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
      f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
      g AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
      FROM g GROUP BY doc_id""",
}


#: crc32 of a text of ASCII characters, by its definition: a byte after another, bit after bit.
_CRC32 = """(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))))"""


def _repair_sql() -> str:
    """The cheapest edits by recursion over the rows of a conversation, a struct (cost, edits, text) for each state."""
    line = "role || ':' || text || chr(10)"

    def put(state: str, cost: str, edits: str, text: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edits}', 'b': {state}.b || {text}}} END"

    def turn(role: str) -> str:
        return f"'{role}:' || text || chr(10)"

    def to(role: str, state: str, states: tuple[str, ...], over: tuple[str, ...]) -> str:
        """Options that lead to the state behind a role: without inserts from ``states``, with one from ``over``."""
        other = "assistant" if role == "user" else "user"
        out = [put(state, "3", "D", "''")]
        for s in states:
            out.append(put(s, "flaw", "K", line, f"ok AND r = '{role[0]}'"))
            out.append(put(s, "2 + flaw", "R", turn(role), "ok"))
        for s in over:
            insert = f"'{other}:' || chr(10) || "
            out.append(put(s, "2 + flaw", "IK", insert + line, f"ok AND r = '{role[0]}'"))
            out.append(put(s, "4 + flaw", "IR", insert + turn(role), "ok"))
        return f"list_min([{', '.join(out)}])"

    free, none = "{'c': 0, 'a': '', 'b': ''}", "{'c': 1000000000, 'a': '', 'b': ''}"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    kept = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return rf"""
      WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format(key)} % 20 AS fate
        FROM conversations),
      d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
          CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM t WHERE fate <> 0),
      o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
      f AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN {kept} = '' THEN 'blank'
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
          WHEN right({kept}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
      g AS (SELECT *, fault IN ('', 'truncated') AS ok, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS flaw FROM f),
      n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS rows, count(*) FILTER (WHERE fault = 'blank') AS blank,
          count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
          count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM g) GROUP BY conv_id),
      v AS (SELECT conv_id, rows, CAST(0 AS BIGINT) AS i, {free} AS q0, {none} AS q1, {none} AS q2, {none} AS q3 FROM n
        UNION ALL
        SELECT v.conv_id, rows, g.i, {put('q0', '3', 'D', "''")},
          list_min([{put('q1', '3', 'D', "''")}, {put('q0', 'flaw', 'K', line, "ok AND r = 's'")}]),
          {to('user', 'q2', ('q0', 'q1', 'q3'), ('q2',))}, {to('assistant', 'q3', ('q2',), ('q0', 'q1', 'q3'))}
        FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1),
      e AS (SELECT conv_id, list_min([q0, q3, {put('q2', '2', 'I', "'assistant:' || chr(10)")},
          {put('q1', '4', 'II', "'user:' || chr(10) || 'assistant:' || chr(10)")}]) AS best FROM v WHERE i = rows)
      SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
        sha256(coalesce(left(best.b, -1), '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN n ON x.conv_id IS NOT DISTINCT FROM n.conv_id
        LEFT JOIN e ON x.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES["op11_conversation_repair"] = _repair_sql()

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op13_url_filter"] = rf"""
  WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS v(verdict, host, path)),
  j AS (SELECT * FROM (VALUES ('*casino*', '\..*casino.*', ''), ('*poker*', '\..*poker.*', ''), ('*pills*', '\..*pills.*', ''),
    ('*viagra*', '\..*viagra.*', ''), ('*-bets*', '\..*-bets.*', ''), ('ads.*', '.*\.ads\..*', ''), ('ads-*', '.*\.ads-.*', ''),
    ('**/wp-login', '.*', '/wp-login'), ('**/cart/', '.*', '/cart/'), ('**/login/', '.*', '/login/'), ('**.zip', '.*', '.zip'),
    ('**.exe', '.*', '.exe'), ('**.jpg', '.*', '.jpg'), ('**.png', '.*', '.png'), ('**.css', '.*', '.css'), ('**.js', '.*', '.js'))
    AS v(pattern, host, part)),
  u AS (SELECT DISTINCT host, path FROM p),
  a AS (SELECT u.host, u.path, first(r.host || r.path ORDER BY length(r.host || r.path) DESC, r.verdict = 'block' DESC, r.host || r.path) AS rule,
      first(r.verdict ORDER BY length(r.host || r.path) DESC, r.verdict = 'block' DESC, r.host || r.path) AS verdict
    FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.host, u.path),
  b AS (SELECT u.host, u.path, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern
    FROM u JOIN j ON regexp_full_match('.' || u.host, '(?s)' || j.host) AND contains(u.path, j.part) GROUP BY u.host, u.path)
  SELECT page_id, p.host, p.path, a.rule, coalesce(a.verdict, CASE WHEN b.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN a.rule IS NULL THEN b.pattern END AS pattern
  FROM p LEFT JOIN a ON p.host = a.host AND p.path = a.path LEFT JOIN b ON p.host = b.host AND p.path = b.path"""
