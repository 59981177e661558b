"""DuckDB statements of the queries that SQL can state."""
from __future__ import annotations

from .secret_rules import RULES

SQL = {}

SQL["op2_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17' || coalesce(':' || CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS place
  FROM documents),
per_source AS (
  SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS budget, CAST(sum(weight) AS BIGINT) AS weights FROM per_source),
ranked AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER w AS k,
         CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS cap_before,
         CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_before
  FROM per_source
  WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST),
         before AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT budget - cap_before AS rest, weights - weight_before AS open_weight, k FROM ranked, total
  WHERE CAST(weight AS DOUBLE) * CAST(budget - cap_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) <= cap
  ORDER BY k LIMIT 1),
goals AS (
  SELECT source, n_docs, source_size, CASE WHEN r.k < l.k THEN CAST(cap AS DOUBLE)
         ELSE CAST(weight AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target, cap
  FROM ranked r, level l),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(round(target) AS BIGINT), cap) // source_size ELSE 0 END AS whole,
         least(CAST(round(target) AS BIGINT), cap) AS goal FROM goals),
placed AS (
  SELECT s.*, p.* EXCLUDE (source), goal - whole * source_size
           - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, remaining)) AS BIGINT) AS taken,
       CAST(whole AS BIGINT) AS whole, CAST(greatest(0, least(size, remaining)) AS BIGINT) AS part
FROM placed"""



def _secrets() -> str:
    """Spans of each rule from the lengths of its matches and of the pieces between them."""
    def pattern(rule) -> str:  # a run of one class can be asked for its least length at once
        return (rule.pattern[:-1] + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern).replace("'", "''")

    pieces = ",\n    ".join(
        f"regexp_extract_all(body, '{pattern(r)}') AS m{i}, regexp_extract_all(body, '{pattern(r)}', {r.group}) AS p{i}, "
        f"regexp_split_to_array(body, '{pattern(r)}') AS g{i}" for i, r in enumerate(RULES))
    lists = ",\n    ".join(f"""list_transform(list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: struct_pack(
      start := CAST(list_sum(list_transform(g{i}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
      n := length(m{i}[i]), part := length(p{i}[i]))), lambda s: s.part >= {r.least}),
      lambda s: struct_pack(start := s.start, rule := {i}, span := '{r.kind}:' || s.start || ':' || (s.start + s.n))) AS s{i}""" for i, r in enumerate(RULES))
    every = "list_concat(" * (len(RULES) - 1) + "s0" + "".join(f", s{i})" for i in range(1, len(RULES)))
    return f"""
WITH pieces AS (
  SELECT doc_id, {pieces}
  FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)),
found AS (
  SELECT doc_id, {lists}
  FROM pieces),
listed AS (
  SELECT *, list_sort(list_concat(list_concat(s0, s1), s2)) AS base, list_sort({every}) AS every FROM found)
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
       sha256(array_to_string(list_transform(base, lambda s: s.span), ',')) AS base_sha256,
       array_to_string(list_transform(every, lambda s: s.span), ',') AS spans
FROM listed"""


SQL["op8_secrets"] = _secrets()

# crc32 over the hexadecimal digits of a byte string; its table comes from the polynomial.
CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32_sql(text: str, table: str = "t") -> str:
    digits = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda d: CAST('0x' || d AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])), 4294967295)"


SQL["op11_rendezvous"] = f"""
WITH claims AS (
  SELECT doc_id, text, list_transform(range(9), lambda i: {{'claim': -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13)
         AS BIGINT) + 0.5::DOUBLE) / 4503599627370496), 'shard': i}}) AS c
  FROM documents),
placed AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
         CAST(list_min(c[1:8]).shard AS INT) AS shard, CAST(list_min(c).shard AS INT) AS grown_shard
  FROM claims, {CRC_TABLE})
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed"""

SQL["op13_setm"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, words
  FROM (SELECT lang, list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+')) AS lists FROM documents),
       unnest(lists) AS u(words)),
spots AS (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS spot FROM pieces),
following AS (
  SELECT lang, w, lead(w, 1) OVER places AS w2, lead(w, 2) OVER places AS w3 FROM spots WINDOW places AS (PARTITION BY piece ORDER BY spot)),
phrases AS (
  SELECT lang, [w] AS words, 1 AS k, count(*) AS f FROM following GROUP BY lang, w
  UNION ALL SELECT lang, [w, w2], 2, count(*) FROM following WHERE w2 IS NOT NULL GROUP BY lang, w, w2
  UNION ALL SELECT lang, [w, w2, w3], 3, count(*) FROM following WHERE w3 IS NOT NULL GROUP BY lang, w, w2, w3),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM phrases WHERE k > 1 AND f >= 10),
absorbed AS (
  SELECT lang, words, max(f) AS around FROM (
    SELECT lang, words[1:2] AS words, f FROM candidates WHERE k = 3 UNION ALL SELECT lang, words[2:3], f FROM candidates WHERE k = 3)
  GROUP BY lang, words),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, cut, h.f AS l, t.f AS r,
         CAST(CAST(c.f AS HUGEINT) * c.f * 1000000 // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM candidates c, (VALUES (1), (2)) AS points(cut), phrases h, phrases t
  WHERE cut < c.k AND h.lang = c.lang AND h.words = c.words[1:cut] AND t.lang = c.lang AND t.words = c.words[cut + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
ranked AS (
  SELECT c.lang, array_to_string(c.words, ' ') AS phrase, a, l, r, score
  FROM lowest c LEFT JOIN absorbed b ON b.lang = c.lang AND b.words = c.words WHERE around IS NULL OR 100 * around < 50 * a)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000"""

# Cheapest repairs: from the last row on, a list of cost and audit by state (nothing yet, after s, after u, after ua) is carried along.


def _repairs() -> str:
    def edit(cost: str, letter: str, state: int) -> str:
        return f"{{'cost': v[{state}].cost + {cost}, 'audit': '{letter}' || v[{state}].audit}}"

    steps = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    reached = {1: 3, 2: 3, 3: 4, 4: 3}  # by the role other than system that may come next
    ways = ", ".join("list_min([" + ", ".join(
        [edit("2", "D", s), edit("1 + extra", "R", reached[s])] + [edit(f"extra + CASE WHEN initial = '{r}' THEN 0 ELSE 1000000000 END", "K", t)
                                                                                       for r, t in steps[s].items()]) + "])" for s in steps)
    more = ", ".join(f"list_min([v[{s}], {edit('5', 'I', reached[s])}])" for s in steps)

    def insertions(source: str, kept: str) -> str:
        for _ in range(3):
            source = f"(SELECT {kept}, [{more}] AS v FROM {source})"
        return source

    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations, {CRC_TABLE}),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM placed),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
signs AS (
  SELECT conv_id, i, role[1] AS initial, CASE fault WHEN 'truncated' THEN 5 WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 ELSE 0 END AS extra
  FROM faults),
togo(conv_id, left_rows, v) AS (
  SELECT conv_id, left_rows, v FROM {insertions("(SELECT conv_id, n AS left_rows, [{'cost': 0, 'audit': ''}, {'cost': 1000000000, 'audit': ''}, {'cost': 1000000000, 'audit': ''}, {'cost': 0, 'audit': ''}] AS v FROM facts)", "conv_id, left_rows")}
  UNION ALL
  SELECT conv_id, left_rows, v FROM {insertions(f"(SELECT t.conv_id, left_rows - 1 AS left_rows, [{ways}] AS v FROM togo t JOIN signs s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.i = t.left_rows)", "conv_id, left_rows")}),
best AS (SELECT conv_id, CAST(v[1].cost AS BIGINT) AS cost, v[1].audit AS audit FROM togo WHERE left_rows = 0),
walk(conv_id, audit, k, i, state, line) AS (
  SELECT conv_id, audit, 0, 0::BIGINT, 1, NULL::VARCHAR FROM best
  UNION ALL
  SELECT w.conv_id, audit, k + 1, CASE WHEN edit = 'I' THEN w.i ELSE w.i + 1 END,
         CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND f.role[1] = 's' THEN 2 WHEN state = 3 THEN 4 ELSE 3 END,
         CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN f.role || ':' || f.text
              ELSE CASE state WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE edit WHEN 'R' THEN f.text ELSE '' END END
  FROM (SELECT *, audit[k + 1] AS edit FROM walk WHERE k < length(audit)) w
  LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS body FROM walk GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""


SQL["op12_dawg"] = _repairs()
