"""DuckDB statements for the operators that SQL can express."""

from tallyloom.llm.quality_rules import IN_CONTEXT

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), grams AS (
  SELECT r, len(ws) AS n, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM grams
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c >= 2) GROUP BY r
), lines AS (
  SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM w
), facts AS (
  SELECT r, k, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw, lower(l) AS low FROM lines
), judged AS (
  SELECT r, k, l,
    len(regexp_extract_all(l, '[#*$%&|<>]')) > len(lw) * 0.3
    OR len(regexp_extract_all(l, '!!')) > len(lw) * 0.3
    OR (len(lw) >= 10 AND l = upper(l) AND l <> low)
    OR (len(lw) >= 10 AND len(list_distinct(lw)) < len(lw) * 0.3)
    OR (len(lw) <= 4 AND NOT regexp_matches(l, '[.!?:;…。！？]["''”’»)\]]*\s*$'))
    OR (length(l) <= 200 AND (contains(low, 'all rights reserved') OR contains(low, 'licensed under')
        OR contains(low, 'privacy policy') OR contains(low, 'terms of use') OR contains(low, 'terms of service')
        OR contains(low, 'enable javascript') OR contains(low, 'lorem ipsum') OR contains(low, 'subscribe to our')
        OR contains(low, 'alle rechte vorbehalten') OR contains(low, 'lizenziert unter')
        OR contains(low, 'nutzungsbedingungen') OR contains(low, 'javascript aktivieren')
        OR contains(low, 'newsletter abonnieren') OR contains(low, 'tous droits réservés') OR contains(low, 'sous licence')
        OR contains(low, 'politique de confidentialité') OR contains(low, 'conditions d''utilisation') OR contains(low, 'mentions légales')
        OR contains(low, 'activer javascript') OR contains(low, 'abonnez-vous') OR contains(low, 'todos los derechos reservados')
        OR contains(low, 'bajo licencia') OR contains(low, 'política de privacidad') OR contains(low, 'términos de uso')
        OR contains(low, 'condiciones de uso') OR contains(low, 'aviso legal') OR contains(low, 'activar javascript')
        OR contains(low, 'suscríbete') OR CONTEXT)) AS fails
  FROM facts
), cleaned AS (
  SELECT r, count(*) FILTER (fails) AS n_failed_lines,
         coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) FILTER (NOT fails), 0) AS kept_chars
  FROM judged GROUP BY r
), base AS (
  SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
         coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN covered ON covered.r = w.r LEFT JOIN cleaned ON cleaned.r = w.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= word_chars * 0.5 AS kept,
       n_failed_lines
FROM base
"""

#: Written out from the operator's own list: the patterns are one and the same.
OP8 = OP8.replace("CONTEXT", " OR ".join(f"regexp_matches(low, '{p}')" for p in IN_CONTEXT))

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(rk - 1) % 3 + 1]::DOUBLE AS weight, [0.5, 0.0, -0.5][(rk - 1) % 3 + 1]::DOUBLE AS slope,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM s
), f AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before,
         sum(weight) OVER () AS all_weight
  FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (SELECT (g.budget - g.cap_before) / (g.all_weight - g.weight_before) FROM f g
             WHERE (g.budget - g.cap_before) / (g.all_weight - g.weight_before) <= 2.0::DOUBLE * g.source_size / g.weight
             ORDER BY 2.0::DOUBLE * g.source_size / g.weight, g.rk LIMIT 1) AS level
  FROM f
), t AS (
  SELECT source, source_size, slope, coalesce(least(2.0::DOUBLE * source_size, level * weight), 2.0::DOUBLE * source_size) AS target FROM l
), x AS (
  SELECT doc_id, size, source_size, target, slope, CAST(floor(target) AS BIGINT) AS whole,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes,
         CASE WHEN target > 0 THEN least(start / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS share
  FROM x
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + least(greatest(whole - passes * source_size - start, 0), size) AS BIGINT) AS taken,
       round(CASE WHEN slope = 0 THEN share ELSE abs((sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope)) END, 9) AS position
FROM y
"""

#: CRC-32 of a column's ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}, ''),
    lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         CASE WHEN doc_id IS NULL THEN 1 ELSE CRC END AS h
  FROM documents
), g AS (
  SELECT r, doc_id, ws, h, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a FROM d
), p AS (
  SELECT r, doc_id, ws, h, n, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g
), planted AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
      THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws
  FROM p
), w AS (
  SELECT r, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM planted
), equal AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= 12 AND length >= 2 * q GROUP BY r, start, length
), facts AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_min({'s': start, 'n': length, 'p': period}, [-length, start, period]) AS best
  FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS words
  FROM (SELECT r, w, i FROM w ANTI JOIN (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs) USING (r, i)) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.n // best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM planted LEFT JOIN facts USING (r) LEFT JOIN kept USING (r)
""".replace("CRC", _CRC.format("doc_id::VARCHAR"))


def _way(x: str, cost: str, edit: str) -> str:
    return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_FAR = "{'c': 1000000000000, 'a': ''}"
#: Inserts before a turn, then what may be done with it, for each grammar state.
_INSERTED = f"""b0 AS e0, b1 AS e1, {_least("b2", *(_way(x, "3", "I") for x in ("b0", "b1", "b3")))} AS e2,
         {_least("b3", _way("b2", "3", "I"), _way("b0", "6", "II"), _way("b1", "6", "II"))} AS e3"""


def _kept(x: str, initial: str) -> str:
    return f"CASE WHEN NOT forced AND initial = '{initial}' THEN {_way(x, 'extra', 'K')} ELSE {_FAR} END"


def _reroled(x: str) -> str:
    return f"CASE WHEN NOT forced THEN {_way(x, '3 + extra', 'R')} ELSE {_FAR} END"


_CONSUMED = f"""{_way("e0", "4", "D")} AS b0, {_least(_way("e1", "4", "D"), _kept("e0", "s"))} AS b1,
         {_least(_way("e2", "4", "D"), *(f(x) for x in ("e0", "e1", "e3") for f in (lambda x: _kept(x, "u"), _reroled)))} AS b2,
         {_least(_way("e3", "4", "D"), _kept("e2", "a"), _reroled("e2"))} AS b3"""

OP12 = (
    r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, role, text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), c AS (
  SELECT conv_id, turn, role, text, CRC % 20 AS k FROM hashed
), damaged AS (
  SELECT conv_id, turn, coalesce(CASE WHEN k = 4 THEN 'user' ELSE role END, ' ') AS role,
         coalesce(CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END, ' ') AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c
), ids AS (
  SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
), numbered AS (
  SELECT id, turn, role, text, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, copy) AS k
  FROM damaged d JOIN ids i ON d.conv_id IS NOT DISTINCT FROM i.conv_id
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY id, role, text ORDER BY k) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY id ORDER BY k) AS before
  FROM numbered
), codes AS (
  SELECT id, k, role, text, initial, blank OR again AS forced, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM judged
), facts AS (
  SELECT id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
         count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY id
), path AS (
  SELECT id, 0::BIGINT AS k, {'c': 0::BIGINT, 'a': ''} AS b0, FAR AS b1, FAR AS b2, FAR AS b3 FROM ids
  UNION ALL
  SELECT id, k, CONSUMED FROM (
    SELECT p.id, c.k, c.initial, c.forced, c.extra, INSERTED FROM path p JOIN codes c ON p.id = c.id AND c.k = p.k + 1
  )
), ends AS (
  SELECT id, arg_max(LEAST, k) AS best FROM path GROUP BY id
), edits AS (
  SELECT id, unnest(string_split(best.a, '')) AS e, generate_subscripts(string_split(best.a, ''), 1) AS i FROM ends WHERE best.a <> ''
), steps AS (
  SELECT id, e, i, count(*) FILTER (e <> 'I') OVER w AS k, count(*) FILTER (e <> 'D') OVER w AS o, count(*) FILTER (e <> 'D') OVER (PARTITION BY id) AS n
  FROM edits WINDOW w AS (PARTITION BY id ORDER BY i)
), repaired AS (
  SELECT s.id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o + n) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines
  FROM steps s LEFT JOIN codes c ON s.id = c.id AND s.k = c.k WHERE e <> 'D' GROUP BY s.id
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids LEFT JOIN facts USING (id) JOIN ends USING (id) LEFT JOIN repaired USING (id)
""".replace("CRC", _CRC.format("name"))
    .replace("FAR", _FAR)
    .replace("CONSUMED", _CONSUMED)
    .replace("INSERTED", _INSERTED)
    .replace("LEAST", _least("b0", "b3", _way("b1", "6", "II"), _way("b2", "3", "I")))
)

SQL = {"op8_quality_rules": OP8, "op9_mixing": OP9, "op11_periodic_runs": OP11, "op12_conversation_repair": OP12}
