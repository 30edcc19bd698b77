"""DuckDB SQL of the opN_ queries that SQL can say, in numbers of its own."""

from __future__ import annotations


def _crc32(blob: str) -> str:
    """CRC-32 of a blob: a fold over its bits, the lowest of each byte first."""
    number = f"list_transform(range(1, length(hex({blob})) + 1, 2), lambda i: CAST('0x' || substr(hex({blob}), i, 2) AS BIGINT))"
    bits = f"flatten(list_transform({number}, lambda b: list_transform(range(8), lambda k: (b >> k) & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _more(state: str, cost: str, letters: str) -> str:
    """A state is its cost in nine digits and the audit, so that texts sort as (cost, audit)."""
    return f"lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || {letters}"


#: A cost that no edits have; sums of a few stay within nine digits.
_NEVER = 10_000_000

TURN_REPAIR = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT key, {_crc32("encode(key)")} % 20 AS kind FROM (SELECT DISTINCT key FROM keyed)),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS again
  FROM keyed JOIN kinds USING (key)),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS nr, left(role, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM hurt),
faults AS (
  SELECT conv_id, turn, role, text, nr, i, lag(i) OVER (PARTITION BY conv_id ORDER BY nr) AS before,
    CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM rows),
moves AS (
  SELECT conv_id, nr, CASE WHEN fault IN ('blank', 'duplicate') THEN {_NEVER} WHEN i = 'u' THEN late ELSE 2 + late END AS to_u, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS by_u,
    CASE WHEN fault IN ('blank', 'duplicate') THEN {_NEVER} WHEN i = 'a' THEN late ELSE 2 + late END AS to_a, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS by_a,
    CASE WHEN fault IN ('blank', 'duplicate') OR i <> 's' THEN {_NEVER} ELSE late END AS to_s
  FROM (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM faults)),
fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS nr, '000000000' AS a, '{_NEVER:09d}' AS b, '{_NEVER:09d}' AS c, '{_NEVER:09d}' AS d FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, nr, {_more("a", "3", "'D'")}, least({_more("b", "3", "'D'")}, {_more("a", "to_s", "'K'")}),
    least({_more("c", "3", "'D'")}, {_more("least(a, b, d)", "to_u", "by_u")}), least({_more("d", "3", "'D'")}, {_more("c", "to_a", "by_a")})
  FROM (
    SELECT m.*, a, b, least(c, {_more("a", "2", "'I'")}, {_more("b", "2", "'I'")}, {_more("d", "2", "'I'")}) AS c, least(d, {_more("c", "2", "'I'")}, {_more("a", "4", "'II'")}, {_more("b", "4", "'II'")}) AS d
    FROM fold JOIN moves AS m ON m.nr = fold.nr + 1 AND m.conv_id IS NOT DISTINCT FROM fold.conv_id)),
ends AS (
  SELECT conv_id, least(a, d, {_more("c", "2", "'I'")}, {_more("b", "4", "'II'")}) AS best FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY nr DESC) = 1),
audits AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ends),
letters AS (SELECT conv_id, length(replace(audit, 'D', '')) % 2 AS lead, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits),
steps AS (
  SELECT conv_id, k, substr(audit, k, 1) AS e, length(replace(substr(audit, 1, k - 1), 'D', '')) - lead AS spot, length(replace(substr(audit, 1, k), 'I', '')) AS nr FROM letters),
lines AS (
  SELECT s.conv_id, k, CASE WHEN e = 'K' THEN f.role WHEN spot % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
  FROM steps s LEFT JOIN faults f ON e <> 'I' AND f.nr = s.nr AND f.conv_id IS NOT DISTINCT FROM s.conv_id WHERE e <> 'D'),
texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


RESAMPLING = f"""
WITH docs AS (
  SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
goal AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
found AS (SELECT nr, unnest(words) AS word FROM docs),
bucket AS (SELECT word, {_crc32("encode(word)")} % 10000 AS bucket FROM (SELECT word FROM found UNION SELECT word FROM goal)),
s AS (SELECT bucket, count(*) AS s FROM found JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal JOIN bucket USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * ((SELECT count(*) FROM found) + CAST(10000 AS DOUBLE)) / ((s + CAST(1 AS DOUBLE)) * ((SELECT count(*) FROM goal) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT nr, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN bucket USING (word) JOIN gains USING (bucket) GROUP BY nr),
scored AS (
  SELECT doc_id, len(words) AS n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (nr)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n) AS place, count(*) OVER (PARTITION BY n >= 20) AS eligible FROM scored)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM ranked
"""
