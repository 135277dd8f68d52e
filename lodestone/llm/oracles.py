"""DuckDB SQL of op12 and op13, which needs CRC-32, edits as strings, and long expressions made of a few short ones."""

from __future__ import annotations

#: The table of CRC-32 by its rule: a list of 256 numbers.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _crc(hexed: str) -> str:
    """CRC-32 of bytes that the column hexed spells, with the table in column t."""
    numbers = f"list_transform(range(length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


# A state of the walk over a conversation is one string: the cost in nine digits, the edits, chr(1), and the repaired
# turns with a line feed before each. The smallest string is the cheapest way, and of those the first one in ASCII.

_USER, _ASSISTANT, _OWN = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
_LATE = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _add(state: str, cost: int | str, letter: str, line: str = "''") -> str:
    at = f"strpos({state}, chr(1))"
    return f"(lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10, {at} - 10) || '{letter}' || chr(1) || substr({state}, {at} + 1) || {line})"


def _least(*states: str) -> str:
    return f"least({', '.join(states)})"


def _inserted() -> str:
    """The states after a user's turn may have been inserted."""
    return f"s0, s1, {_least('s2', *(_add(s, 2, 'I', _USER) for s in ('s0', 's1', 's3')))} AS s2, s3"


def _inserted_last() -> str:
    """The states after an assistant's turn may have been inserted."""
    return f"s0, s1, s2, {_least('s3', _add('s2', 2, 'I', _ASSISTANT))} AS s3"


def _kept(initial: str, *states: str) -> list[str]:
    return [f"CASE WHEN left(role, 1) = '{initial}' AND fault NOT IN ('blank', 'duplicate') THEN {_add(s, _LATE, 'K', _OWN)} END" for s in states]


def _rerole(line: str, *states: str) -> list[str]:
    return [f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_add(s, '2 + ' + _LATE, 'R', line + ' || text')} END" for s in states]


OP12_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT {CRC_TABLE} AS t),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
k AS (SELECT *, {_crc('h')} % 20 AS kind FROM c, crc_table),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text, copy FROM k, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, {BLANKS}) AS ended FROM damaged),
rows_ AS (SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows_ GROUP BY conv_id),
walk(conv_id, i, s0, s1, s2, s3) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000' || chr(1), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM conversations
  UNION ALL SELECT conv_id, i, {_add('s0', 3, 'D')}, {_least(_add('s1', 3, 'D'), *_kept('s', 's0'))}, {_least(_add('s2', 3, 'D'), *_kept('u', 's0', 's1', 's3'), *_rerole(_USER, 's0', 's1', 's3'))}, {_least(_add('s3', 3, 'D'), *_kept('a', 's2'), *_rerole(_ASSISTANT, 's2'))}
  FROM (SELECT conv_id, i, role, text, fault, {_inserted_last()} FROM (SELECT r.conv_id, r.i, role, text, fault, {_inserted()} FROM walk JOIN rows_ r ON walk.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = walk.i + 1))),
ends AS (SELECT conv_id, least(s0, s3) AS s FROM (SELECT conv_id, i, {_inserted_last()} FROM (SELECT conv_id, i, {_inserted()} FROM walk)) w
  WHERE i = coalesce((SELECT max(n) FROM facts WHERE facts.conv_id IS NOT DISTINCT FROM w.conv_id), 0))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(substr(s, 1, 9) AS BIGINT) AS cost, substr(s, 10, strpos(s, chr(1)) - 10) AS audit, sha256(substr(s, strpos(s, chr(1)) + 2)) AS repaired_sha256
FROM ends e LEFT JOIN facts f ON e.conv_id IS NOT DISTINCT FROM f.conv_id
"""

OP13_SQL = fr"""
WITH lowered AS (SELECT 'd' AS k, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(t, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM lowered),
f AS (SELECT k, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)), crc_table AS (SELECT {CRC_TABLE} AS t),
b AS (SELECT f, {_crc('h')} % 10000 AS b FROM names, crc_table),
n AS (SELECT b, count(*) FILTER (WHERE k = 'd') AS s, count(*) FILTER (WHERE k = 'b') AS t FROM f JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS g FROM n),
d AS (SELECT id, CAST(count(*) AS BIGINT) AS n, sum(g) AS g FROM f JOIN b USING (f) JOIN g USING (b) WHERE k = 'd' GROUP BY id),
x AS (SELECT w.id AS doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(g / n) AS BIGINT), 0) AS weight, len(ws) >= 20 AS enough, CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d ON w.id = d.id WHERE k = 'd'),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS r FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= (SELECT count(*) FROM y WHERE enough) * 25 // 100 THEN r END AS rank FROM r
"""
