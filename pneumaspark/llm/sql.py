"""DuckDB SQL for the training-data queries that SQL can state."""

from __future__ import annotations

import string

_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[u.i : u.i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, u.i AS i, array_to_string(w[u.i : u.i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
m AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_TRIM = "trim(x, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13)))"
_BARE = "NOT regexp_matches(regexp_replace({x}, '[^ ]*[0-9][^ ]*', '', 'g'), '\\p{{L}}')"
_MASK = f"CASE WHEN regexp_matches({_TRIM}, '[0-9]') AND NOT ({_BARE.format(x=_TRIM)}) THEN regexp_replace({_TRIM}, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE {_TRIM} END"

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, dense_rank() OVER (ORDER BY doc_id, text) AS k FROM documents),
l AS (SELECT r, k, doc_id, u.i AS i, string_split(text, chr(10))[u.i] AS x FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE text IS NOT NULL),
e AS (SELECT r, k, doc_id, i, {_MASK} AS m FROM l),
t AS (SELECT *, len(string_split(m, ' ')) AS n, CASE WHEN {_BARE.format(x="m")} THEN m ELSE array_to_string(string_split(m, ' ')[1:3], ' ') END AS head FROM e WHERE m <> ''),
u AS (SELECT DISTINCT m, n, head FROM t),
g AS (SELECT *, count(*) OVER (PARTITION BY n, head) AS size FROM u WHERE n > 3),
p AS (SELECT g.m, g.n, g.head, g.size, v.j, string_split(g.m, ' ')[v.j] AS token FROM g, unnest(range(1, g.n + 1)) AS v(j) WHERE size >= 2),
c AS (SELECT n, head, j, token FROM p GROUP BY n, head, j, token HAVING 2 * count(*) > any_value(size)),
a AS (SELECT p.m FROM p JOIN c ON c.n = p.n AND c.head = p.head AND c.j = p.j AND c.token = p.token GROUP BY p.m, p.n HAVING count(*) >= 0.8 * p.n),
z AS (SELECT t.r, t.k, t.doc_id, t.i, CASE WHEN a.m IS NULL THEN 'line ' || t.m ELSE 'leaf ' || t.n || ' ' || t.head END AS template FROM t LEFT JOIN a ON a.m = t.m),
o AS (SELECT template, min(doc_id) AS first FROM z GROUP BY template HAVING count(DISTINCT k) >= 3),
x AS (SELECT z.r, z.i FROM z JOIN o USING (template) WHERE z.doc_id IS DISTINCT FROM o.first),
s AS (SELECT l.r, count(*) AS n_lines, count(x.i) AS n_dropped, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (x.i IS NULL) AS kept FROM l LEFT JOIN x ON x.r = l.r AND x.i = l.i GROUP BY l.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""

_SPLIT = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, u.i AS i, array_to_string(w[u.i : u.i + 19], ' ') AS win FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
f AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f),
k AS (SELECT d.doc_id, d.w[u.p] AS word, u.p, g.p IS NOT NULL AS gone FROM d, unnest(range(1, len(d.w) + 1)) AS u(p) LEFT JOIN g ON g.doc_id = d.doc_id AND g.p = u.p),
t AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM k),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_factors, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM t GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_factors, 0) AS n_factors FROM d LEFT JOIN r USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"

COMPONENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[u.i : u.i + least(len(w), 5) - 1], ' ') AS x FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, common = p.n AND common = q.n AS equal FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
e AS (SELECT a AS v, b AS u FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT v, v AS u FROM (SELECT DISTINCT v FROM e) UNION SELECT r.v, e.u FROM reach r JOIN e ON e.v = r.u),
root AS (SELECT v, min(u) AS root FROM reach GROUP BY v),
class AS (SELECT b, min(a) AS class FROM l WHERE equal GROUP BY b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(class, d.doc_id) AS class_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN root ON v = d.doc_id LEFT JOIN class ON b = d.doc_id
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_SPLIT.format(text="coalesce(text, '')")} AS w FROM documents),
k AS (SELECT r, u.p AS p, w[u.p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
tot AS (SELECT r, sum(strlen(word)) AS total, sum(length(word)) AS chars FROM k GROUP BY r),
s AS (SELECT r, z.n, u.i AS i, array_to_string(w[u.i : u.i + z.n - 1], ' ') AS win FROM d, (VALUES (3), (5), (7), (10)) z(n), unnest(range(1, len(w) - z.n + 2)) AS u(i) WHERE len(w) >= z.n),
m AS (SELECT r, n, i FROM s QUALIFY count(*) OVER (PARTITION BY r, n, win) > 1),
g AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS p FROM m),
c AS (SELECT r, n, count(*) AS words, sum(strlen(word)) AS bytes FROM g JOIN k USING (r, p) GROUP BY r, n),
l AS (SELECT r, {_SPLIT.format(text="string_split(text, chr(10))[u.i]")} AS lw, row_number() OVER (PARTITION BY r, string_split(text, chr(10))[u.i] ORDER BY u.i) AS nth FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
ln AS (SELECT r, count(*) FILTER (len(lw) > 0) AS n_dup_lines, sum(strlen(array_to_string(lw, ''))) AS held FROM l WHERE nth > 1 GROUP BY r),
f AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(tot.chars, 0) AS BIGINT) AS word_chars, CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(ln.n_dup_lines, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words, CAST(coalesce(ln.held, 0) AS DOUBLE) / greatest(coalesce(tot.total, 0), 1) AS dup_line_share,
  CAST(coalesce(c5.bytes, 0) AS DOUBLE) / greatest(coalesce(tot.total, 0), 1) AS dup_ngram_share, CAST(coalesce(c7.bytes, 0) AS DOUBLE) / greatest(coalesce(tot.total, 0), 1) AS share7, CAST(coalesce(c10.bytes, 0) AS DOUBLE) / greatest(coalesce(tot.total, 0), 1) AS share10
  FROM d LEFT JOIN tot ON tot.r = d.r LEFT JOIN ln ON ln.r = d.r LEFT JOIN c c3 ON c3.r = d.r AND c3.n = 3 LEFT JOIN c c5 ON c5.r = d.r AND c5.n = 5 LEFT JOIN c c7 ON c7.r = d.r AND c7.n = 7 LEFT JOIN c c10 ON c10.r = d.r AND c10.n = 10),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND dup_ngram_share <= 0.25 AND share7 <= 0.22 AND share10 <= 0.2 AND dup_line_share <= 0.3 AND n_symbols <= CAST(0.2 AS DOUBLE) * n_words AS kept, dup_line_share, dup_ngram_share FROM b
"""

_CRC_TABLE = "(SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n)))"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + length(hex(encode({s}))), 2), lambda i: CAST('0x' || substr(hex(encode({s})), i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _edit(x: str, cost: str, initial: str) -> str:
    """Cost in nine digits, then the audit: the least string is the cheapest, and of those the ASCII-least."""
    return f"(lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{initial}')"


_KEEPS = {k: f"CASE WHEN NOT gone AND initial = '{k}' THEN " for k in "sua"}
_STAYS = "CASE WHEN truncated THEN 5 ELSE 0 END"
_ROLED = "CASE WHEN NOT gone THEN {} END"
_TO_USER = ", ".join([_edit("x2", "2", "D"), *(_ROLED.format(_edit(x, f"1 + {_STAYS}", "R")) for x in ("x0", "x1", "x3")), *(_KEEPS["u"] + _edit(x, _STAYS, "K") + " END" for x in ("x0", "x1", "x3"))])

CONVERSATIONS = f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
fate AS (SELECT conv_id, turn, role, text, {_CRC.format(s="id")} % 20 AS f FROM raw, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fate WHERE f <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM pos),
judged AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, pair, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, again AND regexp_matches(text, '[^\x20\x09-\x0D]') AS duplicate,
  NOT again AND regexp_matches(text, '[^\x20\x09-\x0D]') AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated FROM said),
line AS (SELECT *, blank OR duplicate AS gone, count(*) OVER (PARTITION BY conv_id) AS n FROM judged),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS x0, CAST(NULL AS VARCHAR) AS x1, '000000005I' AS x2, '000000010II' AS x3 FROM conversations
  UNION ALL
  SELECT conv_id, i, y0, y1, y2, least(y3, {_edit("y2", "5", "I")}) FROM (
    SELECT conv_id, i, y0, y1, least(y2, {_edit("y0", "5", "I")}, {_edit("y1", "5", "I")}, {_edit("y3", "5", "I")}) AS y2, y3 FROM (
      SELECT walk.conv_id, line.i, {_edit("x0", "2", "D")} AS y0, least({_edit("x1", "2", "D")}, {_KEEPS["s"]}{_edit("x0", _STAYS, "K")} END) AS y1, least({_TO_USER}) AS y2,
        least({_edit("x3", "2", "D")}, {_ROLED.format(_edit("x2", f"1 + {_STAYS}", "R"))}, {_KEEPS["a"]}{_edit("x2", _STAYS, "K")} END) AS y3
      FROM walk JOIN line ON line.conv_id IS NOT DISTINCT FROM walk.conv_id AND line.i = walk.i + 1))),
ends AS (SELECT conv_id, CAST(substr(x, 1, 9) AS BIGINT) AS cost, substr(x, 10) AS audit FROM (SELECT conv_id, arg_max(least(x0, x3), i) AS x FROM walk GROUP BY conv_id)),
edits AS (SELECT conv_id, u.k AS k, substr(audit, u.k, 1) AS e, length(replace(left(audit, u.k), 'I', '')) AS i FROM ends, unnest(range(1, length(audit) + 1)) AS u(k)),
done AS (SELECT edits.*, line.role, line.text, row_number() OVER (PARTITION BY edits.conv_id ORDER BY k) AS m, first_value(e = 'K' AND coalesce(line.initial = 's', false)) OVER (PARTITION BY edits.conv_id ORDER BY k) AS led
  FROM edits LEFT JOIN line ON line.conv_id IS NOT DISTINCT FROM edits.conv_id AND line.i = edits.i AND e <> 'I' WHERE e <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS body FROM done GROUP BY conv_id),
facts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM line GROUP BY conv_id)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ends LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ends.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM ends.conv_id
"""

RESAMPLING = f"""
WITH crc AS {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
hashed AS (SELECT word, {_CRC.format(s="word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT b.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (SELECT coalesce(sum(n), 0) + 10000 FROM s) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * (SELECT coalesce(sum(n), 0) + 10000 FROM t)))) AS BIGINT) AS g
  FROM range(10000) AS b(bucket) LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
f AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f USING (r)),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""

ORACLES = {"op1_decontamination": CONTAMINATION, "op3_substring_dedup": SUBSTRINGS, "op7_jaccard_join": COMPONENTS, "op8_quality_rules": QUALITY, "op10_line_dedup": LINES, "op12_conversation_repair": CONVERSATIONS, "op13_importance_resampling": RESAMPLING}
