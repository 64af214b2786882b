"""DuckDB SQL for the queries over filters, mixtures and conversations, each by a plainer way than the operator's."""

from __future__ import annotations

#: Every order and step is counted from the rows' masks, one by one.
FILTER_AUDIT = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
 + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
 + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, b)),
o AS (SELECT '' AS filter_order, 0 AS used UNION ALL SELECT filter_order || letter, used + b FROM o JOIN l ON used & b = 0),
s AS (SELECT filter_order, step, b, letter, coalesce((SELECT sum(b) FROM l WHERE instr(filter_order, letter) < step), 0)::INT AS before
 FROM o CROSS JOIN (SELECT unnest(range(1, 6))::INT AS step) JOIN l ON letter = substring(filter_order, step, 1) WHERE used = 31),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (before + b) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & b > 0), 0) AS removed,
 coalesce(sum(n) FILTER (mask & before > 0 AND mask & b > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
 coalesce(sum(good) FILTER (mask & before = 0 AND mask & b > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & b > 0), 0) AS toxic_lost FROM s CROSS JOIN c GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""

#: Sources are sorted whole, and the words before each document summed in one window.
MIXING = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY 1),
s AS (SELECT source, source_size, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM q),
l AS (SELECT 0 AS k, (sum(source_size)::DOUBLE / sum(w)::DOUBLE) AS level FROM s UNION ALL
 SELECT k + 1, ((sum(source_size) - coalesce(sum(cap) FILTER (level * w > cap), 0))::DOUBLE / (sum(w) FILTER (level * w <= cap))::DOUBLE) FROM l, s WHERE k < (SELECT count(*) FROM s) GROUP BY k, level),
t AS (SELECT s.*, CASE WHEN level * w > cap THEN cap::DOUBLE ELSE level * w END AS target FROM s, (SELECT arg_max(level, k) AS level FROM l)),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
n AS (SELECT *, greatest(floor(target)::BIGINT - whole * source_size, 0) AS need FROM u),
m AS (SELECT d.*, source_size, target, whole, need, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, 'null')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, need - before)))::BIGINT AS taken FROM m"""


def _conversations() -> str:
    """The least (cost, edits) of each state, row by row, over the whole lattice."""
    add = lambda way, cost, edit: f"{{'c': ({way}).c + {cost}, 'a': ({way}).a || '{edit}'}}"
    far = "{'c': 1000000000, 'a': ''}"
    entered = lambda cost, edit: f"least({add('t0', cost, edit)}, {add('t1', cost, edit)}, {add('t3', cost, edit)})"
    on = lambda test, way: f"CASE WHEN {test} THEN {way} ELSE {far} END"
    stays, more = "fault NOT IN (1, 2)", "(CASE WHEN fault = 3 THEN 3 ELSE 0 END)"
    moved = {
        "m0": add("t0", 4, "D"),
        "m1": f"least({add('t1', 4, 'D')}, {on(stays + " AND initial = 's'", add('t0', more, 'K'))})",
        "m2": f"least({add('t2', 4, 'D')}, {on(stays + " AND initial = 'u'", entered(more, 'K'))}, {on(stays, entered('3 + ' + more, 'R'))})",
        "m3": f"least({add('t3', 4, 'D')}, {on(stays + " AND initial = 'a'", add('t2', more, 'K'))}, {on(stays, add('t2', '3 + ' + more, 'R'))})",
    }
    put = lambda table: f"SELECT conv, i, m0 AS t0, m1 AS t1, n2 AS t2, least(m3, {add('n2', 3, 'I')}) AS t3 FROM (SELECT *, least(m2, {add('m0', 3, 'I')}, {add('m1', 3, 'I')}, {add('m3', 3, 'I')}) AS n2 FROM {table})"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)), lambda y, b: list_reduce(list_prepend(xor(y, b), range(8)), lambda z, j: xor(z >> 1, 3988292384::BIGINT * (z & 1)))), 4294967295::BIGINT)"
    return rf"""WITH RECURSIVE k AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t, {crc.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations),
e AS (SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE h <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(t), copy) AS i, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS bare FROM e),
f AS (SELECT *, substring(role, 1, 1) AS initial, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, t ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(bare, '[.!?]$') THEN 3 ELSE 0 END AS fault FROM p),
x AS (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM f),
n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM x GROUP BY 1),
z AS (SELECT conv, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS m0, {far} AS m1, {far} AS m2, {far} AS m3 FROM n),
y AS ({put('z')} UNION ALL {put(f"(SELECT y.conv, f.i, {', '.join(f'{way} AS {m}' for m, way in moved.items())} FROM y JOIN f ON f.conv IS NOT DISTINCT FROM y.conv AND f.i = y.i + 1)")}),
b AS (SELECT n.*, least(t0, t3) AS best FROM y JOIN n ON n.conv IS NOT DISTINCT FROM y.conv AND y.i = n.n),
a AS (SELECT conv, unnest(range(1, length(best.a) + 1)) AS pos, best.a AS audit FROM b),
c AS (SELECT a.conv, pos, substring(audit, pos, 1) AS edit, length(replace(substring(audit, 1, pos), 'I', '')) AS i FROM a),
r AS (SELECT c.conv, pos, edit, role, coalesce(t, '') AS t, row_number() OVER w AS place, first_value(edit = 'K' AND initial = 's') OVER w AS begins FROM c LEFT JOIN f ON f.conv IS NOT DISTINCT FROM c.conv AND f.i = c.i AND edit <> 'I' WHERE edit <> 'D' WINDOW w AS (PARTITION BY c.conv ORDER BY pos)),
h AS (SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - (CASE WHEN begins THEN 1 ELSE 0 END)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || t, chr(10) ORDER BY pos) AS repaired FROM r GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON b.conv IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv IS NOT DISTINCT FROM o.conv_id"""


CONVERSATIONS = _conversations()
