"""DuckDB twins of the queries whose contracts draw on crc32, which DuckDB lacks: it is computed here byte by byte.

A SQL text has one table ``tab`` of 256 remainders; ``CRC`` is the crc32 of the bytes whose hexadecimal digits stand in a column ``h``.
"""

from __future__ import annotations

#: Fixed value: the reversed polynomial of crc32 is 3988292384.
CRC_TABLE = """WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(b)))"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"""

#: The role that may follow in each state of the order, and the state after it.
_NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))


def conversations() -> str:
    """DuckDB twin of the query op12: rows from the last to the first, four states of (cost, audit, repaired text) each."""
    cell = lambda c, a, t: f"{{'c': {c}, 'a': {a}, 't': {t}}}"

    def best(s: int) -> str:
        to, role = _NEXT[s]
        keeps = [(i, d) for i, d, fr in (("s", 1, (0,)), ("u", 2, (0, 1, 3)), ("a", 3, (2,))) if s in fr]
        more = "5 * (fault = 3)::INT"
        kept = " ".join(f"WHEN ini = '{i}' THEN {cell(f'{more} + s{d}.c', f"'K' || s{d}.a", f"chr(10) || role || ':' || text || s{d}.t")}" for i, d in keeps)
        out = [cell(f"2 + s{s}.c", f"'D' || s{s}.a", f"s{s}.t"), f"CASE WHEN fault IN (1, 2) THEN NULL {kept} END", f"CASE WHEN fault NOT IN (1, 2) THEN {cell(f'1 + {more} + s{to}.c', f"'R' || s{to}.a", f"chr(10) || '{role}:' || text || s{to}.t")} END"]
        return f"list_sort(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL))[1] AS n{s}"

    def inserted(a: str, b: str, s: int, name: str) -> str:
        to, role = _NEXT[s]
        return f"list_sort([{a}{s}, {cell(f'5 + {b}{to}.c', f"'I' || {b}{to}.a", f"chr(10) || '{role}:' || {b}{to}.t")}])[1] AS {name}{s}"

    ends = [cell(c, f"'{a}'", t) for c, a, t in ((0, "", "''"), (10, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"), (5, "I", "chr(10) || 'assistant:'"), (0, "", "''"))]
    states = lambda f: ", ".join(f(s) for s in range(4))
    return f"""
{CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
fated AS (SELECT conv_id, turn, role, text, {CRC} % 20 AS fate FROM raw, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM fated, range(2) AS c(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS ini FROM damaged),
marked AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 1)::BIGINT AS blank, count_if(fault = 2)::BIGINT AS duplicate, count_if(fault = 3)::BIGINT AS truncated, count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
back AS (SELECT d.conv_id, n + 1 AS pos, {states(lambda s: f"{ends[s]} AS s{s}")} FROM (SELECT d.conv_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id) d
UNION ALL SELECT conv_id, pos, {states(lambda s: inserted('n', 'm', s, 'k'))} FROM (SELECT *, {states(lambda s: inserted('n', 'n', s, 'm'))} FROM (SELECT back.conv_id, marked.pos, {states(best)} FROM back JOIN marked ON marked.conv_id IS NOT DISTINCT FROM back.conv_id AND marked.pos = back.pos - 1)))
SELECT back.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s0.c::BIGINT AS cost, s0.a AS audit, sha256(substr(s0.t, 2)) AS repaired_sha256
FROM back LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM back.conv_id WHERE back.pos = 1
"""


SPELLING = rf"""
{CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
uses AS (SELECT doc, run, count(*) AS k, hex(encode(doc || ':' || run)) AS h FROM runs GROUP BY doc, run),
hashed AS (SELECT doc, run, k, {CRC} AS crc FROM uses, tab),
worn AS (SELECT k, CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM worn WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
ins AS (SELECT DISTINCT a.word AS a, v.word AS b FROM w a JOIN v ON v.less = a.word),
near AS (SELECT x.word, y.word AS other FROM v x JOIN v y ON x.i = y.i AND x.less = y.less AND x.word <> y.word UNION SELECT a, b FROM ins UNION SELECT b, a FROM ins),
best AS (SELECT near.word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS other, max(w.n) AS other_n FROM near JOIN w ON w.word = near.other GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL
"""
