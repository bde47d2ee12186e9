"""The repair of damaged conversations as SQL, written on its own: recursion over rows, a state being the least struct of cost, audit string and turns so far."""

NONE = "NULL::STRUCT(c integer, a varchar, r varchar)"
LATE = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"


def _after(state: str, cost, letter: str, turn: str | None = None) -> str:
    """``state`` with an edit more; null where it can't be reached."""
    turns = f"CASE WHEN {state}.r IS NULL THEN {turn} ELSE {state}.r || chr(10) || {turn} END" if turn else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {turns}}} END"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND role[1] = '{initial}' THEN {_after(state, LATE, 'K', chr(39).join(['role || ', ':', ' || text']))} END"


def _named(state: str, role: str) -> str:
    return f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_after(state, f'3 + {LATE}', 'R', f"'{role}:' || text")} END"


def _closed(query: str) -> str:
    """A round of inserted turns."""
    user, assistant = _after("b", 3, "I", "'user:'"), _after("s2", 3, "I", "'assistant:'")
    return f"(SELECT k, n, s0, s1, least(s2, {user}) AS s2, least(s3, {assistant}) AS s3 FROM (SELECT *, least(s0, s1, s3) AS b FROM {query}))"


_START = f"(SELECT DISTINCT conv_id AS k, 0::bigint AS n, {{'c': 0, 'a': '', 'r': NULL::varchar}} AS s0, {NONE} AS s1, {NONE} AS s2, {NONE} AS s3 FROM conversations)"
_STEP = f"""(SELECT k, n, {_after('s0', 4, 'D')} AS s0, least({_after('s1', 4, 'D')}, {_kept('s0', 's')}) AS s1,
    least({_after('s2', 4, 'D')}, {_kept('b', 'u')}, {_named('b', 'user')}) AS s2, least({_after('s3', 4, 'D')}, {_kept('s2', 'a')}, {_named('s2', 'assistant')}) AS s3
    FROM (SELECT w.s0, w.s1, w.s2, w.s3, least(w.s0, w.s1, w.s3) AS b, t.k, t.n, t.role, t.text, t.fault FROM walk w JOIN turns t ON t.k IS NOT DISTINCT FROM w.k AND t.n = w.n + 1))"""

SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS name FROM conversations),
dealt AS (SELECT named.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: ord(c)::bigint)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS way FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE way <> 0),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM damaged),
turns AS (SELECT conv_id AS k, turn, n, role, text, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    n > 1 AND lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM marked),
walk AS (SELECT k, n, s0, s1, s2, s3 FROM {_closed(_closed(_START))} UNION ALL SELECT k, n, s0, s1, s2, s3 FROM {_closed(_closed(_STEP))}),
best AS (SELECT k, arg_max(least(s0, s3), n) AS s FROM walk GROUP BY k),
seen AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal FROM turns GROUP BY k)
SELECT b.k AS conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal,
    s.c::bigint AS cost, s.a AS audit, sha256(coalesce(s.r, '')) AS repaired_sha256 FROM best b LEFT JOIN seen ON seen.k IS NOT DISTINCT FROM b.k"""
