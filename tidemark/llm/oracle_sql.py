"""DuckDB SQL of the operators on lines, filters and conversations."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
    keyed AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
    firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
    marked AS (SELECT keyed.*, f IS NOT NULL AND doc_id <> f AS gone FROM keyed LEFT JOIN firsts USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""

FILTER_AUDIT = r"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
    marks AS (
      SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask FROM texts),
    known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    cells AS (
      SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM marks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
    perms(p) AS (
      SELECT '' UNION ALL SELECT p || f FROM perms, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE length(p) < 5 AND NOT contains(p, f)),
    steps AS (
      SELECT p AS filter_order, s::INTEGER AS step, 1 << (ascii(substr(p, s::INTEGER, 1)) - 65) AS own,
        coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(substr(p, i::INTEGER, 1)) - 65))), 0)::INTEGER AS before
      FROM perms, range(1, 6) r(s) WHERE length(p) = 5),
    counts AS (
      SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
      FROM cells, steps GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts"""


def _then(way: str, cost: str, letter: str, line: str = "") -> str:
    """The way ``way`` with one edit more, which may add a line."""
    text = f"{way}.t || CASE WHEN {way}.t = '' THEN '' ELSE chr(10) END || {line}" if line else f"{way}.t"
    return f"CASE WHEN {way} IS NULL THEN NULL ELSE {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {text}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _inserted(v: str) -> str:
    """Columns w0 to w3: the ways v0 to v3 with any insertions after them."""
    user = [_then(f"{v}{i}", "2", "I", "'user:'") for i in (0, 1, 3)]
    both = [_then(f"({x})", "2", "I", "'assistant:'") for x in user[:2]]
    return f"{v}0 AS w0, {v}1 AS w1, {_least(f'{v}2', *user)} AS w2, {_least(f'{v}3', _then(f'{v}2', '2', 'I', chr(39) + 'assistant:' + chr(39)), *both)} AS w3"


def _row_step() -> str:
    """Columns v0 to v3: the ways w0 to w3 with an edit of the row after them."""
    sound = lambda way: f"CASE WHEN kind < 2 THEN {way} END"
    kept = lambda i, x: sound(f"CASE WHEN initial = '{x}' THEN {_then(f'w{i}', 'kind', 'K', 'line')} END")
    other = lambda i, role: sound(_then(f"w{i}", "kind + 2", "R", f"'{role}:' || text"))
    gone = [_then(f"w{i}", "3", "D") for i in range(4)]
    before = (0, 1, 3)
    return f"""{gone[0]} AS v0, {_least(gone[1], kept(0, 's'))} AS v1,
        {_least(gone[2], *(kept(i, 'u') for i in before), *(other(i, 'user') for i in before))} AS v2, {_least(gone[3], kept(2, 'a'), other(2, 'assistant'))} AS v3"""


_NONE = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"

CONVERSATION_REPAIR = rf"""
    WITH RECURSIVE original AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT) AS key
      FROM conversations),
    coded AS (
      SELECT * EXCLUDE key, xor(list_reduce(list_prepend(4294967295::BIGINT, key), lambda c, b:
        list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS fault FROM original),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
      FROM coded WHERE fault <> 0),
    ordered AS (
      SELECT *, substr(role, 1, 1) AS initial, role || ':' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        trim(text, {_SPACES}) AS core FROM damaged),
    rows AS (
      SELECT conv_id, turn, text, initial, line, i, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
        CASE WHEN core = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, line, length(initial) ORDER BY i) > 1 THEN 3
          WHEN right(core, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS kind FROM ordered),
    ways(conv_id, i, v0, v1, v2, v3) AS (
      SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), {_NONE}, {_NONE}, {_NONE} FROM rows
      UNION ALL
      SELECT conv_id, i, {_row_step()}
      FROM (SELECT rows.conv_id, rows.i, text, initial, line, kind, {_inserted("ways.v")}
        FROM ways JOIN rows ON rows.conv_id IS NOT DISTINCT FROM ways.conv_id AND rows.i = ways.i + 1)),
    ends AS (
      SELECT conv_id, {_least("w0", "w3")} AS best FROM (SELECT conv_id, i, max(i) OVER (PARTITION BY conv_id) AS n, {_inserted("v")} FROM ways) WHERE i = n),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 2) AS blank, count(*) FILTER (kind = 3) AS duplicate,
        count(*) FILTER (kind = 1) AS truncated, count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id"""
