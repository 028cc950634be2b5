"""DuckDB SQL of the core queries. Patterns and letter tables are the same fixed values."""

from __future__ import annotations

import re

from idsync.functions import text
from idsync.functions.dates import FORMATS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"


def strip(x: str) -> str:
    return _sub(x, rf"^{text.BLANK}+|{text.BLANK}+$")


def clean_spaces(x: str) -> str:
    return f"translate({strip(x)}, {_q(chr(0xA0))}, ' ')"


def remove_accents(x: str) -> str:
    singles, plain, many = text._tables()
    out = f"translate({_sub(strip(x), r'[\p{M}]')}, {_q(singles)}, {_q(plain)})"
    for letter, to in many.items():
        if letter in text.SPECIAL or letter.lower() in text.ROMAN:
            out = f"replace({out}, {_q(letter)}, {_q(to)})"
    return out


def non_word(x: str) -> str:
    return _sub(x, text.NO_WORD, " ")


def double_spaces(x: str) -> str:
    return _sub(x, rf"{text.BLANK}+", " ")


def womens(x: str) -> str:
    out = strip(x)
    for ending in text.WOMENS_ENDINGS:
        out = _sub(out, ending)
    for phrase in text.WOMENS_PHRASES:
        out = f"replace({out}, {_q(phrase)}, '')"
    return strip(out)


def youth(x: str) -> str:
    out = _sub(_sub(strip(x), " Under-?", " U"), " Sub-?", " U")
    return strip(_sub(f"replace({out}, ' U-', ' U')", r" U\s?\d+$"))


def suffixes(x: str) -> str:
    return _sub(youth(womens(x)), rf"(?: (?:{'|'.join(re.escape(e) for e in text.CLUB_ENDINGS)})|\sW|, W)$")


def prefixes(x: str) -> str:
    return _sub(x, rf"^(?:{'|'.join(re.escape(e) for e in text.CLUB_STARTS)}) ")


def normalize(x: str) -> str:
    return strip(f"lower({double_spaces(non_word(remove_accents(clean_spaces(x))))})")


def team_names(x: str) -> str:
    return normalize(prefixes(suffixes(x)))


# The same notations in DuckDB's letters.
_FORMATS = {
    "yyyy-MM-dd": "%Y-%m-%d", "MM-dd-yyyy": "%m-%d-%Y", "dd-MM-yyyy": "%d-%m-%Y", "MMM d, yyyy": "%b %-d, %Y", "MMMM d, yyyy": "%B %-d, %Y",
    "yyyy/MM/dd": "%Y/%m/%d", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyyMMdd": "%Y%m%d",
}


def parse_date(x: str) -> str:
    tried = ", ".join(f"try_strptime(trim({x}), {_q(_FORMATS[f])})" for f in FORMATS)
    return f"CAST(coalesce({tried}) AS DATE)"


_NORM = f"SELECT record_id, competition_id, season_id, data_provider, provider_team_id, team_name, {normalize('team_name')} AS t FROM team_records"
_GRAM_TEXT = "regexp_replace(t, '[,\\-./;]|\\s', '', 'g')"
_GRAMS = f"CASE WHEN length({_GRAM_TEXT}) >= 3 THEN list_transform(range(1, length({_GRAM_TEXT}) - 1), lambda i: substring({_GRAM_TEXT}, i, 3)) ELSE [] END"


def _matches(p: str) -> str:
    where = {"a": "TRUE", "b": "o_orderkey % 7 <> 0", "c": "o_orderkey % 4 <> 0"}[p]
    day = {
        "a": "CAST(o_orderdate AS DATE)",
        "b": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 2 AS INT) ELSE CAST(o_orderdate AS DATE) END",
        "c": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END",
    }[p]
    first = {"a": 0, "b": 10_000_000, "c": 20_000_000}[p]
    return f"""SELECT CAST(o_orderkey + {first} AS VARCHAR) AS {p}_match_id, strftime({day}, '%Y-%m-%d') AS match_date, 'h' || o_custkey AS home_team_id,
      'a' || (o_orderkey % 20) AS away_team_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(week(CAST(o_orderdate AS DATE)) AS VARCHAR) END AS matchday, o_orderkey + {first} AS pos
      FROM orders WHERE {where}"""


_MATCHES = ", ".join(f"m{p} AS ({_matches(p)})" for p in "abc")
_NEAR = "a.home_team_id = b.home_team_id AND a.away_team_id = b.away_team_id AND abs(datediff('day', CAST(a.match_date AS DATE), CAST(b.match_date AS DATE))) <= 1"
_DAY = "a.home_team_id = b.home_team_id AND a.away_team_id = b.away_team_id AND a.matchday IS NOT DISTINCT FROM b.matchday"


def _pair(x: str, y: str, xs: str, ys: str, name: str) -> str:
    """CTEs that pair two tables: exact, then near dates, then matchday, each on what is open."""
    i, j = f"{x}_match_id", f"{y}_match_id"
    open_ = lambda t, c, done: f"SELECT * FROM {t} WHERE {c} NOT IN (SELECT {c} FROM {done})"
    return f"""
    {name}1 AS (SELECT a.{i}, b.{j} FROM {xs} a JOIN {ys} b USING (match_date, home_team_id, away_team_id)),
    {name}2 AS (SELECT * FROM {name}1 UNION ALL SELECT DISTINCT a.{i}, b.{j} FROM ({open_(xs, i, name + '1')}) a JOIN ({open_(ys, j, name + '1')}) b ON {_NEAR}),
    {name}3 AS (SELECT * FROM {name}2 UNION ALL SELECT a.{i}, b.{j} FROM ({open_(xs, i, name + '2')}) a JOIN ({open_(ys, j, name + '2')}) b ON {_DAY})"""


MATCH_SYNC_2 = f"""
WITH {_MATCHES}, {_pair('a', 'b', 'ma', 'mb', 'p')},
r1 AS (SELECT m.match_date, m.home_team_id, m.away_team_id, m.a_match_id, p3.b_match_id, 1 AS layer, 0 AS rank, m.pos FROM ma m LEFT JOIN p3 USING (a_match_id)),
rows AS (SELECT * FROM r1 UNION ALL
  SELECT match_date, home_team_id, away_team_id, NULL, b_match_id, 3, 1, pos FROM mb WHERE b_match_id NOT IN (SELECT b_match_id FROM r1 WHERE b_match_id IS NOT NULL))
SELECT match_date, home_team_id, away_team_id, arg_min(a_match_id, (layer, rank, pos, a_match_id)) FILTER (a_match_id IS NOT NULL) AS a_match_id,
  arg_min(b_match_id, (layer, rank, pos, b_match_id)) FILTER (b_match_id IS NOT NULL) AS b_match_id, 'a' AS provider
FROM rows GROUP BY ALL
"""

# Layer 2 pairs the remainders of b and c; a never has one, as every row of the first side is kept.
MATCH_SYNC_3 = f"""
WITH {_MATCHES}, {_pair('a', 'b', 'ma', 'mb', 'p')}, {_pair('a', 'c', 'ma', 'mc', 'q')}, {_pair('b', 'c', 'mb', 'mc', 's')},
r1 AS (SELECT m.match_date, m.home_team_id, m.away_team_id, m.a_match_id, p3.b_match_id, coalesce(q3.c_match_id, t.c_match_id) AS c_match_id, 1 AS layer, 0 AS rank, m.pos
  FROM ma m LEFT JOIN p3 USING (a_match_id) LEFT JOIN q3 USING (a_match_id) LEFT JOIN (SELECT b.b_match_id, s3.c_match_id FROM mb b LEFT JOIN s3 USING (b_match_id)) t ON t.b_match_id = p3.b_match_id),
ub AS (SELECT * FROM mb WHERE b_match_id NOT IN (SELECT b_match_id FROM r1 WHERE b_match_id IS NOT NULL)),
uc AS (SELECT * FROM mc WHERE c_match_id NOT IN (SELECT c_match_id FROM r1 WHERE c_match_id IS NOT NULL)),
{_pair('b', 'c', 'ub', 'uc', 'v')},
r2 AS (SELECT * FROM r1 UNION ALL SELECT u.match_date, u.home_team_id, u.away_team_id, NULL, u.b_match_id, v3.c_match_id, 2, 0, u.pos FROM ub u JOIN v3 USING (b_match_id)),
rows AS (SELECT * FROM r2
  UNION ALL SELECT match_date, home_team_id, away_team_id, NULL, b_match_id, NULL, 3, 1, pos FROM mb WHERE b_match_id NOT IN (SELECT b_match_id FROM r2 WHERE b_match_id IS NOT NULL)
  UNION ALL SELECT match_date, home_team_id, away_team_id, NULL, NULL, c_match_id, 3, 2, pos FROM mc WHERE c_match_id NOT IN (SELECT c_match_id FROM r2 WHERE c_match_id IS NOT NULL))
SELECT match_date, home_team_id, away_team_id, {', '.join(f"arg_min({p}_match_id, (layer, rank, pos, {p}_match_id)) FILTER ({p}_match_id IS NOT NULL) AS {p}_match_id" for p in 'abc')}, 'a' AS provider
FROM rows GROUP BY match_date, home_team_id, away_team_id
"""

EDGES = f"""
WITH n AS ({_NORM}), sides AS (
  SELECT competition_id, season_id, CASE data_provider WHEN 'provider_a' THEN 1 ELSE 2 END AS side, CAST(record_id AS VARCHAR) AS id, t FROM n WHERE data_provider IN ('provider_a', 'provider_b') AND t IS NOT NULL),
total AS (SELECT competition_id, season_id, count(*) AS total FROM sides GROUP BY ALL),
grams AS (SELECT competition_id, season_id, side, id, gram, count(*) AS tf FROM (SELECT competition_id, season_id, side, id, unnest({_GRAMS}) AS gram FROM sides) GROUP BY ALL),
often AS (SELECT competition_id, season_id, gram, count(*) AS df FROM grams GROUP BY ALL),
w AS (SELECT g.*, g.tf * (ln((1 + total) / (1 + df)) + 1) AS w FROM grams g JOIN often USING (competition_id, season_id, gram) JOIN total USING (competition_id, season_id)),
u AS (SELECT competition_id, season_id, side, id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY competition_id, season_id, side, id)) AS w FROM w),
edges AS (SELECT x.competition_id, x.season_id, x.id AS i, y.id AS j, round(sum(x.w * y.w), 6) AS similarity
  FROM u x JOIN u y USING (competition_id, season_id, gram) WHERE x.side = 1 AND y.side = 2 GROUP BY ALL)
"""

def _own(p: str) -> str:
    side = lambda s: f"WHEN {s}_provider = 'provider_{p}' AND {s}_object_id IS NOT NULL THEN object_type || ':' || {strip(s + '_object_id')}"
    return f"CASE {side('left')} {side('right')} END AS {p}_id"


_WIDE = f"SELECT link_id, {', '.join(map(_own, 'abc'))} FROM id_links"


def _only(c: str) -> str:
    return f"CASE WHEN count(DISTINCT {c}) <= 1 THEN min({c}) END AS {c}"


_SQUISHED = f"SELECT a_id, {_only('b_id')}, {_only('c_id')} FROM ({_WIDE}) WHERE a_id IS NOT NULL GROUP BY a_id"


def _knock_out(ids: tuple[str, ...]) -> str:
    """CTEs of the loop: known and open rows after each provider."""
    steps, known, rest = [], "k", "o"
    for n, key in enumerate(ids):
        others = [c for c in ids if c != key]
        steps.append(f"""s{n} AS (SELECT {key}, {', '.join(map(_only, others))} FROM {rest} WHERE {key} IN (SELECT {key} FROM {known} WHERE {key} IS NOT NULL) GROUP BY {key}),
        k{n} AS (SELECT {key}, {', '.join(f'coalesce(t.{c}, u.{c}) AS {c}' for c in others)} FROM (SELECT * FROM {known} WHERE {key} IS NOT NULL) t FULL JOIN s{n} u USING ({key})
          UNION ALL BY NAME SELECT {', '.join(ids)} FROM {known} WHERE {key} IS NULL),
        o{n} AS (SELECT * FROM {rest} WHERE {key} IS NULL OR {key} NOT IN (SELECT {key} FROM k{n} WHERE {key} IS NOT NULL))""")
        known, rest = f"k{n}", f"o{n}"
    return ", ".join(steps) + f" SELECT {', '.join(ids)} FROM {known}"


# Greedy choice in order: each left text that has no equal takes the first free right text whose token set contains or is contained.
NAIVE_MATCH = f"""
WITH RECURSIVE n AS ({_NORM}), f AS (SELECT competition_id || '|' || season_id AS b, competition_id, season_id, data_provider, t, min(record_id) AS id, list_distinct(string_split_regex(t, '\\s+')) AS s
  FROM n WHERE t IS NOT NULL AND data_provider IN ('provider_a', 'provider_b') GROUP BY ALL),
x AS (SELECT * FROM f WHERE data_provider = 'provider_a'), y AS (SELECT * FROM f WHERE data_provider = 'provider_b'),
equal AS (SELECT x.b, x.id AS i, y.id AS j FROM x JOIN y ON x.b = y.b AND x.t = y.t),
edges AS (SELECT x.b, x.id AS i, list_sort(list(y.id)) AS js FROM x JOIN y ON x.b = y.b WHERE (list_has_all(x.s, y.s) OR list_has_all(y.s, x.s))
  AND x.id NOT IN (SELECT i FROM equal) AND y.id NOT IN (SELECT j FROM equal) GROUP BY ALL),
lefts AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY i) AS n FROM edges),
walk AS (SELECT DISTINCT b, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j FROM lefts
  UNION ALL SELECT w.b, l.n, list_append(w.used, list_filter(l.js, lambda q: NOT list_contains(w.used, q))[1]), l.i, list_filter(l.js, lambda q: NOT list_contains(w.used, q))[1]
  FROM walk w JOIN lefts l ON l.b = w.b AND l.n = w.n + 1)
SELECT split_part(b, '|', 1) AS competition_id, split_part(b, '|', 2) AS season_id, CAST(i AS VARCHAR) AS i, CAST(j AS VARCHAR) AS j
FROM (SELECT b, i, j FROM equal UNION ALL SELECT b, i, j FROM walk WHERE j IS NOT NULL)
"""


def _text(key: str, table: str, expression: str) -> str:
    return f"SELECT {key}, {expression} AS value FROM {table}"


def _person(expression: str) -> str:
    return _text("record_id", "player_records", expression)


def _team(expression: str) -> str:
    return _text("record_id", "team_records", expression)


def _birth(expression: str) -> str:
    return _text("version_id", "squad_versions", expression)


# --- mixed timestamps ------------------------------------------------------------------------

_YMD = r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?:[T ](.*))?$"
_TWO = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
_DMY = r"^(?:[A-Za-z]{3}, )?(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})(?: (.*))?$"
_MDY = r"^([A-Za-z]{3,9}) (\d{1,2}), (\d{4})$"
_TIME = r"^(\d{1,2})[:.]?(\d{2})(?:[:.]?(\d{2})(?:\.(\d{1,6}))?)? ?([AaPp][Mm])? ?(GMT|UTC|Z|[-+]\d{2}:?\d{2})?(?:\[.*\])?$"


def _part(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {_q(pattern)}, {group})"


def _like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _day(x: str, month_first: str) -> str:
    month = lambda name: f"((position(lower(left({name}, 3)) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3)"
    made = lambda y, m, d: f"try_cast(printf('%04d-%02d-%02d', CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT)) AS DATE)"
    p, q, y = (_part(x, _TWO, i) for i in (1, 2, 3))
    return f"""CASE WHEN {_like(x, r'^(\d{10}|\d{13})$')} THEN NULL
      WHEN {_like(x, _YMD)} THEN {made(*(_part(x, _YMD, i) for i in (1, 2, 3)))}
      WHEN {_like(x, _TWO)} AND {month_first} THEN {made(y, p, q)} WHEN {_like(x, _TWO)} THEN {made(y, q, p)}
      WHEN {_like(x, _DMY)} THEN {made(_part(x, _DMY, 3), month(_part(x, _DMY, 2)), _part(x, _DMY, 1))}
      WHEN {_like(x, _MDY)} THEN {made(_part(x, _MDY, 3), month(_part(x, _MDY, 1)), _part(x, _MDY, 2))} END"""


def _clock_ms(t: str) -> str:
    h, m, sec, f, half = (_part(t, _TIME, i) for i in (1, 2, 3, 4, 5))
    hour = f"(CASE WHEN {half} = '' THEN CAST({h} AS INT) ELSE CAST({h} AS INT) % 12 + CASE WHEN lower({half}) = 'pm' THEN 12 ELSE 0 END END)"
    second = f"CAST(CASE WHEN {sec} = '' THEN '0' ELSE {sec} END AS INT)"
    return f"CASE WHEN {_like(t, _TIME)} THEN (({hour} * 60 + CAST({m} AS INT)) * 60 + {second}) * 1000 + CAST(left({f} || '000', 3) AS INT) END"


def _offset_ms(t: str) -> str:
    z = f"replace({_part(t, _TIME, 6)}, ':', '')"
    return f"CASE WHEN {z} IN ('GMT', 'UTC', 'Z') THEN 0 WHEN {z} <> '' THEN (CASE left({z}, 1) WHEN '-' THEN -60000 ELSE 60000 END) * (CAST(substring({z}, 2, 2) AS INT) * 60 + CAST(substring({z}, 4, 2) AS INT)) END"


_VOTES = " UNION ALL ".join(
    f"SELECT data_provider, CAST({_part(c, _TWO, 1)} AS INT) AS p, CAST({_part(c, _TWO, 2)} AS INT) AS q FROM {t} WHERE {_like(c, _TWO)}" for t, c in (("match_records", "match_date"), ("player_records", "birth_date"))
)
P6_FOUND = f"""
WITH votes AS ({_VOTES}),
orders AS (SELECT data_provider, count(*) FILTER (q BETWEEN 13 AND 31 AND p BETWEEN 1 AND 12) > count(*) FILTER (p BETWEEN 13 AND 31 AND q BETWEEN 1 AND 12) AS mf FROM votes GROUP BY data_provider),
m AS (SELECT record_id, trim(match_date) AS d, trim(kick_off) AS k, coalesce(venue_zone, 'UTC') AS z, coalesce(mf, FALSE) AS mf FROM match_records LEFT JOIN orders USING (data_provider)),
parts AS (SELECT *, {_day('d', 'mf')} AS day, CASE WHEN {_like('d', _YMD)} THEN {_part('d', _YMD, 4)} WHEN {_like('d', _DMY)} THEN {_part('d', _DMY, 4)} ELSE '' END AS rest,
  CASE WHEN {_like('d', r'^\d{10}$')} THEN CAST(d AS BIGINT) * 1000 WHEN {_like('d', r'^\d{13}$')} THEN CAST(d AS BIGINT) END AS epoch FROM m),
timed AS (SELECT *, CASE WHEN {_like('rest', _TIME)} THEN rest WHEN {_like('k', _TIME)} THEN k END AS t FROM parts),
local AS (SELECT *, epoch_ms(CAST(day AS TIMESTAMP)) + {_clock_ms('t')} AS ms, {_offset_ms('t')} AS off FROM timed),
zoned AS (SELECT *, timezone(z, make_timestamp(ms * 1000)) AS inst FROM local),
found AS (SELECT record_id, day, CASE WHEN epoch IS NOT NULL THEN epoch WHEN off IS NOT NULL THEN ms - off
  WHEN timezone(z, inst - INTERVAL 1 HOUR) = make_timestamp(ms * 1000) THEN epoch_ms(inst) - 3600000 ELSE epoch_ms(inst) END AS utc FROM zoned),
b AS (SELECT record_id, trim(birth_date) AS d, coalesce(mf, FALSE) AS mf FROM player_records LEFT JOIN orders USING (data_provider))
SELECT 'match' AS record_type, record_id, CASE WHEN utc IS NOT NULL THEN strftime(make_timestamp(utc * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') ELSE strftime(day, '%Y-%m-%d') END AS iso_value
FROM found WHERE utc IS NOT NULL OR day IS NOT NULL
UNION ALL SELECT 'player', record_id, strftime({_day('d', 'mf')}, '%Y-%m-%d') FROM b WHERE {_day('d', 'mf')} IS NOT NULL
"""

ORACLE = {
    "p6_found": P6_FOUND,
    "clean_spaces": _person(clean_spaces("player_name")),
    "remove_accents": _person(remove_accents("player_name")),
    "non_word_chars": _person(non_word("player_name")),
    "double_spaces": _person(double_spaces("player_name")),
    "normalize_text": _person(normalize("player_name")),
    "womens_suffixes": _team(womens("team_name")),
    "youth_suffixes": _team(youth("team_name")),
    "common_suffixes": _team(suffixes("team_name")),
    "common_prefixes": _team(prefixes("team_name")),
    "normalize_team_names": _team(team_names("team_name")),
    "ngrams3": f"WITH n AS ({_NORM}) SELECT record_id, array_to_string({_GRAMS}, '|') AS value FROM n",
    "token_sets": f"WITH n AS ({_NORM}) SELECT record_id, array_to_string(list_sort(list_distinct(string_split_regex(t, '\\s+'))), '|') AS value FROM n",
    "date_parse_any": _birth(f"strftime({parse_date('birth_date')}, '%Y-%m-%d')"),
    "date_shift": _birth(f"strftime({parse_date('birth_date')} - 1, '%Y-%m-%d')"),
    "date_swap": _birth(f"strftime({parse_date('birth_date')}, '%Y-%d-%m')"),
    "coalesce_suffixes": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN coalesce(o_orderpriority, o_orderstatus) ELSE o_orderstatus END AS label FROM orders",
    "clean_suffixes": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS label FROM orders",
    "split_providers": "SELECT data_provider AS provider, count(DISTINCT provider_team_id) AS ids, count(*) AS rows FROM team_records GROUP BY 1",
    "content_merge": f"WITH {_MATCHES}, e AS (SELECT a.a_match_id, b.b_match_id FROM ma a LEFT JOIN mb b USING (match_date, home_team_id, away_team_id)) "
    "SELECT e.a_match_id, e.b_match_id, c.c_match_id FROM e LEFT JOIN mc c ON CAST(CAST(c.c_match_id AS BIGINT) - 10000000 AS VARCHAR) = e.b_match_id",
    "content_append": f"WITH {_MATCHES} SELECT a_match_id, NULL AS b_match_id, match_date FROM ma UNION ALL SELECT NULL, b_match_id, match_date FROM mb",
    "schema_violations": f"""WITH v AS (SELECT *, {parse_date('birth_date')} AS d FROM squad_versions)
      SELECT unnest(['provider_a_player_id is null', 'player_name is null', 'team_id is null', 'birth_date is no date']) AS "check",
        unnest([count(*) FILTER (data_provider <> 'provider_a' OR provider_player_id IS NULL), count(*) FILTER (player_name IS NULL), count(*) FILTER (team_id IS NULL),
          count(*) FILTER (birth_date IS NOT NULL AND (d IS NULL OR d = DATE '1970-01-01'))]) AS rows FROM v""",
    "column_coverage": "SELECT match_id, bool_and(jersey_number IS NOT NULL) AS jersey_number_full, bool_and(team_id IS NOT NULL) AS team_id_full, bool_and(player_name IS NOT NULL) AS player_name_full FROM player_records GROUP BY match_id",
    "match_exact": f"WITH {_MATCHES} SELECT a.a_match_id, b.b_match_id FROM ma a LEFT JOIN mb b USING (match_date, home_team_id, away_team_id)",
    "match_date_window": f"WITH {_MATCHES} SELECT DISTINCT a.a_match_id, b.b_match_id FROM ma a JOIN mb b ON {_NEAR}",
    "match_matchday": f"WITH {_MATCHES} SELECT a.a_match_id, b.b_match_id FROM ma a JOIN mb b ON {_DAY}",
    "remaining_anti": f"WITH {_MATCHES} SELECT a_match_id FROM ma WHERE a_match_id NOT IN (SELECT a.a_match_id FROM ma a JOIN mb b USING (match_date, home_team_id, away_team_id))",
    "match_sync_2": MATCH_SYNC_2,
    "match_sync_3": MATCH_SYNC_3,
    "tfidf_cosine_edges": f"{EDGES} SELECT * FROM edges",
    "tfidf_top1": f"{EDGES} SELECT competition_id, season_id, i, arg_min(j, (-similarity, j)) AS j, max(similarity) AS similarity FROM edges WHERE similarity >= 0.75 GROUP BY ALL",
    "naive_exact": f"WITH n AS ({_NORM}), f AS (SELECT competition_id, season_id, t, data_provider, min(record_id) AS id FROM n GROUP BY ALL) "
    "SELECT competition_id, season_id, x.id AS i, y.id AS j FROM f x JOIN f y USING (competition_id, season_id, t) WHERE x.data_provider = 'provider_a' AND y.data_provider = 'provider_b'",
    "naive_subset_candidates": f"""WITH n AS ({_NORM}), s AS (SELECT *, list_distinct(string_split_regex(t, '\\s+')) AS s FROM n)
      SELECT competition_id, season_id, x.record_id AS i, y.record_id AS j FROM s x JOIN s y USING (competition_id, season_id)
      WHERE x.data_provider = 'provider_a' AND y.data_provider = 'provider_b' AND (list_has_all(x.s, y.s) OR list_has_all(y.s, x.s))""",
    "mutual_unique": f"""WITH {_MATCHES}, p AS (SELECT DISTINCT a.a_match_id, b.b_match_id FROM ma a JOIN mb b ON {_NEAR})
      SELECT a_match_id, b_match_id FROM p WHERE a_match_id IN (SELECT a_match_id FROM p GROUP BY 1 HAVING count(*) = 1) AND b_match_id IN (SELECT b_match_id FROM p GROUP BY 1 HAVING count(*) = 1)""",
    "dedupe_first_non_null": f"WITH n AS ({_NORM}) SELECT competition_id, season_id, t, "
    + ", ".join(f"arg_min(provider_team_id, record_id) FILTER (data_provider = 'provider_{p}') AS provider_{p}_team_id" for p in "abc")
    + " FROM n GROUP BY ALL",
    "knockout_squish": _SQUISHED,
    "knockout_upsert": f"""WITH r AS ({_SQUISHED}), k AS (SELECT a_id, CASE WHEN a_id LIKE '%1' THEN NULL ELSE b_id END AS b_id, c_id FROM r WHERE length(a_id) % 2 = 0)
      SELECT a_id, coalesce(k.b_id, r.b_id) AS b_id, coalesce(k.c_id, r.c_id) AS c_id FROM r LEFT JOIN k USING (a_id)""",
    "knockout_loop": f"WITH w AS ({_WIDE}), k AS (SELECT a_id, {_only('b_id')}, {_only('c_id')} FROM w WHERE link_id % 10 = 0 AND a_id IS NOT NULL GROUP BY a_id), o AS (SELECT * FROM w WHERE link_id % 10 <> 0), " + _knock_out(("a_id", "b_id", "c_id")),
    "naive_match": NAIVE_MATCH,
    "knockout_antijoin": f"WITH r AS ({_WIDE}), k AS (SELECT * FROM r WHERE link_id % 10 = 0) SELECT * FROM r WHERE " + " AND ".join(f"({c} IS NULL OR {c} NOT IN (SELECT {c} FROM k WHERE {c} IS NOT NULL))" for c in ("a_id", "b_id", "c_id")),
    "flag_duplicates": f"WITH r AS ({_WIDE}) SELECT *, " + " OR ".join(f"({c} IS NOT NULL AND row_number() OVER (PARTITION BY {c} ORDER BY link_id) > 1)" for c in ("a_id", "b_id", "c_id")) + " AS is_duplicate FROM r",
    "metadata_priority": "SELECT competition_id, season_id, team_gender, ussf_country_id, coalesce("
    + ", ".join(f"max(team_name) FILTER (data_provider = 'provider_{p}')" for p in "bac")
    + ") AS team_name FROM team_records GROUP BY ALL",
    "durable_ids": """WITH c AS (SELECT c_custkey, lower(c_mktsegment) || '-' || left('nation' || c_nationkey, 10) AS stem FROM customer),
      o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY c_custkey) AS n FROM c),
      h AS (SELECT stem, max(n) AS last FROM o WHERE c_custkey % 2 = 0 GROUP BY stem)
      SELECT c_custkey, c.stem || '-' || (coalesce(h.last, 0) + row_number() OVER (PARTITION BY c.stem ORDER BY c_custkey)) AS durable_id FROM c LEFT JOIN h USING (stem) WHERE c_custkey % 2 = 1""",
    "upsert_merge": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "crosswalk_metrics": """WITH q AS (SELECT l_suppkey AS a_id, sum(l_quantity) AS qty FROM lineitem GROUP BY 1), v AS (SELECT user_id AS b_id, sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS value FROM events GROUP BY 1)
      SELECT o_orderkey, round(q.qty, 2) AS qty, CAST(v.value AS DOUBLE) AS value FROM orders LEFT JOIN q ON q.a_id = o_custkey LEFT JOIN v ON v.b_id = o_orderkey % 1000""",
}
