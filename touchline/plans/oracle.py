"""DuckDB SQL that says what the queries of `registry` say, written apart from them."""

from __future__ import annotations

from .fixtures import GAMES_SQL, SIDES_SQL, STATISTICS_SQL

DOUBLE = "CAST({} AS DOUBLE)"


def r(e: str) -> str:
    return f"(round(CAST({e} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"  # never -0.0


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def home_away(*columns: str) -> str:
    return ", ".join(f"max(CASE WHEN is_home = {home} THEN {c} END) AS {c}_{side}" for c in columns for home, side in (("TRUE", "home"), ("FALSE", "away")))


SEASON = "competition_id, competition_year"
POSITION = "CAST(substr(team_{}, 2) AS BIGINT) + 1"
RATES = {"win_rate": "wins", "draw_rate": "draws", "loss_rate": "losses", "avg_points_for": "points_for", "avg_points_against": "points_against"}
RATED = ("wins", "losses", "draws", "points_for", "points_against")
SIGNED = "CASE WHEN own > other THEN 1 WHEN own < other THEN -1 ELSE 0 END"
BINOMIAL = "CASE WHEN score_home >= score_away THEN 'Win' WHEN score_home < score_away THEN 'Loss' END"
OUTCOME = "CASE WHEN score_home > score_away THEN 'home' WHEN score_home < score_away THEN 'away' WHEN score_home = score_away THEN 'draw' END"

PREVIOUS = f"""previous AS (
  SELECT game_id, coalesce(h, 0) AS prev_result_home, coalesce(a, 0) AS prev_result_away, coalesce(h - a, 0) AS prev_result_diff FROM (
    SELECT game_id, lag(score_home - score_away) OVER (PARTITION BY {SEASON}, team_home ORDER BY round_id, game_id) AS h,
      lag(score_home - score_away) OVER (PARTITION BY {SEASON}, team_away ORDER BY round_id, game_id) AS a FROM games))"""
GAPS = f"""gaps AS (
  SELECT *, date_diff('microsecond', lag(start_time) OVER (PARTITION BY competition_id, team ORDER BY start_time, game_id), start_time) / 86400000000.0 AS gap FROM sides),
turned AS (SELECT game_id, {home_away('turn_around')} FROM (SELECT *, coalesce(gap, (SELECT avg(gap) FROM gaps)) AS turn_around FROM gaps) GROUP BY game_id)"""
MATCHUP = """matchup AS (
  SELECT game_id, CAST(coalesce(sum(CASE WHEN score_home > score_away THEN 1 WHEN score_home < score_away THEN -1 ELSE 0 END)
    OVER (PARTITION BY competition_id, team_home, team_away ORDER BY start_time, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS matchup_form FROM games)"""


def rounds(most: int) -> str:
    return f"""rounds AS (
  SELECT *, coalesce(lag(small_round) OVER (PARTITION BY {SEASON} ORDER BY round_id), 0) AS after_small_round FROM (
    SELECT {SEASON}, round_id, CAST(bool_or(contains(round_name, 'Round')) AND count(*) <= {most} AS BIGINT) AS small_round FROM games GROUP BY ALL))"""


LADDER = f"""by_round AS (
  SELECT {SEASON}, round_id, team, CAST(count(*) FILTER (own > other) AS DOUBLE) AS wins, CAST(count(*) FILTER (own < other) AS DOUBLE) AS losses, CAST(count(*) FILTER (own = other) AS DOUBLE) AS draws,
    coalesce(sum(own), 0) AS points_for, coalesce(sum(other), 0) AS points_against,
    coalesce(string_agg(CASE WHEN own > other THEN 'W' WHEN own < other THEN 'L' WHEN own = other THEN 'D' END, '' ORDER BY game_id), '') AS recent_form
  FROM sides GROUP BY ALL),
ladder AS (
  SELECT {SEASON}, round_id, team, string_agg(recent_form, '') OVER t AS recent_form, {', '.join(f'sum({x}) OVER t AS {x}' for x in RATED)}
  FROM by_round WINDOW t AS (PARTITION BY {SEASON}, team ORDER BY round_id ROWS UNBOUNDED PRECEDING)),
entering AS (
  SELECT {SEASON}, round_id, team, {', '.join(f'coalesce(lag({x}) OVER t, 0) AS {x}' for x in RATED)}
  FROM ladder WINDOW t AS (PARTITION BY {SEASON}, team ORDER BY round_id))"""
NO_GAP = f"QUALIFY dense_rank() OVER (PARTITION BY {SEASON} ORDER BY round_id) = round_id"
WIDE = f"""wide AS (
  SELECT season_id, round_number, team, {', '.join(f"coalesce(max(value) FILTER (stat_name = '{s}'), 0) AS {s}" for s in ('flag_a', 'flag_n', 'flag_r'))} FROM statistics GROUP BY ALL)"""

EXPECTED = """expected AS (
  SELECT g.*, h.home_score_avg, a.away_score_avg FROM games g
  LEFT JOIN (SELECT competition_id, team_home, avg(score_home) AS home_score_avg FROM games WHERE game_state_name = 'Final' GROUP BY ALL) h USING (competition_id, team_home)
  LEFT JOIN (SELECT competition_id, team_away, avg(score_away) AS away_score_avg FROM games WHERE game_state_name = 'Final' GROUP BY ALL) a USING (competition_id, team_away))"""


def chances(state: str) -> str:
    """Probabilities from running sums over the terms of both sides."""
    term = lambda m: f"CASE WHEN {m} > 0 THEN exp(k * ln({m}) - {m} - lgamma(k + 1)) WHEN k = 0 THEN 1.0 ELSE 0.0 END"
    return f"""means AS (SELECT DISTINCT home_score_avg AS h, away_score_avg AS a FROM expected WHERE game_state_name = '{state}' AND home_score_avg IS NOT NULL AND away_score_avg IS NOT NULL),
terms AS (
  SELECT h, a, k, {term('h')} AS ph, {term('a')} AS pa FROM (SELECT h, a, unnest(range(0, CAST(greatest(h, a) + 14 * sqrt(greatest(h, a)) AS BIGINT) + 40)) AS k FROM means)),
summed AS (
  SELECT h, a, sum(ph * a_below) AS p_home, sum(pa * h_below) AS p_away, sum(ph * pa) AS p_draw FROM (
    SELECT h, a, ph, pa, coalesce(sum(pa) OVER below, 0) AS a_below, coalesce(sum(ph) OVER below, 0) AS h_below
    FROM terms WINDOW below AS (PARTITION BY h, a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY h, a),
chances AS (
  SELECT e.*, s.p_home AS home_team_win_prob, s.p_away AS home_team_lose_prob, s.p_draw AS draw_prob
  FROM expected e JOIN summed s ON e.home_score_avg = s.h AND e.away_score_avg = s.a WHERE e.game_state_name = '{state}'),
records AS (
  SELECT *, CASE WHEN home_score_avg > away_score_avg THEN 'Win' ELSE 'Loss' END AS home_team_result,
    CASE WHEN home_score_avg = away_score_avg THEN 1.0 WHEN home_team_lose_prob = 0 THEN 1e300 ELSE home_team_win_prob / home_team_lose_prob END AS ratio FROM chances)"""


PREDICTED = (GAMES_SQL, EXPECTED, chances("Pre Game"))
PICKS = f"""picks AS (SELECT * FROM (
  SELECT game_id, competition_id, team_home AS team, odds_home AS price, 1 / nullif(home_team_win_prob, 0) AS price_min FROM records WHERE home_team_result = 'Win'
  UNION ALL SELECT game_id, competition_id, team_away, odds_away, 1 / nullif(home_team_lose_prob, 0) FROM records WHERE home_team_result = 'Loss') WHERE price > price_min * 1.05)"""
BAND = """CASE WHEN ratio < 1 THEN 'Negative evidence' WHEN ratio < 3 THEN 'Anecdotal evidence' WHEN ratio < 10 THEN 'Moderate evidence'
  WHEN ratio < 30 THEN 'Strong evidence' WHEN ratio < 100 THEN 'Very strong evidence' ELSE 'Decisive evidence' END AS evidence_strength"""
SCORELINE = ", ".join(f"CAST({e} AS BIGINT) AS predicted_{n}" for n, e in (("home_score", "floor(home_score_avg)"), ("away_score", "floor(away_score_avg)"), ("margin", "floor(home_score_avg) - floor(away_score_avg)")))
PRICE = "coalesce(format('{{:.2f}}', {}), 'None')"
LABELS = "(VALUES ('home'), ('away'), ('draw')) l(label)"
JUDGED = f"""judged AS (
  SELECT *, {OUTCOME} AS actual,
    CASE WHEN floor(home_score_avg) > floor(away_score_avg) THEN 'home' WHEN floor(home_score_avg) < floor(away_score_avg) THEN 'away' WHEN floor(home_score_avg) = floor(away_score_avg) THEN 'draw' END AS foretold
  FROM expected WHERE game_state_name = 'Final')"""


def ratings(ks: list[float]) -> str:
    """The recurrence as a recursive query: game n of every competition and k in step n, with the
    ratings of the 17 teams as a list."""
    low, high, start, carry = -80.0, 80.0, 1500.0, 0.5
    base = f"CASE WHEN s.year <> g.competition_year THEN list_transform(s.ratings, lambda x: x + {carry} * ({start} - x)) ELSE s.ratings END"
    return f"""numbered AS (
  SELECT g.competition_id, game_id, competition_year, CAST(substr(team_home, 2) AS INT) + 1 AS h, CAST(substr(team_away, 2) AS INT) + 1 AS a, m.advantage, ks.k,
    CASE WHEN score_home IS NOT NULL THEN least(1.0, greatest(0.0, (score_home - score_away - ({low})) / ({high} - ({low})))) END AS w,
    row_number() OVER (PARTITION BY g.competition_id, ks.k ORDER BY start_time, game_id) AS n
  FROM games g JOIN (SELECT competition_id, coalesce(avg(score_home - score_away), 0) AS advantage FROM games GROUP BY ALL) m USING (competition_id),
    (VALUES {', '.join(f'(CAST({k} AS DOUBLE))' for k in ks)}) ks(k)),
steps AS (
  SELECT DISTINCT competition_id, k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS year, list_transform(range(17), lambda x: CAST({start} AS DOUBLE)) AS ratings,
    CAST(NULL AS BIGINT) AS game_id, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS elo_home, CAST(NULL AS DOUBLE) AS elo_away, CAST(NULL AS DOUBLE) AS p FROM numbered
  UNION ALL
  SELECT competition_id, k, n, competition_year,
    list_transform(base, lambda x, i: CASE WHEN w IS NULL THEN x WHEN i = h THEN x + k * (w - p) WHEN i = a THEN x - k * (w - p) ELSE x END), game_id, w, base[h], base[a], p
  FROM (SELECT *, 1 / (1 + pow(10, (base[a] - (base[h] + advantage)) / 400)) AS p FROM (
    SELECT g.*, {base} AS base FROM steps s JOIN numbered g ON g.competition_id = s.competition_id AND g.k = s.k AND g.n = s.n + 1))),
rated AS (SELECT * FROM steps WHERE n > 0)"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


CURVE = f"""{with_(GAMES_SQL, EXPECTED, chances('Final'))}, scores AS (SELECT {OUTCOME} = 'home' AS y, {r('home_team_win_prob')} AS cutoff FROM records WHERE score_home IS NOT NULL AND score_away IS NOT NULL),
    tied AS (SELECT cutoff, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM scores GROUP BY cutoff),
    curve AS (SELECT *, CAST(sum(positives) OVER w AS BIGINT) AS tp, CAST(sum(negatives) OVER w AS BIGINT) AS fp FROM tied WINDOW w AS (ORDER BY cutoff DESC)),
    totals AS (SELECT CAST(max(tp) AS DOUBLE) AS p, CAST(max(fp) AS DOUBLE) AS n FROM curve)"""

ORACLE_SQL: dict[str, str] = {
    "fixture_result_binomial": f"{with_(GAMES_SQL)} SELECT game_id, {BINOMIAL} AS home_team_result FROM games",
    "fixture_result_multiclass": f"{with_(GAMES_SQL)} SELECT game_id, CASE WHEN score_home > score_away THEN 'Win' WHEN score_home < score_away THEN 'Loss' WHEN score_home = score_away THEN 'Draw' END AS home_team_result FROM games",
    "fixture_result_elo": f"""{with_(GAMES_SQL)} SELECT game_id, {r('h')} AS home_result, {r('1 - h')} AS away_result, {r('abs(score_home - score_away)')} AS margin
        FROM (SELECT *, CASE WHEN score_home > score_away THEN 1.0 WHEN score_home < score_away THEN 0.0 WHEN score_home = score_away THEN 0.5 END AS h FROM games)""",
    "game_outcome": f"{with_(GAMES_SQL)} SELECT game_id, {OUTCOME} AS outcome FROM games",
    "easy_pickings": f"""{with_(GAMES_SQL)} SELECT game_id, {POSITION.format('home')} - ({POSITION.format('away')}) AS position_diff, competition_year IN (1996, 1997) AS corona_season,
        CAST(hour(start_time) AS BIGINT) AS start_hour, dayname(start_time) AS game_day FROM games""",
    "prev_result": f"{with_(GAMES_SQL, PREVIOUS)} SELECT game_id, {r('prev_result_home')} AS prev_result_home, {r('prev_result_away')} AS prev_result_away, {r('prev_result_diff')} AS prev_result_diff FROM previous",
    "turn_around": f"""{with_(GAMES_SQL, SIDES_SQL, GAPS)} SELECT game_id, {r('turn_around_home')} AS turn_around_home, {r('turn_around_away')} AS turn_around_away,
        {r('turn_around_home - turn_around_away')} AS turn_around_diff FROM turned""",
    "matchup_form": f"{with_(GAMES_SQL, MATCHUP)} SELECT * FROM matchup",
    "season_stats": f"""{with_(GAMES_SQL, SIDES_SQL)} SELECT game_id, {home_away('season_record', 'season_points_for', 'season_points_against', 'season_points_diff')} FROM (
        SELECT game_id, is_home, CAST(coalesce(sum({SIGNED}) OVER b, 0) AS BIGINT) AS season_record,
          coalesce(CASE WHEN count(own) OVER b = count(*) OVER b THEN sum(own) OVER b END, 0) AS season_points_for,
          coalesce(CASE WHEN count(other) OVER b = count(*) OVER b THEN sum(other) OVER b END, 0) AS season_points_against,
          coalesce(lag(own - other) OVER (PARTITION BY {SEASON}, team ORDER BY game_id), 0) AS season_points_diff
        FROM sides WINDOW b AS (PARTITION BY {SEASON}, team ORDER BY game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY game_id""",
    "form_stats": f"""{with_(GAMES_SQL, SIDES_SQL)} SELECT game_id, {', '.join(f"{r(f'max(CASE WHEN is_home = {h} THEN {x} END)') if 'points' in x else f'max(CASE WHEN is_home = {h} THEN {x} END)'} AS {x}_{s}" for x in ('form_record', 'form_points_for', 'form_points_against', 'form_points_diff') for h, s in (('TRUE', 'home'), ('FALSE', 'away')))} FROM (
        SELECT game_id, is_home, CAST(coalesce(sum({SIGNED}) OVER b, 0) AS BIGINT) AS form_record, {', '.join(f"coalesce(CASE WHEN count({e}) OVER b <> count(*) OVER b THEN NULL WHEN row_number() OVER o <= 5 THEN sum({e}) OVER b ELSE avg({e}) OVER b END, 0) AS form_points_{n}" for e, n in (('own', 'for'), ('other', 'against'), ('own - other', 'diff')))}
        FROM sides WINDOW b AS (PARTITION BY {SEASON}, team ORDER BY game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY {SEASON}, team ORDER BY game_id)) GROUP BY game_id""",
    "state_of_origin": f"{with_(GAMES_SQL, rounds(9))} SELECT game_id, small_round, after_small_round FROM games LEFT JOIN rounds USING (competition_id, competition_year, round_id)",
    "bye_flag": f"""{with_(GAMES_SQL, SIDES_SQL)} SELECT game_id, {home_away('bye_before')} FROM (
        SELECT game_id, is_home, CAST(coalesce(round_id - lag(round_id) OVER (PARTITION BY {SEASON}, team ORDER BY round_id, game_id) > 1, FALSE) AS BIGINT) AS bye_before FROM sides) GROUP BY game_id""",
    "fixture_features": f"""{with_(GAMES_SQL, SIDES_SQL, PREVIOUS, GAPS, MATCHUP, rounds(5))} SELECT game_id, competition_id, competition_year,
        {', '.join(f'{r(x)} AS {x}' for x in ('prev_result_home', 'prev_result_away', 'prev_result_diff', 'turn_around_home', 'turn_around_away'))}, {r('turn_around_home - turn_around_away')} AS turn_around_diff,
        matchup_form, small_round, after_small_round, {BINOMIAL} AS home_team_result
        FROM games JOIN previous USING (game_id) JOIN turned USING (game_id) JOIN matchup USING (game_id) JOIN rounds USING (competition_id, competition_year, round_id)
        JOIN (SELECT competition_id, min(competition_year) AS first_year FROM games GROUP BY ALL) USING (competition_id) WHERE competition_year <> first_year""",
    "ladder_entering_round": f"{with_(GAMES_SQL, SIDES_SQL, LADDER)} SELECT * FROM entering",
    "ladder_rates": f"{with_(GAMES_SQL, SIDES_SQL, LADDER)} SELECT {SEASON}, round_id, team, {', '.join(f'{r(f'{x} / round_id')} AS {n}' for n, x in RATES.items())} FROM entering",
    "form_string_score": f"{with_(GAMES_SQL, SIDES_SQL, LADDER)} SELECT {SEASON}, round_id, team, recent_form, CAST(len(replace(replace(recent_form, 'L', ''), 'D', '')) - len(replace(replace(recent_form, 'W', ''), 'D', '')) AS BIGINT) AS form_score FROM ladder",
    "home_away_ladder_join": f"""{with_(GAMES_SQL, SIDES_SQL, LADDER)} SELECT game_id, h.wins AS wins_home_ladder, a.wins AS wins_away_ladder, h.points_for AS points_for_home_ladder, a.points_for AS points_for_away_ladder
        FROM games g LEFT JOIN entering h ON g.competition_id = h.competition_id AND g.competition_year = h.competition_year AND g.round_id = h.round_id AND g.team_home = h.team
        LEFT JOIN entering a ON g.competition_id = a.competition_id AND g.competition_year = a.competition_year AND g.round_id = a.round_id AND g.team_away = a.team""",
    "performance_pivot": f"{with_(STATISTICS_SQL, WIDE)} SELECT * FROM wide",
    "performance_join": f"""{with_(GAMES_SQL, STATISTICS_SQL, WIDE)}, b AS (SELECT season_id, round_number, team, {', '.join(f'coalesce(lag({s}) OVER t, 0) AS {s}' for s in ('flag_a', 'flag_n', 'flag_r'))} FROM wide WINDOW t AS (PARTITION BY season_id, team ORDER BY round_number))
        SELECT game_id, {', '.join(f'{t}.{s} AS {s}_{n}_performance' for s in ('flag_a', 'flag_n', 'flag_r') for t, n in (('h', 'home'), ('a', 'away')))} FROM games g
        LEFT JOIN b h ON g.competition_year = h.season_id AND g.round_id = h.round_number AND g.team_home = h.team
        LEFT JOIN b a ON g.competition_year = a.season_id AND g.round_id = a.round_number AND g.team_away = a.team""",
    "xml_fixtures_roundtrip": f"{with_(GAMES_SQL)} SELECT competition_id, competition_year, round_id, round_name, game_id, game_state_name, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, venue_name, crowd, team_home, team_away, score_home, score_away, {r('odds_home')} AS odds_home, {r('odds_away')} AS odds_away FROM games",
    "xml_ladder": f"{with_(GAMES_SQL, SIDES_SQL, LADDER)} SELECT {SEASON}, round_id, team, {', '.join(RATED)} FROM ladder {NO_GAP}",
    "assembled_games": f"""{with_(GAMES_SQL, SIDES_SQL, STATISTICS_SQL, LADDER)}, hosts AS (SELECT DISTINCT competition_id, team_home AS team FROM games), kept AS (SELECT * FROM ladder {NO_GAP}),
        b AS (SELECT {SEASON}, round_id, team, coalesce(lag(wins) OVER t, 0) AS wins, coalesce(lag(points_for) OVER t, 0) AS points_for, coalesce(lag(form) OVER t, 0) AS form
          FROM (SELECT *, CAST(len(regexp_replace(recent_form, '[^W]', '', 'g')) - len(regexp_replace(recent_form, '[^L]', '', 'g')) AS DOUBLE) AS form FROM kept)
          WINDOW t AS (PARTITION BY {SEASON}, team ORDER BY round_id))
        , {WIDE}, s AS (SELECT season_id, round_number, team, {', '.join(f'coalesce(lag({x}) OVER t, 0) AS {x}' for x in ('flag_a', 'flag_n', 'flag_r'))} FROM wide WINDOW t AS (PARTITION BY season_id, team ORDER BY round_number))
        SELECT game_id, {', '.join(f'{t}.{x} AS {x}_{n}_performance' for x in ('flag_a', 'flag_n', 'flag_r') for t, n in (('sh', 'home'), ('sa', 'away')))}, {', '.join(f"{t}.wins AS wins_{n}_ladder, {t}.form AS recent_form_{n}_ladder, {r(f'{t}.wins / g.round_id')} AS win_rate_{n}_ladder, {r(f'{t}.points_for / g.round_id')} AS avg_points_for_{n}_ladder" for t, n in (('h', 'home'), ('a', 'away')))} FROM games g
        LEFT JOIN b h ON g.competition_id = h.competition_id AND g.competition_year = h.competition_year AND g.round_id = h.round_id AND g.team_home = h.team
        LEFT JOIN b a ON g.competition_id = a.competition_id AND g.competition_year = a.competition_year AND g.round_id = a.round_id AND g.team_away = a.team
        LEFT JOIN hosts hh ON hh.competition_id = g.competition_id AND hh.team = g.team_home LEFT JOIN hosts ha ON ha.competition_id = g.competition_id AND ha.team = g.team_away
        LEFT JOIN s sh ON g.competition_year = sh.season_id AND g.round_id = sh.round_number AND hh.team = sh.team
        LEFT JOIN s sa ON g.competition_year = sa.season_id AND g.round_id = sa.round_number AND ha.team = sa.team""",
    "xml_performance": f"{with_(STATISTICS_SQL)} SELECT CAST(season_id AS VARCHAR) AS season_id, CAST(round_number AS VARCHAR) AS round_number, stat_name, team, {r('value')} AS value FROM statistics",
    "stop_at_gap": f"""{with_(GAMES_SQL)} SELECT competition_year, round_id FROM (SELECT *, row_number() OVER (PARTITION BY competition_year ORDER BY round_id) AS n FROM (
        SELECT DISTINCT competition_year, round_id FROM games WHERE NOT (competition_year = 1996 AND round_id = 4) AND NOT (competition_year = 1998 AND round_id = 1))) WHERE n = round_id""",
    "schema_union": f"{with_(GAMES_SQL)} SELECT game_id, team_home, NULL AS team_away FROM games UNION ALL SELECT game_id, NULL, team_away FROM games",
    "level_vocabulary": f"{with_(GAMES_SQL)} SELECT team_home, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT team_home, CAST(count(*) AS BIGINT) AS n FROM games GROUP BY ALL UNION ALL SELECT 'T3', 0 UNION ALL SELECT 'Newcomers', 0) GROUP BY ALL",
    "predictor_filter": f"""{with_(GAMES_SQL, SIDES_SQL, LADDER)}, shares AS (SELECT count(h.team) / count(*) AS home, count(a.team) / count(*) AS away FROM games g
        LEFT JOIN entering h ON g.competition_id = h.competition_id AND g.competition_year = h.competition_year AND g.round_id = h.round_id AND g.team_home = h.team
        LEFT JOIN entering a ON g.competition_id = a.competition_id AND g.competition_year = a.competition_year AND g.round_id = a.round_id AND g.team_away = a.team)
        SELECT n || '_' || s || '_ladder' AS predictor, {r("CASE s WHEN 'home' THEN home ELSE away END")} AS present
        FROM shares, (VALUES {', '.join(f"('{n}')" for n in ('wins', 'losses', 'draws', 'points_for', 'points_against', 'recent_form', 'win_rate', 'draw_rate', 'loss_rate', 'avg_points_for', 'avg_points_against'))}) t(n), (VALUES ('home'), ('away')) u(s)""",
    "fct_lump_max": """WITH counts AS (SELECT p_name, count(*) AS n FROM part GROUP BY ALL), ranked AS (SELECT p_name, (SELECT count(*) FROM counts b WHERE b.n >= a.n) AS place FROM counts a)
        SELECT p_partkey, CASE WHEN p_name IS NULL OR place <= 40 THEN p_name ELSE 'Other' END AS p_name FROM part LEFT JOIN ranked USING (p_name)""",
    "fct_lump_min": f"""{with_(GAMES_SQL)}, counts AS (SELECT venue_name, count(*) AS n FROM games GROUP BY ALL), ranked AS (SELECT venue_name, rank() OVER (ORDER BY n DESC) AS place FROM counts)
        SELECT game_id, CASE WHEN venue_name IS NULL OR place <= 42 THEN venue_name ELSE 'Other' END AS venue_name FROM games LEFT JOIN ranked USING (venue_name)""",
    "null_fill_by_type": f"{with_(GAMES_SQL)} SELECT game_id, competition_year, coalesce(round_name, 'None') AS round_name, {', '.join(f'{r(f'coalesce({x}, 0)')} AS {x}' for x in ('score_home', 'score_away', 'odds_home', 'crowd'))} FROM games",
    "training_split": f"""{with_(GAMES_SQL)} SELECT game_id, competition_year, {r('odds_home')} AS odds_home FROM games WHERE game_state_name = 'Final' AND odds_home IS NOT NULL
        AND competition_year <> (SELECT min(competition_year) FROM games f WHERE f.competition_id = games.competition_id)""",
    "inference_split": f"{with_(GAMES_SQL)} SELECT game_id, competition_year, round_id FROM games WHERE game_state_name = 'Pre Game' AND round_id = (SELECT min(round_id) FROM games WHERE game_state_name = 'Pre Game')",
    "drop_first_season": f"""{with_(GAMES_SQL)} SELECT {SEASON}, count(*) AS games FROM games WHERE competition_year <> (SELECT min(competition_year) FROM games f WHERE f.competition_id = games.competition_id) GROUP BY ALL""",
    "margin_outcome": f"{with_(GAMES_SQL)} SELECT game_id, CASE WHEN score_home IS NOT NULL THEN {r('least(1.0, greatest(0.0, (score_home - score_away + 20) / 40))')} END AS w FROM games",
    "elo_ratings": f"{recursive(GAMES_SQL, ratings([70.0]))} SELECT competition_id, game_id, {r('elo_home')} AS elo_home, {r('elo_away')} AS elo_away, {r('p')} AS elo_home_prob FROM rated",
    "elo_draw_rates": f"""{recursive(GAMES_SQL, ratings([70.0]))}, bucketed AS (SELECT *, round_even(p * 20, 0) AS bucket FROM rated),
        drawn AS (SELECT bucket, avg(CASE WHEN w = 0.5 THEN 1.0 ELSE 0.0 END) AS draw_rate FROM bucketed GROUP BY ALL)
        SELECT game_id, {r('elo_home - elo_away')} AS elo_diff, {r('draw_rate')} AS draw_rate, {r('p * (1 - draw_rate)')} AS home_prob, {r('(1 - p) * (1 - draw_rate)')} AS away_prob,
          {r('p * (1 - draw_rate) - (1 - p) * (1 - draw_rate)')} AS elo_prob_diff FROM bucketed JOIN drawn USING (bucket)""",
    "elo_k_sweep": f"""{recursive(GAMES_SQL, ratings([float(k) for k in range(21, 71)]))}, bucketed AS (SELECT *, round_even(p * 20, 0) AS bucket FROM rated WHERE w IS NOT NULL),
        drawn AS (SELECT k, bucket, avg(CASE WHEN w = 0.5 THEN 1.0 ELSE 0.0 END) AS draw_rate FROM bucketed GROUP BY ALL),
        later AS (SELECT b.*, draw_rate FROM bucketed b JOIN drawn USING (k, bucket) WHERE year <> (SELECT min(competition_year) FROM games g WHERE g.competition_id = b.competition_id))
        SELECT k, {r('avg(-ln(greatest(CASE WHEN w > 0.5 THEN p * (1 - draw_rate) WHEN w < 0.5 THEN (1 - p) * (1 - draw_rate) ELSE draw_rate END, 1e-15)))')} AS log_loss, count(*) AS games FROM later GROUP BY k""",
    "poisson_outcome": f"{with_(*PREDICTED)} SELECT game_id, {', '.join(f'{r(x)} AS {x}' for x in ('home_score_avg', 'away_score_avg', 'home_team_win_prob', 'home_team_lose_prob', 'draw_prob'))} FROM records",
    "bayes_evidence": f"{with_(*PREDICTED)} SELECT game_id, {BAND}, round(least(ratio, 1e9), 4) AS bayes_factor FROM records",
    "modal_scoreline": f"{with_(*PREDICTED)} SELECT game_id, {SCORELINE} FROM records",
    "prediction_record": f"""{with_(*PREDICTED)} SELECT game_id, home_team_result, {', '.join(f'{r(x)} AS {x}' for x in ('home_team_win_prob', 'home_team_lose_prob', 'draw_prob', 'home_score_avg', 'away_score_avg'))},
        {SCORELINE}, {BAND} FROM records""",
    "predictions_upsert": f"""{with_(*PREDICTED)}, ends AS (SELECT min(round_id) AS first, max(round_id) AS last FROM records)
        SELECT game_id, home_team_result, {r('CASE WHEN round_id > first THEN home_team_win_prob / 2 ELSE home_team_win_prob END')} AS home_team_win_prob,
        {r('home_team_lose_prob')} AS home_team_lose_prob FROM records, ends WHERE round_id > first OR round_id < last""",
    "prediction_report": f"""{with_(*PREDICTED)} SELECT game_id, home_team_result, team_home, {POSITION.format('home')} AS position_home, {r('odds_home')} AS odds_home, team_away, {POSITION.format('away')} AS position_away, {r('odds_away')} AS odds_away, {r('home_team_win_prob')} AS home_team_win_prob,
        {r('home_team_lose_prob')} AS home_team_lose_prob, round_id, competition_year, round_name FROM records WHERE round_id = (SELECT min(round_id) FROM games WHERE game_state_name = 'Pre Game')""",
    "value_picks": f"""{with_(*PREDICTED, PICKS)} SELECT game_id, team, {r('price')} AS price, {r('price_min')} AS price_min FROM picks""",
    "pick_text": f"""{with_(*PREDICTED, PICKS)} SELECT competition_id, string_agg('Team: ' || team || chr(10) || 'Price: ' || {PRICE.format('price')}, chr(10) || chr(10) ORDER BY game_id) AS report FROM picks GROUP BY ALL""",
    "report_text": f"""{with_(*PREDICTED)} SELECT {SEASON}, round_id, string_agg(concat_ws(chr(10), 'Round Name: ' || round_name, 'Home Team Result: ' || home_team_result,
        'Home Team: ' || team_home, 'Home Team Position: ' || ({POSITION.format('home')}), 'Home Team Head to Head Price: ' || {PRICE.format('odds_home')},
        'Away Team: ' || team_away, 'Away Team Position: ' || ({POSITION.format('away')}), 'Away Team Head to Head Price: ' || {PRICE.format('odds_away')}), chr(10) || chr(10) ORDER BY game_id) AS report FROM records GROUP BY ALL""",
    "confusion_matrix": f"""{with_(GAMES_SQL, EXPECTED, JUDGED)} SELECT label AS actual, {', '.join(f"count(*) FILTER (foretold = '{x}') AS predicted_{x}" for x in ('home', 'away', 'draw'))} FROM {LABELS} LEFT JOIN judged ON actual = label GROUP BY ALL""",
    "classification_report": f"""{with_(GAMES_SQL, EXPECTED, JUDGED)}, cells AS (SELECT label, count(*) FILTER (actual = label AND foretold = label) AS tp, count(*) FILTER (foretold = label) AS called, count(*) FILTER (actual = label) AS support FROM judged, {LABELS} GROUP BY ALL),
        ratios AS (SELECT *, coalesce(tp / nullif(called, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM cells)
        SELECT label, {r('pr')} AS precision, {r('re')} AS recall, {r('coalesce(2 * pr * re / nullif(pr + re, 0), 0)')} AS f1, support FROM ratios""",
    "regression_metrics": f"""{with_(GAMES_SQL, EXPECTED, JUDGED)}, pairs AS (SELECT 'home' AS target, score_home AS y, home_score_avg AS f FROM judged UNION ALL SELECT 'away', score_away, away_score_avg FROM judged)
        SELECT target, {r('avg(abs(y - f))')} AS mae, {r('sqrt(avg((y - f) * (y - f)))')} AS rmse, {r('1 - sum((y - f) * (y - f)) / nullif(var_pop(y) * count(y), 0)')} AS r2,
          {r('avg(2 * (CASE WHEN y > 0 THEN y * ln(y / greatest(f, 1e-9)) ELSE 0 END - y + greatest(f, 1e-9)))')} AS poisson_deviance FROM pairs WHERE y IS NOT NULL AND f IS NOT NULL GROUP BY target""",
    "score_source_metrics": f"""{with_(GAMES_SQL, EXPECTED, JUDGED)}, pairs AS (SELECT 'mean_home' AS target, score_home AS y, home_score_avg AS f FROM judged UNION ALL SELECT 'mean_away', score_away, away_score_avg FROM judged
          UNION ALL SELECT 'mode_home', score_home, floor(home_score_avg) FROM judged UNION ALL SELECT 'mode_away', score_away, floor(away_score_avg) FROM judged)
        SELECT target, {r('avg(abs(y - f))')} AS mae, {r('sqrt(avg((y - f) * (y - f)))')} AS rmse, {r('1 - sum((y - f) * (y - f)) / nullif(var_pop(y) * count(y), 0)')} AS r2,
          {r('avg(2 * (CASE WHEN y > 0 THEN y * ln(y / greatest(f, 1e-9)) ELSE 0 END - y + greatest(f, 1e-9)))')} AS poisson_deviance FROM pairs WHERE y IS NOT NULL AND f IS NOT NULL GROUP BY target""",
    "accuracy": f"{with_(GAMES_SQL, EXPECTED, JUDGED)} SELECT {r('avg(CASE WHEN actual = foretold THEN 1.0 WHEN actual <> foretold THEN 0.0 END)')} AS accuracy FROM judged",
    "roc_points": f"""{with_(GAMES_SQL, EXPECTED, JUDGED)}, rates AS (SELECT label, count(*) FILTER (actual = label AND foretold = label) / nullif(count(*) FILTER (actual = label), 0) AS tpr,
        count(*) FILTER (actual <> label AND foretold = label) / nullif(count(*) FILTER (actual <> label), 0) AS fpr FROM judged, {LABELS} GROUP BY ALL)
        SELECT label, {r('tpr')} AS tpr, {r('fpr')} AS fpr, {r('(1 + tpr - fpr) / 2')} AS auc FROM rates""",
    "log_loss": f"""{with_(GAMES_SQL, EXPECTED, chances('Final'))}, p AS (SELECT CASE {OUTCOME} WHEN 'home' THEN home_team_win_prob WHEN 'away' THEN home_team_lose_prob WHEN 'draw' THEN draw_prob END AS p FROM records)
        SELECT {r('avg(-ln(greatest(p, 1e-15)))')} AS log_loss, count(p) AS games FROM p""",
    "kappa_cutoffs": f"""{with_(GAMES_SQL, EXPECTED, chances('Final'))}, s AS (SELECT {OUTCOME} = 'home' AS y, floor(round(home_team_win_prob, 9) * 20) AS step FROM records WHERE score_home IS NOT NULL AND score_away IS NOT NULL),
        counts AS (SELECT k, count(*) FILTER (y AND step >= k) AS tp, count(*) FILTER (NOT y AND step >= k) AS fp, CAST(count(*) FILTER (y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM s, range(1, 20) t(k) GROUP BY k),
        rates AS (SELECT *, (tp + n - p - fp) / n AS agreed, ((tp + fp) * p + (n - tp - fp) * (n - p)) / (n * n) AS chance FROM counts WHERE tp + fp > 0)
        SELECT k AS cutoff_no, {r('k / 20')} AS cutoff, tp, fp, {r('coalesce((agreed - chance) / nullif(1 - chance, 0), 0)')} AS kappa FROM rates""",
    "score_roc_curve": f"{CURVE} SELECT cutoff, positives, negatives, tp, fp, {r('tp / p')} AS tpr, {r('fp / n')} AS fpr FROM curve, totals",
    "score_auc": f"""{CURVE} SELECT {r('(SELECT sum(CASE WHEN a.cutoff > b.cutoff THEN 1.0 WHEN a.cutoff = b.cutoff THEN 0.5 ELSE 0.0 END * a.positives * b.negatives) FROM tied a, tied b) / (p * n)')} AS auc,
        CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM totals""",
    "score_best_cutoff": f"""{CURVE}, agreed AS (SELECT *, (tp + n - fp) / (p + n) AS a, ((tp + fp) * p + (p + n - tp - fp) * n) / ((p + n) * (p + n)) AS c FROM curve, totals)
        SELECT cutoff, tp, fp, {r('coalesce((a - c) / nullif(1 - c, 0), 0)')} AS kappa FROM agreed ORDER BY round(coalesce((a - c) / nullif(1 - c, 0), 0), 12) DESC, cutoff LIMIT 1""",
    "crosstab_nulls": f"{with_(GAMES_SQL)} SELECT coalesce(round_name, 'missing') AS round_name, count(crowd) AS n_known, count(*) FILTER (crowd IS NULL) AS n_missing FROM games GROUP BY ALL",
    "profile_summary": with_(GAMES_SQL)
    + " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count({x}) AS present, count(*) FILTER ({x} IS NULL) AS missing, {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS sd, {r(f'min({x})')} AS smallest, {r(f'max({x})')} AS largest FROM games"
        for x in ("score_home", "score_away", "odds_home", "odds_away", "crowd")
    ),
    "margin_histogram": f"""{with_(GAMES_SQL)} SELECT CAST(CASE WHEN m < -60 THEN 0 WHEN m >= 60 THEN 13 ELSE floor((m + 60) / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT score_home - score_away AS m FROM games) WHERE m IS NOT NULL GROUP BY ALL""",
    "error_density": f"""{with_(GAMES_SQL, EXPECTED, JUDGED)}, errors AS (SELECT 'home' AS side, {r('score_home - home_score_avg')} AS e FROM judged UNION ALL SELECT 'away', {r('score_away - away_score_avg')} FROM judged),
        moments AS (SELECT side, min(e) AS low, max(e) AS high, count(e) AS n, stddev_samp(e) * pow(count(e), -0.2) AS h FROM errors GROUP BY side),
        counts AS (SELECT side, least(floor((e - low) / ((high - low) / 1000)), 999) AS bin, count(*) AS c FROM errors JOIN moments USING (side) WHERE e IS NOT NULL GROUP BY ALL),
        places AS (SELECT *, low + k * (high - low) / 99 AS x FROM moments, range(100) t(k))
        SELECT k AS point, side, {r('any_value(x)')} AS x, {r('sum(c * exp(-0.5 * pow((x - low - (bin + 0.5) * (high - low) / 1000) / h, 2))) / any_value(n * h * sqrt(2 * pi()))')} AS density
        FROM places JOIN counts USING (side) GROUP BY k, side""",
    "score_scatter": f"""{with_(GAMES_SQL, EXPECTED, JUDGED)}, pairs AS (SELECT 'home' AS side, score_home AS x, home_score_avg AS y FROM judged UNION ALL SELECT 'away', score_away, away_score_avg FROM judged)
        SELECT side, {r('floor(x / 2) * 2')} AS x, {r('floor(y / 2) * 2')} AS y, count(*) AS n FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""",
    "crowd_imputation": f"""{with_(GAMES_SQL)}, seen AS (SELECT * FROM games WHERE competition_year NOT IN (1996, 1997))
        SELECT game_id, {r("CASE WHEN competition_year IN (1996, 1997) THEN 0 ELSE coalesce(crowd, (SELECT avg(crowd) FROM seen v WHERE v.venue_name = games.venue_name), (SELECT avg(crowd) FROM seen)) END")} AS crowd FROM games""",
}
ORACLE_SQL["predictions_keyed"] = ORACLE_SQL["predictions_upsert"]
ORACLE_SQL["stage_report"] = f"""{with_(GAMES_SQL)}, settled AS (SELECT * FROM games WHERE competition_year > (SELECT min(competition_year) FROM games f WHERE f.competition_id = games.competition_id))
    SELECT 'games' AS stage, 'done' AS status, count(*) AS rows FROM games UNION ALL SELECT 'features', 'done', count(*) FROM games
    UNION ALL SELECT 'settled', 'done', count(*) FROM settled UNION ALL SELECT 'training', 'done', count(*) FROM settled WHERE game_state_name = 'Final'"""
