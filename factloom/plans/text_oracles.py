"""DuckDB SQL of the queries that read or write whole texts: claims, premises, alignment, PARENT, fact sheets."""

from __future__ import annotations

from factloom.plans.oracles import _DRAWS, _LETTERS, CELLS, ORACLE_SQL, GAMES, NUMBERS, TEXTS, _bleu_items, _numbers, _sentences, _tokens, counted, permuted

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

# Claims are read off the sentences, and checked against the players and results.
CLAIMS = TEXTS + f""",
said AS (SELECT id, {_sentences('output')} AS s FROM texts),
roster AS (SELECT ex_id, player, team, lower(city) AS scope, pts, reb FROM players),
best AS (SELECT ex_id, scope, list_sort(list(player)) AS top FROM (SELECT *, max(pts) OVER (PARTITION BY ex_id, scope) AS m FROM roster) WHERE pts = m GROUP BY ALL),
nicks AS (SELECT ex_id, team0 AS team, nick0 AS nick FROM facts UNION ALL SELECT ex_id, team1, nick1 FROM facts),
won AS (SELECT id, 0 AS pos, 0 AS k, s[1] AS sentence, regexp_extract(s[1], '^The (.+) defeated the (.+) [0-9]+ to [0-9]+\\.$', 1) AS claimed FROM said
  UNION ALL SELECT id, 2, 0, s[3], team FROM said JOIN nicks ON id = ex_id AND nick = regexp_extract(s[3], 'victory for the (.+)\\.$', 1)),
result AS (SELECT id, pos, 0 AS part, k, 'winner' AS type, sentence, claimed, winner AS expected, claimed = winner AS correct FROM won JOIN facts ON id = ex_id WHERE NOT tie
  UNION ALL SELECT id, 2, 0, (NOT tie)::INT, 'margin', s[3], n, margin::VARCHAR, n = margin::VARCHAR
    FROM (SELECT *, regexp_extract(s[3], '([0-9]+)-point', 1) AS n FROM said) JOIN facts ON id = ex_id WHERE margin <> 0),
scored AS (SELECT id, s[2] AS sentence, regexp_extract(s[2], '^(.+) led the (.+) with ([0-9]+) points', ['player', 'nick', 'n']) AS x FROM said),
added AS (SELECT id, s[4] AS sentence, regexp_extract(s[4], '^The ([^'']+)'' (.+) added ([0-9]+) rebounds', ['nick', 'player', 'n']) AS x FROM said),
about AS (SELECT a.*, r.team, r.scope, c.team AS said_team, CASE pos WHEN 1 THEN r.pts ELSE r.reb END AS v, CASE pos WHEN 1 THEN 'PTS' ELSE 'REB' END AS stat
  FROM (SELECT id, 1 AS pos, sentence, x.player AS player, x.nick AS nick, x.n AS n FROM scored UNION ALL SELECT id, 3, sentence, x.player, x.nick, x.n FROM added) a
  JOIN roster r ON r.ex_id = a.id AND r.player = a.player JOIN nicks c ON c.ex_id = a.id AND c.nick = a.nick),
claims AS (SELECT * FROM result
  UNION ALL SELECT id, pos, 1, 0, 'team-attribution', sentence, player || ' on ' || said_team, player || ' on ' || team, team = said_team FROM about
  UNION ALL SELECT id, pos, 1, 1, 'attribution', sentence, player || ' ' || n || ' ' || stat, player || ' ' || v || ' ' || stat, n = v::VARCHAR FROM about
  UNION ALL SELECT id, pos, 1, 2, 'leader', sentence, player || ' led (PTS)', 'led by [''' || array_to_string(top, ''', ''') || '''] (PTS)', list_contains(top, player) FROM about JOIN best ON ex_id = id AND best.scope = about.scope WHERE pos = 1)"""

SQL: dict[str, str] = {}
SQL["relation_claims"] = f"WITH {CLAIMS} SELECT id, pos::INT AS pos, part::INT AS part, 0 AS clause_no, 0 AS seg_no, k::INT AS k, type, sentence, claimed, expected, correct FROM claims"
SQL["relations_run"] = f"""WITH {CLAIMS}, per AS (SELECT t.id, count(c.id) AS n, count(*) FILTER (NOT correct) AS w FROM texts t LEFT JOIN claims c ON t.id = c.id GROUP BY t.id)
  SELECT count(*) AS items, sum(n)::BIGINT AS relational_claims, sum(w)::BIGINT AS relational_wrong, round(sum(w) / sum(n), 9) AS relational_wrong_rate, round(count(*) FILTER (w > 0) / count(*), 9) AS pct_items_with_relational_error FROM per"""
SQL["wrong_by_type"] = f"WITH {CLAIMS} SELECT type, count(*) AS wrong FROM claims WHERE NOT correct GROUP BY type"
SQL["positional_bias"] = f"""WITH {CLAIMS}, j AS (SELECT t.id, CASE WHEN winner = team0 THEN 'first' ELSE 'second' END AS side, c.correct FROM texts t JOIN facts ON t.id = ex_id LEFT JOIN claims c ON c.id = t.id AND type = 'winner' WHERE NOT tie)
  SELECT side, count(DISTINCT id) AS games, count(correct) AS claims, count(*) FILTER (NOT correct) AS wrong, round(count(*) FILTER (NOT correct) / count(correct), 9) AS wrong_rate FROM j GROUP BY side"""
SQL["filter_reference"] = f"""WITH {CLAIMS}, kept AS (SELECT id, i, s[i + 1] AS sentence FROM (SELECT id, s, unnest(range(len(s))) AS i FROM said)),
  bad AS (SELECT DISTINCT id, pos FROM claims WHERE NOT correct)
  SELECT t.id AS ex_id, coalesce(string_agg(sentence, ' ' ORDER BY i), '') AS reference FROM texts t LEFT JOIN (SELECT k.* FROM kept k ANTI JOIN bad b ON k.id = b.id AND k.i = b.pos) k ON t.id = k.id GROUP BY t.id"""

# A unit of these texts is a sentence.
UNITS = f"""units AS (SELECT id, i AS pos, trim(s[i + 1], ' ,') AS unit FROM (SELECT id, s, unnest(range(len(s))) AS i FROM (SELECT id, {_sentences('output')} AS s FROM {{}})))"""
SQL["premise_lengths"] = f"""WITH {TEXTS}, {UNITS.format('texts')},
  lines AS (SELECT ex_id, sec_idx, row_idx, n_sec_rows, list_filter({_WORDS.format('entity')}, lambda t: length(t) >= 3 AND t NOT IN ('the', 'and', 'for', 'out', 'city', 'new')) AS names,
    length(sec_name || ' ' || entity || ' -- ' || string_agg(col_name || ': ' || text, '; ' ORDER BY col_idx) FILTER (NOT is_key)) AS size FROM full_cells GROUP BY ex_id, sec_idx, sec_name, row_idx, n_sec_rows, entity),
  hits AS (SELECT u.id, pos, unit, l.*, n_sec_rows > 1 AND list_has_any(names, {_WORDS.format('unit')}) AS hit, min(CASE WHEN n_sec_rows > 1 THEN sec_idx END) OVER (PARTITION BY u.id, pos) AS lead FROM units u JOIN lines l ON u.id = l.ex_id),
  chosen AS (SELECT id, pos, unit, size FROM (SELECT *, bool_or(hit) OVER (PARTITION BY id, pos) AS named FROM hits) WHERE n_sec_rows = 1 OR CASE WHEN named THEN hit ELSE sec_idx = lead AND row_idx < 2 END
    UNION ALL SELECT u.id, pos, unit, length('The ' || winner || ' defeated the ' || loser || ' ' || greatest(pts0, pts1) || ' to ' || least(pts0, pts1) || ' ; the ' || winner || ' won the game and the ' || loser || ' lost the game') FROM units u JOIN facts ON u.id = ex_id WHERE NOT tie)
  SELECT id, pos::INT AS pos, length(unit)::INT AS unit_chars, least(2000, sum(size) + 3 * (count(*) - 1))::INT AS premise_chars FROM chosen GROUP BY id, pos, unit"""
_CLOSING = "CASE WHEN e % 2 = 0 THEN ' In the end the team that had won was glad.' ELSE ' Nobody there had lost the will to play on.' END"
SQL["nli_stub_run"] = f"""WITH {TEXTS}, longer AS (SELECT id, output || {_CLOSING} AS output FROM texts), {UNITS.format('longer')},
  labels AS (SELECT id, CASE WHEN contains(unit, 'won') THEN 'entailment' WHEN contains(unit, 'lost') THEN 'contradiction' ELSE 'neutral' END AS label FROM units),
  per AS (SELECT id, count(*) AS n, count(*) FILTER (label = 'entailment') AS e, count(*) FILTER (label = 'contradiction') AS c FROM labels GROUP BY id)
  SELECT count(*) AS items, sum(n)::BIGINT AS total_claims, round(sum(e) / sum(n), 9) AS claim_entailed_rate_micro, round(count(*) FILTER (c > 0) / count(*), 9) AS pct_items_with_contradiction FROM per"""

_MENTIONS = r"regexp_matches({}, '(^|[^\pL\pN_])' || regexp_escape({}) || '($|[^\pL\pN_])')"
SQL["align_labels"] = f"""WITH {TEXTS}, low AS (SELECT id, lower(output) AS t, list_transform({_numbers('output')}, lambda v: round(v, 6)) AS ns FROM texts),
  surnames AS (SELECT ex_id, player, lower('S' || {_LETTERS.format('s_suppkey % 40')}) AS surname, count(*) OVER (PARTITION BY ex_id, s_suppkey % 40) AS n FROM players),
  towns AS (SELECT ex_id, team0 AS team, nick0 AS nick, city0 AS city, city0 <> city1 AS own FROM facts UNION ALL SELECT ex_id, team1, nick1, city1, city0 <> city1 FROM facts)
  SELECT c.ex_id, sec_idx, row_idx::INT AS row_idx, col_idx::INT AS col_idx, CASE WHEN kind = 1 THEN list_contains(ns, round(num, 6)) ELSE {_MENTIONS.format('t', 'lower(text)')}
    OR (is_key AND coalesce(p.n = 1 AND {_MENTIONS.format('t', 'p.surname')}, false))
    OR (is_key AND coalesce({_MENTIONS.format('t', 'lower(w.nick)')} OR (w.own AND {_MENTIONS.format('t', 'lower(w.city)')}), false)) END AS label
  FROM full_cells c JOIN low ON c.ex_id = low.id LEFT JOIN surnames p ON c.ex_id = p.ex_id AND sec_idx = 1 AND p.player = c.text LEFT JOIN towns w ON c.ex_id = w.ex_id AND sec_idx = 0 AND w.team = c.text"""

_GRAMS = "SELECT id, n, t[i:i + n - 1] AS gram, count(*) AS c FROM (SELECT id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT id, {} AS t FROM texts), (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL"
# The longest common subsequence of a short value and a text is the largest part of the value that the text holds in order.
SQL["parent_items"] = f"""WITH {TEXTS}, entries AS (SELECT ex_id AS id, {_tokens('text')} AS v FROM full_cells),
  lexicon AS (SELECT id, list_distinct(flatten(list(v))) AS lex FROM entries GROUP BY id), hg AS ({_GRAMS.format(_tokens('output'))}), rg AS ({_GRAMS.format(_tokens('reference'))}),
  grams AS (SELECT id, n, coalesce(h.c, 0) AS ch, coalesce(r.c, 0) AS cr, len(list_filter(gram, lambda x: list_contains(lex, x))) / len(gram) AS w FROM hg h FULL JOIN rg r USING (id, n, gram) JOIN lexicon USING (id)),
  gsums AS (SELECT id, n, sum(CASE WHEN ch > 0 THEN ch * (least(1.0, cr / ch) + (1 - least(1.0, cr / ch)) * w) ELSE 0 END) AS pn, sum(ch) AS pd, sum(CASE WHEN cr > 0 THEN cr * w * least(1.0, ch / cr) ELSE 0 END) AS rn, sum(cr * w) AS rd FROM grams GROUP BY ALL),
  rates AS (SELECT id, n, CASE WHEN coalesce(pd, 0) = 0 THEN 0 ELSE pn / pd END AS p, CASE WHEN coalesce(rd, 0) = 0 THEN 1 ELSE rn / rd END AS r FROM (SELECT id, unnest([1, 2, 3, 4]) AS n FROM texts) LEFT JOIN gsums USING (id, n)),
  smooth AS (SELECT id, CASE WHEN n > 1 AND p = 0 THEN 1e-5 ELSE p END AS p, CASE WHEN n > 1 AND r = 0 THEN 1e-5 ELSE r END AS r FROM rates),
  means AS (SELECT id, CASE WHEN min(p) = 0 THEN 0 ELSE exp(sum(ln(CASE WHEN p > 0 THEN p END)) / 4) END AS precision, CASE WHEN min(r) = 0 THEN 1e-5 ELSE exp(sum(ln(CASE WHEN r > 0 THEN r END)) / 4) END AS rr FROM smooth GROUP BY id),
  marked AS (SELECT id, array_to_string(list_transform({_tokens('output')}, lambda x: chr(30) || x || chr(31)), '') AS t FROM texts),
  masks AS (SELECT DISTINCT id, v, unnest(range(1, (1 << len(v))::BIGINT)) AS mask FROM entries),
  found AS (SELECT m.id, v, max(bit_count(mask)) AS lcs FROM masks m JOIN marked USING (id)
    WHERE regexp_matches(t, array_to_string(list_transform(list_filter(range(len(v)), lambda i: (mask >> i) & 1 = 1), lambda i: chr(30) || regexp_escape(v[i + 1]) || chr(31)), '.*'), 's') GROUP BY m.id, v),
  mention AS (SELECT e.id, sum(coalesce(lcs, 0) / len(e.v)) / count(*) AS m FROM entries e LEFT JOIN found f ON e.id = f.id AND e.v = f.v GROUP BY e.id),
  last AS (SELECT id, precision, exp(0.5 * ln(rr) + 0.5 * ln(CASE WHEN m = 0 THEN 1e-5 ELSE m END)) AS recall FROM means JOIN mention USING (id))
  SELECT id, 0 AS ref, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall + 1e-8), 9) AS f1 FROM last"""


def _count(n: str, word: str) -> str:
    return f"({n} || ' {word}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


def _listed(names: str) -> str:
    return f"CASE WHEN len({names}) <= 1 THEN array_to_string({names}, '') ELSE array_to_string({names}[:-2], ', ') || ' and ' || {names}[-1] END"


def _leading(stat: str) -> str:
    """A CTE of the players of a scope at the maximum of a statistic, in order of their names."""
    return f"top_{stat} AS (SELECT ex_id, scope, list(player ORDER BY player) AS names, list(player || ' (' || fgm || '-of-' || fga || ' shooting)' ORDER BY player) AS shown, any_value(fgm || '-of-' || fga) AS shot, any_value({stat}) AS v FROM (SELECT *, max({stat}) OVER (PARTITION BY ex_id, scope) AS m FROM own) WHERE {stat} = m GROUP BY ALL)"


def _other(stat: str, label: str, word: str) -> str:
    return f"team || ' {label}: ' || {_listed(f'{stat}.names')} || ' with ' || {_count(f'{stat}.v', word)} || CASE WHEN len({stat}.names) > 1 THEN ' each' ELSE '' END || '.'"


_BOX = f"""own AS (SELECT p.*, lower(p.city) AS scope FROM players p SEMI JOIN facts f ON p.ex_id = f.ex_id),
{_leading('pts')}, {_leading('reb')}, {_leading('ast')},
sides AS (SELECT DISTINCT ex_id, side, team, scope FROM own),
leaders AS (SELECT ex_id, string_agg(team || ' top scorer: ' || CASE WHEN len(pts.names) = 1 THEN pts.names[1] || ' with ' || {_count('pts.v', 'point')} || ' on ' || pts.shot || ' shooting' ELSE {_listed('pts.shown')} || ' with ' || {_count('pts.v', 'point')} || ' each' END || '.'
  || chr(10) || {_other('reb', 'top rebounder', 'rebound')} || chr(10) || {_other('ast', 'top assists', 'assist')}, chr(10) ORDER BY side) AS t
  FROM sides s JOIN top_pts pts USING (ex_id, scope) JOIN top_reb reb USING (ex_id, scope) JOIN top_ast ast USING (ex_id, scope) GROUP BY ex_id),
notables AS (SELECT ex_id, string_agg(player || ' had ' || {_listed('said')} || badge || '.', chr(10) ORDER BY pts DESC, player) AS t FROM (
  SELECT *, list_filter([{_count('pts', 'point')}, {_count('reb', 'rebound')}, {_count('ast', 'assist')}, CASE WHEN stl >= 10 THEN {_count('stl', 'steal')} END, CASE WHEN blk >= 10 THEN {_count('blk', 'block')} END], lambda x: x IS NOT NULL) AS said,
    CASE (pts >= 10)::INT + (reb >= 10)::INT + (ast >= 10)::INT + (stl >= 10)::INT + (blk >= 10)::INT WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN ', a double-double' ELSE ', a triple-double' END AS badge FROM own WHERE pts >= 20 OR reb >= 10 OR ast >= 10) GROUP BY ex_id),
more AS (SELECT ex_id, string_agg(line, chr(10) ORDER BY side) AS t FROM (SELECT ex_id, side, team || ': ' || string_agg(player || ' ' || {_count('pts', 'point')}, '; ' ORDER BY pts DESC, player) || '.' AS line
  FROM (SELECT * FROM (SELECT *, max(pts) OVER (PARTITION BY ex_id, scope) AS m FROM own) WHERE pts < m QUALIFY row_number() OVER (PARTITION BY ex_id, side ORDER BY pts DESC, player) <= 2) GROUP BY ex_id, side, team) GROUP BY ex_id),
totals AS (SELECT ex_id, string_agg('The ' || team || ' are now ' || wins || '-' || losses || '.', chr(10) ORDER BY side) AS record, string_agg(team || ' -- points: ' || pts || '; rebounds: ' || reb || '; assists: ' || ast, chr(10) ORDER BY side) AS t FROM (SELECT t.* FROM teams t SEMI JOIN facts f ON t.ex_id = f.ex_id) GROUP BY ex_id)"""
SQL["factsheets"] = f"""WITH {CELLS}, {_BOX},
sheets AS (SELECT f.ex_id, CASE WHEN tie THEN 'The ' || team0 || ' and the ' || team1 || ' finished tied at ' || pts0 || ' points apiece.' ELSE 'The ' || winner || ' defeated the ' || loser || ' ' || greatest(pts0, pts1) || ' to ' || least(pts0, pts1) || ' (margin ' || margin || ').' END
  || chr(10) || record || chr(10) || chr(10) || 'Team totals:' || chr(10) || totals.t || coalesce(chr(10) || chr(10) || 'Team leaders:' || chr(10) || leaders.t, '')
  || coalesce(chr(10) || chr(10) || 'Notable performances:' || chr(10) || notables.t, '') || coalesce(chr(10) || chr(10) || 'Other scorers:' || chr(10) || more.t, '') AS text
  FROM facts f JOIN totals USING (ex_id) LEFT JOIN leaders USING (ex_id) LEFT JOIN notables USING (ex_id) LEFT JOIN more USING (ex_id)),
plain AS (SELECT c.* FROM full_cells c ANTI JOIN facts f ON c.ex_id = f.ex_id),
bodies AS (SELECT ex_id, sec_idx, sec_name, string_agg(line, chr(10) ORDER BY k) AS t FROM (SELECT ex_id, sec_idx, sec_name, col_idx AS k, col_name || ': ' || text AS line FROM plain WHERE n_sec_rows = 1
  UNION ALL SELECT ex_id, sec_idx, sec_name, row_idx, entity || ' -- ' || string_agg(col_name || ': ' || text, '; ' ORDER BY col_idx) FILTER (NOT is_key) FROM plain WHERE n_sec_rows > 1 GROUP BY ex_id, sec_idx, sec_name, row_idx, entity) GROUP BY ex_id, sec_idx, sec_name)
SELECT ex_id, text FROM sheets UNION ALL SELECT ex_id, string_agg(CASE WHEN n > 1 THEN sec_name || ':' || chr(10) ELSE '' END || t, chr(10) ORDER BY sec_idx) FROM (SELECT *, count(*) OVER (PARTITION BY ex_id) AS n FROM bodies) GROUP BY ex_id"""

_PLAYER_COLUMNS = ["PLAYER_NAME", "TEAM_CITY", "PTS", "FGM", "FGA", "REB", "AST", "STL", "BLK"]
_TEAM_COLUMNS = ["TEAM", "TEAM-AST", "TEAM-LOSSES", "TEAM-PTS", "TEAM-REB", "TEAM-WINS"]
_CELL = "ex_id, sec_idx, sec_name, row_idx::INT AS row_idx, col_idx::INT AS col_idx, col_name, is_key, max(CASE WHEN is_key THEN text END) OVER (PARTITION BY ex_id, sec_idx, row_idx) AS entity, CASE WHEN text IS NULL THEN 0 WHEN is_text THEN 2 ELSE 1 END AS kind, CASE WHEN NOT is_text THEN text::DOUBLE END AS num, text, (max(row_idx) OVER (PARTITION BY ex_id, sec_idx) + 1)::INT AS n_sec_rows"
SQL["box_score_cells"] = f"""WITH {GAMES}, p AS (SELECT ex_id, row_number() OVER (PARTITION BY ex_id ORDER BY s_suppkey) - 1 AS row_idx, max(blk) OVER (PARTITION BY ex_id) AS blocks,
    [player, city, pts::VARCHAR, fgm::VARCHAR, fga::VARCHAR, reb::VARCHAR, ast::VARCHAR, stl::VARCHAR, CASE WHEN blk > 0 THEN blk::VARCHAR END] AS v FROM players SEMI JOIN facts USING (ex_id)),
  t AS (SELECT ex_id, row_idx, [team, ast::VARCHAR, losses::VARCHAR, pts::VARCHAR, reb::VARCHAR, wins::VARCHAR] AS v FROM teams SEMI JOIN facts USING (ex_id)),
  c AS (SELECT ex_id, 1 AS sec_idx, 'players' AS sec_name, row_idx, i AS col_idx, {_PLAYER_COLUMNS}[i + 1] AS col_name, i = 0 AS is_key, i < 2 AS is_text, v[i + 1] AS text, blocks FROM (SELECT *, unnest(range(9)) AS i FROM p)
    UNION ALL SELECT ex_id, 0, 'teams', row_idx, i, {_TEAM_COLUMNS}[i + 1], i = 0, i = 0, v[i + 1], 1 FROM (SELECT *, unnest(range(6)) AS i FROM t))
  SELECT {_CELL} FROM c WHERE col_name <> 'BLK' OR blocks > 0"""
SQL["meaning_cells"] = f"""WITH c AS (SELECT 'part-' || p_partkey AS ex_id, 0 AS sec_idx, 'restaurant' AS sec_name, 0 AS row_idx, i AS col_idx, ['name', 'brand name', 'size'][i + 1] AS col_name, i = 0 AS is_key, i < 2 AS is_text, [p_name, p_brand, p_size::VARCHAR][i + 1] AS text FROM part, (SELECT unnest(range(3)) AS i))
  SELECT {_CELL} FROM c"""
SQL["box_score_files"] = f"""WITH cells AS ({SQL["box_score_cells"]}), ids AS (SELECT ex_id, 'rotowire-test-' || printf('%04d', row_number() OVER (ORDER BY ex_id) - 1) AS id FROM (SELECT DISTINCT ex_id FROM cells))
  SELECT id AS ex_id, c.* EXCLUDE (ex_id), 'A "game" of }} ' || c.ex_id || ' \\ .' AS reference FROM cells c JOIN ids i ON c.ex_id = i.ex_id"""
SQL["meaning_files"] = """WITH m AS (SELECT p_partkey, regexp_replace(p_name, ' .*', '') || '|' || p_brand AS attributes, CASE WHEN p_partkey % 4 > 0 THEN 'It is "' || p_type || '",' || chr(10) || 'size ' || p_size || '.' END AS said FROM part),
  g AS (SELECT attributes, min(p_partkey) AS first, count(said) AS n_references, coalesce(string_agg(said, '|' ORDER BY p_partkey), '') AS said FROM m GROUP BY attributes), o AS (SELECT *, (row_number() OVER (ORDER BY first) - 1)::INT AS pos FROM g)
  SELECT 'e2e-dev-' || printf('%04d', pos) AS id, pos, attributes, n_references, said FROM o"""
SQL["cell_kinds"] = """WITH r AS (SELECT event_id, event_id::VARCHAR AS n, event_type FROM events),
  v AS (SELECT event_id, unnest([{'pos': 0, 'num': n::DOUBLE, 'i': true, 't': n}, {'pos': 1, 'num': -(n::DOUBLE), 'i': true, 't': (-event_id)::VARCHAR}, {'pos': 2, 'num': ('10' || n)::DOUBLE, 'i': true, 't': '10' || n}, {'pos': 3, 'num': NULL, 'i': false, 't': NULL},
    {'pos': 4, 'num': (n || '.5')::DOUBLE, 'i': false, 't': n || '.5'}, {'pos': 5, 'num': NULL, 'i': false, 't': NULL}, {'pos': 6, 'num': ('.' || n || 'e2')::DOUBLE, 'i': false, 't': ('.' || n || 'e2')::DOUBLE::VARCHAR}, {'pos': 7, 'num': NULL, 'i': false, 't': NULL},
    {'pos': 8, 'num': NULL, 'i': false, 't': NULL}, {'pos': 9, 'num': ('9000000000000000000' || n)::DOUBLE, 'i': true, 't': '9000000000000000000' || n}], recursive := true) FROM r)
  SELECT event_id, pos::INT AS pos, CASE WHEN pos = 8 THEN 0 WHEN num IS NULL THEN 2 ELSE 1 END AS kind, num, i AS is_int, t AS text FROM v"""
SQL["report_panels"] = f"""WITH {_DRAWS} SELECT 'num_unsupported' AS metric, 'Unsupported numbers' AS label, p.run, round(any_value(100 * p.value), 6) AS point, round(100 * quantile_cont(d.value, 0.025), 6) AS lo, round(100 * quantile_cont(d.value, 0.975), 6) AS hi, false AS higher_better
  FROM pts p JOIN draws d USING (run, metric) WHERE metric = 'num_unsupported' GROUP BY p.run"""

SQL["relations_item"] = f"WITH {CLAIMS} SELECT t.id, count(c.id) AS n_claims, count(*) FILTER (NOT correct) AS n_wrong FROM texts t LEFT JOIN claims c ON t.id = c.id GROUP BY t.id"


def _item_metrics(numbers: str) -> str:
    return f"""WITH {numbers}{CLAIMS.removeprefix(TEXTS)}, {_bleu_items('output', 'reference')}, rel AS (SELECT t.id, count(c.id) AS n, count(*) FILTER (NOT correct) AS w FROM texts t LEFT JOIN claims c ON t.id = c.id GROUP BY t.id)
  SELECT i.id, n_numbers AS num_n_numbers, n_unsupported AS num_n_unsupported, rel.n AS rel_n_claims, rel.w AS rel_n_wrong, bleu.* EXCLUDE (id) FROM items i JOIN rel USING (id) JOIN bleu USING (id)"""


# Of the queries that count derived numbers, this one takes columns of any length.
SQL["item_metrics"] = _item_metrics(NUMBERS.replace("HAVING count(*) BETWEEN 2 AND 40", "HAVING count(*) >= 2"))
SQL["positional_counts"] = f"""WITH {CLAIMS}, bad AS (SELECT id, list(claimed) AS named FROM claims WHERE type = 'winner' AND NOT correct GROUP BY id),
  g AS (SELECT t.id, winner = team0 AS first_won, named IS NOT NULL AS err, len(list_filter(named, lambda x: contains(x, team0) AND NOT contains(x, team1))) AS f, len(list_filter(named, lambda x: contains(x, team1) AND NOT contains(x, team0))) AS s
    FROM texts t JOIN facts ON t.id = ex_id LEFT JOIN bad ON bad.id = t.id WHERE NOT tie),
  c AS (SELECT count(*) FILTER (first_won) AS n_first, count(*) FILTER (NOT first_won) AS n_second, count(*) FILTER (first_won AND err) AS err_first, count(*) FILTER (NOT first_won AND err) AS err_second, coalesce(sum(f), 0)::BIGINT AS named_first, coalesce(sum(s), 0)::BIGINT AS named_second FROM g),
  numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS item FROM g), w AS ({counted('(SELECT count(*) FROM g)')}),
  d AS (SELECT sum(w * err::INT) FILTER (first_won) / sum(w) FILTER (first_won) - sum(w * err::INT) FILTER (NOT first_won) / sum(w) FILTER (NOT first_won) AS d FROM numbered JOIN w USING (item) GROUP BY b),
  s AS (SELECT list_sort(list(d)) AS s FROM d WHERE d IS NOT NULL)
  SELECT c.*, round(err_first / n_first, 9) AS rate_first, round(err_second / n_second, 9) AS rate_second, round(err_first / n_first - err_second / n_second, 9) AS diff,
    round(s[floor(0.025 * len(s))::INT + 1], 9) AS lo, round(s[floor(0.975 * len(s))::INT + 1], 9) AS hi FROM c, s"""
SQL["matched_outputs"] = f"WITH {TEXTS} SELECT id, length(output)::INT AS n_chars, (SELECT count(*) FROM texts WHERE yr % 2 = 0 AND pair >= 6) AS missing FROM texts WHERE yr % 2 = 0 AND pair < 6"
SQL["uncertainty_run"] = "SELECT round(avg(embedding[1]::DOUBLE), 6) AS mean_seq_logprob, count(*) AS n_with_logprob FROM embeddings WHERE vec_id % 5 > 0"
SQL["shown_values"] = "SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN format('{:.1f}%', 100 * p_size / 64) ELSE '–' END AS rate, CASE WHEN p_partkey % 7 > 0 THEN format('{:.3f}', p_size / 64) ELSE '–' END AS mean FROM part"
SQL["id_splits"] = """WITH r AS (SELECT vec_id, list_transform(range(41), lambda i: (i * (vec_id % 7 + 1)) % 11) AS ids FROM embeddings), p AS (SELECT *, ids[vec_id % 9 + 3:vec_id % 9 + 4] AS part FROM r),
  f AS (SELECT vec_id, ids, list_min(list_filter(range(40), lambda i: ids[i + 1:i + 2] = part)) AS spot FROM p)
  SELECT vec_id, spot::INT AS "at", spot::INT AS n_before, (39 - spot)::INT AS n_after, array_to_string(ids[spot + 3:], ',') AS after FROM f"""
SQL["collated_rows"] = """WITH r AS (SELECT vec_id, vec_id // 10 AS batch, list_transform(range(1, vec_id % 4 + 2), lambda i: i + 100) AS p, list_transform(range(1, vec_id % 3 + 2), lambda i: i + 200) AS s, list_transform(range(1, vec_id % 6 + 2), lambda i: i + 300) AS r, list_transform(range(1, vec_id % 5 + 2), lambda i: i + 400) AS t FROM embeddings),
  j AS (SELECT *, p || [0, 0, 0] || t || s || r AS ids, len(p) + 3 + len(t) + len(s) AS given FROM r), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS pad FROM j)
  SELECT vec_id, array_to_string(ids || list_transform(range(pad), lambda i: 0), ',') AS input_ids, array_to_string(list_transform(range(given), lambda i: -100) || r || list_transform(range(pad), lambda i: -100), ',') AS labels,
    array_to_string(list_transform(range(len(ids)), lambda i: 1) || list_transform(range(pad), lambda i: 0), ',') AS attention, array_to_string([len(p), len(p) + 1, len(p) + 2], ',') AS soft_pos FROM w"""
SQL["json_props"] = """SELECT event_id, (props->>'$.k')::BIGINT AS k, '{"type":"' || event_type || '","inner":{"n":' || (props->>'$.k') || '}}' AS record FROM events"""

_LOW = SQL["align_labels"].index("low AS (")
_LOW_END = SQL["align_labels"].index("FROM texts)", _LOW) + len("FROM texts)")
_KEPT_LABELS = SQL["align_labels"][:_LOW] + f"low AS (SELECT ex_id AS id, lower(reference) AS t, list_transform({_numbers('reference')}, lambda v: round(v, 6)) AS ns FROM kept_refs)" + SQL["align_labels"][_LOW_END:]
SQL["training_rows"] = f"""WITH kept_refs AS (SELECT * FROM ({SQL['filter_reference']}) WHERE reference <> ''), labels AS (SELECT ex_id, count(*)::INT AS n_cells, count(*) FILTER (label)::BIGINT AS n_mentioned FROM ({_KEPT_LABELS}) GROUP BY ex_id),
  md AS (SELECT ex_id, len({_tokens('text')})::INT AS n_table_ids FROM ({ORACLE_SQL['md_serialise_game']})),
  ids AS (SELECT ex_id, list_transform({_tokens('reference')}, lambda t: (length(t) + 10)::BIGINT) AS ids FROM kept_refs), cut AS (SELECT ex_id, CASE WHEN len(ids) > 30 THEN ids[:30] ELSE ids || [2] END AS ids FROM ids),
  r AS (SELECT ex_id, 0 AS ref, len(ids)::INT AS n_ref_ids, list_sum(ids)::BIGINT AS ref_sum, n_table_ids, n_cells, n_mentioned FROM cut JOIN labels USING (ex_id) JOIN md USING (ex_id)),
  p AS (SELECT *, (row_number() OVER (ORDER BY ex_id) - 1) // 1024 AS block FROM r)
  SELECT *, (coalesce(sum(3 + n_ref_ids + n_table_ids) OVER (PARTITION BY block ORDER BY ex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000)::BIGINT AS batch FROM p"""

_TEXTS_B = TEXTS.replace("texts AS (", "texts_a AS (") + ", texts AS (SELECT * REPLACE (CASE WHEN pair % 2 = 1 THEN reference ELSE output END AS output) FROM texts_a)"
_ITEMS = f"""SELECT * FROM ({_item_metrics(NUMBERS)}) i JOIN (SELECT id, f1 AS parent_f1 FROM ({SQL['parent_items']})) USING (id) JOIN (WITH {TEXTS} SELECT id, -(length(output) % 97) / 97 AS seq_logprob FROM texts) USING (id)"""


def _catalogue(frm: str, keys: str, w: str = "1") -> str:
    m, t = ([f"sum({w} * bleu_{c}_{n})" for n in range(1, 5)] for c in ("match", "total"))
    h, r = f"sum({w} * bleu_hyp_len)", f"sum({w} * bleu_ref_len)"
    logs = " + ".join(f"ln({a} / {b})" for a, b in zip(m, t, strict=True))
    bleu = f"CASE WHEN {' OR '.join(f'{a} = 0' for a in m)} THEN 0 ELSE 100 * CASE WHEN {h} > {r} THEN 1 ELSE exp(1 - {r} / {h}) END * exp(({logs}) / 4) END"
    values = [f"sum({w} * rel_n_wrong) / sum({w} * rel_n_claims)", f"sum({w} * (rel_n_wrong > 0)::INT) / sum({w})", f"sum({w} * num_n_unsupported) / sum({w} * num_n_numbers)", f"sum({w} * parent_f1) / sum({w})", bleu, f"sum({w} * seq_logprob) / sum({w})"]
    return f"SELECT {keys}, unnest(['rel_wrong', 'rel_items', 'num_unsupported', 'parent', 'bleu', 'seq_logprob']) AS metric, unnest([{', '.join(values)}]) AS value FROM {frm} GROUP BY {keys}"


SQL["report_catalogue"] = f"""WITH items AS (SELECT *, dense_rank() OVER (ORDER BY id) - 1 AS item FROM (SELECT 'A' AS run, * FROM ({_ITEMS}) UNION ALL SELECT 'B', * FROM ({_ITEMS.replace(TEXTS, _TEXTS_B)}))),
  w AS ({counted('(SELECT max(item) + 1 FROM items)')}), draws AS ({_catalogue('items JOIN w USING (item)', 'run, b', 'w')}), pts AS ({_catalogue('items', 'run')}),
  info(metric, label, higher_better, scale) AS (VALUES ('rel_wrong', 'Wrong relational claims', false, 100), ('rel_items', 'Items with relational error', false, 100), ('num_unsupported', 'Unsupported numbers', false, 100), ('parent', 'PARENT F1', true, 1), ('bleu', 'BLEU', true, 1), ('seq_logprob', 'Seq-logprob', true, 1))
  SELECT metric, label, run, round(any_value(p.value) * any_value(scale), 6) AS point, round(quantile_cont(d.value, 0.025) * any_value(scale), 6) AS lo, round(quantile_cont(d.value, 0.975) * any_value(scale), 6) AS hi, higher_better
  FROM pts p JOIN draws d USING (run, metric) JOIN info USING (metric) GROUP BY metric, label, run, higher_better"""
SQL["fold_rank_permuted"] = permuted(ORACLE_SQL["fold_rank"])
_ATTR = f"array_to_string({_tokens("CASE WHEN n_sec_rows = 1 THEN col_name ELSE entity || ' ' || col_name END")}, '_')"
SQL["cooccurrence_entailment"] = f"""WITH {TEXTS},
  held AS (SELECT DISTINCT ex_id AS id, unnest(list_append({_tokens('text')}, {_ATTR})) AS b FROM full_cells WHERE text IS NOT NULL),
  words AS (SELECT DISTINCT id, unnest({_tokens('reference')}) AS x FROM texts), alone AS (SELECT b, count(*) AS n FROM held GROUP BY b),
  ratios AS (SELECT b, x, any_value(p.n) / any_value(a.n) AS p FROM (SELECT b, x, count(*) AS n FROM held JOIN words USING (id) GROUP BY ALL) p JOIN alone a USING (b) GROUP BY b, x),
  toks AS (SELECT id, {_tokens('output')} AS t FROM texts), grams AS (SELECT DISTINCT id, t[i] AS x, t[i + 1] AS y FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM toks)),
  best AS (SELECT id, x, max(p) AS p FROM held JOIN ratios USING (b) GROUP BY ALL), said AS (SELECT DISTINCT id, unnest(t) AS x FROM toks),
  p AS (SELECT s.id, s.x, CASE WHEN h.b IS NOT NULL THEN 1 ELSE coalesce(p, 0) END AS p FROM said s LEFT JOIN held h ON s.id = h.id AND s.x = h.b LEFT JOIN best b ON s.id = b.id AND s.x = b.x)
  SELECT id, count(*) AS n_grams, round(avg(sqrt(a.p * z.p)), 6) AS mean_probability, count(*) FILTER (sqrt(a.p * z.p) >= 0.999999) AS n_certain FROM grams g JOIN p a USING (id, x) JOIN p z ON g.id = z.id AND g.y = z.x GROUP BY id"""

# Each sentence is split into its words again, and what it says is looked up.
SQL["turned_claims"] = f"""WITH {TEXTS}, turned AS (SELECT p.ex_id AS id, 'The ' || CASE WHEN e = 0 THEN w ELSE l END || ' were defeated by the ' || CASE WHEN e = 0 THEN l ELSE w END || '.' AS s0, 'The ' || CASE WHEN e = 1 THEN w ELSE l END || ' lost to the ' || CASE WHEN e = 1 THEN l ELSE w END || ' at home.' AS s1,
    top0 || ' had ' || (tp0 + (e = 2)::INT) || ' points and ' || top1 || ' grabbed ' || tr1 || ' rebounds.' AS s2 FROM parts p),
  won AS (SELECT id, 0 AS pos, s0 AS sentence, regexp_extract(s0, ' were defeated by the (.+)\\.$', 1) AS claimed FROM turned UNION ALL SELECT id, 1, s1, regexp_extract(s1, ' lost to the (.+) at home\\.$', 1) FROM turned),
  said AS (SELECT id, regexp_extract(s2, '^(.+) had ([0-9]+) points and (.+) grabbed ([0-9]+) rebounds\\.$', ['a', 'n', 'b', 'm']) AS x FROM turned),
  each AS (SELECT id, 0 AS seg_no, x.a || ' had ' || x.n || ' points and' AS sentence, x.a AS player, x.n AS n, 'PTS' AS stat FROM said UNION ALL SELECT id, 1, x.b || ' grabbed ' || x.m || ' rebounds.', x.b, x.m, 'REB' FROM said),
  v AS (SELECT e.*, CASE stat WHEN 'PTS' THEN r.pts ELSE r.reb END AS v FROM each e JOIN players r ON r.ex_id = e.id AND r.player = e.player)
  SELECT id, pos::INT AS pos, 0 AS part, 0 AS clause_no, 0 AS seg_no, 0 AS k, 'winner' AS type, sentence, claimed, winner AS expected, claimed = winner AS correct FROM won JOIN facts ON id = ex_id WHERE NOT tie
  UNION ALL SELECT id, 2, 1, 0, seg_no, 0, 'attribution', sentence, player || ' ' || n || ' ' || stat, player || ' ' || v || ' ' || stat, n = v::VARCHAR FROM v"""
_TEXTS_2 = TEXTS.replace("texts AS (", "texts_1 AS (") + ", texts AS (SELECT * REPLACE (CASE WHEN e % 2 = 0 THEN regexp_replace(output, 'points|rebounds', 'scores', 'g') ELSE reference || ' Nothing else happened.' END AS reference) FROM texts_1)"
SQL["parent_two_references"] = f"""SELECT * FROM (SELECT * REPLACE (0 AS ref) FROM ({SQL['parent_items']}) UNION ALL SELECT * REPLACE (1 AS ref) FROM ({SQL['parent_items'].replace(TEXTS, _TEXTS_2)})) QUALIFY row_number() OVER (PARTITION BY id ORDER BY f1 DESC, ref) = 1"""
