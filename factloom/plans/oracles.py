"""DuckDB SQL of the catalog's queries, over the driver tables."""

from __future__ import annotations

import math

_LETTERS = "translate(({})::VARCHAR, '0123456789', 'abcdefghij')"

GAMES = f"""
home AS (SELECT n_nationkey AS nation, n_nationkey // 2 AS pair, n_nationkey % 2 AS side, r_name AS city, 'N' || {_LETTERS.format('n_nationkey')} AS nick
  FROM nation JOIN region ON n_regionkey = r_regionkey),
stats AS (SELECT l_suppkey, year(o_orderdate) AS yr, count(*) FILTER (l_returnflag = 'R') AS pts, count(DISTINCT l_orderkey) FILTER (l_linenumber = 1) AS reb,
  count(*) FILTER (l_discount >= 0.09) AS ast, count(*) FILTER (l_tax >= 0.08) AS stl, count(*) FILTER (l_quantity >= 50) AS blk,
  count(*) FILTER (l_returnflag = 'N') AS fgm, count(*) AS fga FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
players AS (SELECT 'game-' || pair || '-' || yr AS ex_id, pair, yr, nation, side, city, nick, city || ' ' || nick AS team, s_suppkey,
  'F' || {_LETTERS.format('s_suppkey // 40')} || ' S' || {_LETTERS.format('s_suppkey % 40')} || CASE WHEN s_suppkey % 10 = 3 THEN ' Jr.' ELSE '' END AS player,
  stats.* EXCLUDE (l_suppkey, yr) FROM stats JOIN supplier ON l_suppkey = s_suppkey JOIN home ON s_nationkey = nation),
prow AS (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY side, s_suppkey) - 1 AS row_idx FROM players),
sums AS (SELECT ex_id, pair, yr, side, nation, team, nick, city, sum(pts)::BIGINT AS pts, sum(reb)::BIGINT AS reb, sum(ast)::BIGINT AS ast FROM players GROUP BY ALL),
res AS (SELECT *, count(*) OVER g AS sides, sum(pts) OVER g - pts AS other FROM sums WINDOW g AS (PARTITION BY ex_id)),
teams AS (SELECT ex_id, pair, yr, side, nation, team, nick, city, pts, reb, ast,
  sum((sides = 2 AND pts > other)::INT) OVER w ::BIGINT AS wins, sum((sides = 2 AND pts < other)::INT) OVER w ::BIGINT AS losses,
  row_number() OVER (PARTITION BY ex_id ORDER BY side) - 1 AS row_idx, sides FROM res WINDOW w AS (PARTITION BY nation ORDER BY yr ROWS UNBOUNDED PRECEDING)),
facts AS (SELECT a.ex_id, a.team AS team0, b.team AS team1, a.nick AS nick0, b.nick AS nick1, a.city AS city0, b.city AS city1, a.pts AS pts0, b.pts AS pts1, a.pts = b.pts AS tie,
  CASE WHEN a.pts > b.pts THEN a.team WHEN b.pts > a.pts THEN b.team END AS winner, CASE WHEN a.pts > b.pts THEN b.team WHEN b.pts > a.pts THEN a.team END AS loser,
  abs(a.pts - b.pts) AS margin, a.pair, a.yr FROM teams a JOIN teams b ON a.ex_id = b.ex_id AND a.side = 0 AND b.side = 1)"""

CELLS = GAMES + """,
tcell AS (UNPIVOT (SELECT ex_id, row_idx, team AS "TEAM", pts::VARCHAR AS "TEAM-PTS", reb::VARCHAR AS "TEAM-REB", ast::VARCHAR AS "TEAM-AST", wins::VARCHAR AS "TEAM-WINS", losses::VARCHAR AS "TEAM-LOSSES" FROM teams)
  ON "TEAM", "TEAM-PTS", "TEAM-REB", "TEAM-AST", "TEAM-WINS", "TEAM-LOSSES" INTO NAME col_name VALUE text),
pcell AS (UNPIVOT (SELECT ex_id, row_idx, player AS "PLAYER_NAME", city AS "TEAM_CITY", pts::VARCHAR AS "PTS", reb::VARCHAR AS "REB", ast::VARCHAR AS "AST", stl::VARCHAR AS "STL", blk::VARCHAR AS "BLK", fgm::VARCHAR AS "FGM", fga::VARCHAR AS "FGA" FROM prow)
  ON "PLAYER_NAME", "TEAM_CITY", "PTS", "REB", "AST", "STL", "BLK", "FGM", "FGA" INTO NAME col_name VALUE text),
cells AS (SELECT ex_id, 0 AS sec_idx, 'teams' AS sec_name, row_idx, list_position(['TEAM', 'TEAM-PTS', 'TEAM-REB', 'TEAM-AST', 'TEAM-WINS', 'TEAM-LOSSES'], col_name) - 1 AS col_idx, col_name, text FROM tcell
  UNION ALL SELECT ex_id, 1, 'players', row_idx, list_position(['PLAYER_NAME', 'TEAM_CITY', 'PTS', 'REB', 'AST', 'STL', 'BLK', 'FGM', 'FGA'], col_name) - 1, col_name, text FROM pcell),
full_cells AS (SELECT *, col_idx = 0 AS is_key, max(CASE WHEN col_idx = 0 THEN text END) OVER (PARTITION BY ex_id, sec_idx, row_idx) AS entity,
  CASE WHEN col_idx = 0 OR col_name = 'TEAM_CITY' THEN 2 ELSE 1 END AS kind, CASE WHEN NOT (col_idx = 0 OR col_name = 'TEAM_CITY') THEN text::DOUBLE END AS num,
  max(row_idx) OVER (PARTITION BY ex_id, sec_idx) + 1 AS n_sec_rows FROM cells)"""


def _text(err: str) -> str:
    return f"""'The ' || CASE WHEN {err} = 0 THEN l ELSE w END || ' defeated the ' || CASE WHEN {err} = 0 THEN w ELSE l END || ' ' || high || ' to ' || low || '. '
  || top0 || ' led the ' || nick0 || ' with ' || (tp0 + ({err} = 1)::INT) || ' points. It was a ' || (high - low + ({err} = 2)::INT) || '-point victory for the ' || wn || '. The '
  || CASE WHEN {err} = 3 THEN nick0 ELSE nick1 END || ''' ' || top1 || ' added ' || tr1 || ' rebounds.'"""


TEXTS = CELLS + f""",
top AS (SELECT ex_id, side, player, pts, reb FROM players QUALIFY row_number() OVER (PARTITION BY ex_id, side ORDER BY pts DESC, player) = 1),
parts AS (SELECT f.*, (f.pair * 31 + f.yr) % 4 AS e, CASE WHEN pts0 >= pts1 THEN team0 ELSE team1 END AS w, CASE WHEN pts0 >= pts1 THEN team1 ELSE team0 END AS l,
  CASE WHEN pts0 >= pts1 THEN nick0 ELSE nick1 END AS wn, greatest(pts0, pts1) AS high, least(pts0, pts1) AS low, a.player AS top0, a.pts AS tp0, b.player AS top1, b.reb AS tr1
  FROM facts f JOIN top a ON f.ex_id = a.ex_id AND a.side = 0 JOIN top b ON f.ex_id = b.ex_id AND b.side = 1),
texts AS (SELECT ex_id AS id, pair, yr, e, {_text('e')} AS output, {_text('9')} AS reference FROM parts)"""

_NUM = r"\d{1,3}(?:,\d{3})+|\d+\.\d+|\.\d+|\d+"
_TOKEN = r"[\pL\pN_]+|[^\pL\pN_\s\x1c-\x1f\x{85}\pZ]"
_BLANKS = "' ' || chr(10) || chr(9) || chr(13)"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{_NUM}'), lambda m: replace(m, ',', '')::DOUBLE)"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{_TOKEN}')"


def _sentences(x: str) -> str:
    cut = rf"""regexp_replace(trim({x}, {_BLANKS}), '([.!?])\s+([A-Z0-9"''])', '\1' || chr(31) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(31)), lambda s: trim(s, {_BLANKS})), lambda s: s <> '')"


NUMBERS = TEXTS + f""",
tn AS (SELECT DISTINCT ex_id, round(v, 6) AS v FROM (SELECT ex_id, unnest(CASE WHEN kind = 1 THEN [num] ELSE {_numbers('text')} END) AS v FROM full_cells)),
exact AS (SELECT ex_id, v FROM tn UNION SELECT ex_id, round(v / 100, 6) FROM tn),
wide AS (SELECT ex_id, sec_idx, col_idx FROM full_cells WHERE kind = 1 GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40),
pairs AS (SELECT a.ex_id, a.num AS x, b.num AS y FROM full_cells a JOIN full_cells b USING (ex_id, sec_idx, col_idx) JOIN wide USING (ex_id, sec_idx, col_idx) WHERE a.kind = 1 AND b.kind = 1 AND a.row_idx < b.row_idx),
derived AS (SELECT ex_id, round(x + y, 6) AS v FROM pairs UNION SELECT ex_id, round(abs(x - y), 6) FROM pairs),
found AS (SELECT id, unnest({_numbers('output')}) AS v FROM texts),
tiers AS (SELECT f.id, f.v, CASE WHEN e.v IS NOT NULL THEN 1 WHEN d.v IS NOT NULL THEN 2 ELSE 0 END AS tier
  FROM found f LEFT JOIN exact e ON f.id = e.ex_id AND round(f.v, 6) = e.v LEFT JOIN derived d ON f.id = d.ex_id AND round(f.v, 6) = d.v),
items AS (SELECT t.id, count(v) AS n_numbers, count(*) FILTER (tier = 1) AS n_exact, count(*) FILTER (tier = 2) AS n_derived, count(*) FILTER (tier = 0) AS n_unsupported
  FROM texts t LEFT JOIN tiers USING (id) GROUP BY t.id)"""

WINNER = TEXTS + """,
said AS (SELECT p.ex_id AS id, tie, winner, CASE WHEN e = 0 THEN l ELSE w END AS claimed, margin, margin + (e = 2)::INT AS said_margin, wn FROM parts p)"""

_PRICE = "p_retailprice"
ORACLE_SQL: dict[str, str] = {
    "cells_melt": f"WITH {CELLS} SELECT ex_id, sec_idx, sec_name, row_idx::INT AS row_idx, col_idx::INT AS col_idx, col_name, is_key, entity, kind, num, text, n_sec_rows::INT AS n_sec_rows FROM full_cells",
    "doc_numbers": f"SELECT doc_id, i::INT AS pos, ns[i] AS number FROM (SELECT doc_id, ns, unnest(range(1, len(ns) + 1)) AS i FROM (SELECT doc_id, {_numbers('text')} AS ns FROM documents))",
    "doc_sentences": f"SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS n_chars FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)",
    "doc_tokens_top": f"SELECT lang, token, n FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) <= 20",
    "claim_units": rf"""SELECT doc_id, count(*)::BIGINT AS n_units, sum(length(u))::BIGINT AS n_chars FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(regexp_replace(s, ';\s+|,\s+while\s+', chr(31), 'g'), ',\s+and\s+([A-Z])', chr(31) || '\1', 'g'), chr(31))), ' ,') AS u FROM (SELECT doc_id, unnest({_sentences('text')}) AS s FROM documents))
      WHERE u <> '' AND len(regexp_extract_all(u, '[A-Za-z]{{2,}}')) >= 3 GROUP BY doc_id""",
    "claim_rows_sql": rf"""WITH s AS (SELECT doc_id, i, s[i] AS s FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents))),
      p AS (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(s, ';\s+|,\s+while\s+', chr(31), 'g'), ',\s+and\s+([A-Z])', chr(31) || '\1', 'g'), chr(31)) AS u FROM s),
      e AS (SELECT doc_id, i, k, trim(u[k], ' ,') AS u FROM (SELECT doc_id, i, u, unnest(range(1, len(u) + 1)) AS k FROM p))
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS pos, length(u)::INT AS n_chars, md5(u) AS digest FROM e WHERE u <> '' AND len(regexp_extract_all(u, '[A-Za-z]{{2,}}')) >= 3""",
    "game_team_facts": f"WITH {GAMES} SELECT ex_id, team0, team1, pts0::DOUBLE AS pts0, pts1::DOUBLE AS pts1, tie, winner, loser, margin::DOUBLE AS margin FROM facts",
    "game_leaders": f"""WITH {GAMES}, s AS (SELECT ex_id, player, lower(city) AS city, unnest([{{'stat': 'PTS', 'v': pts}}, {{'stat': 'REB', 'v': reb}}, {{'stat': 'AST', 'v': ast}}], recursive := true) FROM players),
      scoped AS (SELECT ex_id, player, city AS scope, stat, v FROM s UNION ALL SELECT ex_id, player, '*', stat, v FROM s)
      SELECT ex_id, scope, stat, max(v)::DOUBLE AS best, string_agg(player, ',' ORDER BY player) AS players FROM (SELECT *, max(v) OVER (PARTITION BY ex_id, scope, stat) AS m FROM scoped) WHERE v = m GROUP BY ex_id, scope, stat""",
    "game_topk_scorers": f"""WITH {GAMES}, m AS (SELECT *, max(pts) OVER (PARTITION BY ex_id, city) AS best, count(DISTINCT side) OVER (PARTITION BY ex_id) AS sides FROM players)
      SELECT ex_id, city, player, pts::DOUBLE AS pts, row_number() OVER (PARTITION BY ex_id, city ORDER BY pts DESC, player)::INT AS rank FROM m WHERE pts < best QUALIFY rank <= 2""",
    "surname_alias": f"""WITH {GAMES}, n AS (SELECT ex_id, player, lower('S' || translate((s_suppkey % 40)::VARCHAR, '0123456789', 'abcdefghij')) AS surname FROM players), c AS (SELECT *, count(*) OVER (PARTITION BY ex_id, surname) AS k FROM n)
      SELECT ex_id, lower(player) AS alias, player FROM n UNION ALL SELECT ex_id, surname, player FROM c WHERE k = 1""",
    "derived_numbers": f"WITH {NUMBERS} SELECT ex_id, v AS value FROM derived",
    "number_support_item": f"WITH {NUMBERS} SELECT id, n_numbers, n_exact, n_derived, n_exact + n_derived AS n_supported, n_unsupported, round((n_exact + n_derived) / nullif(n_numbers, 0), 9) AS support_rate, round(n_exact / nullif(n_numbers, 0), 9) AS exact_rate FROM items",
    "number_support_run": f"""WITH {NUMBERS} SELECT count(*) AS items, count(*) FILTER (n_numbers > 0) AS items_with_numbers, round(sum(n_exact + n_derived) / sum(n_numbers), 9) AS number_support_rate_micro,
      round(sum(n_exact) / sum(n_numbers), 9) AS number_exact_rate_micro, round(count(*) FILTER (n_unsupported > 0) / count(*), 9) AS pct_items_with_unsupported_number FROM items""",
    "part_number_support": f"""SELECT count(*) AS items, count(*) FILTER (n = 0 OR u = 0) AS fully_supported, sum(u)::BIGINT AS n_unsupported FROM (
      SELECT p_partkey, count(*) AS n, count(*) FILTER (NOT list_contains(allowed, v) AND NOT list_contains(list_transform(allowed, lambda a: round(a / 100, 6)), v)) AS u FROM (
        SELECT p_partkey, unnest({_numbers("'The ' || p_name || ' by ' || p_brand || ' is of size ' || (p_size + (p_partkey % 5 = 0)::INT) || '.'")}) AS v,
          list_transform(list_concat(list_concat({_numbers('p_name')}, {_numbers('p_brand')}), list_concat({_numbers('p_type')}, [p_size::DOUBLE, p_retailprice])), lambda x: round(x, 6)) AS allowed FROM part) GROUP BY p_partkey)""",
    "winner_claims": f"WITH {WINNER} SELECT id, claimed, winner AS expected, claimed = winner AS correct FROM said WHERE NOT tie",
    "game_texts": f"WITH {TEXTS} SELECT id, e::INT AS e, output, reference FROM texts",
    "premise_rows": f"""WITH {CELLS}, f AS (SELECT ex_id, sec_idx, sec_name, row_idx, entity, n_sec_rows, string_agg(col_name || ': ' || text, '; ' ORDER BY col_idx) FILTER (NOT is_key) AS facts FROM full_cells GROUP BY ALL)
      SELECT ex_id, sec_idx, row_idx::INT AS row_idx, sec_name || ' ' || entity || ' -- ' || facts AS fact FROM f""",
    "result_facts": f"WITH {GAMES} SELECT ex_id, 'The ' || winner || ' defeated the ' || loser || ' ' || greatest(pts0, pts1) || ' to ' || least(pts0, pts1) || ' ; the ' || winner || ' won the game and the ' || loser || ' lost the game' AS fact FROM facts WHERE NOT tie",
    "md_serialise_part": """SELECT 'part-' || p_partkey AS ex_id, '### part' || chr(10) || '| attribute | value |' || chr(10) || '| --- | --- |' || chr(10) || '| name | ' || replace(p_name, '|', '\\|') || ' |' || chr(10) || '| brand | ' || p_brand || ' |' || chr(10)
      || '| type | ' || p_type || ' |' || chr(10) || '| size | ' || p_size || ' |' || chr(10) || '| price | ' || p_retailprice || ' |' AS text FROM part""",
    "bleu_item_counts": "",
}


def _bleu_items(hyp: str, ref: str) -> str:
    """CTEs items(id, bleu_*) for one reference per item; hyp and ref: columns of texts."""
    grams = lambda c: f"SELECT id, n, array_to_string(t[i:i + n - 1], chr(31)) AS gram, count(*) AS c FROM (SELECT id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT id, {_tokens(c)} AS t FROM texts), (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL"
    match = ", ".join(f"coalesce(sum(CASE WHEN r.c IS NULL THEN 0 ELSE least(h.c, r.c) END) FILTER (h.n = {n}), 0)::BIGINT AS bleu_match_{n}" for n in range(1, 5))
    total = ", ".join(f"greatest(0, hl - {n} + 1)::BIGINT AS bleu_total_{n}" for n in range(1, 5))
    return f"""hg AS ({grams(hyp)}), rg AS ({grams(ref)}), matched AS (SELECT h.id, {match} FROM hg h LEFT JOIN rg r USING (id, n, gram) GROUP BY h.id),
      lens AS (SELECT id, len({_tokens(hyp)})::BIGINT AS hl, len({_tokens(ref)})::BIGINT AS rl FROM texts),
      bleu AS (SELECT id, matched.* EXCLUDE (id), {total}, hl AS bleu_hyp_len, rl AS bleu_ref_len FROM lens JOIN matched USING (id))"""


_BLEU = f"{TEXTS}, {_bleu_items('output', 'reference')}"
ORACLE_SQL["bleu_item_counts"] = f"WITH {_BLEU} SELECT * FROM bleu"
ORACLE_SQL["bleu_corpus"] = (
    f"WITH {_BLEU} SELECT round(100 * CASE WHEN h > r THEN 1 ELSE exp(1 - r / h) END * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4), 2) AS bleu, "
    "round(CASE WHEN h > r THEN 1 ELSE exp(1 - r / h) END, 4) AS brevity_penalty, h::BIGINT AS hyp_len, r::BIGINT AS ref_len FROM (SELECT "
    + ", ".join(f"sum(bleu_match_{n}) AS m{n}, sum(bleu_total_{n}) AS t{n}" for n in range(1, 5))
    + ", sum(bleu_hyp_len) AS h, sum(bleu_ref_len) AS r FROM bleu)"
)

_PARTS = "('### part' || chr(10) || '| attribute | value |' || chr(10) || '| --- | --- |' || chr(10) || '| name | ' || p_name || ' |' || chr(10) || '| brand | ' || p_brand || ' |' || chr(10) || '| type | ' || p_type || ' |' || chr(10) || '| size | ' || p_size || ' |' || chr(10) || '| price | ' || p_retailprice || ' |')"
ORACLE_SQL["md_serialise_game"] = f"""WITH {CELLS}, r AS (SELECT ex_id, sec_idx, sec_name, row_idx, n_sec_rows, '| ' || string_agg(text, ' | ' ORDER BY col_idx) || ' |' AS line, '| ' || string_agg(col_name, ' | ' ORDER BY col_idx) || ' |' AS head, '|' || repeat(' --- |', count(*)) AS rule FROM full_cells GROUP BY ALL),
  multi AS (SELECT ex_id, sec_idx, '### ' || any_value(sec_name) || chr(10) || max(head) || chr(10) || max(rule) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) AS section FROM r WHERE n_sec_rows > 1 GROUP BY ex_id, sec_idx),
  single AS (SELECT ex_id, sec_idx, '### ' || any_value(sec_name) || chr(10) || '| attribute | value |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || col_name || ' | ' || text || ' |', chr(10) ORDER BY col_idx) AS section FROM full_cells WHERE n_sec_rows = 1 GROUP BY ex_id, sec_idx)
  SELECT ex_id, string_agg(section, chr(10) || chr(10) ORDER BY sec_idx) AS text FROM (FROM multi UNION ALL FROM single) GROUP BY ex_id"""


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompt_sql() -> str:
    from factloom.operators.prompts import PROMPTS

    spec = PROMPTS["e2e/strict_v1"]
    user = f"replace({_quote(spec['user'])}, '{{table}}', {_PARTS})"
    one = lambda pos, role, text: f"SELECT 'part-' || p_partkey AS ex_id, {pos} AS pos, '{role}' AS role, length({text})::INT AS n_chars, md5({text}) AS digest FROM part"
    return f"{one(0, 'system', _quote(spec['system']))} UNION ALL {one(1, 'user', user)}"


ORACLE_SQL["prompt_messages"] = _prompt_sql()
ORACLE_SQL["extract_final"] = f"""SELECT doc_id, length(trim(regexp_replace('- a: 1' || chr(10) || '**Summary:** draft' || chr(10) || 'SUMMARY: ' || text, '(?is)^.*summary[*_\\s]*:[*_\\s]*', ''), {_BLANKS}))::INT AS n_chars FROM documents"""
ORACLE_SQL["column_stats"] = f"WITH {CELLS} SELECT sec_name || '|' || col_name AS key, round(avg(num), 6) AS mean, round(stddev_pop(num), 6) AS std FROM full_cells WHERE kind = 1 GROUP BY ALL"
ORACLE_SQL["column_vocab"] = f"WITH {CELLS}, k AS (SELECT DISTINCT sec_name || '|' || col_name AS key FROM full_cells UNION SELECT 'part|' || unnest(['name', 'brand', 'type', 'size', 'price'])) SELECT key, row_number() OVER (ORDER BY key)::INT AS col_id FROM k"
ORACLE_SQL["string_bucket"] = "SELECT p_partkey, (('0x' || substr(md5(lower(trim(p_name))), 1, 8))::BIGINT % 2048)::INT AS bucket FROM part"
_FEATURES = "round({s} , 6) AS f0, round(ln(1 + abs({v})), 6) AS f1, round(sign({v})::DOUBLE, 6) AS f2, ({v} = floor({v}))::INT::DOUBLE AS f3"
ORACLE_SQL["numeric_features"] = "SELECT c_custkey, " + _FEATURES.format(v="c_acctbal", s="greatest(-10, least(10, (c_acctbal - 4500) / 3000))") + " FROM customer"
ORACLE_SQL["featurised_cells"] = f"""WITH {CELLS}, st AS (SELECT sec_name, col_name, avg(num) AS mean, stddev_pop(num) AS std FROM full_cells WHERE kind = 1 GROUP BY ALL),
  vocab AS (SELECT sec_name, col_name, row_number() OVER (ORDER BY sec_name || '|' || col_name) AS col_id FROM (SELECT DISTINCT sec_name, col_name FROM full_cells))
  SELECT ex_id, (dense_rank() OVER (PARTITION BY ex_id ORDER BY sec_idx, row_idx) - 1)::INT AS r, col_idx::INT AS c, col_id::INT AS col_id, kind, CASE WHEN kind = 2 THEN (('0x' || substr(md5(lower(trim(text))), 1, 8))::BIGINT % 2048)::INT ELSE 0 END AS str_bucket, is_key,
  CASE WHEN kind = 1 THEN round(CASE WHEN std > 0 THEN greatest(-10, least(10, (num - mean) / std)) ELSE 0 END, 6) ELSE 0 END AS f0, CASE WHEN kind = 1 THEN round(ln(1 + abs(num)), 6) ELSE 0 END AS f1,
  CASE WHEN kind = 1 THEN sign(num)::DOUBLE ELSE 0 END AS f2, CASE WHEN kind = 1 THEN (num = floor(num))::INT::DOUBLE ELSE 0 END AS f3 FROM full_cells LEFT JOIN vocab USING (sec_name, col_name) LEFT JOIN st USING (sec_name, col_name)"""
ORACLE_SQL["align_numeric"] = f"WITH {TEXTS}, f AS (SELECT id, {_numbers('output')} AS ns FROM texts) SELECT ex_id, sec_idx, row_idx::INT AS row_idx, col_idx::INT AS col_idx, list_contains(ns, num) AS label FROM full_cells JOIN f ON ex_id = id WHERE kind = 1"
ORACLE_SQL["seq_logprob"] = "SELECT vec_id, round(list_avg(list_transform(embedding[1:(vec_id % 64 + 1)], lambda x: x::DOUBLE)), 6) AS seq_logprob FROM embeddings"
ORACLE_SQL["resume_anti_join"] = f"WITH {TEXTS} SELECT id FROM texts WHERE yr % 2 <> 0"
_TWO = TEXTS + f""",
runs AS (SELECT 'A' AS run, id, output FROM texts UNION ALL SELECT 'B', id, CASE WHEN pair % 2 = 1 THEN reference ELSE output END FROM texts),
tn AS (SELECT DISTINCT ex_id, round(v, 6) AS v FROM (SELECT ex_id, unnest(CASE WHEN kind = 1 THEN [num] ELSE {_numbers('text')} END) AS v FROM full_cells)),
exact AS (SELECT ex_id, v FROM tn UNION SELECT ex_id, round(v / 100, 6) FROM tn),
wide AS (SELECT ex_id, sec_idx, col_idx FROM full_cells WHERE kind = 1 GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40),
pairs AS (SELECT a.ex_id, a.num AS x, b.num AS y FROM full_cells a JOIN full_cells b USING (ex_id, sec_idx, col_idx) JOIN wide USING (ex_id, sec_idx, col_idx) WHERE a.kind = 1 AND b.kind = 1 AND a.row_idx < b.row_idx),
derived AS (SELECT ex_id, round(x + y, 6) AS v FROM pairs UNION SELECT ex_id, round(abs(x - y), 6) FROM pairs),
found AS (SELECT run, id, unnest({_numbers('output')}) AS v FROM runs),
tiers AS (SELECT f.run, f.id, f.v, CASE WHEN e.v IS NOT NULL THEN 1 WHEN d.v IS NOT NULL THEN 2 ELSE 0 END AS tier FROM found f LEFT JOIN exact e ON f.id = e.ex_id AND round(f.v, 6) = e.v LEFT JOIN derived d ON f.id = d.ex_id AND round(f.v, 6) = d.v),
items AS (SELECT run, id, count(*) AS num_n, count(*) FILTER (tier = 0) AS u, count(*) FILTER (tier = 2) AS n_derived, count(*) FILTER (tier = 1) AS n_exact, dense_rank() OVER (ORDER BY id) - 1 AS item FROM tiers GROUP BY run, id)"""


def _values(frm: str, keys: str, w: str = "1") -> str:
    return f"""SELECT {keys}, unnest(['num_unsupported', 'num_derived', 'exact_mean', 'unsupported_items']) AS metric,
      unnest([sum({w} * u) / sum({w} * num_n), sum({w} * n_derived) / sum({w} * num_n), sum({w} * n_exact) / sum({w}), sum({w} * (u > 0)::INT) / sum({w})]) AS value FROM {frm} GROUP BY {keys}"""


_DRAWS = _TWO + f""", n AS (SELECT max(item) + 1 AS n FROM items),
w AS (SELECT b, ((b * 7919 + j * 104729 + (b * j) % 613) * 31 % 2147483647) % n AS item, count(*) AS w FROM (SELECT unnest(range(0, 10000)) AS b), (SELECT n, unnest(range(0, n)) AS j FROM n) GROUP BY ALL),
draws AS ({_values('items JOIN w USING (item)', 'run, b', 'w')}), pts AS ({_values('items', 'run')})"""


def _mixed(frm: str, keys: str) -> str:
    for shift, factor in ((15, 48_271), (13, 69_621), (16, 39_373)):
        frm = f"(SELECT {keys}, xor(x, x >> {shift}) * {factor} % 2147483647 AS x FROM {frm})"
    return frm


def _hashed(items: str, seed: int = 13) -> str:
    return _mixed(f"(SELECT item, (item * 40692 + {seed} * 1000003 + 1) % 2147483647 AS x FROM {items})", "item")


def permuted(sql: str) -> str:
    """``fold_rank`` with folds of the items in hashed order, three or from 400 items on five, whose sizes differ by one at most."""
    fold = "CASE WHEN spot < n % k * (n // k + 1) THEN spot // (n // k + 1) ELSE n % k + (spot - n % k * (n // k + 1)) // (n // k) END"
    cut = f"SELECT item, ({fold})::INT AS fold FROM (SELECT item, row_number() OVER (ORDER BY x, item) - 1 AS spot, count(*) OVER () AS n, CASE WHEN count(*) OVER () < 400 THEN 3 ELSE 5 END AS k FROM {_hashed('(SELECT DISTINCT item FROM items)')})"
    return sql.replace("(SELECT *, (item % 3)::INT AS fold FROM items)", f"(SELECT * FROM items JOIN ({cut}) USING (item))")


def counted(n: str, replicates: int = 10_000, seed: int = 13) -> str:
    """A query of (item, b, w) with w > 0: the weights of a Poisson bootstrap over items 0 to n - 1, by hash."""
    keyed = _hashed(f"(SELECT unnest(range(0, {n})) AS item)", seed)
    both = _mixed(f"(SELECT item, b, (x + (b + 1) * 1566083) % 2147483647 AS x FROM {keyed}, (SELECT unnest(range(0, {replicates})) AS b))", "item, b")
    bounds = [int(2147483647 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]
    return f"SELECT item, b, {' + '.join(f'(x >= {t})::INT' for t in bounds)} AS w FROM {both} WHERE x >= {bounds[0]}"


_COUNTED = _TWO + f""", w AS ({counted('(SELECT max(item) + 1 FROM items)')}),
draws AS ({_values('items JOIN w USING (item)', 'run, b', 'w')}), pts AS ({_values('items', 'run')})"""
ORACLE_SQL["compare_runs"] = f"WITH {_TWO} SELECT run, metric, round(value, 9) AS value FROM ({_values('items', 'run')})"
ORACLE_SQL["bootstrap_lcg_ci"] = f"WITH {_DRAWS} SELECT p.run, p.metric, round(any_value(p.value), 9) AS point, round(quantile_cont(d.value, 0.025), 9) AS lo, round(quantile_cont(d.value, 0.975), 9) AS hi FROM pts p JOIN draws d USING (run, metric) GROUP BY p.run, p.metric"
ORACLE_SQL["paired_diff"] = f"""WITH {_DRAWS}, dd AS (SELECT a.metric, a.value - z.value AS d FROM draws a JOIN draws z ON a.metric = z.metric AND a.b = z.b AND a.run = 'A' AND z.run = 'B'),
  pp AS (SELECT a.metric, a.value - z.value AS diff FROM pts a JOIN pts z ON a.metric = z.metric AND a.run = 'A' AND z.run = 'B')
  SELECT metric, round(any_value(diff), 9) AS diff, round(quantile_cont(d, 0.025), 9) AS lo, round(quantile_cont(d, 0.975), 9) AS hi FROM pp JOIN dd USING (metric) GROUP BY metric"""
ORACLE_SQL["bootstrap_counter_ci"] = ORACLE_SQL["bootstrap_lcg_ci"].replace(_DRAWS, _COUNTED)
ORACLE_SQL["paired_counter_diff"] = ORACLE_SQL["paired_diff"].replace(_DRAWS, _COUNTED)
ORACLE_SQL["fold_rank"] = f"WITH {_TWO}, v AS ({_values('(SELECT *, (item % 3)::INT AS fold FROM items)', 'run, fold')}) SELECT run, fold, metric, round(value, 9) AS value, row_number() OVER (PARTITION BY metric, fold ORDER BY value IS NULL, CASE WHEN metric = 'exact_mean' THEN -value ELSE value END, run)::INT AS rank FROM v"
ORACLE_SQL["rolling_rate"] = f"""WITH {_TWO}, o AS (SELECT run, id, regexp_extract(id, '([0-9]+)$', 1)::BIGINT AS i, u, num_n FROM items),
  x AS (SELECT run, i, round(sum(u) OVER w / sum(num_n) OVER w, 9) AS rate, row_number() OVER (PARTITION BY run ORDER BY i, id) AS k FROM o WINDOW w AS (PARTITION BY run ORDER BY i, id ROWS 74 PRECEDING)) SELECT run, i, rate FROM x WHERE k >= 75"""
ORACLE_SQL["selection_rule"] = f"WITH {_TWO}, v AS ({_values('items', 'run')}), p AS (SELECT run, max(value) FILTER (metric = 'num_unsupported') AS num_unsupported, max(value) FILTER (metric = 'num_derived') AS num_derived, max(value) FILTER (metric = 'exact_mean') AS exact_mean FROM v GROUP BY run) SELECT run, round(num_unsupported, 9) AS num_unsupported, round(num_derived, 9) AS num_derived, round(exact_mean, 9) AS exact_mean FROM p ORDER BY round(num_unsupported, 4), round(num_derived, 4), round(-exact_mean, 4), run LIMIT 1"
ORACLE_SQL["sample_first_n"] = "SELECT p_partkey AS pos, p_name FROM part ORDER BY p_partkey LIMIT 100"
