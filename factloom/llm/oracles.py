"""DuckDB SQL that says the same as the queries of this package, over the same tables."""

from __future__ import annotations

from factloom.llm import decontaminate as D
from factloom.llm import hard_negatives as H
from factloom.llm import jaccard_join as J
from factloom.llm import quality_rules as Q
from factloom.llm import url_cascade as U

_SPACE = r"[^\x20\x09-\x0D]"


def _spread(alias: str, keys: str) -> str:
    cols = [f"quantile_disc({r}::DOUBLE, 0.5) AS mid_{r}" for r in (*Q.RATIOS, *Q.SIZES)]
    cols += [f"least(quantile_disc({r}, 0.75) - quantile_disc({r}, 0.5), quantile_disc({r}, 0.5) - quantile_disc({r}, 0.25)) AS half_{r}" for r in Q.RATIOS]
    return f"{alias} AS (SELECT {keys + ', ' if keys else ''}count(*) AS n, {', '.join(cols)} FROM measured WHERE NOT base_failed {'GROUP BY ' + keys if keys else ''})"


def quality_ctes(table: str = "documents") -> str:
    """CTEs that end in ``judged``: every measure and verdict of each row."""
    fields = [f"mid_{r}" for r in (*Q.RATIOS, *Q.SIZES)] + [f"half_{r}" for r in Q.RATIOS]
    def blend(g: str, n: str, larger: str) -> str:
        out = []
        for c in fields:
            held = f"greatest({larger}{c}, coalesce(abs({g}.mid_{c[5:]} - {larger}mid_{c[5:]}), 0))" if c.startswith("half_") else f"{larger}{c}"
            out.append(f"coalesce(({n} * {g}.{c} + {Q.PRIOR} * {held}) / ({n} + {Q.PRIOR}), {held}) AS {'l' if larger == 'e.' else 'o'}_{c}")
        return ", ".join(out)

    bad = []
    for r, (size, weight, laxest, both) in Q.RATIOS.items():
        mine = f"greatest({size}, 1)::DOUBLE"
        width = {g: f"({Q.REACH} * {g}_half_{r} * greatest(1, sqrt({g}_mid_{size} / {mine})) + {Q.EVENTS * weight} / least({g}_mid_{size}, {mine}))" for g in "ol"}
        for sign, inner, beyond in (("+", "least", ">"), *([("-", "greatest", "<")] if both else [])):
            bad.append(f"coalesce(coalesce({r}, 0) {beyond} {inner}(o_mid_{r} {sign} {width['o']}, l_mid_{r} {sign} greatest({width['l']}, {laxest})), false)")
    return f"""
split AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM {table}),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
counted AS (SELECT s.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
measured AS (SELECT *, n_symbols / nullif(word_chars, 0) AS symbol_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
  n_repeat_words / nullif(n_words, 0) AS repeat_ratio, word_chars / nullif(n_words, 0) AS word_length,
  (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted),
{_spread("s_own", "lang, source")}, {_spread("s_lang", "lang")}, {_spread("s_all", "")},
larger AS (SELECT m.*, {blend("l", "l.n", "e.")} FROM measured m LEFT JOIN s_lang l ON m.lang IS NOT DISTINCT FROM l.lang LEFT JOIN s_all e ON true),
own AS (SELECT m.*, {blend("o", "o.n", "l_")} FROM larger m LEFT JOIN s_own o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source),
judged AS (SELECT *, NOT (base_failed OR {' OR '.join(bad)}) AS kept FROM own)"""


_OP9 = f"WITH {quality_ctes()} SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"


def _op8() -> str:
    ordered = sorted(U.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in ordered) + " END"
    names = ", ".join(f"'{n}'" for n in U.LISTED_NAMES)
    return f"""
WITH split AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{U._UPPER}', '{U._LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
  coalesce({case(lambda v, h, p: v)}, CASE WHEN list_has_any(string_split(host, '.'), [{names}]) THEN 'block' ELSE 'allow' END) AS verdict FROM split"""


def _op10() -> str:
    def escaped(col: str) -> str:
        out = rf"replace({col}, '\', '\\')"
        for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
            out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
        return out

    same = "</s>[INST] ok [/INST]"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{same}'), (-1, 1, 'assistant', '{same}')),
formatted AS (SELECT *, length('<s>[INST][/INST]</s>' || {escaped('role')} || {escaped('text')}) AS size FROM turns),
placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS until FROM formatted)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant')::BIGINT AS n_examples, coalesce(sum(until) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM placed GROUP BY conv_id"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{U._UPPER}', '{U._LOWER}'), '{_ALNUM}')"


def _op2() -> str:
    n, (num, den) = J.NGRAM, J.THRESHOLD
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {_words('text')} AS w FROM documents), full_ AS (SELECT doc_id, w, array_to_string(w, ' ') AS s FROM words WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM full_ WHERE len(w) >= {n}) UNION ALL SELECT doc_id, s FROM full_ WHERE len(w) < {n}),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE {den} * m >= {num} * (x.n + y.n - m)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
tops AS (SELECT a, min(b) AS top FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), copies AS (SELECT s, count(*) AS n FROM full_ GROUP BY s)
SELECT w.doc_id, least(w.doc_id, coalesce(top, w.doc_id)) AS class_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(k.n - 1, 0)::BIGINT AS n_copies
FROM words w LEFT JOIN tops t ON w.doc_id = t.a LEFT JOIN counts c ON w.doc_id = c.a LEFT JOIN full_ f ON w.doc_id = f.doc_id LEFT JOIN copies k ON f.s = k.s"""


def _op6() -> str:
    n = D.WINDOW
    return f"""
WITH docs AS (SELECT doc_id, {_words('text')} AS w FROM documents), items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, {_words('text')} AS w FROM benchmark),
windows AS (SELECT item_id, i AS spot, least(len(w), {n}) AS l, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {n - 1}) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM windows),
places AS (SELECT doc_id, i AS pos, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, lengths WHERE len(w) >= l)),
hits AS (SELECT doc_id, pos, p.l, item_id, spot FROM places p JOIN windows v ON p.g = v.g AND p.l = v.l),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + l)) AS p FROM (SELECT DISTINCT doc_id, pos, l FROM hits)) GROUP BY doc_id),
runs AS (SELECT doc_id, any_value(l) + count(*) - 1 AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, pos - spot ORDER BY pos) AS run FROM (SELECT DISTINCT * FROM hits)) GROUP BY doc_id, item_id, pos - spot, run),
longest AS (SELECT doc_id, max(n) AS n FROM runs GROUP BY doc_id), named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated, coalesce(x.n, 0)::BIGINT AS longest
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id LEFT JOIN longest x ON d.doc_id = x.doc_id"""


def _op12() -> str:
    return f"""
WITH clean AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({H.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM clean a JOIN clean b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {H.POSITIVES}),
found AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND {H.LOWER} * p.score <= 100 * n.score AND 100 * n.score <= {H.UPPER} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {H.NEGATIVES}"""


ORACLE_SQL: dict[str, str] = {"op12_hard_negatives": _op12(), "op2_jaccard_join": _op2(), "op6_decontaminate": _op6(), "op8_url_cascade": _op8(), "op9_quality_rules": _OP9, "op10_chat_expand": _op10()}
