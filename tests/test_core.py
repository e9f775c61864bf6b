"""Operators on hand-made tables: facts, numbers, relations, claims, overlap, sheets, alignment, features."""

from __future__ import annotations

import itertools
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from factloom.functions import numeric as V
from factloom.functions import text as T
from factloom.operators import align, claims, facts, features, numbers, overlap, prompts, relations, serialise
from factloom.sources.cells import TABLE, from_nested
from pyspark.sql import functions as F

TEAMS = (["TEAM", "TEAM-PTS", "TEAM-WINS", "TEAM-LOSSES"], [["Toronto Raptors", 122, 5, 1], ["Philadelphia 76ers", 95, 2, 4]])
PLAYERS = (
    ["PLAYER_NAME", "TEAM_CITY", "PTS", "REB", "AST", "FGM", "FGA"],
    [
        ["Kyle Lowry", "Toronto", 24, 4, 10, 8, 14], ["DeMar DeRozan", "Toronto", 24, 11, 3, 9, 20], ["Jeremy Lin", "Toronto", 0, None, 2, None, None],
        ["Robert Covington", "Philadelphia", 21, 6, 1, 7, 15], ["Tim Hardaway Jr.", "Philadelphia", 11, 12, 11, 4, 9],
    ],
)


def cell(x):
    if x is None:
        return (0, None, False, None)
    return (2, None, False, x) if isinstance(x, str) else (1, float(x), isinstance(x, int), None)


def table(*sections):
    return [(name, cols, [[cell(x) for x in row] for row in rows], 0) for name, (cols, rows) in sections]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [
        ("g", table(("teams", TEAMS), ("players", PLAYERS))),
        ("tie", table(("teams", (TEAMS[0], [["A Reds", 90, 1, 1], ["B Blues", 90, 1, 1]])))),
        ("r", table(("restaurant", (["name", "priceRange", "area", "note"], [["The Vaults", "£20-25", "city | centre", None]])))),
        ("null", table(("teams", (["TEAM", "TEAM-PTS"], [["A X", 1], ["B Y", None]])))),
    ]
    return from_nested(spark.createDataFrame(rows, f"id string, table {TABLE}")).cache()


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def check(spark, cells, text, id="g"):
    found = relations.claims(spark.createDataFrame([(id, text)], "id string, output string"), facts.context(cells))
    return [(r.type, r.claimed, r.correct) for r in found.orderBy("pos", "part", "clause_no", "seg_no", "k").collect()]


def test_width_is_checked(spark):
    bad = spark.createDataFrame([("x", table(("s", (["a", "b"], [[1]]))))], f"id string, table {TABLE}")
    with pytest.raises(Exception, match="row width"):
        from_nested(bad).collect()


def test_text_functions(spark):
    assert one(spark, T.numbers, "scored 1,234 on .500 or 3.5, 20-25") == [1234.0, 0.5, 3.5, 20.0, 25.0]
    assert one(spark, T.tokens, "Émile's 122-95!") == ["émile", "'", "s", "122", "-", "95", "!"]
    assert one(spark, T.sentences, "  One. two! Three?  4 ") == ["One. two!", "Three?", "4"]
    assert one(spark, T.claim_units, 'He led the team, while Kyle Lowry scored ten; 23). It was, and The game was long.') == ["He led the team", "Kyle Lowry scored ten", "The game was long."]
    assert [one(spark, T.surname, n) for n in ("Tim Hardaway Jr.", "Robinson III", "jr", "Nene")] == ["hardaway", "robinson", "jr", "nene"]
    assert one(spark, lambda x: T.ngrams(T.tokens(x), 2), "a") == []
    assert one(spark, lambda x: T.extract_final(x, F.lit("SUMMARY:")), "- x\n**Summary:** one\nsummary : two ") == "two"
    assert one(spark, lambda x: T.extract_final(x, F.lit("SUMMARY:")), " none ") == "none"
    assert one(spark, lambda x: T.lcs_length(F.split(F.lit("a b c d"), " "), F.split(x, " ")), "b x d a c d") == 3


def test_numeric_functions(spark):
    parsed = [one(spark, V.parse_cell, x) for x in ("N/A", "", "12", "12.5", "abc", None)]
    assert [p.kind for p in parsed] == [0, 0, 1, 1, 2, 0] and parsed[2].is_int and parsed[3].num == 12.5
    feats = one(spark, lambda x: V.numeric_features(x, F.lit(10.0), F.lit(2.0)), 14.0, "double")
    assert feats == [2.0, math.log1p(14), 1.0, 1.0]
    assert one(spark, lambda x: V.numeric_features(x, F.lit(0.0), F.lit(1.0)), 1e9, "double")[0] == 10.0
    assert one(spark, lambda x: V.seq_logprob(x, F.array(*map(F.lit, (5, 2, 9))), F.lit(2)), [-1.0, -3.0, -9.0], "array<double>") == -2.0
    assert one(spark, lambda x: V.seq_logprob(x, F.array().cast("array<int>"), F.lit(2)), [], "array<double>") is None
    split = one(spark, lambda x: V.split_ids(x, F.array(F.lit(9), F.lit(9))), [1, 2, 9, 9, 3], "array<int>")
    assert (split.before, split.after) == ([1, 2], [3])
    with pytest.raises(Exception, match="placeholder"):
        one(spark, lambda x: V.split_ids(x, F.array(F.lit(7))), [1], "array<int>")


def test_cells_are_parsed_once(spark, capsys):
    cells = spark.createDataFrame([("12",)], "raw string").withColumn("c", V.parse_cell(F.col("raw")))
    cells.select("c.kind", V.number_text(F.col("c.num"), F.col("c.is_int"), F.col("c.str"))).explain("codegen")
    # Of other patterns the generated code holds none: what they gave is taken from the parts of the number.
    assert capsys.readouterr().out.count(".matcher(") == 1


def test_odd_cells(spark):
    parsed = [one(spark, V.parse_cell, x) for x in (" -1_0\n", "12\u2028", "1d", "1__0", "1,000", "+.5e1_0", "-inf", "-0009223372036854775808", "+9223372036854775808", "0" * 30, "1" + "_1" * 20_000, "7" * 20_000 + "x")]
    assert [p.kind for p in parsed] == [1, 1, 2, 2, 2, 1, 1, 1, 1, 1, 1, 2]
    assert [p.num for p in parsed[:2] + parsed[5:7]] == [-10.0, 12.0, 5e9, -math.inf]
    assert [p.str for p in parsed[7:10]] == [None, "9223372036854775808", None] and parsed[10].str == "1" * 20_001
    floats = (0.1, -12345678.5, 1e7, 123456789012345.6, -9999999999999998.0, 1e16, 1.5e-4, -2.5e-5, 1e300, -0.0, math.inf, -math.inf, math.nan)
    # As an element of an array, as the loaders take it.
    assert one(spark, lambda x: F.transform(x, V.real_text), floats, "array<double>") == [repr(x) for x in floats]
    assert one(spark, V.real_text, 1.5e-4, "double") == "0.00015"


def test_facts(cells):
    f = {r.ex_id: r for r in facts.team_facts(cells).collect()}
    assert set(f) == {"g", "tie"}
    assert (f["g"].winner, f["g"].margin, f["tie"].winner, f["tie"].margin) == ("Toronto Raptors", 27.0, None, 0.0)
    alias = {(r.ex_id, r.alias): r.team for r in facts.team_aliases(facts.team_facts(cells)).collect()}
    assert alias["g", "76ers"] == "Philadelphia 76ers" and alias["g", "toronto"] == "Toronto Raptors"
    rows = facts.player_rows(cells)
    assert {r.alias for r in facts.player_aliases(rows).collect()} >= {"hardaway", "tim hardaway jr.", "lin"}
    led = {(r.scope, r.stat): r.players for r in facts.leaders(rows).collect()}
    assert led["toronto", "PTS"] == ["DeMar DeRozan", "Kyle Lowry"] and led["*", "AST"] == ["Tim Hardaway Jr."]


def test_number_support(spark, cells):
    texts = [("g", "122 to 95, by 27; 48 and 999. He shot .24"), ("r", "It costs 25, not 26."), ("tie", "no digits")]
    items = numbers.score_items(spark.createDataFrame(texts, "id string, output string"), cells)
    got = {r.id: r for r in items.collect()}
    assert (got["g"].n_numbers, got["g"].n_exact, got["g"].n_derived, got["g"].unsupported) == (6, 3, 2, [999.0])
    assert got["r"].unsupported == [26.0] and got["tie"].support_rate is None
    run = numbers.score_run(items).first()
    assert run.items == 3 and run.items_with_numbers == 2 and math.isclose(run.pct_items_with_unsupported_number, 2 / 3)
    assert numbers.score_items(spark.createDataFrame(texts, "id string, output string"), cells, allow_derived=False).filter("id = 'g'").first().n_derived == 0


def test_number_support_of_long_columns(spark):
    """Sums and differences of columns beyond 40 cells, against all pairs; the values round, repeat, or are large."""
    rng = np.random.default_rng(5)
    columns = {
        ("a", 0): [float(v) for v in rng.integers(100, 1000, 60)],
        ("a", 1): [0.5, 0.5] + [7.0] * 50,
        ("b", 0): [round(float(v), 7) for v in rng.normal(0, 3, 70)],
        ("c", 0): [float(v) for v in rng.integers(10**14, 10**15, 50) / 8] + [5e-7, 1.5e-6],
        ("d", 0): [1e308] * 41 + [math.inf, math.nan, -3.0, 4.0],
        ("e", 0): [12.0],
    }
    rows = [(e, 1, c, 1, v, None) for (e, c), vs in columns.items() for v in vs]
    cells = spark.createDataFrame(rows, "ex_id string, sec_idx int, col_idx int, kind int, num double, str string")
    key = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if math.isfinite(x) and abs(x) < 1e20 else x
    made = {e: {key(z) for (f, _), vs in columns.items() if f == e for x, y in itertools.combinations(vs, 2) for z in (x + y, abs(x - y))} for e in "abcde"}
    said = {e: sorted(v for v in made[e] if 0 <= v < 1e20)[:: max(1, len(made[e]) // 80)] for e in made}
    said = {e: vs + [v + 1 for v in vs] + [14.0, 0.0, 1.0, 24.0, 99999.0] for e, vs in said.items()}
    texts = [(e, " and ".join(f"{v:.12f}" for v in vs)) for e, vs in said.items()] + [("d", "9" * 400)]
    want = sorted((e, v) for e, vs in said.items() for v in {key(v) for v in vs} if v in made[e])
    outputs = spark.createDataFrame(texts, "id string, output string")
    found = outputs.select(F.col("id").alias("ex_id"), F.explode(F.transform(T.numbers(F.col("output")), V.key6)).alias("value")).distinct()
    assert sorted(map(tuple, numbers.derived_among(found, cells).collect())) == want
    assert ("a", 14.0) in want and ("a", 0.0) in want and ("d", 1.0) in want and ("e", 24.0) not in want
    one = spark.createDataFrame([("a", "14 and 99999")], "id string, output string")
    got = [numbers.score_items(one, cells, long_columns=on).first() for on in (False, True)]
    assert [(r.n_derived, r.unsupported) for r in got] == [(0, [14.0, 99999.0]), (1, [99999.0])]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The Raptors defeated the 76ers 122-95.", [("winner", "Toronto Raptors", True)]),
        ("The Raptors were defeated by the 76ers.", [("winner", "Philadelphia 76ers", False)]),
        ("The 76ers fell to the Raptors in a 27-point loss.", [("winner", "Toronto Raptors", True)]),
        ("The 76ers won by a lot.", [("winner", "Philadelphia 76ers", False)]),
        ("The 76ers have won 11 of 13.", []),
        ("It was a 20-point victory for the Raptors.", [("winner", "Toronto Raptors", True), ("margin", "20", False)]),
        ("Lowry had 24 points and 9 assists.", [("attribution", "Kyle Lowry 24 PTS", True), ("attribution", "Kyle Lowry 9 AST", False)]),
        ("The 76ers' Lowry added 24 points.", [("team-attribution", "Kyle Lowry on Philadelphia 76ers", False), ("attribution", "Kyle Lowry 24 PTS", True)]),
        ("Lowry and DeRozan combined for 48 points.", []),
        ("Lowry scored 24 points and 21 points from Covington.", [("attribution", "Kyle Lowry 24 PTS", True), ("attribution", "Robert Covington 21 PTS", True)]),
        ("Covington led the 76ers with 21 points.", [("team-attribution", "Robert Covington on Philadelphia 76ers", True), ("attribution", "Robert Covington 21 PTS", True), ("leader", "Robert Covington led (PTS)", True)]),
        ("Lowry led all scorers with 24 points.", [("attribution", "Kyle Lowry 24 PTS", True), ("leader", "Kyle Lowry led (PTS)", True)]),
        ("Lin led the bench with 0 points.", [("attribution", "Jeremy Lin 0 PTS", True)]),
        ("On the line, Lowry watched as the Raptors put up 122 points.", []),
    ],
)
def test_relations(spark, cells, text, want):
    assert check(spark, cells, text) == want


def test_ties_and_other_tables_make_no_result_claim(spark, cells):
    assert check(spark, cells, "The Reds defeated the Blues.", "tie") == [] and check(spark, cells, "The Vaults won.", "r") == []


def test_premises_and_claims(spark, cells):
    texts = spark.createDataFrame([("g", "Kyle Lowry won the long game. The 76ers lost the game. Nobody named here at all."), ("r", "The Vaults is cheap.")], "id string, output string")
    pairs = claims.premises(claims.units(texts), cells)
    got = {(r.id, r.pos): r.premise for r in pairs.collect()}
    won = "The Toronto Raptors defeated the Philadelphia 76ers 122 to 95 ; the Toronto Raptors won the game and the Philadelphia 76ers lost the game"
    assert got["g", 0] == won + " . players Kyle Lowry -- TEAM_CITY: Toronto; PTS: 24; REB: 4; AST: 10; FGM: 8; FGA: 14"
    assert "teams Philadelphia 76ers -- TEAM-PTS: 95" in got["g", 1]
    assert got["g", 2].count("teams ") == 2
    assert got["r", 0] == "restaurant The Vaults -- priceRange: £20-25; area: city | centre"
    run = claims.score_run(claims.score_items(texts, claims.score_with_stub(pairs))).first()
    assert (run.items, run.total_claims, run.claim_entailed_rate_micro, run.pct_items_with_contradiction) == (2, 4, 0.25, 0.5)

    def make():
        return lambda batch: [{"entailment": 0.9, "neutral": 0.05, "contradiction": 0.05} for _ in batch]

    assert claims.score_with_model(pairs, make).filter("label = 'entailment'").count() == 4


def test_bleu(spark):
    pairs = spark.createDataFrame([("a", "the cat sat on the mat", ["the cat sat on the mat"]), ("b", "the the the", ["the cat is here now", "the the dog"]), ("c", "x", [])], "id string, output string, references array<string>")
    items = overlap.bleu_items(pairs)
    got = {r.id: r for r in items.collect()}
    assert [got["a"][c] for c in overlap.MATCH] == [6, 5, 4, 3] and (got["b"].bleu_match_1, got["b"].bleu_match_2, got["b"].bleu_ref_len) == (2, 1, 3) and got["c"].bleu_ref_len == 0
    assert overlap.bleu_run(items.filter("id = 'a'")).first().bleu == 100.0
    assert overlap.bleu_run(items.filter("id = 'c'")).first().bleu == 0.0


def test_parent_prefers_the_faithful_text(spark, cells):
    pairs = spark.createDataFrame([("r", "The Vaults costs £20-25 in the city centre .", ["The Vaults costs £20-25 in the centre ."])], "id string, output string, references array<string>")
    worse = pairs.withColumn("output", F.lit("Zizzi is a family pub by the river ."))
    good, bad = (overlap.parent_items(p, cells).first() for p in (pairs, worse))
    assert good.f1 > 0.5 > bad.f1
    assert overlap.parent_items(pairs, cells, table_weight=None).first().f1 > 0.5


def test_markdown_and_sheets(cells):
    md = {r.ex_id: r.text for r in serialise.to_markdown(cells).collect()}
    assert md["r"] == "### restaurant\n| attribute | value |\n| --- | --- |\n| name | The Vaults |\n| priceRange | £20-25 |\n| area | city \\| centre |\n| note | N/A |"
    assert md["g"].startswith("### teams\n| TEAM | TEAM-PTS | TEAM-WINS | TEAM-LOSSES |\n| --- | --- | --- | --- |\n| Toronto Raptors | 122 | 5 | 1 |") and "\n\n### players\n" in md["g"] and "| Jeremy Lin | Toronto | 0 | N/A |" in md["g"]
    sheet = {r.ex_id: r.text for r in serialise.to_factsheet(cells).collect()}
    assert sheet["r"] == "name: The Vaults\npriceRange: £20-25\narea: city | centre"
    assert sheet["tie"].startswith("The A Reds and the B Blues finished tied at 90 points apiece.\nThe A Reds are now 1-1.")
    assert sheet["g"] == (
        "The Toronto Raptors defeated the Philadelphia 76ers 122 to 95 (margin 27).\nThe Toronto Raptors are now 5-1.\nThe Philadelphia 76ers are now 2-4.\n\n"
        "Team totals:\nToronto Raptors -- points: 122\nPhiladelphia 76ers -- points: 95\n\n"
        "Team leaders:\nToronto Raptors top scorer: DeMar DeRozan (9-of-20 shooting) and Kyle Lowry (8-of-14 shooting) with 24 points each.\nToronto Raptors top rebounder: DeMar DeRozan with 11 rebounds.\nToronto Raptors top assists: Kyle Lowry with 10 assists.\n"
        "Philadelphia 76ers top scorer: Robert Covington with 21 points on 7-of-15 shooting.\nPhiladelphia 76ers top rebounder: Tim Hardaway Jr. with 12 rebounds.\nPhiladelphia 76ers top assists: Tim Hardaway Jr. with 11 assists.\n\n"
        "Notable performances:\nDeMar DeRozan had 24 points, 11 rebounds and 3 assists, a double-double.\nKyle Lowry had 24 points, 4 rebounds and 10 assists, a double-double.\nRobert Covington had 21 points, 6 rebounds and 1 assist.\nTim Hardaway Jr. had 11 points, 12 rebounds and 11 assists, a triple-double.\n\n"
        "Other scorers:\nToronto Raptors: Jeremy Lin 0 points.\nPhiladelphia 76ers: Tim Hardaway Jr. 11 points."
    )


def test_sheets_compare_no_player_with_all_others(spark, cells, capsys):
    serialise.to_factsheet(cells).explain()
    plan = capsys.readouterr().out
    assert "roster" not in plan and "array_max" not in plan
    # 2000 players, two of them at the top, in a game of two teams.
    columns = ["PLAYER_NAME", "TEAM_CITY", "PTS", "REB", "AST"]
    rows = [[f"P{i:04d}", ("Toronto", "Philadelphia")[i % 2], 30 if i in (4, 8) else i % 19, None, None] for i in range(2000)]
    big = from_nested(spark.createDataFrame([("g", table(("teams", TEAMS), ("players", (columns, rows))))], f"id string, table {TABLE}"))
    sheet = serialise.to_factsheet(big).first().text
    assert "Toronto Raptors top scorer: P0004 and P0008 with 30 points each." in sheet and "top rebounder" not in sheet
    assert "Toronto Raptors: P0018 18 points; P0056 18 points." in sheet


def test_a_context_for_texts_holds_only_the_players_that_they_may_name(spark, cells):
    text = "The Raptors defeated the 76ers 122-95. Lowry led all scorers with 24 points. Hardaway Jr. added 12 rebounds."
    texts = spark.createDataFrame([("g", text)], "ex_id string, text string")
    part, whole = facts.context(cells, texts), facts.context(cells)
    row = part.filter("ex_id = 'g'").first()
    assert [p.player for p in row.players] == ["Kyle Lowry", "Tim Hardaway Jr."] and {a.alias for a in row.player_aliases} == {"lowry", "hardaway"}
    outputs = texts.select(F.col("ex_id").alias("id"), F.col("text").alias("output"))
    found = [sorted(map(tuple, relations.claims(outputs, c).collect())) for c in (part, whole)]
    assert found[0] == found[1] and len(found[0]) > 3


def test_a_sheet_passes_the_number_check(cells):
    sheets = serialise.to_factsheet(cells).select(F.col("ex_id").alias("id"), F.col("text").alias("output")).filter("id IN ('g', 'tie', 'r')")
    assert numbers.score_items(sheets, cells).filter(F.size("unsupported") > 0).count() == 0


def test_prompts(spark):
    assert len(prompts.PROMPTS) == 8 and "extract_marker" in prompts.get_spec("e2e/structured_v1")
    with pytest.raises(KeyError):
        prompts.get_spec("nope")
    m = prompts.messages(spark.createDataFrame([("a", "T {x}")], "ex_id string, text string"), "rotowire/plain_v1").first().messages
    assert [x.role for x in m] == ["system", "user"] and "\n\nT {x}\n\n" in m[1].content
    with pytest.raises(KeyError):
        serialise.get_serialiser("xml")


def test_alignment(spark, cells):
    refs = spark.createDataFrame([("g", "The Raptors defeated the 76ers. DeRozan had 24 points. Lowry had 99 points. It rained."), ("r", "Near the Vaults, £20-25.")], "ex_id string, reference string")
    label = {(r.ex_id, r.sec_idx, r.row_idx, r.col_idx): r.label for r in align.alignment_labels(cells, refs).collect()}
    assert label["g", 1, 1, 0] and label["g", 0, 1, 0] and label["g", 1, 0, 2] and not label["g", 1, 2, 0] and not label["g", 0, 0, 1]
    assert label["r", 0, 0, 0] and label["r", 0, 0, 1] and not label["r", 0, 0, 2]
    kept = {r.ex_id: r.reference for r in align.filter_references(cells, refs).collect()}
    assert kept == {"g": "The Raptors defeated the 76ers. DeRozan had 24 points.", "r": "Near the Vaults, £20-25."}


def test_features(spark, cells):
    games = cells.filter("ex_id = 'g'")
    stats = {r.key: (r["mean"], r.std) for r in features.column_stats(games).collect()}
    assert stats["teams|TEAM-PTS"] == (108.5, 13.5)
    vocab = features.column_vocab(games)
    assert [r.col_id for r in vocab.orderBy("key").collect()] == list(range(1, 12))
    found = features.featurise(games, vocab, features.column_stats(games))
    assert found.filter("r = 2 AND c = 0").first().kind == 2 and found.filter("kind = 0").count() == 3
    assert tuple(features.shapes(found).first())[1:] == (7, 7)
    rows = spark.createDataFrame([(0, [1], [2], [3, 4], [8]), (0, [1], [2], [3], [8])], "batch int, prefix array<int>, suffix array<int>, ref array<int>, table_ids array<int>")
    got = features.collate(rows, 2, 0).collect()
    assert got[0].input_ids == [1, 0, 0, 8, 2, 3, 4] and got[0].labels == [-100] * 5 + [3, 4] and got[1].attention == [1] * 6 + [0] and got[0].soft_pos == [1, 2]
    assert one(spark, lambda x: features.training_refs(x, 2, 3), [7, 7, 7, 7], "array<int>") == [7, 7, 7] and one(spark, lambda x: features.training_refs(x, 2, 3), [7], "array<int>") == [7, 2]


def test_decimals_round_as_the_binary_value_does(spark):
    from factloom.functions.numeric import fixed, percent

    rng = np.random.default_rng(8)
    values = [0.0625, 6.25, 0.295, 0.285, 2.675, 0.0005, 0.0015, -0.0005, 1e-9, 0.0, 12345.6785, 0.5, 999.9995, *rng.uniform(-50, 50, 300).tolist(), *(rng.integers(0, 20_000, 300) / 2000).tolist()]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select(*[fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 3, 6)], percent(F.col("v")).alias("p")).collect()
    for v, r in zip(values, got, strict=True):
        assert tuple(r) == (f"{v:.1f}", f"{v:.3f}", f"{v:.6f}", f"{100 * v:.1f}%"), v


def brute_lcs(x, y):
    row = [0] * (len(x) + 1)
    for t in y:
        last = row
        row = [0]
        for j, v in enumerate(x):
            row.append(last[j] + 1 if v == t else max(last[j + 1], row[j]))
    return row[-1]


def test_longest_common_subsequences_of_any_length(spark):
    """One and several machine words, at and beside their border."""
    rng = np.random.default_rng(11)
    pairs = [([str(t) for t in rng.integers(0, k, m)], [str(t) for t in rng.integers(0, k, n)]) for m in (0, 1, 2, 12, 59, 60, 61, 119, 120, 121, 200) for n, k in ((0, 3), (40, 3), (300, 25))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, v array<string>, t array<string>")
    got = {r.i: r.n for r in df.select("i", T.lcs_length(F.col("v"), F.col("t")).alias("n")).collect()}
    assert got == {i: brute_lcs(*p) for i, p in enumerate(pairs)}


def test_phrases_are_found_as_a_search_for_whole_words_finds_them(spark):
    import re

    from factloom.operators import phrases

    rng = np.random.default_rng(12)
    words = ["st.", "o'neal", "a", "b-b", "los", "Los", "é", "漢字", "\U0001f600", "x_1", "7", "'76ers", "&", "a.b", "  ", "\t", "."]
    make = lambda n: "".join(words[j] + (" " if rng.random() < 0.7 else "") for j in rng.integers(0, len(words), n))
    texts = [(f"g{i % 3}", i, make(60)) for i in range(12)] + [("g0", 90, ""), ("none", 91, "a a")]
    said = {(f"g{i % 3}", make(int(rng.integers(1, 4))).strip()) for i in range(200)} | {("g0", ""), ("g0", "a"), ("g1", "a"), ("g0", "nowhere")}
    word = r"[^\W]"
    want = {(g, i, p, m.start()) for g, i, t in texts for h, p in said if g == h and p for m in re.finditer(f"(?=(?<!{word}){re.escape(p)}(?!{word}))", t)}
    df = spark.createDataFrame(texts, "ex_id string, s int, text string")
    ph = spark.createDataFrame(sorted(said), "ex_id string, phrase string")
    got = {tuple(r) for r in phrases.occurrences(df, ph, "ex_id", ["ex_id", "s"]).collect()}
    assert got == want and len(got) > 100
    starts = spark.createDataFrame([([0, 2, 3, 6, 7],)], "s array<int>").select(phrases.apart(F.col("s"), F.lit(3)).alias("s")).first().s
    assert starts == [0, 3, 6]
