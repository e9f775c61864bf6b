"""Loaders, run joins, statistics and streaming."""

from __future__ import annotations

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import facts, generate, overlap, prompts, relations, report, runs, stats
from factloom.sources import loaders
from factloom.sources.cells import finish
from factloom.streaming import scoring


def test_e2e(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿MR,Ref\n"name[The Vaults], eatType[pub]","A pub, ""The Vaults""."\n"name[Other]",\n"name[The Vaults], eatType[pub]",Second.\n', encoding="utf-8")
    got = loaders.load(spark, "e2e", str(path), "dev").orderBy("pos").collect()
    assert [(r.id, r.references) for r in got] == [("e2e-dev-0000", ['A pub, "The Vaults".', "Second."]), ("e2e-dev-0001", [])]
    cells = loaders.e2e_cells(loaders.load(spark, "e2e", str(path), "dev"))
    assert {(r.col_name, r.text, r.is_key) for r in cells.filter("ex_id = 'e2e-dev-0000'").collect()} == {("name", "The Vaults", True), ("eatType", "pub", False)}
    with pytest.raises(ValueError):
        loaders.load(spark, "nope", str(path), "dev")
    with pytest.raises(Exception, match="no attributes"):
        spark.createDataFrame([("garbage",)], "mr string").select(loaders.parse_mr(F.col("mr"))).collect()


def test_rotowire(spark, tmp_path):
    box = {"PLAYER_NAME": {"10": "B Two", "2": "A One", "3": "C Bench"}, "FIRST_NAME": {"2": "A"}, "TEAM_CITY": {"10": "Y", "2": "X", "3": "X"}, "PTS": {"10": "7", "2": "12", "3": "N/A"}, "AAA": {"2": "1.5"}, "STL": {"2": "N/A", "10": "N/A"}}
    game = {"home_city": "X", "home_name": "Home", "vis_city": "Y", "vis_name": "Vis", "home_line": {"TEAM-PTS": "12", "TEAM-CITY": "X"}, "vis_line": {"TEAM-PTS": "7", "TEAM-AST": "N/A"}, "box_score": box, "summary": ["The", "end", "."]}
    path = tmp_path / "x.json"
    path.write_text(json.dumps([game, game | {"summary": []}]))
    ex = loaders.load(spark, "rotowire", str(path), "test")
    assert [(r.id, r.references) for r in ex.orderBy("pos").collect()] == [("rotowire-test-0000", ["The end ."]), ("rotowire-test-0001", [])]
    cells = loaders.rotowire_cells(ex).filter("ex_id LIKE '%0000'")
    players = [(r.row_idx, r.col_name, r.text) for r in cells.filter("sec_name = 'players'").orderBy("row_idx", "col_idx").collect()]
    assert [c for r, c, _ in players if r == 0] == ["PLAYER_NAME", "TEAM_CITY", "PTS", "AAA"] and [t for _, c, t in players if c == "PLAYER_NAME"] == ["A One", "B Two"]
    assert [(r.col_name, r.text) for r in cells.filter("sec_name = 'teams' AND row_idx = 1").orderBy("col_idx").collect()] == [("TEAM", "Y Vis"), ("TEAM-AST", None), ("TEAM-PTS", "7")]
    assert facts.team_facts(cells).first().winner == "X Home"


def test_box_scores_show_all_columns_in_order(spark):
    """Every known column, two that aren't, and players whose ids sort by number; missing values stand as null cells."""
    shown = (
        "PLAYER_NAME TEAM_CITY START_POSITION MIN PTS FGM FGA FG_PCT FG3M FG3A FG3_PCT FTM FTA FT_PCT OREB DREB REB AST STL BLK TO PF".split()
    )
    box = {c: {"11": f"{k}", "9": f"{k + 100}", "100": "N/A"} for k, c in enumerate(sorted([*shown, "ZZZ", "AAA", "FIRST_NAME", "SECOND_NAME"], key=lambda c: c[::-1]))}
    box["PLAYER_NAME"], box["TO"] = {"11": "Eleven", "9": "Nine", "100": "Bench"}, {"9": "3"}
    game = {"home_city": "X", "home_name": "Home", "vis_city": "Y", "vis_name": "Vis", "home_line": {"TEAM-PTS": "1"}, "vis_line": {"TEAM-PTS": "2"}, "box_score": box, "summary": []}
    game_type = loaders.GAME.replace(", summary", ">, summary").replace("home_city", "game struct<home_city", 1)
    examples = spark.createDataFrame([("g", {k: v for k, v in game.items() if k != "summary"}, [])], f"id string, {game_type}")
    cells = loaders.rotowire_cells(examples).filter("sec_name = 'players'").orderBy("row_idx", "col_idx").collect()
    assert [r.col_name for r in cells if r.row_idx == 0] == [*shown, "AAA", "ZZZ"]
    assert [r.text for r in cells if r.col_name == "PLAYER_NAME"] == ["Nine", "Eleven"] and [r.text for r in cells if r.col_name == "TO"] == ["3", None]


def test_box_scores_are_taken_apart_by_value(spark):
    """No value is looked up among all players: a game of 3000 is read in its order within a minute."""
    n, began = 3000, time.time()
    box = {"PLAYER_NAME": {str(i): f"P{i}" for i in range(n)}, "PTS": {str(i): str(i) for i in range(n) if i % 3}, "MIN": {str(i): "N/A" for i in range(n)}}
    examples = spark.createDataFrame([("g", ("X", "Home", "Y", "Vis", {"TEAM-PTS": "1"}, {"TEAM-PTS": "2"}, box))], f"id string, game struct<{loaders.GAME.replace(', summary array<string>', '')}>")
    cells = loaders.rotowire_cells(examples)
    found = cells.filter("sec_idx = 1").orderBy("row_idx", "col_idx").collect()
    assert [(r.row_idx, r.col_name, r.text, r.entity, r.n_sec_rows) for r in found] == [
        (k, c, v, f"P{i}", 2000) for k, i in enumerate(i for i in range(n) if i % 3) for c, v in (("PLAYER_NAME", f"P{i}"), ("PTS", str(i)))
    ]
    assert time.time() - began < 60


def test_cells_are_parsed_as_numbers_are_written(spark):
    values = ["12", "-3", "+4", " 7 ", "1_000", "1__0", "_1", "1d", "1f", "2.50", ".5", "5.", "1e3", "1_0.5", "12345678901234567890", "007", "inf", "nan", "1e400", "1,000", "abc", "N/A", "", None, "0x10", "12345678.5", "0.0001234", "0.00001", "1e16", "-2e22"]

    def parse(v):
        if v in (None, "", "N/A"):
            return (0, None)
        for kind in (int, float):
            try:
                return (1, str(kind(v)))
            except ValueError:
                pass
        return (2, v)

    cells = loaders.from_strings(spark.createDataFrame([("x", 0, "s", i, 0, "c", False, v) for i, v in enumerate(values)], "ex_id string, sec_idx int, sec_name string, row_idx int, col_idx int, col_name string, is_key boolean, value string"))
    assert [(r.kind, r.text) for r in cells.orderBy("row_idx").collect()] == [parse(v) for v in values]


def test_sampling_keeps_order(spark):
    ex = spark.createDataFrame([(i, f"x-{i:03d}") for i in range(50)], "pos int, id string")
    got = [r.pos for r in loaders.sample(ex, 10, 7).orderBy("pos").collect()]
    import random

    assert got == sorted(random.Random(7).sample(range(50), 10))
    assert loaders.sample(ex, 0, 7).count() == loaders.sample(ex, 99, 7).count() == 50
    assert [r.pos for r in loaders.sample(ex, 3, None).collect()] == [0, 1, 2]


def test_configs(tmp_path):
    assert loaders.config_hash({"a": 1, "b": 2}) == loaders.config_hash({"b": 2, "a": 1}) != loaders.config_hash({"a": 1, "b": 3})
    assert len(loaders.config_hash({})) == 10 and loaders.run_name({"x": 1}).startswith("run-")
    assert loaders.checkpoint_of({"checkpoint": "c", "train_config": "t"}) == "c"
    with pytest.raises(ValueError):
        loaders.checkpoint_of({})
    assert runs.run_label({"prompt": "rotowire/plain_v1", "serialisation": "factsheet"}) == "plain+fs" and runs.run_label({"name": "rw-full-soft"}) == "soft"


def test_resumable_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, output string")
    for _ in range(2):
        runs.append_generations(new, path)
    runs.append_generations(spark.createDataFrame([("b", "z"), ("c", "w")], "id string, output string"), path)
    assert sorted((r.id, r.output) for r in loaders.load_generations(spark, path).collect()) == [("a", "x"), ("b", "y"), ("c", "w")]
    kept, missing = runs.match_outputs(new, spark.createDataFrame([("a",)], "id string"))
    assert kept.count() == 1 and missing == 1


def test_generation_hook(spark):
    m = prompts.messages(spark.createDataFrame([("a", "first\nsecond")], "ex_id string, text string"), "e2e/plain_v1")
    assert tuple(generate.generate(m, generate.stub_backend).first()) == ("a", "first", -0.5)
    assert generate.wait_before(9, None) == 60.0 and generate.wait_before(1, 5) == 5


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    num = rng.integers(0, 4, 40)
    items = spark.createDataFrame([(r, i, int(num[i] + (r == "B")), 5) for r in "AB" for i in range(40)], "run string, item int, u long, n long")
    metrics = (stats.Metric("rate", "ratio", ("u", "n"), False), stats.Metric("share", "positive", ("u",), False), stats.Metric("mean", "mean", ("u",), True))
    w = stats.numpy_weights(spark, 40, 300)
    ci = {(r.run, r.metric): r for r in stats.bootstrap_ci(items, w, metrics).collect()}
    g = np.random.default_rng(13)
    draws = [num[g.integers(0, 40, 40)].mean() for _ in range(300)]
    lo, hi = np.percentile(draws, [2.5, 97.5])
    assert math.isclose(ci["A", "mean"].lo, lo, abs_tol=1e-9) and math.isclose(ci["A", "mean"].hi, hi, abs_tol=1e-9) and ci["A", "rate"].point == num.sum() / 200
    diff = {r.metric: r for r in stats.paired_diff(items, w, metrics, "B", "A").collect()}
    assert all(math.isclose(diff["mean"][c], 1.0, abs_tol=1e-9) for c in ("diff", "lo", "hi"))
    assert all(r.diff == r.lo == r.hi == 0 for r in stats.paired_diff(items, w, metrics, "A", "A").collect())
    folds = stats.fold_of(40, 3)
    assert sorted(np.bincount(list(folds.values()))) == [13, 13, 14]
    ranked = stats.ranks(stats.fold_points(items, folds, metrics), metrics, ("fold",))
    assert {(r.metric, r.run): r["rank"] for r in ranked.collect()} == {("rate", "A"): 1, ("rate", "B"): 2, ("share", "A"): 1, ("share", "B"): 2, ("mean", "B"): 1, ("mean", "A"): 2}
    assert stats.select_best(stats.points(items, metrics), metrics, ["rate", "mean"]).first().run == "A"
    assert [m.name for m in stats.active_metrics(items, (*metrics, stats.METRICS[0]))] == ["rate", "share", "mean"]
    with pytest.raises(ValueError):
        stats.fold_of(2, 3)
    d, low, high = stats.independent_diff([1, 1, 1], [0, 0], 200)
    assert d == low == high == 1


def test_draws_from_a_counter(spark):
    """Weights are Poisson, the same however the items are dealt out, shared by the runs; intervals as wide as numpy's."""
    w = stats.Draws(800).weights(np.arange(1500), np.arange(800))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01 and abs(np.corrcoef(w[:60]) - np.eye(60)).max() < 0.2
    rng = np.random.default_rng(5)
    u = rng.integers(0, 4, 300)
    items = spark.createDataFrame([(r, i, int(u[i] + (r == "B")), 5) for r in "AB" for i in range(300)] + [("A", 300, None, 5), ("B", 300, None, 5)], "run string, item int, u long, n long")
    metrics = (stats.Metric("rate", "ratio", ("u", "n"), False), stats.Metric("share", "positive", ("u",), False))
    one, many = ({(r.run, r.metric): (r.point, r.lo, r.hi) for r in stats.bootstrap_ci(items.repartition(k), stats.Draws(800), metrics).collect()} for k in (1, 7))
    assert one == many and len(one) == 4
    theirs = np.percentile([u[rng.integers(0, 300, 300)].mean() / 5 for _ in range(800)], [2.5, 97.5])
    low, high = (x * 301 / 300 for x in one["A", "rate"][1:])
    assert abs((high - low) - (theirs[1] - theirs[0])) < 0.2 * (theirs[1] - theirs[0]) and one["A", "rate"][1] < one["A", "rate"][0] < one["A", "rate"][2]
    diff = {r.metric: r for r in stats.paired_diff(items.filter("item < 300"), stats.Draws(800), metrics, "B", "A").collect()}["rate"]
    assert all(math.isclose(diff[c], 0.2, abs_tol=1e-9) for c in ("diff", "lo", "hi"))
    plan = stats.bootstrap_ci(items, stats.Draws(10), metrics)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of points and bounds


def test_folds_of_a_hashed_order(spark):
    items = spark.range(43).select(F.col("id").cast("int").alias("item")).repartition(5)
    fold = {r.item: r.fold for r in stats.hashed_folds(items, 5).collect()}
    assert sorted(np.bincount(list(fold.values()))) == [8, 8, 9, 9, 9] and sorted(fold) == list(range(43))
    assert fold == {r.item: r.fold for r in stats.hashed_folds(items.coalesce(1), 5).collect()} and fold != {r.item: r.fold for r in stats.hashed_folds(items, 5, 14).collect()}
    assert [fold[i] for i in range(43)] != sorted(fold.values()) and [stats.n_folds(n) for n in (399, 400)] == [3, 5]
    with pytest.raises(ValueError):
        stats.hashed_folds(items.limit(1), 2)


def test_rolling_rates_in_blocks(spark, monkeypatch):
    """Blocks shorter and longer than runs, a window wider than a block, ids out of order and repeated."""
    rng = np.random.default_rng(6)
    rows = [(r, f"{r}-{i}", int(rng.integers(5)), int(rng.integers(1, 9))) for r, n in (("A", 61), ("B", 7), ("C", 3)) for i in rng.permutation(n)] + [("A", "x-5", 1, 0)]
    items = spark.createDataFrame(rows, "run string, id string, u long, n long").repartition(3)
    for block, width in ((4, 3), (10, 7), (1024, 7), (4, 11)):
        monkeypatch.setattr(stats, "ROLLING_BLOCK", block)
        want = []
        for run in "ABC":
            mine = sorted((int(i.split("-")[1]), i, u, n) for r, i, u, n in rows if r == run)
            want += [(run, mine[k][0], sum(m[2] for m in mine[k - width + 1 : k + 1]) / sum(m[3] for m in mine[k - width + 1 : k + 1])) for k in range(width - 1, len(mine))]
        got = sorted(tuple(r) for r in stats.rolling_rate(items, "u", "n", width).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])


def test_independent_bounds(spark):
    metric = stats.Metric("err", "mean", ("err",), False)
    rows = [(i, i < 60, int(i % 3 == 0)) for i in range(100)]
    items = spark.createDataFrame(rows, "item int, first boolean, err int")
    r = stats.independent_bounds(items, stats.Draws(500), metric, "first", True, False).first()
    a, b = ([e for _, f, e in rows if f == side] for side in (True, False))
    d, low, high = stats.independent_diff(a, b, 500)
    assert math.isclose(r["diff"], d) and abs(r.lo - low) < 0.06 and abs(r.hi - high) < 0.06
    alone = stats.independent_bounds(items.filter("first"), stats.Draws(50), metric, "first", True, False).first()
    assert tuple(alone) == (None, None, None)


def test_missing_values_rank_last(spark):
    v = spark.createDataFrame([("a", "m", float("nan")), ("b", "m", 1.0), ("c", "m", 2.0)], "run string, metric string, value double")
    for up, want in ((True, ["c", "b", "a"]), (False, ["b", "c", "a"])):
        got = stats.ranks(v, [stats.Metric("m", "mean", ("x",), up)]).orderBy("rank").collect()
        assert [r.run for r in got] == want


def test_a_batch_that_fails_half_way_adds_nothing(spark, tmp_path):
    """The second task of the first attempt fails after the first has written; then the batch is retried, and repeated."""
    from factloom.sources.sink import Sink

    path, flag = str(tmp_path / "out"), tmp_path / "failed"
    @F.udf("string")
    def say(i):
        if i == 17 and not flag.exists():
            flag.write_text("")
            raise RuntimeError("lost")
        return f"text {i}"

    rows = spark.range(40).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("id"), say("id").alias("output"))
    sink = Sink(spark, path, loaders.GENERATION)
    with pytest.raises(Exception, match="lost"):
        sink.append(rows, "batch-1")
    assert sink.entries() == [] and sink.read().count() == 0
    assert [sink.append(rows, "batch-1") for _ in range(3)] == [40, 0, 0]
    assert sink.append(rows.limit(5).unionByName(spark.createDataFrame([("new", "x"), ("new", "y")], "id string, output string")), "batch-2") == 1
    assert [e["rows"] for e in sink.entries()] == [40, 1] and loaders.load_generations(spark, path).count() == 41


def test_writers_that_meet_keep_keys_unique(spark, tmp_path, monkeypatch):
    from factloom.sources.sink import Sink

    path = str(tmp_path / "out")
    mine, other = Sink(spark, path, loaders.GENERATION), Sink(spark, path, loaders.GENERATION)
    publish = mine._publish

    def late(number, entry):
        monkeypatch.setattr(mine, "_publish", publish)
        other.append(spark.createDataFrame([("a", "theirs"), ("b", "theirs")], "id string, output string"), "theirs")
        return publish(number, entry)

    monkeypatch.setattr(mine, "_publish", late)
    assert mine.append(spark.createDataFrame([("b", "mine"), ("c", "mine")], "id string, output string"), "mine") == 1
    assert sorted((r.id, r.output) for r in mine.read().collect()) == [("a", "theirs"), ("b", "theirs"), ("c", "mine")]
    assert len(list((tmp_path / "out" / "data").iterdir())) == 2


def test_reports(spark):
    ci = spark.createDataFrame([("m", "A", 0.5, 0.4, 0.6)], "metric string, run string, point double, lo double, hi double")
    assert runs.summary_lines(ci).first().line == "| m | A | 0.5000 [0.4000, 0.6000] |"
    pts = spark.createDataFrame([("A", "m", 0.5), ("B", "m", 0.25)], "run string, metric string, value double")
    assert runs.summary_csv(pts).first().asDict() == {"metric": "m", "A": "0.500000", "B": "0.250000"}
    d = spark.createDataFrame([("m", 0.1, -0.1, 0.3)], "metric string, diff double, lo double, hi double")
    assert tuple(runs.forest(d, {"m": True}).first()) == ("m", -0.1, -0.3, 0.1)
    shown = runs.run_table(spark.createDataFrame([("A",), ("B",)], "run string"), spark.createDataFrame([("A", 0.5, 1.5)], "run string, x_rate double, y double"))
    assert {tuple(r) for r in shown.collect()} == {("A", "50.0%", "1.500"), ("B", "–", "–")}


def test_streaming(spark, tmp_path):
    raw = [("g", 0, "teams", i, j, c, j == 0, 2 if j == 0 else 1, None if j == 0 else float(v[1]), j != 0, v[0] if j == 0 else None) for i, v in enumerate((("A Reds", 10), ("B Blues", 7))) for j, c in enumerate(("TEAM", "TEAM-PTS"))]
    cells = finish(spark.createDataFrame(raw, "ex_id string, sec_idx int, sec_name string, row_idx int, col_idx int, col_name string, is_key boolean, kind int, num double, is_int boolean, str string"))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(json.dumps({"id": "g", "output": "The Reds defeated the Blues 10 to 8."}) + "\n\n")
    q = scoring.score_stream(scoring.read_stream(spark, str(folder)), cells, facts.context(cells), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got.n_exact, got.n_supported, got.n_numbers, got.rel_n_claims, got.rel_n_wrong) == (1, 1, 2, 1, 0)


def test_bleu_is_compared_from_summed_counts(spark):
    metric = next(m for m in stats.METRICS if m.name == "bleu")
    rng = np.random.default_rng(11)
    rows = [(run, i, *(int(x) for x in (*sorted(rng.integers(1, 9, 4), reverse=True), 20, 19, 18, 17, 20, 18 + i % 5))) for run in "AB" for i in range(30)]
    items = spark.createDataFrame(rows, ["run", "item", *metric.columns])

    def bleu(counts: np.ndarray) -> float:
        s = counts.sum(axis=0)
        penalty = 1.0 if s[8] > s[9] else math.exp(1 - s[9] / s[8])
        return 100 * penalty * math.exp(sum(math.log(s[k] / s[4 + k]) / 4 for k in range(4)))

    by_run = {run: np.array([r[2:] for r in rows if r[0] == run], float) for run in "AB"}
    ci = {r.run: r for r in stats.bootstrap_ci(items, stats.numpy_weights(spark, 30, 200), [metric]).collect()}
    g = np.random.default_rng(13)
    draws = [g.integers(0, 30, 30) for _ in range(200)]
    for run, counts in by_run.items():
        lo, hi = np.percentile([bleu(counts[d]) for d in draws], [2.5, 97.5])
        assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip((ci[run].point, ci[run].lo, ci[run].hi), (bleu(counts), lo, hi), strict=True))
    best = max(by_run, key=lambda r: bleu(by_run[r]))
    values = stats.points(items, [metric])
    assert {r.run: r["rank"] for r in stats.ranks(values, [metric]).collect()}[best] == 1
    assert [m.name for m in stats.active_metrics(items, stats.METRICS)] == ["bleu"] and len(stats.METRICS) == 9


def battery_items(spark, n: int = 30):
    rng = np.random.default_rng(5)
    rows = []
    for run, worse in (("plain", 2), ("faithful+fs", 0), ("soft", 1)):
        for i in range(n):
            claims, nums = 6, 8
            rows.append((run, f"g-{i:04d}", nums, int(rng.integers(0, 2 + worse)), claims, int(rng.integers(0, 1 + worse)), 5, 3, int(rng.integers(0, 2)), 0.4 + 0.01 * (i % 7) - 0.05 * worse))
    rows.append(("plain", "g-9999", 1, 0, 1, 0, 1, 1, 0, 0.5))
    return spark.createDataFrame(rows, "run string, id string, num_n_numbers long, num_n_unsupported long, rel_n_claims long, rel_n_wrong long, cl_n_claims long, cl_n_entailed long, cl_n_contradicted long, parent_f1 double")


def test_battery_report(spark):
    items = battery_items(spark)
    weights = stats.numpy_weights(spark, 30, 200)
    found = report.battery(items, ["plain", "faithful+fs", "soft"], n_boot=200, weights=weights)
    assert found.winner == "faithful+fs" and found.n_items == 30 and found.n_dropped == 1 and found.n_folds == 3
    assert [m.name for m in found.metrics] == ["rel_wrong", "rel_items", "num_unsupported", "entailed", "contra_claims", "contra_items", "parent"]
    held = {(r.run, r.id): r for r in items.collect()}
    mine = [held["plain", f"g-{i:04d}"] for i in range(30)]
    csv = report.summary_csv(found).split("\r\n")
    assert csv[0] == "metric,higher_better,plain,faithful+fs,soft" and csv[1].startswith(f"Wrong relational claims,False,{sum(r.rel_n_wrong for r in mine) / 180:.6f},0.000000,")
    text = report.summary_md(found)
    assert "- **Selected prompt: `faithful+fs`**" in text and "| Wrong relational claims | plain |" in text and "| yes |" in text
    folds = [line for line in text.split("\n") if line.startswith(("| 1 |", "| 2 |", "| 3 |"))]
    assert len(folds) == 3 and all(line.split("|")[3].strip() == "1" for line in folds)
    assert {r.rival for r in report.forest(found).collect()} == {"plain", "soft"} and all(r.diff >= 0 for r in report.forest(found).filter("metric = 'rel_wrong'").collect())
    point = report.panels(found).filter("metric = 'parent' AND run = 'soft'").first()
    assert point.lo <= point.point <= point.hi < 1 and report.panels(found).filter("metric = 'entailed'").first().point == 60.0
    assert {r.panel for r in report.decomposition(found, weights).collect()} == {"volume", "contra_items", "contra_claims"}
    assert report.rolling(found, 10).count() == 3 * 21 and report.rolling(found, 10).agg(F.min("x")).first()[0] == 5.0
    assert report.distribution(found).count() == 90
    for bad in (["plain", "plain"], []):
        with pytest.raises((ValueError, AttributeError)):
            report.battery(items.limit(0) if not bad else items, bad)


def test_items_are_checked(spark):
    metrics = [stats.Metric("m", "mean", ("x",), True)]
    rows = lambda *r: spark.createDataFrame(r, "run string, item int, x double")
    stats.check_items(rows(("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 0.0)), metrics)
    for bad in (rows(("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 0.0)), rows(("a", 0, 1.0), ("a", 1, None)), rows(("a", 0, 1.0)).limit(0), rows(("a", 0, 1.0), ("a", 0, 1.0)), rows(("a", 0, 1.0)).drop("x")):
        with pytest.raises(ValueError):
            stats.check_items(bad, metrics)


def test_item_records_and_reports(spark):
    outputs = spark.createDataFrame([("a", "one text", -0.25), ("b", "another", None)], "id string, output string, seq_logprob double")
    numbers = spark.createDataFrame([("a", 3, 1, 1, 2, [7.5]), ("b", 0, 0, 0, 0, [])], "id string, n_numbers long, n_exact long, n_derived long, n_supported long, unsupported array<double>")
    wrong = "array<struct<pos:int,part:int,clause_no:int,seg_no:int,k:int,type:string,sentence:string,claimed:string,expected:string>>"
    rel = spark.createDataFrame([("a", 2, 1, [(0, 0, 0, 0, 0, "winner", "A won.", "A", "B")]), ("b", 0, 0, [])], f"id string, n_claims long, n_wrong long, wrong {wrong}")
    parent = spark.createDataFrame([("a", 0.5)], "id string, f1 double")
    records = report.item_records(outputs, numbers, rel, parent=parent)
    flat = report.flatten(records, outputs)
    assert set(flat.columns) == {"id", "num_n_numbers", "num_n_unsupported", "rel_n_claims", "rel_n_wrong"}
    assert {tuple(r) for r in flat.collect()} == {("a", 3, 1, 2, 1), ("b", 0, 0, 0, 0)}
    examples = spark.createDataFrame([("a", ["ref", "other"]), ("b", [])], "id string, references array<string>")
    got = {r.id: r.lines for r in report.item_report(records, outputs, examples).collect()}
    assert got["a"] == ["[a]", "REFERENCE : ref", "            (+1 more reference(s))", "GENERATED : one text", "METRICS   : number-check: 3 number(s), 1 via derivation, 1 unsupported -> [7.5] | PARENT F1: 0.500 | seq-logprob: -0.250 | relations: 1/2 wrong", "  REL-WINNER: A won.  [claimed: A | table: B]"]
    assert got["b"][1] == "REFERENCE : (no reference)"
    table = report.run_comparison([({"name": "x", "prompt": "p"}, {"numbers": {"items": 4, "number_support_rate_micro": 0.5}, "parent": {"parent_f1": 0.25}}), ({}, None)])
    assert table[1][:4] == ["x", "p", "4", "50.0%"] and table[1][-2:] == ["0.250", "-"] and table[2][:3] == ["?", "?", "(no metrics.json yet)"]


def test_run_files(tmp_path):
    report.write_meta({"name": "n", "b": 1}, str(tmp_path / "run"))
    assert json.loads((tmp_path / "run" / "meta.json").read_text()) == {"config": {"name": "n", "b": 1}, "config_hash": loaders.config_hash({"b": 1, "name": "n"})}
    log = tmp_path / "log.jsonl"
    log.write_text("".join(json.dumps({"step": i}) + "\n" for i in range(5)) + "\n")
    assert report.rewrite_log(str(log), 2) == 2 and [json.loads(x)["step"] for x in log.read_text().splitlines()] == [0, 1, 2]
    report.set_seed(3)
    first = (np.random.rand(), __import__("random").random())
    report.set_seed(3)
    assert first == (np.random.rand(), __import__("random").random())


def test_cooccurrence_entailment(spark):
    cells = spark.createDataFrame([("t", 0, "s", 0, k, c, k == 0, "x", 2, None, False, v, v, 1) for k, (c, v) in enumerate((("first name", "michael"), ("team", "reds")))], "ex_id string, sec_idx int, sec_name string, row_idx int, col_idx int, col_name string, is_key boolean, entity string, kind int, num double, is_int boolean, str string, text string, n_sec_rows int")
    counts = spark.createDataFrame([("michael", 4), ("michael|||played", 2), ("reds", 10), ("reds|||played", 1), ("first_name", 2), ("first_name|||called", 1), ("blues|||lost", 3)], "key string, count long")
    grams = [["michael", "reds"], ["michael", "played"], ["called"], ["lost"], ["first_name"]]
    got = {tuple(r.gram): r.probability for r in overlap.cooccurrence_entailment(spark.createDataFrame([("t", g) for g in grams], "id string, gram array<string>"), cells, overlap.cooccurrence_ratios(counts)).collect()}
    assert got == {("michael", "reds"): 1.0, ("michael", "played"): 0.5**0.5, ("called",): 0.5, ("lost",): 0.0, ("first_name",): 1.0}


def test_positional_report(spark):
    games = spark.createDataFrame([(f"g{i}", "A", "B", False, "A" if i < 6 else "B") for i in range(10)] + [("t", "A", "B", True, None)], "ex_id string, team0 string, team1 string, tie boolean, winner string")
    claims = [(f"g{i}", "winner", "B" if i < 6 else "A", "x", i in (0, 7, 8)) for i in range(10)]
    found = spark.createDataFrame([(i, t, c, e, not w) for i, t, c, e, w in claims], "id string, type string, claimed string, expected string, correct boolean")
    r = relations.positional_report(games.select(F.col("ex_id").alias("id")), found, games, 500).first()
    assert (r.n_first, r.n_second, r.err_first, r.err_second, r.named_first, r.named_second) == (6, 4, 1, 2, 2, 1)
    assert math.isclose(r["diff"], 1 / 6 - 0.5) and r.lo <= r["diff"] <= r.hi


def winner_backend():
    """Names the first team of each table as the winner."""

    def run(asked):
        out = []
        for p in asked:
            rows = [line.split(" | ") for line in p[-1]["content"].split("\n") if line.startswith("| ")]
            first, second = (r[0].removeprefix("| ") for r in rows[2:4] if len(r) > 1)
            out.append((f" The {first} defeated the {second} 12 to 7. The {first} had won again. ", -0.12345))
        return out

    return run


def test_a_run_from_the_command_line(spark, tmp_path, capsys):
    import sys

    from pyspark import cloudpickle

    import factloom.__main__ as cli

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find the tests
    box = {"PLAYER_NAME": {"1": "A One", "2": "B Two"}, "TEAM_CITY": {"1": "X", "2": "Y"}, "PTS": {"1": "12", "2": "7"}}
    games = [{"home_city": "X", "home_name": f"Home{i}", "vis_city": "Y", "vis_name": "Vis", "home_line": {"TEAM-PTS": str(12 if i % 2 else 3)}, "vis_line": {"TEAM-PTS": "7"}, "box_score": box, "summary": ["The", "X", f"Home{i}", "defeated", "the", "Y", "Vis", "12", "to", "7", "."]} for i in range(4)]
    data, results = tmp_path / "games.json", str(tmp_path / "results")
    data.write_text(json.dumps(games))
    paths = []
    for kind in ("plain", "strict"):
        path = tmp_path / f"{kind}.yaml"
        path.write_text(f"name: x-{kind}\ndataset: rotowire\nsplit: test\nprompt: rotowire/{kind}_v1\n")
        paths.append(str(path))
    run = lambda *a, of=paths: (cli.main([*a, "--config", *of, "--data", str(data), "--results", results]), capsys.readouterr().out)[1]
    for of in (paths, paths[:1]):  # a second time nothing is left to generate
        run("generate", "--backend", "test_runs:winner_backend", of=of)
    assert "(no metrics.json yet)" in run("compare")
    metrics = json.loads("[" + run("evaluate", "--parent", "--claims", "factloom.operators.claims:score_with_stub").replace("}\n{", "},\n{") + "]")
    assert metrics[0]["numbers"]["items"] == 4 and metrics[0]["relations"]["relational_wrong"] == 2 and metrics[0]["relations"]["wrong_by_type"] == {"winner": 2}
    assert metrics[0]["uncertainty"] == {"mean_seq_logprob": -0.1234 if metrics[0]["uncertainty"]["mean_seq_logprob"] > -0.12345 else -0.1235, "items": 4}
    assert metrics[0]["claims"]["total_claims"] == 8 and 0 < metrics[0]["parent"]["parent_f1"] < 1 and metrics[0]["bleu"]["bleu"] > 0
    table = run("compare").split("\n")
    assert table[2].split()[:4] == ["x-plain", "rotowire/plain_v1", "4", "83.3%"] or table[2].split()[2] == "4"
    lines = run("show", "--n", "1", of=paths[:1])
    assert "[rotowire-test-0000]" in lines and "REL-WINNER" in lines and "claims entailed: 1/2" in lines and "Shown 1 of 4" in lines
    bias = json.loads(run("bias", of=paths[:1]))
    assert (bias["n_first"], bias["n_second"], bias["err_first"], bias["err_second"], bias["named_first"]) == (2, 2, 0, 2, 2)
    out = str(tmp_path / "out")
    assert "4 paired items; selected: plain" in run("report", "--out", out, "--n-boot", "50")
    with open(f"{out}/summary.md", encoding="utf-8") as f:
        assert "| BLEU ↑ |" in f.read()


def test_claim_rows_from_sql(spark):
    """The table function gives the units that the columns give, for plain and odd texts."""
    from factloom.functions import text as T
    from factloom.operators import table_functions

    texts = ["The A beat the B 3 to 2; the C lost, while the D won it. And so, and The end came near!", "", None, "no.", " \u00a0 One two three.\u2003Four five six, and Seven eight nine? \"Ten eleven twelve.\" ", "é à ü words here now; ,x y z, and Then some more words,"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table_functions.register(spark)
    got = sorted((r.id, r.pos, r.unit) for r in spark.sql("SELECT d.id, c.pos, c.unit FROM {df} d, LATERAL claim_rows(d.text) c", df=df).collect())
    want = [(r.id, r.pos, r.unit) for r in df.select("id", F.posexplode(T.claim_units(F.col("text"))).alias("pos", "unit")).orderBy("id", "pos").collect()]
    assert got == want and len(got) > 5


def test_training_rows(spark):
    from factloom.operators import dataset

    assert dataset.split_prompt([1, 9, 9, 2], [9, 9]) == ([1], [2])
    with pytest.raises(ValueError):
        dataset.split_prompt([1, 2], [9])
    with pytest.raises(ValueError):
        dataset.training_rows(None, None, None, ((), ()), 2, "other")
    cells = spark.createDataFrame([("g", 0, "teams", r, c, n, c == 0, t, k, v, t, 2) for r, row in enumerate([("A B", "10"), ("C D", "7")]) for c, (n, t) in enumerate(zip(("TEAM", "TEAM-PTS"), row)) for k, v in [(2, None) if c == 0 else (1, float(t))]],
        "ex_id string, sec_idx int, sec_name string, row_idx int, col_idx int, col_name string, is_key boolean, text string, kind int, num double, str string, n_sec_rows int")
    cells = cells.withColumn("entity", F.when(F.col("row_idx") == 0, "A B").otherwise("C D")).withColumn("is_int", F.lit(True))
    examples = spark.createDataFrame([("g", ["The A B defeated the C D 10 to 7. Nothing here.", "The C D defeated the A B 10 to 7.", "third"])], "ex_id string, references array<string>")
    ids = lambda t: F.transform(F.split(t, " "), lambda w: F.length(w))
    rows = dataset.training_rows(examples, cells, ids, ([1], [2]), 99, "replacement", True, 2, 20)
    got = rows.collect()
    assert [(r.ex_id, r.ref, r.aux_labels, r.ref_ids[-1], r.table_ids, r.prefix, r.suffix) for r in got] == [("g", 0, [1, 1, 1, 1], 99, [], [1], [2])]
    assert dataset.n_dropped(examples, rows, 2) == 1
    cut = dataset.training_rows(examples, cells, ids, ([1], [2]), 99, "augmentation", False, 3, 3).orderBy("ref").collect()
    assert [len(r.ref_ids) for r in cut] == [3, 3, 2] and cut[2].ref_ids == [5, 99] and all(len(r.table_ids) > 3 for r in cut) and cut[2].aux_labels == [0, 0, 0, 0]
    many = spark.createDataFrame([(f"e{i:03d}", 0, [1], [0] * 5, [2], [7] * (i % 4 + 1)) for i in range(30)], "ex_id string, ref int, prefix array<int>, table_ids array<int>, suffix array<int>, ref_ids array<int>")
    batches = {}
    for r in dataset.pack(many, 40).collect():
        batches.setdefault((r.block, r.batch), []).append(7 + len(r.ref_ids))
    assert sum(map(len, batches.values())) == 30 and all(sum(b) - b[-1] < 40 + 11 for b in batches.values()) and len(batches) == 7  # 283 ids, 274 of them before the last row
