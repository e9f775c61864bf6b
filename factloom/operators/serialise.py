"""Tables as text: markdown, fact sheets, and the prompts that carry them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import facts
from factloom.operators.relations import _whole

# Thresholds, labels and their order.
NOTABLE = {"PTS": 20, "REB": 10, "AST": 10}
DOUBLE_AT = 10
SECONDARY = 2
TEAM_STATS = {
    "TEAM-PTS": "points",
    "TEAM-FG_PCT": "field-goal %",
    "TEAM-FG3_PCT": "three-point %",
    "TEAM-FT_PCT": "free-throw %",
    "TEAM-REB": "rebounds",
    "TEAM-AST": "assists",
    "TEAM-TOV": "turnovers",
}


def _lines(df: DataFrame, keys: list[str], order: list[str], line: str, sep: str = "\n") -> DataFrame:
    """Ordered lines of each group as one text."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line]), sep).alias(line))


def to_markdown(cells: DataFrame) -> DataFrame:
    """(ex_id, text): sections with a blank line between; a single row stands as attribute and value pairs."""
    shown = F.coalesce(F.replace(F.col("text"), F.lit("|"), F.lit(r"\|")), F.lit("N/A"))
    c = cells.withColumn("shown", shown)
    pair = F.concat(F.lit("| "), F.col("col_name"), F.lit(" | "), F.col("shown"), F.lit(" |"))
    single = _lines(c.filter("n_sec_rows = 1").withColumn("line", pair), ["ex_id", "sec_idx", "sec_name"], ["col_idx"], "line")
    head = "\n| attribute | value |\n| --- | --- |\n"
    single = single.select("ex_id", "sec_idx", F.concat(F.lit("### "), "sec_name", F.lit(head), "line").alias("section"))
    many = c.filter("n_sec_rows > 1")
    rows = many.groupBy("ex_id", "sec_idx", "sec_name", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "shown", "col_name"))).alias("r"))
    bar = lambda field: F.concat(F.lit("| "), F.array_join(F.transform("r", lambda x: x[field]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("r")))
    rows = rows.select("ex_id", "sec_idx", "sec_name", "row_idx", F.when(F.col("row_idx") == 0, F.concat_ws("\n", bar("col_name"), rule, bar("shown"))).otherwise(bar("shown")).alias("line"))
    multi = _lines(rows, ["ex_id", "sec_idx", "sec_name"], ["row_idx"], "line")
    multi = multi.select("ex_id", "sec_idx", F.concat(F.lit("### "), "sec_name", F.lit("\n"), "line").alias("section"))
    return _lines(single.unionByName(multi), ["ex_id"], ["sec_idx"], "section", "\n\n").withColumnRenamed("section", "text")


def _count(n: Column, word: str) -> Column:
    return F.concat(_whole(n), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def _listed(names: Column) -> Column:
    """a, b and c"""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def _shooting(row: Column) -> Column:
    return F.when(row["FGM"].isNotNull() & row["FGA"].isNotNull(), F.concat(_whole(row["FGM"]), F.lit("-of-"), _whole(row["FGA"]), F.lit(" shooting")))


def _notables(rows: DataFrame) -> DataFrame:
    """(ex_id, notables): a sentence per player over a threshold, best scorers first."""
    over = lambda s, least: F.coalesce(F.col(s) >= least, F.lit(False))
    keep = F.lit(False)
    for s, least in NOTABLE.items():
        keep = keep | over(s, least)
    words = {"PTS": "point", "REB": "rebound", "AST": "assist", "STL": "steal", "BLK": "block"}
    parts = F.array(*[F.when(F.col(s).isNotNull() if s in NOTABLE else over(s, DOUBLE_AT), _count(F.col(s), w)) for s, w in words.items()])
    doubles = sum((over(s, DOUBLE_AT).cast("int") for s in words), F.lit(0))
    badge = F.when(doubles >= 3, ", a triple-double").when(doubles == 2, ", a double-double").otherwise("")
    line = F.concat(F.col("player"), F.lit(" had "), _listed(F.array_compact(parts)), badge, F.lit("."))
    return _lines(rows.filter(keep).select("ex_id", (-F.coalesce("PTS", F.lit(-1.0))).alias("k"), "player", line.alias("notables")), ["ex_id"], ["k", "player"], "notables")


def _leaders(rows: DataFrame) -> DataFrame:
    """(ex_id, side, city scope) lines of the leaders and of the next scorers of each team with players of its own.

    Only players at a maximum, and the next scorers, are gathered: no array holds a team's roster.
    """
    rows = rows.withColumn("scope", F.lower("city"))
    own = rows.filter("team IS NOT NULL")
    player = F.struct("player", "PTS", "REB", "AST", "FGM", "FGA")
    teams = own.groupBy("ex_id", "team", "side").agg(F.min_by("scope", "row_idx").alias("scope"))
    stats = ("PTS", "REB", "AST")
    best = rows.groupBy("ex_id", "scope").agg(*[F.max(s).alias(f"best_{s}") for s in stats])
    at = {s: F.col(s) == F.col(f"best_{s}") for s in stats}
    tops = rows.join(best, ["ex_id", "scope"]).filter(at["PTS"] | at["REB"] | at["AST"]).groupBy("ex_id", "scope").agg(*[F.array_sort(F.collect_list(F.when(at[s], player))).alias(f"top_{s}") for s in stats])
    kind = "array<struct<player:string,PTS:double,REB:double,AST:double,FGM:double,FGA:double>>"
    t = teams.join(tops, ["ex_id", "scope"], "left").select(*teams.columns, *[F.coalesce(f"top_{s}", F.array().cast(kind)).alias(f"top_{s}") for s in stats])
    leading = t.select("ex_id", "team", "side", F.explode(F.array_distinct(F.transform("top_PTS", lambda p: p["player"]))).alias("player"))
    rest = own.filter("PTS IS NOT NULL").join(leading, ["ex_id", "team", "side", "player"], "left_anti").select("ex_id", "team", "side", (-F.col("PTS")).alias("k"), "player")
    place = F.row_number().over(Window.partitionBy("ex_id", "team", "side").orderBy("k", "player"))
    ranked = rest.withColumn("place", place).filter(F.col("place") <= SECONDARY).groupBy("ex_id", "team", "side").agg(F.array_sort(F.collect_list(F.struct("k", "player"))).alias("ranked"))
    t = t.join(ranked, ["ex_id", "team", "side"], "left")
    names = lambda a: F.transform(a, lambda p: p["player"])
    first = F.get("top_PTS", F.lit(0))
    one = F.concat(first["player"], F.lit(" with "), _count(first["PTS"], "point"), F.coalesce(F.concat(F.lit(" on "), _shooting(first)), F.lit("")))
    shown = F.transform("top_PTS", lambda p: F.coalesce(F.concat(p["player"], F.lit(" ("), _shooting(p), F.lit(")")), p["player"]))
    many = F.concat(_listed(shown), F.lit(" with "), _count(first["PTS"], "point"), F.lit(" each"))
    scorer = F.when(F.size("top_PTS") > 0, F.concat(F.col("team"), F.lit(" top scorer: "), F.when(F.size("top_PTS") == 1, one).otherwise(many), F.lit(".")))

    def other(stat: str, label: str, word: str) -> Column:
        got = F.col(f"top_{stat}")
        each = F.when(F.size(got) > 1, " each").otherwise("")
        return F.when(F.size(got) > 0, F.concat(F.col("team"), F.lit(f" {label}: "), _listed(names(got)), F.lit(" with "), _count(F.get(got, F.lit(0))[stat], word), each, F.lit(".")))

    lines = F.array_join(F.array_compact(F.array(scorer, other("REB", "top rebounder", "rebound"), other("AST", "top assists", "assist"))), "\n")
    ranked = F.coalesce("ranked", F.array().cast("array<struct<k:double,player:string>>"))
    more = F.transform(ranked, lambda p: F.concat(p["player"], F.lit(" "), _count(-p["k"], "point")))
    secondary = F.when(F.size(ranked) > 0, F.concat(F.col("team"), F.lit(": "), F.array_join(more, "; "), F.lit(".")))
    return t.select("ex_id", "side", F.when(lines != "", lines).alias("leaders"), secondary.alias("secondary"))


def to_factsheet(cells: DataFrame) -> DataFrame:
    """(ex_id, text): a box-score sheet for games, labelled lines for any other table."""
    f = facts.team_facts(cells)
    box = f.join(facts.team_rows(cells), "ex_id")
    record = F.when(F.col("wins").try_cast("double").isNotNull() & F.col("losses").try_cast("double").isNotNull(), F.concat(F.lit("The "), "team", F.lit(" are now "), "wins", F.lit("-"), "losses", F.lit(".")))
    records = _lines(box.withColumn("records", record).filter("records IS NOT NULL"), ["ex_id"], ["row_idx"], "records")
    team = facts.team_cells(cells)
    label, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (c, name) in enumerate(TEAM_STATS.items()):
        label, rank = F.when(F.upper("col_name") == c, name).otherwise(label), F.when(F.upper("col_name") == c, k).otherwise(rank)
    stats = team.select("ex_id", "row_idx", "entity", rank.alias("rank"), F.concat(label, F.lit(": "), "text").alias("stat")).filter("stat IS NOT NULL")
    totals = _lines(stats, ["ex_id", "row_idx", "entity"], ["rank"], "stat", "; ").select("ex_id", "row_idx", F.concat("entity", F.lit(" -- "), "stat").alias("totals"))
    totals = _lines(totals, ["ex_id"], ["row_idx"], "totals")
    rows = facts.with_team(facts.player_rows(cells), f).join(f.select("ex_id", "team0"), "ex_id").withColumn("side", F.when(F.col("team") == F.col("team0"), 0).otherwise(1)).drop("team0")
    led = _leaders(rows)
    leaders = _lines(led.filter("leaders IS NOT NULL"), ["ex_id"], ["side"], "leaders")
    secondary = _lines(led.filter("secondary IS NOT NULL"), ["ex_id"], ["side"], "secondary")
    sheet = f
    for part in (records, totals, leaders, _notables(rows), secondary):
        sheet = sheet.join(part, "ex_id", "left")
    s = F.lit
    tied = F.concat(s("The "), "team0", s(" and the "), "team1", s(" finished tied at "), _whole(F.col("pts0")), s(" points apiece."))
    won = F.concat(s("The "), "winner", s(" defeated the "), "loser", s(" "), _whole(F.greatest("pts0", "pts1")), s(" to "), _whole(F.least("pts0", "pts1")), s(" (margin "), _whole(F.col("margin")), s(")."))
    result = F.when(F.col("tie"), tied).otherwise(won)
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(s(f"\n\n{title}:\n"), c)).otherwise("")
    text = F.concat(
        result, F.coalesce(F.concat(s("\n"), "records"), s("")), s("\n\nTeam totals:"), F.coalesce(F.concat(s("\n"), "totals"), s("")),
        part("Team leaders", "leaders"), part("Notable performances", "notables"), part("Other scorers", "secondary"),
    )
    games = sheet.select("ex_id", text.alias("text"))
    return games.unionByName(_generic_sheet(cells.join(f.select("ex_id"), "ex_id", "left_anti")))


def _generic_sheet(cells: DataFrame) -> DataFrame:
    """Labelled attribute and value lines; section headers only where there are several sections."""
    said = F.concat("col_name", F.lit(": "), "text")
    single = cells.filter("n_sec_rows = 1 AND text IS NOT NULL").select("ex_id", "sec_idx", "sec_name", F.col("col_idx").alias("k"), said.alias("line"))
    others = cells.filter("n_sec_rows > 1").withColumn("said", F.when(~F.col("is_key"), said))
    rows = others.groupBy("ex_id", "sec_idx", "sec_name", "row_idx", "entity").agg(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("col_idx", "said")))).alias("f"))
    multi = rows.select("ex_id", "sec_idx", "sec_name", F.col("row_idx").alias("k"), F.concat("entity", F.lit(" -- "), F.array_join(F.transform("f", lambda x: x["said"]), "; ")).alias("line"))
    body = _lines(single.unionByName(multi), ["ex_id", "sec_idx", "sec_name"], ["k"], "line")
    several = F.count(F.lit(1)).over(Window.partitionBy("ex_id")) > 1
    headed = body.withColumn("line", F.when(several, F.concat("sec_name", F.lit(":\n"), "line")).otherwise(F.col("line")))
    return _lines(headed, ["ex_id"], ["sec_idx"], "line").withColumnRenamed("line", "text")


SERIALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {"markdown": to_markdown, "factsheet": to_factsheet}


def get_serialiser(name: str) -> Callable[[DataFrame], DataFrame]:
    """The serialiser of that name; KeyError for any other."""
    if name not in SERIALISERS:
        raise KeyError(f"unknown serialiser {name!r}; there are {sorted(SERIALISERS)}")
    return SERIALISERS[name]
