"""Facts derived from box-score cells: result, aliases, players, leaders.

A game is a table with a section whose name holds "team" and that has two rows, both with a numeric TEAM-PTS; other
tables have no facts. A table's rows come from one document, so groups by table stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import surname, tokens
from factloom.sources.staging import staged

STATS = ("PTS", "REB", "AST", "STL", "BLK", "FGM", "FGA")
LEADER_STATS = ("PTS", "REB", "AST")


def _pick(cells: DataFrame, keep) -> DataFrame:
    """The cells of each table's first section for which ``keep`` holds."""
    first = Window.partitionBy("ex_id")
    return cells.filter(keep).withColumn("first_sec", F.min("sec_idx").over(first)).filter(F.col("sec_idx") == F.col("first_sec")).drop("first_sec")


def team_cells(cells: DataFrame) -> DataFrame:
    return _pick(cells, F.lower("sec_name").contains("team") & (F.col("n_sec_rows") == 2))


def player_cells(cells: DataFrame) -> DataFrame:
    return _pick(cells, F.lower("sec_name") == "players")


def _value(name: str, column: str = "num"):
    """The last cell of a column in the row's group, whatever the case of its name."""
    return F.max_by(F.when(F.col("kind") == 1, F.col(column)) if column == "num" else F.col(column), F.when(F.upper("col_name") == name, F.col("col_idx")))


def team_rows(cells: DataFrame) -> DataFrame:
    """(ex_id, row_idx, team, pts, and the other team columns as text): one row per team of a team section."""
    return team_cells(cells).groupBy("ex_id", "row_idx").agg(
        F.max("entity").alias("team"), _value("TEAM-PTS").alias("pts"), _value("TEAM-PTS", "is_int").alias("pts_int"), _value("TEAM-WINS", "text").alias("wins"), _value("TEAM-LOSSES", "text").alias("losses"),
    )


def team_facts(cells: DataFrame) -> DataFrame:
    """(ex_id, team0, team1, pts0, pts1, tie, winner, loser, margin): games only."""
    at = lambda c, i: F.max(F.when(F.col("row_idx") == i, F.col(c))).alias(f"{c}{i}")
    g = team_rows(cells).groupBy("ex_id").agg(*[at(c, i) for c in ("team", "pts") for i in (0, 1)])
    g = g.filter(F.col("pts0").isNotNull() & F.col("pts1").isNotNull())
    first = F.col("pts0") > F.col("pts1")
    tie = F.col("pts0") == F.col("pts1")
    return g.select(
        "*", tie.alias("tie"), F.when(~tie, F.when(first, F.col("team0")).otherwise(F.col("team1"))).alias("winner"),
        F.when(~tie, F.when(first, F.col("team1")).otherwise(F.col("team0"))).alias("loser"), F.abs(F.col("pts0") - F.col("pts1")).alias("margin"),
    )


def team_aliases(facts: DataFrame) -> DataFrame:
    """(ex_id, alias, team): full names, nicknames and cities that only one team has; a later alias replaces an equal one."""
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    city = lambda t: F.lower(F.array_join(F.slice(words(t), F.lit(1), F.size(words(t)) - 1), " "))
    entries = []
    for i in (0, 1):
        t = F.col(f"team{i}")
        own = F.when((city(t) != "") & (city(F.col("team0")) != city(F.col("team1"))), city(t))
        for k, alias in enumerate((F.lower(t), F.lower(F.element_at(words(t), -1)), own)):
            entries.append(F.struct(alias.alias("alias"), t.alias("team"), F.lit(3 * i + k).alias("k")))
    rows = facts.select("ex_id", F.explode(F.array(*entries)).alias("a")).filter("a.alias IS NOT NULL")
    return rows.groupBy("ex_id", F.col("a.alias").alias("alias")).agg(F.max_by("a.team", "a.k").alias("team"))


def player_rows(cells: DataFrame) -> DataFrame:
    """(ex_id, row_idx, player, city, surname, n_surname, statistics): the last row of each name; surnames count rows."""
    rows = player_cells(cells).groupBy("ex_id", "row_idx").agg(
        F.max("entity").alias("player"), F.coalesce(_value("TEAM_CITY", "text"), F.lit("")).alias("city"), *[_value(s).alias(s) for s in STATS]
    )
    rows = rows.withColumn("surname", surname(F.col("player"))).withColumn("n_surname", F.count(F.lit(1)).over(Window.partitionBy("ex_id", "surname")))
    last = F.max("row_idx").over(Window.partitionBy("ex_id", "player"))
    return rows.withColumn("last", last).filter(F.col("row_idx") == F.col("last")).drop("last")


def player_aliases(rows: DataFrame) -> DataFrame:
    """(ex_id, alias, player): full names, and surnames that one row of the game has."""
    entries = F.array(F.struct(F.lower("player").alias("alias"), F.col("row_idx").alias("k")), F.struct(F.when(F.col("n_surname") == 1, F.col("surname")).alias("alias"), (F.col("row_idx") + 1_000_000).alias("k")))
    out = rows.select("ex_id", "player", F.explode(entries).alias("a")).filter("a.alias IS NOT NULL")
    return out.groupBy("ex_id", F.col("a.alias").alias("alias")).agg(F.max_by("player", "a.k").alias("player"))


def leaders(rows: DataFrame) -> DataFrame:
    """(ex_id, scope, stat, best, players): all players at the maximum, per city and over the game (scope ``*``)."""
    pairs = F.array(*[F.struct(scope.alias("scope"), F.lit(s).alias("stat"), F.col(s).alias("v")) for s in LEADER_STATS for scope in (F.lower("city"), F.lit("*"))])
    stacked = rows.select("ex_id", "player", F.explode(pairs).alias("x")).select("ex_id", "player", "x.*").filter("v IS NOT NULL")
    top = F.max("v").over(Window.partitionBy("ex_id", "scope", "stat"))
    return stacked.withColumn("best", top).filter("v = best").groupBy("ex_id", "scope", "stat", "best").agg(F.array_sort(F.collect_set("player")).alias("players"))


def with_team(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Player rows of games with ``team``: the only team whose name holds the player's city, else null."""
    has = lambda i: (F.col("city") != "") & F.lower(f"team{i}").contains(F.lower("city"))
    team = F.when(has(0) & ~has(1), F.col("team0")).when(has(1) & ~has(0), F.col("team1"))
    return rows.join(facts.select("ex_id", "team0", "team1"), "ex_id").withColumn("team", team).drop("team0", "team1")


def said_aliases(aliases: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the aliases (ex_id, alias, ...), those all of whose tokens some text (ex_id, text) of their table holds."""
    words = F.array_distinct(tokens(F.col("alias")))
    seen = texts.select("ex_id", F.explode(tokens(F.col("text"))).alias("token")).distinct()
    own = aliases.withColumn("words", words)
    spread = own.select("ex_id", "alias", F.size("words").alias("n_words"), F.explode("words").alias("token")).join(seen, ["ex_id", "token"])
    whole = spread.groupBy("ex_id", "alias", "n_words").agg(F.count(F.lit(1)).alias("n")).filter("n = n_words").select("ex_id", "alias")
    return aliases.join(whole, ["ex_id", "alias"]).select(*aliases.columns).unionByName(own.filter(F.size("words") == 0).drop("words"))


def context(cells: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per game with all that a text is checked against: result, aliases, players and leaders as arrays.

    texts: (ex_id, text), the only ones that are to be checked; players whom none of them may name are then left out, so that
    rows don't grow with the tables.
    """
    facts, rows = team_facts(cells), player_rows(cells)
    placed, names = with_team(rows, facts), player_aliases(rows)
    if texts is not None:
        names = staged(said_aliases(names, texts), "aliases")
        placed = placed.join(names.select("ex_id", "player").distinct(), ["ex_id", "player"], "left_semi")
    nest = lambda df, name, *cols: df.groupBy("ex_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = facts.join(nest(team_aliases(facts), "team_aliases", "alias", "team"), "ex_id")
    out = out.join(nest(placed, "players", "player", F.lower("city").alias("city"), "team", *STATS), "ex_id", "left")
    out = out.join(nest(names, "player_aliases", "alias", "player"), "ex_id", "left")
    out = out.join(nest(leaders(rows), "leaders", "scope", "stat", "players"), "ex_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    arrays = ("players", "player_aliases", "leaders")
    return out.select(*[c for c in out.columns if c not in arrays], *map(empty, arrays))


def next_scorers(rows: DataFrame, k: int = 2) -> DataFrame:
    """(ex_id, city, player, pts, rank): the k best scorers of each city after its leaders."""
    best = F.max("PTS").over(Window.partitionBy("ex_id", "city"))
    rest = rows.withColumn("best", best).filter("PTS < best")
    rank = F.row_number().over(Window.partitionBy("ex_id", "city").orderBy(F.desc("PTS"), "player"))
    return rest.withColumn("rank", rank).filter(F.col("rank") <= k).select("ex_id", "city", "player", F.col("PTS").alias("pts"), "rank")
