"""Box-score games, single-row tables and generated texts derived from the driver tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.cells import finish, melt
from factloom.sources.staging import staged

TEAM_COLUMNS = {"TEAM": "team", "TEAM-PTS": "pts", "TEAM-REB": "reb", "TEAM-AST": "ast", "TEAM-WINS": "wins", "TEAM-LOSSES": "losses"}
PLAYER_COLUMNS = {"PLAYER_NAME": "player", "TEAM_CITY": "city", "PTS": "pts", "REB": "reb", "AST": "ast", "STL": "stl", "BLK": "blk", "FGM": "fgm", "FGA": "fga"}
PART_COLUMNS = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(x) -> F.Column:
    """A number with its digits as letters, so that names hold no digits."""
    return F.translate(x.cast("string"), "0123456789", "abcdefghij")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, side, nation, yr, row_idx, player, city, team, nick, statistics) of all games.

    The lines are counted per (supplier, year) before any name is joined, so only counts are shuffled on.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    flag = lambda c: F.count_if(c)
    stats = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "yr").agg(
        flag(F.col("l_returnflag") == "R").alias("pts"), F.count_distinct(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey"))).alias("reb"),
        flag(F.col("l_discount") >= 0.09).alias("ast"), flag(F.col("l_tax") >= 0.08).alias("stl"), flag(F.col("l_quantity") >= 50).alias("blk"),
        flag(F.col("l_returnflag") == "N").alias("fgm"), F.count(F.lit(1)).alias("fga"),
    )
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("pair"), (F.col("n_nationkey") % 2).cast("int").alias("side"),
        F.col("r_name").alias("city"), F.concat(F.lit("N"), letters(F.col("n_nationkey"))).alias("nick"),
    )
    key = F.col("s_suppkey")
    name = F.concat(F.lit("F"), letters(F.floor(key / 40).cast("bigint")), F.lit(" S"), letters(key % 40), F.when(key % 10 == 3, F.lit(" Jr.")).otherwise(F.lit("")))
    who = table(spark, sf_dir, "supplier").join(home, F.col("s_nationkey") == F.col("nation")).select(key, name.alias("player"), "nation", "pair", "side", "city", "nick", F.concat_ws(" ", "city", "nick").alias("team"))
    out = stats.join(who, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("ex_id", F.concat_ws("-", F.lit("game"), "pair", "yr"))
    order = Window.partitionBy("ex_id").orderBy("side", "s_suppkey")
    # Both are over the game's partition, so the counts take one shuffle.
    return out.withColumn("row_idx", F.row_number().over(order) - 1).withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("ex_id"))).drop("l_suppkey")


def teams(players_: DataFrame) -> DataFrame:
    """(ex_id, side, row_idx, team, nick, city, pts, reb, ast, wins, losses): one row per team and game."""
    sums = players_.groupBy("ex_id", "pair", "yr", "side", "nation", "team", "nick", "city").agg(*[F.sum(c).alias(c) for c in ("pts", "reb", "ast")])
    game, so_far = Window.partitionBy("ex_id"), Window.partitionBy("nation").orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)
    other = F.sum("pts").over(game) - F.col("pts")
    both = F.count(F.lit(1)).over(game) == 2
    out = sums.withColumn("won", (both & (F.col("pts") > other)).cast("int")).withColumn("lost", (both & (F.col("pts") < other)).cast("int"))
    out = out.withColumn("wins", F.sum("won").over(so_far)).withColumn("losses", F.sum("lost").over(so_far))
    return out.withColumn("row_idx", F.row_number().over(game.orderBy("side")) - 1).withColumn("n_rows", F.count(F.lit(1)).over(game))


class Games(NamedTuple):
    """The games of a folder: their cells and the generated texts, each staged."""

    cells: DataFrame
    texts: DataFrame


def games(spark: SparkSession, sf_dir: str) -> Games:
    """Cells and texts from one pass over the lines, for queries that read them in several branches."""
    rows = staged(players(spark, sf_dir), "players")
    return Games(staged(cells_of(rows), "cells"), staged(texts_of(rows), "texts"))


def cells_of(players_: DataFrame) -> DataFrame:
    t = teams(players_)
    return finish(melt(t, "ex_id", "row_idx", "teams", 0, TEAM_COLUMNS, "TEAM", "n_rows").unionByName(melt(players_, "ex_id", "row_idx", "players", 1, PLAYER_COLUMNS, "PLAYER_NAME", "n_rows")))


def game_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all games: section ``teams`` and section ``players``."""
    return cells_of(players(spark, sf_dir))


def staged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(cells_of(staged(players(spark, sf_dir), "players")), "cells")


def raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, game, references): the two-team games as raw box scores, whose values are strings keyed by supplier."""
    p = staged(players(spark, sf_dir), "players")
    t = teams(p)
    text = lambda c: F.when((F.lit(c) == "blk") & (F.col(c) == 0), "N/A").otherwise(F.col(c).cast("string"))
    keyed = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), text(c))))
    box = p.groupBy("ex_id").agg(*[keyed(c).alias(c) for c in PLAYER_COLUMNS.values()])
    score = F.create_map(*[x for name, c in PLAYER_COLUMNS.items() for x in (F.lit(name), F.col(c))])
    line = F.create_map(*[x for name, c in TEAM_COLUMNS.items() if name != "TEAM" for x in (F.lit(name), F.col(c).cast("string"))])
    side = lambda i, prefix: t.filter(F.col("side") == i).select("ex_id", F.col("city").alias(f"{prefix}_city"), F.col("nick").alias(f"{prefix}_name"), line.alias(f"{prefix}_line"))
    g = side(0, "home").join(side(1, "vis"), "ex_id").join(box.select("ex_id", score.alias("box_score")), "ex_id")
    game = F.struct("home_city", "home_name", "vis_city", "vis_name", "home_line", "vis_line", "box_score")
    return g.select(F.col("ex_id").alias("id"), game.alias("game"), F.array().cast("array<string>").alias("references"))


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one single-row table per part."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("ex_id"), F.lit(0).alias("row_idx"), F.lit(1).alias("n_rows"), *PART_COLUMNS.values())
    return finish(melt(parts, "ex_id", "row_idx", "part", 0, PART_COLUMNS, "name", "n_rows"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, output): a sentence per part whose size is one too large for every fifth."""
    size = F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)
    text = F.concat(F.lit("The "), F.col("p_name"), F.lit(" by "), F.col("p_brand"), F.lit(" is of size "), size, F.lit("."))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("id"), text.alias("output"))


def game_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pair, yr, e, output, reference): a text with one planted error per two-team game, and one without."""
    return texts_of(staged(players(spark, sf_dir), "players"))


def pairs_of(p: DataFrame) -> DataFrame:
    """Two-team games side by side: teams, points, top scorers with their points and rebounds, and which error is planted."""
    top = p.groupBy("ex_id", "side").agg(F.min(F.struct((-F.col("pts")).alias("neg"), "player", "pts", "reb")).alias("t"))
    sides = teams(p).join(top, ["ex_id", "side"])
    one = lambda s: sides.filter(F.col("side") == s).select("ex_id", *[F.col(c).alias(f"{c}{s}") for c in ("team", "nick", "pts")], F.col("t.player").alias(f"top{s}"), F.col("t.pts").alias(f"tp{s}"), F.col("t.reb").alias(f"tr{s}"))
    return one(0).join(one(1), "ex_id").join(p.select("ex_id", "pair", "yr").distinct(), "ex_id").withColumn("e", ((F.col("pair") * 31 + F.col("yr")) % 4).cast("int"))


def turned_texts(p: DataFrame) -> DataFrame:
    """(id, output): a passive defeat, a loss, two players in one clause and a pooled count, with an error in the sentence of number ``e``."""
    won = F.col("pts0") >= F.col("pts1")
    winner, loser = F.when(won, F.col("team0")).otherwise(F.col("team1")), F.when(won, F.col("team1")).otherwise(F.col("team0"))
    side = lambda k, right, wrong: F.when(F.col("e") == k, wrong).otherwise(right)
    text = F.concat(
        F.lit("The "), side(0, loser, winner), F.lit(" were defeated by the "), side(0, winner, loser), F.lit(". "),
        F.lit("The "), side(1, loser, winner), F.lit(" lost to the "), side(1, winner, loser), F.lit(" at home. "),
        F.col("top0"), F.lit(" had "), F.col("tp0") + F.when(F.col("e") == 2, 1).otherwise(0), F.lit(" points and "), F.col("top1"), F.lit(" grabbed "), F.col("tr1"), F.lit(" rebounds. "),
        F.col("top0"), F.lit(" and "), F.col("top1"), F.lit(" combined for "), F.col("tp0") + F.col("tp1"), F.lit(" points."),
    )
    return pairs_of(p).select(F.col("ex_id").alias("id"), text.alias("output"))


def texts_of(p: DataFrame) -> DataFrame:
    g = pairs_of(p)
    first = F.col("pts0") >= F.col("pts1")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    winner, loser, nick = pick("team0", "team1"), pick("team1", "team0"), pick("nick0", "nick1")
    high, low = F.greatest("pts0", "pts1"), F.least("pts0", "pts1")

    def text(err) -> F.Column:
        a, b = F.when(err == 0, loser).otherwise(winner), F.when(err == 0, winner).otherwise(loser)
        points, margin = F.col("tp0") + F.when(err == 1, 1).otherwise(0), high - low + F.when(err == 2, 1).otherwise(0)
        owner = F.when(err == 3, F.col("nick0")).otherwise(F.col("nick1"))
        return F.concat(
            F.lit("The "), a, F.lit(" defeated the "), b, F.lit(" "), high, F.lit(" to "), low, F.lit(". "),
            F.col("top0"), F.lit(" led the "), F.col("nick0"), F.lit(" with "), points, F.lit(" points. "),
            F.lit("It was a "), margin, F.lit("-point victory for the "), nick, F.lit(". "),
            F.lit("The "), owner, F.lit("' "), F.col("top1"), F.lit(" added "), F.col("tr1"), F.lit(" rebounds."),
        )

    return g.select(F.col("ex_id").alias("id"), "pair", "yr", "e", text(F.col("e")).alias("output"), text(F.lit(9)).alias("reference"))
