"""Readers of the corpora, of generated texts and of run configurations."""

from __future__ import annotations

import csv
import hashlib
import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.sources import files
from factloom.sources.cells import entity_of, from_strings
from factloom.sources.ranges import csv_records, json_records
from factloom.sources.sink import LOG, Sink
from factloom.sources.staging import positioned, staged

# Columns of a player row in the order in which they are shown, and columns that aren't statistics.
PLAYER_ORDER = (
    "PLAYER_NAME", "TEAM_CITY", "START_POSITION", "MIN", "PTS",
    "FGM", "FGA", "FG_PCT", "FG3M", "FG3A", "FG3_PCT",
    "FTM", "FTA", "FT_PCT", "OREB", "DREB", "REB", "AST",
    "STL", "BLK", "TO", "PF",
)
NAME_PARTS = ("FIRST_NAME", "SECOND_NAME")
IDENTITY = ("PLAYER_NAME", "TEAM_CITY", "START_POSITION")
GAME = "home_city string, home_name string, vis_city string, vis_name string, home_line map<string,string>, vis_line map<string,string>, box_score map<string,map<string,string>>, summary array<string>"
MR = r"([A-Za-z ]+?)\[([^\]]*)\]"


def parse_mr(mr):
    """ARRAY<STRUCT<key, value>> of a meaning representation; fails where nothing matches."""
    keys, values = (F.transform(F.regexp_extract_all(mr, F.lit(MR), F.lit(g)), strip) for g in (1, 2))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    bad = F.raise_error(F.concat(F.lit("no attributes in: "), mr)).cast("array<struct<key:string,value:string>>")
    return F.when(F.size(keys) > 0, pairs).otherwise(bad)


def load_e2e(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(id, pos, pairs, references) from a CSV with columns mr and ref in any case, one row per mr in first-seen order."""
    records = csv_records(spark, path)
    order = F.struct("file", "start", "seq")
    head = records.orderBy("file", "start", "seq").first()
    names = [c.strip().lower() for c in next(csv.reader([head.text]))] if head else ["mr", "ref"]
    if "mr" not in names:
        raise ValueError(f"{path} has no column mr: {names}")
    fields = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"', "multiLine": "true"})
    of = lambda name: F.col(f"v.c{names.index(name)}") if name in names else F.lit(None).cast("string")
    raw = records.filter("start > 0 OR seq > 0").select(order.alias("at"), fields.alias("v"))
    rows = raw.select(strip(of("mr")).alias("mr"), strip(of("ref")).alias("ref"), "at").filter("mr IS NOT NULL AND mr <> ''")
    said = F.when(F.col("ref") != "", F.struct("at", "ref"))
    groups = rows.groupBy("mr").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(said)).alias("refs"))
    return positioned(groups, "pos", "first").select("pos", parse_mr(F.col("mr")).alias("pairs"), F.transform("refs", lambda r: r["ref"]).alias("references")).select(F.format_string(f"e2e-{split}-%04d", "pos").alias("id"), "pos", "pairs", "references")


def e2e_cells(examples: DataFrame) -> DataFrame:
    """Cells of one single-row section per example; the name is the key."""
    c = examples.select(F.col("id").alias("ex_id"), F.posexplode("pairs").alias("col_idx", "p"))
    return from_strings(c.select("ex_id", F.lit(0).alias("sec_idx"), F.lit("restaurant").alias("sec_name"), F.lit(0).alias("row_idx"), "col_idx", F.col("p.key").alias("col_name"), (F.col("col_idx") == 0).alias("is_key"), F.col("p.value").alias("value")))


def load_rotowire(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(id, pos, game, references) from a JSON array of games; summary tokens are joined by a space."""
    games = json_records(spark, path).select("file", "start", "seq", F.from_json("text", GAME).alias("g"))
    raw = positioned(games, "pos", "file", "start", "seq").select("pos", "g.*")
    text = strip(F.array_join("summary", " "))
    return raw.select("pos", F.struct(*[c for c in raw.columns if c not in ("summary", "pos")]).alias("game"), F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text)).alias("references")).select(F.format_string(f"rotowire-{split}-%04d", "pos").alias("id"), "pos", "game", "references")


def rotowire_cells(examples: DataFrame) -> DataFrame:
    """Cells of the team and player sections; players without a statistic and columns without a value are left out.

    A game's box score is taken apart into its values at once and put together by player, so the work is that of its cells.
    """
    g = examples.select(F.col("id").alias("ex_id"), "game.*")
    line_keys = F.array_sort(F.array_except(F.array_distinct(F.concat(F.map_keys("home_line"), F.map_keys("vis_line"))), F.array(F.lit("TEAM-CITY"), F.lit("TEAM-NAME"))))
    t = g.select("ex_id", line_keys.alias("keys"), F.posexplode(F.array(F.struct(F.concat_ws(" ", "home_city", "home_name").alias("team"), F.col("home_line").alias("line")), F.struct(F.concat_ws(" ", "vis_city", "vis_name").alias("team"), F.col("vis_line").alias("line")))).alias("row_idx", "r"))
    entity, n_rows = entity_of(F.col("r.team")).alias("entity"), F.lit(2).alias("n_sec_rows")
    values = F.concat(F.array(F.struct(F.lit("TEAM").alias("k"), F.col("r.team").alias("v"))), F.transform("keys", lambda k: F.struct(k.alias("k"), F.try_element_at(F.col("r.line"), k).alias("v"))))
    teams = t.select("ex_id", "row_idx", entity, n_rows, F.posexplode(values).alias("col_idx", "x"))
    teams = teams.select("ex_id", F.lit(0).alias("sec_idx"), F.lit("teams").alias("sec_name"), "row_idx", "col_idx", F.col("x.k").alias("col_name"), (F.col("col_idx") == 0).alias("is_key"), F.col("x.v").alias("value"), "entity", "n_sec_rows")
    # Players in the order of their numbers, shown columns first, then the others by name.
    box = F.col("box_score")
    known = F.array_distinct(F.map_keys(box))
    order = F.array(*map(F.lit, PLAYER_ORDER))
    columns = F.concat(F.filter(order, lambda c: F.array_contains(known, c)), F.array_sort(F.array_except(known, F.concat(order, F.array(*map(F.lit, NAME_PARTS))))))
    full = lambda v: ~F.coalesce(v, F.lit("")).isin("", "N/A")
    parts = g.select("ex_id", F.explode(F.transform(known, lambda c: F.struct(c.alias("name"), F.try_element_at(box, c).alias("values")))).alias("c"))
    parts = parts.filter(~F.col("c.name").isin(*NAME_PARTS)).select("ex_id", F.col("c.name").alias("name"), F.posexplode("c.values").alias("nth", "id", "value"))
    statistic = ~F.col("name").isin(*IDENTITY) & full(F.col("value"))
    rows = parts.groupBy("ex_id", "id").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "value"))).alias("row"), F.bool_or(F.col("name") == "PLAYER_NAME").alias("named"), F.bool_or(statistic).alias("plays")).filter("named AND plays")
    held = lambda name: F.get(F.filter("row", lambda x: x["name"] == name), F.lit(0))["value"]
    place = F.row_number().over(Window.partitionBy("ex_id").orderBy(F.col("id").cast("int"), "id")) - 1
    rows = staged(rows.select("ex_id", "id", "row", entity_of(held(F.lit("PLAYER_NAME"))).alias("entity"), place.alias("row_idx")), "players")
    filled = rows.select("ex_id", F.explode("row").alias("x")).filter(full(F.col("x.value"))).groupBy("ex_id").agg(F.collect_set("x.name").alias("filled"))
    counts = rows.groupBy("ex_id").agg(F.count(F.lit(1)).cast("int").alias("n_sec_rows")).join(filled, "ex_id")
    used = F.filter("columns", lambda c: (c == "PLAYER_NAME") | F.array_contains("filled", c))
    tables = g.select("ex_id", columns.alias("columns")).join(counts, "ex_id").select("ex_id", "n_sec_rows", used.alias("used"))
    p = rows.join(tables, "ex_id").select("ex_id", "row_idx", "row", "entity", "n_sec_rows", F.posexplode("used").alias("col_idx", "col_name"))
    players = p.select("ex_id", F.lit(1).alias("sec_idx"), F.lit("players").alias("sec_name"), "row_idx", "col_idx", "col_name", (F.col("col_name") == "PLAYER_NAME").alias("is_key"), held(F.col("col_name")).alias("value"), "entity", "n_sec_rows")
    return from_strings(teams.unionByName(players))


LOADERS: dict[str, tuple[Callable, Callable]] = {"e2e": (load_e2e, e2e_cells), "e2e_cleaned": (load_e2e, e2e_cells), "rotowire": (load_rotowire, rotowire_cells)}


def load(spark: SparkSession, name: str, path: str, split: str, limit: int | None = None, sample_seed: int | None = None) -> DataFrame:
    """Examples of a dataset: the first ``limit``, or as many drawn with a seed in their old order; 0 or None means all."""
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}; there are {sorted(LOADERS)}")
    return sample(LOADERS[name][0](spark, path, split), limit, sample_seed)


def sample(examples: DataFrame, limit: int | None, seed: int | None) -> DataFrame:
    """By position; the seeded choice is that of Python's generator, made on the driver from the number of rows."""
    if not limit:
        return examples
    if seed is None:
        return examples.orderBy("pos").limit(limit)
    n = examples.count()
    if limit >= n:
        return examples
    chosen = sorted(random.Random(seed).sample(range(n), limit))
    table = examples.sparkSession.createDataFrame([(i,) for i in chosen], "pos int")
    return examples.join(table, "pos", "left_semi")


GENERATION = "id string, output string, seq_logprob double, raw_output string"


def load_generations(spark: SparkSession, path: str) -> DataFrame:
    """Generated texts from a sink's published batches, or from plain JSON lines; blank lines are skipped."""
    if files.exists(spark, files.join(path, LOG)):
        return Sink(spark, path, GENERATION).read().filter("id IS NOT NULL")
    return spark.read.schema(GENERATION).json(path).filter("id IS NOT NULL")


def load_config(path: str) -> dict:
    """A run configuration from YAML; it must be a mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


def config_hash(config: dict) -> str:
    """Ten hex digits of the SHA-256 of the compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:10]


def run_name(config: dict) -> str:
    return f"{config.get('name', 'run')}-{config_hash(config)}"


def checkpoint_of(config: dict) -> str:
    """``checkpoint`` if given, else the newest of the training run of ``train_config``."""
    if config.get("checkpoint"):
        return config["checkpoint"]
    if config.get("train_config"):
        return f"{run_name(load_config(config['train_config']))}/checkpoint"
    raise ValueError("a soft run needs a checkpoint or a train_config")


