"""Which cells a reference mentions, and references without unsupported sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numeric import key6
from factloom.functions.text import numbers, sentences, strip
from factloom.operators import facts, phrases, relations
from factloom.sources.staging import staged


def _labels(cells: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """Cells joined to texts (ex_id, keys, reference) with ``label``."""
    at = ["ex_id", *keys]
    games = facts.team_facts(cells)
    teams = facts.team_aliases(games).withColumnRenamed("alias", "phrase")
    players = facts.player_aliases(facts.player_rows(cells)).join(games.select("ex_id"), "ex_id", "left_semi").withColumnRenamed("alias", "phrase")
    value = strip(F.lower("text"))
    values = cells.filter("kind = 2").select("ex_id", value.alias("phrase")).filter("phrase <> ''")
    said = staged(phrases.occurrences(texts.select(*at, F.lower("reference").alias("text")), teams.drop("team").union(players.drop("player")).union(values).distinct(), "ex_id", at), "said")
    # A player alias inside a longer one is not a mention of its own; team aliases stand for themselves.
    spots = said.join(players, ["ex_id", "phrase"]).groupBy(*at, "phrase", "player").agg(phrases.apart(F.array_sort(F.collect_list("start")), F.length(F.first("phrase"))).alias("starts"))
    mentions = spots.select(*at, F.explode("starts").alias("start"), (-F.length("phrase")).alias("neglen"), "player").groupBy(*at).agg(F.collect_list(F.struct("start", "neglen", "player")).alias("every"))
    named = mentions.select(*at, F.explode(F.transform(relations.mentions_apart(F.col("every")), lambda m: m["player"])).alias("name"))
    names = named.union(said.join(teams, ["ex_id", "phrase"]).select(*at, F.col("team").alias("name"))).groupBy(*at).agg(F.collect_set("name").alias("names"))
    ready = staged(texts.select(*at, "reference", F.transform(numbers(F.col("reference")), key6).alias("nums")).join(names, at, "left"), "ready")
    hits = said.select(*at, F.col("phrase").alias("value"), F.lit(True).alias("hit")).distinct()
    joined = cells.join(ready, "ex_id").withColumn("value", value).join(hits, [*at, "value"], "left")
    label = F.when(F.col("kind") == 1, F.array_contains("nums", key6(F.col("num")))).when(F.col("kind") == 2, (F.col("is_key") & F.coalesce(F.array_contains("names", F.col("text")), F.lit(False))) | F.coalesce("hit", F.lit(False)))
    return joined.withColumn("label", F.coalesce(label, F.lit(False)))


def alignment_labels(cells: DataFrame, references: DataFrame, *keys: str) -> DataFrame:
    """(ex_id, keys, sec_idx, row_idx, col_idx, label): whether a reference (ex_id, keys, reference) mentions each cell."""
    return _labels(cells, references, *keys).select("ex_id", *keys, "sec_idx", "row_idx", "col_idx", "label")


def filter_references(cells: DataFrame, references: DataFrame, *keys: str) -> DataFrame:
    """(ex_id, keys, reference) of the sentences that mention a cell and make no wrong claim; empty if none is left."""
    context, at = facts.context(cells, references.select("ex_id", F.col("reference").alias("text"))), ["ex_id", *keys]
    parts = references.select(*at, F.posexplode(sentences(F.col("reference"))).alias("s", "reference"))
    mentioned = _labels(cells, parts, *keys, "s").groupBy(*at, "s").agg(F.bool_or("label").alias("any"), F.first("reference").alias("sentence"))
    key = F.concat_ws("\x1f", *at, "s")
    rows = parts.select(key.alias("id"), F.lit(0).alias("pos"), F.col("reference").alias("sentence"), F.col("ex_id").alias("c_id")).join(context, F.col("c_id") == F.col("ex_id")).drop("c_id")
    wrong = relations.winner_claims(rows).select("id", "claim.correct").unionByName(relations.player_claims(rows).select("id", "claim.correct")).filter("NOT correct").select("id").distinct()
    kept = mentioned.filter("any").withColumn("id", key).join(wrong, "id", "left_anti")
    out = kept.groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "sentence"))), lambda x: x["sentence"]), " ").alias("reference"))
    return references.select(*at).join(out, at, "left").select(*at, F.coalesce("reference", F.lit("")).alias("reference"))
