"""Where texts say given phrases as whole words, by an inverted index of their tokens.

A phrase is looked up by the rarest of its tokens (rarest in all texts), by an equi-join, and verified where that token
puts it; so neither a pattern is compiled nor a text scanned per phrase, and phrases with an unseen token go at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import SPACE_CHARS, TOKEN, WORD_CHARS

#: Tokens and what stands between them: the pieces of a text add up to it.
_PIECE = rf"{TOKEN}|[{SPACE_CHARS}]+"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _spaces(piece: Column) -> Column:
    return piece.rlike(rf"^[{SPACE_CHARS}]")


def token_index(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, at): every token of each text (keys, text) with its 0-based place."""
    pieces = texts.select(*keys, F.posexplode(_pieces(F.col("text"))).alias("k", "token"))
    before = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("at", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)).cast("int")).filter(~_spaces(F.col("token"))).drop("k")


def _keyed(phrases: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """(by, phrase, token, offset): each phrase's rarest token; none for a phrase with a token that no text has."""
    offsets = lambda p: F.transform(p, lambda x, i: F.struct(x.alias("token"), F.aggregate(F.slice(p, F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y)).alias("offset")))
    own = phrases.select(by, "phrase", F.explode(F.transform(F.array(_pieces(F.col("phrase"))), offsets)[0]).alias("t")).select(by, "phrase", "t.*").filter(~_spaces(F.col("token")))
    counts = index.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rated = own.join(counts, "token", "left").groupBy(by, "phrase").agg(
        F.min_by(F.struct("token", "offset"), F.struct("n", "offset")).alias("t"), F.bool_and(F.col("n").isNotNull()).alias("seen")
    )
    return rated.filter("seen").select(by, "phrase", "t.*")


def occurrences(texts: DataFrame, phrases: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(keys, phrase, start): where texts (keys, text) say the phrases (by, phrase) of their ``by`` as whole words.

    ``by`` is one of the keys. Phrases are distinct; one without a token (empty, white space) is said nowhere. Occurrences of one
    phrase that overlap each stand.
    """
    index = token_index(texts, keys)
    placed = index.join(_keyed(phrases, index, by), [by, "token"]).select(*keys, "phrase", (F.col("at") - F.col("offset")).alias("start")).filter("start >= 0")
    size, edge = F.length("phrase"), rf"^[{WORD_CHARS}]"
    char = lambda at: F.substr(F.col("text"), at, F.lit(1)).rlike(edge)
    said = F.substr(F.col("text"), F.col("start") + 1, size) == F.col("phrase")
    free = ~((F.col("start") > 0) & char(F.col("start"))) & ~char(F.col("start") + size + 1)
    return placed.join(texts.select(*keys, "text"), keys).filter(said & free).select(*keys, "phrase", "start")


def apart(starts: Column, size: Column) -> Column:
    """Of sorted starts of one phrase, those that a search from left to right finds: none overlaps the one before."""
    return F.aggregate(
        starts, F.array().cast("array<int>"), lambda a, s: F.when((F.size(a) == 0) | (s >= F.element_at(a, -1) + size), F.concat(a, F.array(s))).otherwise(a)
    )
