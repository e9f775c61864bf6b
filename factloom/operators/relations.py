"""Relational claims: who won, by how much, who plays where, who scored what, who led.

Claims are taken from patterns and checked against facts derived from the table; ambiguous wording yields none. All
steps are expressions over a text joined to its game's context row (``facts.context``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import bind, clauses, quoted, sentences, strip, whole_word, word_positions
from factloom.sources.staging import staged

# Patterns that make a claim, matched in any case.
STAT = r"(?i)(\d+)\s+(points?|rebounds?|boards?|assists?|steals?|blocks?)\b"
LED = r"(?i)\b(led|leads|leading|paced)\b"
DEFEAT = r"(?i)\b(defeated|beat|topped|downed|routed|edged|crushed|blew out|cruised past|held off)\b"
PASSIVE_DEFEAT = r"(?i)\b(?:was|were)\s+(?:defeated|beaten|downed|routed|edged|topped)\s+by\b"
LOST_TO = r"(?i)\b(fell to|lost to)\b"
WON = r"(?i)\b(won|victory|victorious|picked up the win)\b"
SEASON_WON = r"(?i)\b(?:have|has|had)\s+(?:now\s+)?won\b|\bwon\s+\d+\s+of\b|\bwin(?:ning)?\s+streak\b|\bwon\s+\d+\s+(?:straight|consecutive|in a row)\b"
MARGIN = r"(?i)(\d+)\s*-\s*point\s+(victory|win|loss|defeat)\b"
POOLED = r"(?i)\b(combined|between them|total|altogether)\b"
STAT_BEFORE_OWNER = r"(?i)(?:a\s+)?\d+\s+(?:points?|rebounds?|boards?|assists?|steals?|blocks?)\s+(?:from|by|for)\s*$"
TEAM_SUBJECT = r"\s+(?:put up|posted|totaled|totalled|managed|shot|scored|added|grabbed|had)\s*$"
POSSESSIVE = r"[‘’']s?"
GROUP_SCOPE = r"\b(?:bench|second unit|reserves)\b"
GAME_SCOPE = r"all scorers|the game|game-high"
CATEGORY = {"point": "PTS", "rebound": "REB", "board": "REB", "assist": "AST", "steal": "STL", "block": "BLK"}

CLAIM = "struct<type:string,sentence:string,claimed:string,expected:string,correct:boolean>"


def _claim(kind: str, sentence: Column, claimed: Column, expected: Column, correct: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), sentence.alias("sentence"), claimed.alias("claimed"), expected.alias("expected"), correct.alias("correct")).cast(CLAIM)


def _some(when: Column, claim: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(claim)).otherwise(F.array().cast(f"array<{CLAIM}>"))


def _whole(num: Column) -> Column:
    """A number as written: without a point if it is whole."""
    return F.when(num == F.floor(num), num.cast("bigint").cast("string")).otherwise(num.cast("string"))


def _first(text: Column, pattern: str) -> Column:
    """0-based start of the first match; -1 for none."""
    return F.regexp_instr(text, F.lit(pattern)) - 1


def sentence_rows(outputs: DataFrame, context: DataFrame) -> DataFrame:
    """(id, pos, sentence) with the columns of the game's context; texts without a game are left out."""
    rows = outputs.select("id", F.posexplode(sentences(F.col("output"))).alias("pos", "sentence"))
    return rows.join(context, F.col("id") == F.col("ex_id"))


def winner_claims(rows: DataFrame) -> DataFrame:
    """(id, pos, claim): result and margin claims of sentences; the first result pattern that fires ends the sentence."""
    low = F.lower("sentence")

    def team_at(i: int) -> Column:
        own = F.filter("team_aliases", lambda a: a["team"] == F.col(f"team{i}"))
        at = F.transform(own, lambda a: F.regexp_instr(low, whole_word(a["alias"])) - 1)
        return F.array_min(F.filter(at, lambda p: p >= 0))

    rows = rows.select("*", team_at(0).alias("at0"), team_at(1).alias("at1"))
    found = lambda p: _first(low, p)
    start = {k: found(p) for k, p in (("passive", PASSIVE_DEFEAT), ("defeat", DEFEAT), ("lost", LOST_TO))}
    end = {k: start[k] + F.length(F.regexp_extract(low, p, 0)) for k, p in (("passive", PASSIVE_DEFEAT), ("defeat", DEFEAT), ("lost", LOST_TO))}
    rows = rows.select("*", *[start[k].alias(f"{k}_from") for k in start], *[end[k].alias(f"{k}_to") for k in end])
    n = F.col("at0").isNotNull().cast("int") + F.col("at1").isNotNull().cast("int")

    def split(kind: str) -> tuple[Column, Column, Column]:
        """(fires, team before, team after)"""
        a, b = F.col(f"{kind}_from"), F.col(f"{kind}_to")
        first0 = (F.col("at0") < a) & (F.col("at1") >= b)
        first1 = (F.col("at1") < a) & (F.col("at0") >= b)
        fires = (a >= 0) & (n == 2) & (first0 | first1)
        return fires, F.when(first0, F.col("team0")).otherwise(F.col("team1")), F.when(first0, F.col("team1")).otherwise(F.col("team0"))

    passive, defeat, lost = split("passive"), split("defeat"), split("lost")
    active = defeat[0] & (F.col("passive_from") < 0)
    only = F.when(F.col("at0").isNotNull(), F.col("team0")).otherwise(F.col("team1"))
    won = low.rlike(WON) & (n == 1) & (F.col("lost_from") < 0) & ~low.rlike(SEASON_WON)
    fires = F.coalesce(passive[0] | active | lost[0], F.lit(False))
    claimed = F.when(passive[0], passive[2]).when(active, defeat[1]).when(lost[0], lost[2]).when(won, only)
    result = _some(claimed.isNotNull() & ~F.col("tie"), _claim("winner", F.col("sentence"), claimed, F.col("winner"), claimed == F.col("winner")))
    said = F.regexp_extract(F.col("sentence"), MARGIN, 1)
    margin = _some(
        ~fires & (said != "") & (F.col("margin") != 0),
        _claim("margin", F.col("sentence"), said.try_cast("bigint").cast("string"), _whole(F.col("margin")), said.try_cast("double") == F.col("margin")),
    )
    return rows.select("id", "pos", F.posexplode(F.concat(result, margin)).alias("k", "claim"))


def _mentions(text: Column) -> Column:
    """Non-overlapping player mentions (start, neglen, player) of a lower-cased text, the longer one first."""
    return mentions_apart(F.flatten(F.transform("player_aliases", lambda a: F.transform(word_positions(text, a["alias"]), lambda p: F.struct(p.alias("start"), (-F.length(a["alias"])).alias("neglen"), a["player"].alias("player"))))))


def mentions_apart(every: Column) -> Column:
    """Of mentions (start, neglen, player), those that no earlier, or longer and as early, one overlaps."""
    kind = "array<struct<start:int,neglen:int,player:string>>"
    kept = F.aggregate(
        F.array_sort(every.cast(kind)),
        F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("m")),
        lambda a, x: F.when(x["start"] >= a["end"], F.struct((x["start"] - x["neglen"]).alias("end"), F.concat(a["m"], F.array(x)).alias("m"))).otherwise(a),
    )
    return kept["m"]


def _segment_start(low: Column, at: Column) -> Column:
    """Where the text that belongs to a mention begins: a possessive team, or a stat before its owner, is pulled in."""
    head = F.substr(low, F.lit(1), at)
    owned = F.transform("team_aliases", lambda a: F.regexp_instr(head, F.concat(F.lit(r"(?:the\s+)?"), quoted(a["alias"]), F.lit(POSSESSIVE + r"\s*$"))) - 1)
    best = F.least(at, F.coalesce(F.array_min(F.filter(owned, lambda p: p >= 0)), at))

    def before(best: Column) -> Column:
        stat = _first(F.substr(head, F.lit(1), best), STAT_BEFORE_OWNER)
        return F.when(stat >= 0, F.least(stat, best)).otherwise(best)

    return bind(best, before)


def segments(rows: DataFrame) -> DataFrame:
    """(id, pos, clause_no, seg_no, player, segment, low) with context: the span of a clause that belongs to a player."""
    parts = rows.select("*", F.posexplode(clauses(F.col("sentence"))).alias("clause_no", "clause"))
    found = parts.select("*", F.explode(F.array(_mentions(F.lower("clause")))).alias("mentions"))
    names = F.size(F.array_distinct(F.transform("mentions", lambda m: m["player"])))
    starts = F.transform("mentions", lambda m: _segment_start(F.lower("clause"), m["start"]))
    whole = F.array(F.struct(F.get("mentions", F.lit(0))["player"].alias("player"), F.col("clause").alias("segment")))

    def cut(s: Column) -> Column:
        until = lambda i: F.coalesce(F.get(s, i + 1), F.length("clause"))
        return F.transform("mentions", lambda m, i: F.struct(m["player"].alias("player"), F.substr("clause", F.get(s, i) + 1, F.greatest(until(i) - F.get(s, i), F.lit(0))).alias("segment")))

    several = F.when(F.lower("clause").rlike(POOLED), F.array().cast("array<struct<player:string,segment:string>>")).otherwise(bind(starts, cut))
    spans = F.when(F.size("mentions") == 0, F.array().cast("array<struct<player:string,segment:string>>")).when(names == 1, whole).otherwise(several)
    out = found.select(*[c for c in found.columns if c != "mentions"], F.posexplode(spans).alias("seg_no", "seg"))
    return out.select(*[c for c in out.columns if c != "seg"], "seg.player", "seg.segment", F.lower("seg.segment").alias("low"))


def _linked_teams(low: Column) -> Column:
    """Teams that the segment says its player belongs to."""

    def pattern(alias: Column) -> Column:
        a = quoted(alias)
        return F.concat(
            F.lit(r"^[^\p{L}\p{N}_]*(?:the\s+)?"), a, F.lit(POSSESSIVE + r"\s|\b(?:for|of)\s+the\s+"), a, F.lit(r"\b|\b(?:led|leads|leading|paced)\s+the\s+"), a,
            F.lit(r"\b|\b"), a, F.lit(r"\s+(?:was|were)\s+(?:led|paced)\b|\b"), a, F.lit(r"\s+(?:guard|forward|center|star)\b"),
        )

    return F.array_distinct(F.transform(F.filter("team_aliases", lambda a: F.regexp_like(low, pattern(a["alias"]))), lambda a: a["team"]))


def _category(word: Column) -> Column:
    stem = F.regexp_replace(F.lower(word), "s+$", "")
    found = F.lit(None).cast("string")
    for k, v in CATEGORY.items():
        found = F.when(stem == k, F.lit(v)).otherwise(found)
    return found


def _stat_of(info: Column, category: Column) -> Column:
    value = F.lit(None).cast("double")
    for s in ("PTS", "REB", "AST", "STL", "BLK"):
        value = F.when(category == s, info[s]).otherwise(value)
    return value


def player_claims(rows: DataFrame) -> DataFrame:
    """(id, pos, claim): team attribution, statistics and leader claims of the players in sentences."""
    seg = segments(rows)
    info = F.get(F.filter("players", lambda p: p["player"] == F.col("player")), F.lit(0))
    words = lambda group: F.regexp_extract_all("segment", F.lit(STAT), F.lit(group))
    seg = seg.select("*", info.alias("info"), _linked_teams(F.col("low")).alias("linked"), words(0).alias("hits"), words(1).alias("nums"), words(2).alias("cats"), F.split("segment", STAT, -1).alias("gaps"))
    span = strip(F.col("segment"))
    team = F.get("linked", F.lit(0))
    name = F.col("player")
    belongs = _some(
        (F.size("linked") == 1) & F.col("info.team").isNotNull(),
        _claim("team-attribution", span, F.concat(name, F.lit(" on "), team), F.concat(name, F.lit(" on "), F.col("info.team")), team == F.col("info.team")),
    )

    def before(i: Column) -> Column:
        """The lower-cased text up to the i-th statistic."""
        gaps = F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g))
        hits = F.aggregate(F.slice("hits", F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g))
        return F.substr("low", F.lit(1), gaps + hits)

    def attribution(num: Column, i: Column) -> Column:
        category = _category(F.get("cats", i))
        actual = _stat_of(F.col("info"), category)
        subject = F.exists("team_aliases", lambda a: F.regexp_like(before(i), F.concat(quoted(a["alias"]), F.lit(TEAM_SUBJECT))))
        said, known = F.concat_ws(" ", name, num, category), F.concat_ws(" ", name, _whole(actual), category)
        return _some(~subject & actual.isNotNull(), _claim("attribution", span, said, known, num.try_cast("double") == actual))

    stats = F.flatten(F.transform("nums", attribution))
    category = _category(F.get("cats", F.lit(0)))
    scope = F.when(F.col("low").rlike(GAME_SCOPE), F.lit("*")).otherwise(F.col("info.city"))
    group = F.get(F.filter("leaders", lambda x: (x["scope"] == scope) & (x["stat"] == category)), F.lit(0))
    expected = F.concat(F.lit("led by ['"), F.array_join(group["players"], "', '"), F.lit("'] ("), category, F.lit(")"))
    led = _some(
        (F.size("nums") > 0) & F.col("low").rlike(LED) & ~F.col("low").rlike(GROUP_SCOPE) & group.isNotNull(),
        _claim("leader", span, F.concat(name, F.lit(" led ("), category, F.lit(")")), expected, F.array_contains(group["players"], name)),
    )
    return seg.select("id", "pos", "clause_no", "seg_no", F.posexplode(F.concat(belongs, stats, led)).alias("k", "claim"))


def claims(outputs: DataFrame, cells_context: DataFrame) -> DataFrame:
    """(id, pos, part, clause_no, seg_no, k, type, sentence, claimed, expected, correct): all claims of all texts."""
    rows = sentence_rows(outputs, cells_context)
    result = winner_claims(rows).select("id", "pos", F.lit(0).alias("part"), F.lit(0).alias("clause_no"), F.lit(0).alias("seg_no"), "k", "claim.*")
    return result.unionByName(player_claims(rows).select("id", "pos", F.lit(1).alias("part"), "clause_no", "seg_no", "k", "claim.*"))


def score_items(outputs: DataFrame, found: DataFrame) -> DataFrame:
    """Per output: n_claims, n_wrong and the wrong claims in order."""
    order = F.struct("pos", "part", "clause_no", "seg_no", "k", "type", "sentence", "claimed", "expected")
    per = found.groupBy("id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(~F.col("correct")).alias("n_wrong"), F.array_sort(F.collect_list(F.when(~F.col("correct"), order))).alias("wrong"))
    out = outputs.select("id").join(per, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_claims", "n_wrong")], "wrong")


def score_run(items: DataFrame, *by: str) -> DataFrame:
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.sum("n_claims").alias("relational_claims"), F.sum("n_wrong").alias("relational_wrong"),
        F.try_divide(F.sum("n_wrong"), F.sum("n_claims")).alias("relational_wrong_rate"), F.try_divide(F.count_if(F.col("n_wrong") > 0), F.count(F.lit(1))).alias("pct_items_with_relational_error"),
    )


def wrong_by_type(found: DataFrame) -> DataFrame:
    return found.filter("NOT correct").groupBy("type").agg(F.count(F.lit(1)).alias("wrong"))


def positional_bias(outputs: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """Wrong winner claims by where the winner is listed: per side the games, winner claims, wrong ones and the rate."""
    decided = facts.filter("NOT tie").join(outputs.select(F.col("id").alias("ex_id")), "ex_id").select("ex_id", F.when(F.col("winner") == F.col("team0"), "first").otherwise("second").alias("side"))
    winner = found.filter("type = 'winner'").select(F.col("id").alias("ex_id"), "correct")
    joined = decided.join(winner, "ex_id", "left")
    n, wrong = F.count("correct"), F.count_if(~F.col("correct"))
    return joined.groupBy("side").agg(F.count_distinct("ex_id").alias("games"), n.alias("claims"), wrong.alias("wrong"), F.try_divide(wrong, n).alias("wrong_rate"))


def positional_report(outputs: DataFrame, found: DataFrame, facts: DataFrame, n_boot: int = 10_000, seed: int = 13) -> DataFrame:
    """One row: decided games by the side that won, games with a wrong winner claim, the teams that wrong claims name,
    both rates, and their difference with an interval from resampling the sides independently."""
    from factloom.operators import stats

    decided = facts.filter("NOT tie").join(outputs.select(F.col("id").alias("ex_id")), "ex_id").withColumn("first", F.col("winner") == F.col("team0"))
    wrong = found.filter("type = 'winner' AND NOT correct").groupBy(F.col("id").alias("ex_id")).agg(F.collect_list("claimed").alias("named"))
    names = lambda a, b: F.size(F.filter(F.coalesce("named", F.array().cast("array<string>")), lambda c: c.contains(F.col(a)) & ~c.contains(F.col(b))))
    rows = decided.join(wrong, "ex_id", "left").withColumn("err", F.col("named").isNotNull().cast("int"))
    rows = staged(rows.select("ex_id", "first", "err", names("team0", "team1").alias("says_first"), names("team1", "team0").alias("says_second")), "sides")
    count = lambda when: F.count_if(when)
    err, first = F.col("err") == 1, F.col("first")
    counts = rows.agg(
        count(first).alias("n_first"), count(~first).alias("n_second"), count(first & err).alias("err_first"), count(~first & err).alias("err_second"),
        F.coalesce(F.sum("says_first"), F.lit(0)).alias("named_first"), F.coalesce(F.sum("says_second"), F.lit(0)).alias("named_second"),
    )
    counts = counts.withColumn("rate_first", F.try_divide("err_first", "n_first")).withColumn("rate_second", F.try_divide("err_second", "n_second"))
    items = stats.numbered(rows, "ex_id")
    return counts.join(stats.independent_bounds(items, stats.Draws(n_boot, seed), stats.Metric("err", "mean", ("err",), False), "first", True, False))
