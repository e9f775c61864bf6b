"""Claim units, the table rows that they depend on (premises), and entailment labels from a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import claim_units, entity_tokens

MAX_PREMISE_CHARS = 2000
LABELS = ("entailment", "neutral", "contradiction")


def row_facts(cells: DataFrame) -> DataFrame:
    """(ex_id, sec_idx, row_idx, n_sec_rows, entity, fact): "section entity -- column: value; …" without nulls and key."""
    said = F.when(~F.col("is_key") & F.col("text").isNotNull(), F.struct("col_idx", F.concat(F.col("col_name"), F.lit(": "), F.col("text")).alias("t")))
    rows = cells.groupBy("ex_id", "sec_idx", "sec_name", "row_idx", "n_sec_rows", "entity").agg(F.array_sort(F.collect_list(said)).alias("facts"))
    fact = F.concat(F.col("sec_name"), F.lit(" "), F.col("entity"), F.lit(" -- "), F.array_join(F.transform("facts", lambda x: x["t"]), "; "))
    return rows.select("ex_id", "sec_idx", "row_idx", "n_sec_rows", "entity", fact.alias("fact"))


def result_facts(cells: DataFrame) -> DataFrame:
    """(ex_id, sec_idx, fact): who won, for sections of two teams, by the first column whose name ends in PTS.

    This rule is that of premises and differs from the facts' own (which want a column TEAM-PTS).
    """
    two = cells.filter((F.col("n_sec_rows") == 2) & F.lower("sec_name").contains("team"))
    pts = two.withColumn("points", F.upper("col_name").endswith("PTS"))
    first = pts.groupBy("ex_id", "sec_idx").agg(
        F.min(F.when(F.col("points"), F.col("col_idx"))).alias("c"),
        *[F.max(F.when(F.col("row_idx") == i, F.col("entity"))).alias(f"e{i}") for i in (0, 1)],
        F.collect_list(F.struct("row_idx", "col_idx", "kind", "num", "text")).alias("all"),
    )
    of = lambda i, f: F.get(F.filter("all", lambda x: (x["row_idx"] == i) & (x["col_idx"] == F.col("c")) & (x["kind"] == 1)), F.lit(0))[f]
    v = first.select("ex_id", "sec_idx", "e0", "e1", *[of(i, f).alias(f"{f}{i}") for i in (0, 1) for f in ("num", "text")]).filter("num0 <> num1")
    top = F.col("num0") > F.col("num1")
    pick = lambda a, b: F.when(top, F.col(a)).otherwise(F.col(b))
    w, l, wp, lp = pick("e0", "e1"), pick("e1", "e0"), pick("text0", "text1"), pick("text1", "text0")  # noqa: E741
    s = F.lit
    fact = F.concat(s("The "), w, s(" defeated the "), l, s(" "), wp, s(" to "), lp, s(" ; the "), w, s(" won the game and the "), l, s(" lost the game"))
    return v.select("ex_id", "sec_idx", fact.alias("fact"))


def units(outputs: DataFrame) -> DataFrame:
    """(id, pos, unit)"""
    return outputs.select("id", F.posexplode(claim_units(F.col("output"))).alias("pos", "unit"))


def premises(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, pos, unit, premise): result facts, single-row sections and the rows whose entity the unit names.

    A unit that names no row of a section with several gets the first two rows of the first such section.
    """
    rows = row_facts(cells).withColumn("names", entity_tokens(F.col("entity")))
    packed = rows.groupBy("ex_id").agg(F.array_sort(F.collect_list(F.struct("sec_idx", "row_idx", "n_sec_rows", "names", "fact"))).alias("rows"))
    derived = result_facts(cells).groupBy("ex_id").agg(F.array_sort(F.collect_list(F.struct("sec_idx", "fact"))).alias("derived"))
    table = packed.join(derived, "ex_id", "left")
    joined = claims.join(table, F.col("id") == F.col("ex_id"))
    words = F.regexp_extract_all(F.lower("unit"), F.lit("[a-z0-9]+"), F.lit(0))
    joined = joined.select("*", F.explode(F.array(words)).alias("words"))
    hit = lambda r: (r["n_sec_rows"] > 1) & F.arrays_overlap(r["names"], F.col("words"))
    kept = F.filter("rows", lambda r: (r["n_sec_rows"] == 1) | hit(r))
    lead = F.array_min(F.transform(F.filter("rows", lambda r: r["n_sec_rows"] > 1), lambda r: r["sec_idx"]))
    fallback = F.filter("rows", lambda r: (r["sec_idx"] == lead) & (r["row_idx"] < 2))
    chosen = F.when(F.exists("rows", hit), kept).otherwise(F.concat(F.filter("rows", lambda r: r["n_sec_rows"] == 1), F.coalesce(fallback, F.filter("rows", lambda r: F.lit(False)))))
    facts = F.concat(F.coalesce(F.transform("derived", lambda d: d["fact"]), F.array().cast("array<string>")), F.transform(chosen, lambda r: r["fact"]))
    return joined.select("id", "pos", "unit", F.left(F.array_join(facts, " . "), F.lit(MAX_PREMISE_CHARS)).alias("premise"))


def stub_probabilities(hypothesis: Column) -> Column:
    """A fixed stand-in for a model: "won" is entailed, "lost" contradicted, anything else neutral."""
    p = lambda e, n, c: F.struct(F.lit(e).alias("entailment"), F.lit(n).alias("neutral"), F.lit(c).alias("contradiction"))
    return F.when(hypothesis.contains("won"), p(0.9, 0.05, 0.05)).when(hypothesis.contains("lost"), p(0.05, 0.05, 0.9)).otherwise(p(0.1, 0.8, 0.1))


def label(probs: Column) -> Column:
    """The most probable label; the first of equal ones."""
    best = F.greatest(*[probs[x] for x in LABELS])
    return F.when(probs["entailment"] == best, LABELS[0]).when(probs["neutral"] == best, LABELS[1]).otherwise(LABELS[2])


def score_with_stub(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("probs", stub_probabilities(F.col("unit"))).withColumn("label", label(F.col("probs")))


def score_with_model(pairs: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[dict[str, float]]]]) -> DataFrame:
    """Labels from a model: ``make()`` runs once per task and returns a function from (premise, hypothesis) pairs to
    probabilities by label; Arrow batches are its batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for b in batches:
            found = scorer(list(zip(b["premise"], b["unit"], strict=True)))
            yield b[["id", "pos", "unit", "premise"]].assign(**{x: [round(float(p[x]), 4) for p in found] for x in LABELS})

    scored = pairs.mapInPandas(run, "id string, pos int, unit string, premise string, entailment double, neutral double, contradiction double")
    return scored.select("id", "pos", "unit", "premise", F.struct(*LABELS).alias("probs")).withColumn("label", label(F.col("probs")))


def score_items(outputs: DataFrame, scored: DataFrame) -> DataFrame:
    """Per output: n_claims, n_entailed, n_contradicted, entailed_rate (null without claims)."""
    count = lambda x: F.count_if(F.col("label") == x)
    per = scored.groupBy("id").agg(F.count(F.lit(1)).alias("n_claims"), count("entailment").alias("n_entailed"), count("contradiction").alias("n_contradicted"))
    out = outputs.select("id").join(per, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_claims", "n_entailed", "n_contradicted")])
    return out.withColumn("entailed_rate", F.try_divide("n_entailed", "n_claims"))


def score_run(items: DataFrame, *by: str) -> DataFrame:
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.sum("n_claims").alias("total_claims"), F.try_divide(F.sum("n_entailed"), F.sum("n_claims")).alias("claim_entailed_rate_micro"),
        F.try_divide(F.count_if(F.col("n_contradicted") > 0), F.count(F.lit(1))).alias("pct_items_with_contradiction"),
    )
