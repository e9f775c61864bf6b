"""The report on a battery of runs: intervals, the selected run, paired differences, fold ranks, tables and chart frames.

Everything is computed over the items that all runs share. ``battery`` stages them once; the frames that follow are small
(a row per run and metric), and the text of the report is put together on the driver from those.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numeric import fixed
from factloom.operators import overlap, stats
from factloom.sources import files, loaders
from factloom.sources.staging import staged


def item_records(outputs: DataFrame, numbers: DataFrame, relations: DataFrame, wrong: DataFrame | None = None, claims: DataFrame | None = None, parent: DataFrame | None = None, bleu: DataFrame | None = None) -> DataFrame:
    """A record per item, as one line of a run's ``metrics_per_item.jsonl``; groups that weren't computed are left out.

    numbers, relations, claims, parent, bleu: what the operators' ``score_items`` return.
    """
    tiers = [c for c in ("n_numbers", "n_exact", "n_derived", "n_supported", "unsupported", "support_rate", "exact_rate") if c in numbers.columns]
    rel = relations.select("id", F.struct("n_claims", "n_wrong", F.transform("wrong", lambda w: w.dropFields("pos", "part", "clause_no", "seg_no", "k")).alias("wrong")).alias("relations"))
    out = outputs.select("id").join(numbers.select("id", *tiers), "id").join(rel, "id")
    if claims is not None:
        out = out.join(claims.select("id", F.struct(*[c for c in claims.columns if c != "id"]).alias("claims")), "id", "left")
    if parent is not None:
        out = out.join(parent.select("id", F.col("f1").alias("parent_f1")), "id", "left")
    if bleu is not None:
        out = out.join(bleu, "id", "left")
    return out


def flatten(records: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Records as the flat columns that metrics name; a group is left out where an item lacks it.

    outputs: (id, seq_logprob), joined by id. One aggregation tells which groups are whole.
    """
    held = records if outputs is None else records.join(outputs.select("id", "seq_logprob"), "id", "left")
    rows: list = [F.col("n_numbers").alias("num_n_numbers"), (F.col("n_numbers") - F.col("n_supported")).alias("num_n_unsupported"), F.col("relations.n_claims").alias("rel_n_claims"), F.col("relations.n_wrong").alias("rel_n_wrong")]
    groups = {
        "claims": [F.col(f"claims.{c}").alias(f"cl_{c}") for c in ("n_claims", "n_entailed", "n_contradicted")],
        "parent_f1": [F.col("parent_f1")],
        "bleu_hyp_len": [F.col(c) for c in (*overlap.MATCH, *overlap.TOTAL, "bleu_hyp_len", "bleu_ref_len")],
        "seq_logprob": [F.col("seq_logprob")],
    }
    there = [g for g in groups if g in held.columns]
    gaps = held.agg(*[F.count_if(F.col(g).isNull()).alias(g) for g in there]).first() if there else None
    for g in there:
        rows += groups[g] if not gaps[g] else []
    keep = [c for c in ("id", "run") if c in held.columns]
    return held.select(*keep, *rows)


@dataclass(frozen=True)
class Battery:
    """What a report holds. diffs: run minus winner, as computed; labels: the runs in their order."""

    items: DataFrame
    metrics: tuple[stats.Metric, ...]
    labels: list[str]
    n_items: int
    n_dropped: int
    n_folds: int
    n_boot: int
    seed: int
    ci: DataFrame
    winner: str
    diffs: DataFrame
    fold_ranks: DataFrame


def battery(items: DataFrame, labels: Sequence[str], n_boot: int = 10_000, n_folds: int = 0, seed: int = 13, weights: DataFrame | stats.Draws | None = None) -> Battery:
    """Compare runs: items (run, id, metric columns), one row per run and item.

    Only items of all runs count. n_folds: 0 takes 3 below 400 items, else 5. weights: (b, item, w), or draws that the items
    derive; those of numpy's generator if not given, which is for items that fit the driver.
    """
    labels = list(labels)
    if len(set(labels)) != len(labels):
        raise ValueError(f"duplicate labels: {labels}")
    items = staged(items, "items")
    found = stats.common_ids(items)
    n, every = found.count(), items.select("id").distinct().count()
    if not n:
        raise ValueError("the runs share no item")
    items = staged(stats.numbered(items.join(found, "id")), "items")
    metrics = tuple(stats.active_metrics(items, stats.METRICS))
    stats.check_items(items, metrics)
    weights = stats.numpy_weights(items.sparkSession, n, n_boot, seed) if weights is None else weights
    ci = staged(stats.bootstrap_ci(items, weights, metrics), "intervals")
    rule = [m for m in stats.SELECTION if m in {x.name for x in metrics}]
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("run"))
    points = ci.select("run", "metric", F.col("point").alias("value"))
    winner = _select(points, metrics, rule, order)
    diffs = None
    for run in labels:
        if run != winner:
            one = stats.paired_diff(items, weights, metrics, run, winner).select(F.lit(run).alias("rival"), "metric", "diff", "lo", "hi")
            diffs = one if diffs is None else diffs.unionByName(one)
    if diffs is None:
        diffs = items.sparkSession.createDataFrame([], "rival string, metric string, diff double, lo double, hi double")
    k = n_folds or stats.n_folds(n)
    primary = [m for m in metrics if m.name == stats.SELECTION[0]]
    ranked = items.sparkSession.createDataFrame([], "run string, fold int, metric string, value double, rank int")
    if primary and n >= k:
        values = stats.fold_points(items, stats.fold_of(n, k, seed), primary).withColumn("at", order)
        ranked = stats.ranks(values.withColumn("name", F.col("run")).withColumn("run", F.format_string("%06d", "at")), primary, ("fold",)).select(F.col("name").alias("run"), "fold", "metric", "value", "rank")
    return Battery(items, metrics, labels, n, every - n, k, n_boot, seed, ci, winner, staged(diffs, "differences"), staged(ranked, "folds"))


def _select(points: DataFrame, metrics: Sequence[stats.Metric], rule: Sequence[str], order) -> str:
    """The run that the rule picks; ties go to the first label."""
    signs = {m.name: -1.0 if m.higher_better else 1.0 for m in metrics}
    wide = points.groupBy("run").pivot("metric", list(rule)).agg(F.first("value")) if rule else points.select("run").distinct()
    keys = [signs[m] * F.round(F.coalesce(F.nanvl(F.col(m), F.lit(0.0)), F.lit(0.0)), 4) for m in rule]
    return wide.orderBy(*keys, order).first().run


def shown(value: float | None, is_rate: bool) -> str:
    """A rate as percent with one decimal, anything else with three; a dash for none."""
    if value is None or math.isnan(value):
        return "–"
    return f"{100 * value:.1f}%" if is_rate else f"{value:.3f}"


def oriented(found: Battery, names: Sequence[str] | None = None) -> DataFrame:
    """(rival, metric, diff, lo, hi, robust): differences turned so that a positive one means that the rival is worse."""
    sign = F.lit(1.0)
    for m in found.metrics:
        sign = F.when(F.col("metric") == m.name, -1.0 if m.higher_better else 1.0).otherwise(sign)
    rows = found.diffs if names is None else found.diffs.filter(F.col("metric").isin(*names))
    lo, hi = sign * F.col("lo"), sign * F.col("hi")
    out = rows.select("rival", "metric", (sign * F.col("diff")).alias("diff"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))
    return out.withColumn("robust", (F.col("lo") > 0) | (F.col("hi") < 0))


def summary_csv(found: Battery) -> str:
    """Point estimates, six decimals: a line per metric with its label and direction, a column per run."""
    points = {(r.run, r.metric): r.point for r in found.ci.collect()}
    lines = [["metric", "higher_better", *found.labels]]
    lines += [[m.label, str(m.higher_better), *(f"{points[run, m.name]:.6f}" for run in found.labels)] for m in found.metrics]
    quote = lambda x: '"' + x.replace('"', '""') + '"' if set(x) & set(',"\r\n') else x
    return "".join(",".join(map(quote, line)) + "\r\n" for line in lines)


# Wording of the report.
CAVEAT = "> Seq-logprob caveat: computed over the full generation, so for two-stage prompts (structured) it includes scratch tokens and is not comparable with single-stage prompts. Not part of the decision rule."
RULE = "- Decision rule (pre-specified): minimise wrong-relational-claim rate; ties broken by unsupported-number rate, claim entailment, PARENT F1."
ORIENTATION = "Positive oriented difference = rival worse. CI excluding 0 marks a robust difference."


def summary_md(found: Battery) -> str:
    """The report's text: the selected run, intervals, differences and fold ranks."""
    ci = {(r.run, r.metric): r for r in found.ci.collect()}
    diff = {(r.rival, r.metric): r for r in oriented(found).collect()}
    ranks = {(r.fold, r.run): r["rank"] for r in found.fold_ranks.collect()}
    rule = "|---" * (len(found.labels) + 1) + "|"
    heads = " | ".join(found.labels)
    out = ["# Prompt battery report", "", CAVEAT, ""]
    out += [f"- Paired items: **{found.n_items}** | bootstrap resamples: {found.n_boot} | seed: {found.seed} | folds: {found.n_folds}", RULE, f"- **Selected prompt: `{found.winner}`**", ""]
    out += ["## Point estimates (95% bootstrap CI)", "", f"| metric | {heads} |", rule]
    for m in found.metrics:
        cells = [f"{shown(r.point, m.is_rate)} [{shown(r.lo, m.is_rate)}, {shown(r.hi, m.is_rate)}]" for r in (ci[run, m.name] for run in found.labels)]
        out.append(f"| {m.label} {'↑' if m.higher_better else '↓'} | " + " | ".join(cells) + " |")
    out += ["", f"## Paired differences vs `{found.winner}`", "", ORIENTATION, "", "| metric | rival | Δ (oriented) | 95% CI | robust? |", "|---|---|---|---|---|"]
    for m in found.metrics:
        for run in found.labels:
            if run != found.winner and (r := diff.get((run, m.name))):
                out.append(f"| {m.label} | {run} | {shown(r.diff, m.is_rate)} | [{shown(r.lo, m.is_rate)}, {shown(r.hi, m.is_rate)}] | {'yes' if r.robust else 'no'} |")
    out += ["", "## Fold ranking (primary metric)", "", f"| fold | {heads} |", rule]
    out += [f"| {f + 1} | " + " | ".join(str(ranks.get((f, run), "–")) for run in found.labels) + " |" for f in range(found.n_folds)]
    return "\n".join(out) + "\n"


# -- frames that charts are drawn from


def panels(found: Battery) -> DataFrame:
    """(metric, label, run, point, lo, hi, higher_better): bars with whiskers; rates in percent."""
    info = found.items.sparkSession.createDataFrame([(m.name, m.label, m.higher_better, 100.0 if m.is_rate else 1.0) for m in found.metrics], "metric string, label string, higher_better boolean, scale double")
    return found.ci.join(F.broadcast(info), "metric").select("metric", "label", "run", *[(F.col(c) * F.col("scale")).alias(c) for c in ("point", "lo", "hi")], "higher_better")


def forest(found: Battery) -> DataFrame:
    """The oriented differences of the metrics that share an axis, in percentage points."""
    rows = oriented(found, stats.FOREST)
    return rows.select("metric", "rival", *[(100 * F.col(c)).alias(c) for c in ("diff", "lo", "hi")])


def decomposition(found: Battery, weights: DataFrame) -> DataFrame:
    """(panel, run, point, lo, hi): claims per item, items with a contradiction, contradictions per claim."""
    volume = stats.bootstrap_ci(found.items, weights, [stats.Metric("volume", "mean", ("cl_n_claims",), True, False)])
    named = found.ci.filter(F.col("metric").isin("contra_items", "contra_claims")).unionByName(volume)
    return named.select(F.col("metric").alias("panel"), "run", "point", "lo", "hi")


def rolling(found: Battery, width: int = 75) -> DataFrame:
    """(run, x, rate): wrong relational claims in percent over a centred window of items in the order of their ids."""
    rates = stats.rolling_places(found.items, "rel_n_wrong", "rel_n_claims", width)
    return rates.select("run", (F.col("place") - (width - 1) + width / 2).alias("x"), (100 * F.col("rate")).alias("rate"))


def distribution(found: Battery, column: str = "parent_f1") -> DataFrame:
    """(run, id, value, mean): every item's value and its run's mean."""
    means = found.items.groupBy("run").agg(F.avg(column).alias("mean"))
    return found.items.select("run", "id", F.col(column).alias("value")).join(means, "run").select("run", "id", "value", "mean")


# -- smaller reports


# Columns of the table of runs, and where each stands in a run's metrics; the last says whether it is a rate.
RUN_COLUMNS = (
    ("num-support", "numbers.number_support_rate_micro", True), ("unsup-items", "numbers.pct_items_with_unsupported_number", True), ("rel-wrong", "relations.relational_wrong_rate", True),
    ("claims-ent", "claims.claim_entailed_rate_micro", True), ("contra-items", "claims.pct_items_with_contradiction", True), ("parent-f1", "parent.parent_f1", False), ("logprob", "uncertainty.mean_seq_logprob", False),
)


def run_comparison(runs: Sequence[tuple[dict, dict | None]]) -> list[list[str]]:
    """Head and rows of the table of runs, from each run's configuration and metrics (None: not evaluated yet)."""

    def at(metrics: dict, path: str):
        for step in path.split("."):
            metrics = (metrics or {}).get(step)
        return metrics

    def cell(x, rate: bool) -> str:
        return "-" if x is None else str(x) if isinstance(x, int) else f"{100 * x:.1f}%" if rate else f"{x:.3f}"

    rows = [["run", "prompt", "n", *(name for name, _, _ in RUN_COLUMNS)]]
    for config, metrics in runs:
        n = cell(at(metrics or {}, "numbers.items"), False) if metrics else "(no metrics.json yet)"
        rows.append([config.get("name", "?"), config.get("prompt", "?"), n, *(cell(at(metrics or {}, path), rate) for _, path, rate in RUN_COLUMNS)])
    return rows


def item_report(records: DataFrame, outputs: DataFrame, examples: DataFrame, most: int = 10) -> DataFrame:
    """(id, lines): per item, the first reference, the text, its metrics and the wrong claims, as shown to a reader.

    examples: (id, references). Items without an example are left out; ``most``: how many items are shown, by id.
    """
    has = lambda c: c in records.columns
    rows = outputs.select("id", "output", *[c for c in ("seq_logprob",) if c in outputs.columns]).join(examples.select("id", "references"), "id").orderBy("id").limit(most).join(records, "id")
    lit, none = F.lit, F.array().cast("array<string>")
    n_refs = F.size("references")
    reference = F.when(n_refs > 0, F.get("references", lit(0))).otherwise("(no reference)")
    more = F.when(n_refs > 1, F.array(F.format_string("            (+%d more reference(s))", n_refs - 1))).otherwise(none)
    line = F.format_string("METRICS   : number-check: %d number(s), %d via derivation, %d unsupported", "n_numbers", "n_derived", F.size("unsupported"))
    unsupported = F.when(F.size("unsupported") > 0, F.concat(lit(" -> ["), F.array_join(F.transform("unsupported", lambda x: x.cast("string")), ", "), lit("]"))).otherwise("")
    f1 = F.when(F.col("parent_f1").isNotNull(), F.concat(lit(" | PARENT F1: "), fixed(F.col("parent_f1"), 3))).otherwise("") if has("parent_f1") else lit("")
    logprob = F.when(F.col("seq_logprob").isNotNull(), F.concat(lit(" | seq-logprob: "), fixed(F.col("seq_logprob"), 3))).otherwise("") if "seq_logprob" in rows.columns else lit("")
    relation = F.when(F.col("relations.n_claims") > 0, F.format_string(" | relations: %d/%d wrong", "relations.n_wrong", "relations.n_claims")).otherwise("")
    entailed = F.when(F.col("claims").isNotNull(), F.format_string(" | claims entailed: %d/%d", "claims.n_entailed", "claims.n_claims")).otherwise("") if has("claims") else lit("")
    wrong = F.transform(
        F.coalesce("relations.wrong", F.array().cast(records.schema["relations"].dataType["wrong"].dataType)),
        lambda w: F.concat(lit("  REL-"), F.upper(w["type"]), lit(": "), F.substring(w["sentence"], 1, 110), lit("  [claimed: "), w["claimed"], lit(" | table: "), w["expected"], lit("]")),
    )
    head = F.array(F.concat(lit("["), "id", lit("]")), F.concat(lit("REFERENCE : "), reference))
    body = F.array(F.concat(lit("GENERATED : "), "output"), F.concat(line, unsupported, f1, logprob, relation, entailed))
    return rows.select("id", F.concat(head, more, body, wrong).alias("lines"))


def set_seed(seed: int) -> None:
    """Seed Python's and numpy's generators on the driver; draws on executors take their seed as an argument."""
    random.seed(seed)
    np.random.seed(seed)


def write_meta(config: dict, folder: str, spark: SparkSession | None = None) -> None:
    """A run's ``meta.json``: its configuration and that one's hash."""
    document = {"config": config, "config_hash": loaders.config_hash(config)}
    files.write_text(spark or SparkSession.active(), files.join(folder, "meta.json"), json.dumps(document, indent=2))


def rewrite_log(path: str, step: int, spark: SparkSession | None = None) -> int:
    """Drop the lines of a training log past the step that it resumes from; returns how many went."""
    spark = spark or SparkSession.active()
    rows = [line for line in files.read_text(spark, path).split("\n") if line.strip()]
    kept = [line for line in rows if json.loads(line)["step"] <= step]
    if len(kept) < len(rows):
        files.write_text(spark, path, "".join(line + "\n" for line in kept))
    return len(rows) - len(kept)
