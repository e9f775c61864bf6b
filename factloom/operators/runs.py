"""Whole runs: joins of outputs to tables, per-item metrics, summaries, resumable sinks and report frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numeric import fixed, fixed3, percent
from factloom.sources import files
from factloom.sources.loaders import GENERATION
from factloom.sources.sink import Sink


def match_outputs(outputs: DataFrame, examples: DataFrame) -> tuple[DataFrame, int]:
    """Outputs whose example exists, and how many have none."""
    ids = examples.select("id").distinct()
    return outputs.join(ids, "id", "left_semi"), outputs.join(ids, "id", "left_anti").count()


def todo(examples: DataFrame, done: DataFrame) -> DataFrame:
    """Examples without a generation."""
    return examples.join(done.select("id").distinct(), "id", "left_anti")


def append_generations(new: DataFrame, path: str, batch: str | None = None) -> int:
    """Publish generations that aren't in the sink yet; returns how many. Running it twice, or half, adds nothing twice."""
    return Sink(new.sparkSession, path, GENERATION).append(new, batch)


def item_metrics(outputs: DataFrame, numbers: DataFrame, relations: DataFrame, claims: DataFrame | None = None, parent: DataFrame | None = None, bleu: DataFrame | None = None) -> DataFrame:
    """One row per item with the flat columns that runs are compared on; groups that weren't computed are left out."""
    out = outputs.select("id", *[c for c in ("run", "seq_logprob") if c in outputs.columns])
    out = out.join(numbers.select("id", F.col("n_numbers").alias("num_n_numbers"), (F.col("n_numbers") - F.col("n_supported")).alias("num_n_unsupported")), "id", "left")
    out = out.join(relations.select("id", F.col("n_claims").alias("rel_n_claims"), F.col("n_wrong").alias("rel_n_wrong")), "id", "left")
    if claims is not None:
        out = out.join(claims.select("id", F.col("n_claims").alias("cl_n_claims"), F.col("n_entailed").alias("cl_n_entailed"), F.col("n_contradicted").alias("cl_n_contradicted")), "id", "left")
    if parent is not None:
        out = out.join(parent.select("id", F.col("f1").alias("parent_f1")), "id", "left")
    return out if bleu is None else out.join(bleu, "id", "left")


def uncertainty(outputs: DataFrame) -> DataFrame:
    """Mean sequence log probability and how many items have one."""
    return outputs.agg(F.avg("seq_logprob").alias("mean_seq_logprob"), F.count("seq_logprob").alias("n_with_logprob"))


def run_table(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Configurations beside their metrics as shown text; a missing metric is a dash."""
    rates = [c for c, t in metrics.dtypes if t == "double" and ("rate" in c or c.startswith("pct"))]
    other = [c for c, t in metrics.dtypes if t == "double" and c not in rates]
    shown = runs.join(metrics, "run", "left")
    keep = [c for c in shown.columns if c not in rates and c not in other]
    return shown.select(*keep, *[percent(F.col(c)).alias(c) for c in rates], *[fixed3(F.col(c)).alias(c) for c in other])


def summary_csv(points: DataFrame) -> DataFrame:
    """Metrics by run, six decimals."""
    return points.withColumn("shown", fixed(F.col("value"), 6)).groupBy("metric").pivot("run").agg(F.first("shown")).orderBy("metric")


def summary_lines(ci: DataFrame) -> DataFrame:
    """Markdown rows ``| metric | run | point [lo, hi] |``."""
    f = lambda c: fixed(F.col(c), 4)
    return ci.select("metric", "run", F.concat(F.lit("| "), "metric", F.lit(" | "), "run", F.lit(" | "), f("point"), F.lit(" ["), f("lo"), F.lit(", "), f("hi"), F.lit("] |")).alias("line"))


def contradiction_parts(items: DataFrame) -> DataFrame:
    """Per run: claims per item, contradictions per claim, and their product."""
    per = items.groupBy("run").agg(F.avg("cl_n_claims").alias("claims_per_item"), F.try_divide(F.sum("cl_n_contradicted"), F.sum("cl_n_claims")).alias("per_claim"))
    return per.withColumn("contradictions_per_item", F.col("claims_per_item") * F.col("per_claim"))


def forest(diffs: DataFrame, higher_better: dict[str, bool]) -> DataFrame:
    """Differences turned so that a positive value means that the rival is worse."""
    sign = F.lit(1.0)
    for name, up in higher_better.items():
        sign = F.when(F.col("metric") == name, -1.0 if up else 1.0).otherwise(sign)
    lo, hi = sign * F.col("lo"), sign * F.col("hi")
    return diffs.select("metric", (sign * F.col("diff")).alias("diff"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))


def run_label(config: dict) -> str:
    """What a run is called in reports: the prompt's kind and the sheet, else the run's name."""
    if config.get("prompt"):
        kind = config["prompt"].rpartition("/")[2].rpartition("_v")[0]
        return kind + ("" if config.get("serialisation", "markdown") == "markdown" else "+fs")
    return config.get("name", "run").removeprefix("rw-full-")


def write_metrics(aggregates: DataFrame, path: str) -> None:
    """A one-row aggregate as a JSON document."""
    files.write_text(aggregates.sparkSession, path, json.dumps(aggregates.first().asDict(recursive=True), indent=2))


def truncate_log(log: DataFrame, step: int) -> DataFrame:
    """Log rows up to the step that training resumes from."""
    return log.filter(F.col("step") <= step)
