"""Whole runs from files: generate, evaluate, show, compare, report.

A run is a folder ``<results>/<name>-<hash>`` of its configuration, with ``meta.json``, ``generations.jsonl`` (a folder of
JSON lines), ``metrics.json`` and ``metrics_per_item.jsonl`` (as well). A configuration names ``dataset``, ``split``,
``prompt``, ``serialisation``, ``limit`` and ``sample_seed``; where the dataset's file lies is an argument.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import claims as C
from factloom.operators import facts, generate, overlap, prompts, relations, report, runs, serialise
from factloom.operators import numbers as N
from factloom.sources import files, loaders
from factloom.sources.staging import staged

GENERATIONS, METRICS, PER_ITEM = "generations.jsonl", "metrics.json", "metrics_per_item.jsonl"


class Dataset(NamedTuple):
    """Examples (id, references, …) and the cells of their tables, both staged."""

    examples: DataFrame
    cells: DataFrame


def run_folder(config: dict, results: str) -> str:
    return files.join(results, loaders.run_name(config))


def load_dataset(spark: SparkSession, config: dict, data: str) -> Dataset:
    examples = staged(loaders.load(spark, config["dataset"], data, config["split"], config.get("limit"), config.get("sample_seed")), "examples")
    return Dataset(examples, staged(loaders.LOADERS[config["dataset"]][1](examples), "cells"))


def run_generation(spark: SparkSession, config: dict, data: str, results: str, make: Callable[[], generate.Backend]) -> str:
    """Generate what isn't there yet; returns the run's folder."""
    folder, found = run_folder(config, results), load_dataset(spark, config, data)
    report.write_meta(config, folder, spark)
    path = files.join(folder, GENERATIONS)
    todo = runs.todo(found.examples.select("id"), loaders.load_generations(spark, path)) if files.exists(spark, path) else found.examples.select("id")
    texts = serialise.get_serialiser(config.get("serialisation", "markdown"))(found.cells.join(todo.withColumnRenamed("id", "ex_id"), "ex_id", "left_semi"))
    raw = generate.generate(prompts.messages(texts, config["prompt"]), make).withColumn("output", F.trim("output"))
    final = prompts.final_texts(raw, config["prompt"]).join(raw.select("id", F.round("seq_logprob", 4).alias("seq_logprob")), "id")
    kept = final.select("id", "output", "seq_logprob", F.when(F.col("raw_output") != F.col("output"), F.col("raw_output")).alias("raw_output"))
    runs.append_generations(staged(kept, "generations"), path)
    return folder


def evaluate(outputs: DataFrame, found: Dataset, parent: bool = False, scorer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict, DataFrame]:
    """(metrics, a record per item) of generations (id, output, seq_logprob).

    scorer: turns (id, pos, unit, premise) into labelled claims; without one, claims aren't verified. Generations without an
    example are left out; BLEU and PARENT are over items with references.
    """
    matched, _ = runs.match_outputs(outputs, found.examples)
    outputs = staged(matched, "outputs")
    texts = outputs.select("id", "output")
    numbers = staged(N.score_items(texts, found.cells), "numbers")
    rel = staged(relations.score_items(texts, relations.claims(texts, facts.context(found.cells))), "relations")
    pairs = texts.join(found.examples.select("id", "references"), "id").filter(F.size("references") > 0)
    bleu = staged(overlap.bleu_items(pairs), "bleu")
    one = lambda df: df.first().asDict(recursive=True)
    metrics = {"numbers": one(N.score_run(numbers)), "relations": one(relations.score_run(rel)) | {"wrong_by_type": {r.type: r.n for r in rel.select(F.explode("wrong.type").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}}}
    with_logprob = one(runs.uncertainty(outputs))
    if with_logprob["n_with_logprob"]:
        metrics["uncertainty"] = {"mean_seq_logprob": with_logprob["mean_seq_logprob"], "items": with_logprob["n_with_logprob"]}
    metrics["bleu"] = one(overlap.bleu_run(bleu))
    parents = labelled = None
    if parent:
        parents = staged(overlap.parent_items(pairs, found.cells), "parent")
        metrics["parent"] = one(overlap.parent_run(parents))
    if scorer is not None:
        scored = staged(scorer(C.premises(C.units(texts), found.cells)), "claims")
        items = C.score_items(texts, scored)
        metrics["claims"] = one(C.score_run(items))
        said = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("unit").alias("sentence"), "label"))).alias("claims"))
        labelled = items.join(said, "id", "left").withColumn("claims", F.transform("claims", lambda c: c.dropFields("pos")))
    return metrics, report.item_records(outputs, numbers, rel, claims=labelled, parent=parents, bleu=bleu)


def run_evaluation(spark: SparkSession, config: dict, data: str, results: str, parent: bool = False, scorer: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Evaluate a run and write its metrics; returns them."""
    folder = run_folder(config, results)
    path = files.join(folder, GENERATIONS)
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no generations at {path}")
    metrics, records = evaluate(loaders.load_generations(spark, path).dropDuplicates(["id"]), load_dataset(spark, config, data), parent, scorer)
    records.write.mode("overwrite").json(files.join(folder, PER_ITEM))
    files.write_text(spark, files.join(folder, METRICS), json.dumps(metrics, indent=2))
    return metrics


def _records(spark: SparkSession, folder: str) -> DataFrame:
    path = files.join(folder, PER_ITEM)
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no {PER_ITEM} in {folder}: the run isn't evaluated yet")
    return spark.read.json(path)


def show(spark: SparkSession, config: dict, data: str, results: str, most: int = 10) -> list[str]:
    """The lines of the first items of an evaluated run."""
    folder = run_folder(config, results)
    outputs = loaders.load_generations(spark, files.join(folder, GENERATIONS)).dropDuplicates(["id"])
    found = load_dataset(spark, config, data)
    rows = report.item_report(_records(spark, folder), outputs, found.examples, most).orderBy("id").collect()
    return [line for r in rows for line in ("=" * 78, *r.lines)] + ["=" * 78, f"Shown {len(rows)} of {outputs.count()} generated items"]


def compare(configs: Sequence[dict], results: str) -> list[str]:
    """The table of runs, columns padded to their widest cell."""
    found = []
    for config in configs:
        path = files.join(run_folder(config, results), METRICS)
        spark = SparkSession.active()
        found.append((config, json.loads(files.read_text(spark, path)) if files.exists(spark, path) else None))
    rows = report.run_comparison(found)
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return [lines[0], "-" * len(lines[0]), *lines[1:]]


def bias(spark: SparkSession, config: dict, data: str, results: str) -> dict:
    """Wrong winner claims of a run by whether the first-listed team won."""
    outputs = loaders.load_generations(spark, files.join(run_folder(config, results), GENERATIONS)).dropDuplicates(["id"])
    found = load_dataset(spark, config, data)
    texts = staged(outputs.select("id", "output").join(found.examples.select("id"), "id"), "outputs")
    return relations.positional_report(texts, relations.claims(texts, facts.context(found.cells)), facts.team_facts(found.cells)).first().asDict()


def write_report(spark: SparkSession, configs: Sequence[dict], results: str, out: str, n_boot: int = 10_000, n_folds: int = 0, seed: int = 13) -> report.Battery:
    """Compare evaluated runs and write ``summary.csv`` and ``summary.md``."""
    labels, frames = [], []
    for config in configs:
        folder, label = run_folder(config, results), runs.run_label(config)
        outputs = loaders.load_generations(spark, files.join(folder, GENERATIONS)).dropDuplicates(["id"])
        labels.append(label)
        frames.append(report.flatten(_records(spark, folder), outputs).withColumn("run", F.lit(label)))
    # Only columns that every run has are compared.
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    items = frames[0].select(*common)
    for f in frames[1:]:
        items = items.unionByName(f.select(*common))
    found = report.battery(items, labels, n_boot, n_folds, seed)
    for name, text in (("summary.csv", report.summary_csv(found)), ("summary.md", report.summary_md(found))):
        files.write_text(spark, files.join(out, name), text)
    return found


__all__ = ["Dataset", "bias", "compare", "evaluate", "load_dataset", "run_evaluation", "run_folder", "run_generation", "show", "write_report"]
