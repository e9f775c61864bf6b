"""Comparing runs: bootstrap intervals, paired and independent differences, folds, ranks, selection.

Every statistic here is a function of weighted sums over items. ``Draws`` derives an item's weights of all replicates from a
hash of its number where the item is read, and a task adds them up for all replicates at once, so a bootstrap is one pass
over the items that sends a row per replicate, run and task: nothing grows with items times replicates but the arithmetic.
A table of weights (b, item, w) does in place of it where given draws are to be repeated: those of numpy's generator from the
driver (``numpy_weights``, whose size is checked) or those of an expression (``lcg_weights``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import bind
from factloom.operators import overlap
from factloom.sources.staging import positioned

MAX_WEIGHTS = 200_000_000


@dataclass(frozen=True)
class Metric:
    """How a metric follows from item columns: a mean, a ratio of sums, the share of positive values, or corpus BLEU from summed counts."""

    name: str
    kind: str
    columns: tuple[str, ...]
    higher_better: bool
    is_rate: bool = True
    label: str = ""

    def terms(self) -> list[Column]:
        """Per item: what is summed; numerator and denominator, or the counts of BLEU in the order of its columns."""
        if self.kind == "bleu":
            return [F.col(c).cast("double") for c in self.columns]
        if self.kind == "ratio":
            return [F.col(self.columns[0]).cast("double"), F.col(self.columns[1]).cast("double")]
        if self.kind == "positive":
            return [(F.col(self.columns[0]) > 0).cast("double"), F.lit(1.0)]
        return [F.col(self.columns[0]).cast("double"), F.lit(1.0)]

    def value(self, sums: Sequence[Column]) -> Column:
        """The metric from the sums of its terms."""
        if self.kind == "bleu":
            n = overlap.MAX_N
            return overlap.bleu_score(sums[:n], sums[n : 2 * n], sums[2 * n], sums[2 * n + 1])
        return F.try_divide(*sums)


# The metrics that runs are compared on, with their columns and labels, and the rule of selection.
METRICS = (
    Metric("rel_wrong", "ratio", ("rel_n_wrong", "rel_n_claims"), False, True, "Wrong relational claims"),
    Metric("rel_items", "positive", ("rel_n_wrong",), False, True, "Items with relational error"),
    Metric("num_unsupported", "ratio", ("num_n_unsupported", "num_n_numbers"), False, True, "Unsupported numbers"),
    Metric("entailed", "ratio", ("cl_n_entailed", "cl_n_claims"), True, True, "Claims entailed (NLI)"),
    Metric("contra_claims", "ratio", ("cl_n_contradicted", "cl_n_claims"), False, True, "Contradictions per claim"),
    Metric("contra_items", "positive", ("cl_n_contradicted",), False, True, "Items with contradiction"),
    Metric("parent", "mean", ("parent_f1",), True, False, "PARENT F1"),
    Metric("bleu", "bleu", (*overlap.MATCH, *overlap.TOTAL, "bleu_hyp_len", "bleu_ref_len"), True, False, "BLEU"),
    Metric("seq_logprob", "mean", ("seq_logprob",), True, False, "Seq-logprob"),
)
SELECTION = ("rel_wrong", "num_unsupported", "entailed", "parent")
FOREST = ("rel_wrong", "rel_items", "entailed", "contra_claims")


def check_items(items: DataFrame, metrics: Sequence[Metric], run: str = "run") -> None:
    """ValueError unless there are items, all runs have the same ones, and each once, with a value in every column."""
    columns = sorted({c for m in metrics for c in m.columns})
    missing = [c for c in columns if c not in items.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    gaps = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    per = items.groupBy(run).agg(F.count(F.lit(1)).alias("n_"), F.count_distinct("item").alias("d_"), F.min("item").alias("a_"), F.max("item").alias("z_"), *gaps).collect()
    if not per:
        raise ValueError("there are no items")
    if len({(r.n_, r.d_, r.a_, r.z_) for r in per}) > 1 or any(r.n_ != r.d_ or r.z_ - r.a_ + 1 != r.n_ for r in per):
        raise ValueError("the runs must have the same items, each once")
    if short := sorted({c for c in columns for r in per if r[c]}):
        raise ValueError(f"columns of different lengths: {short} have no value for some items")


#: Modulus of the hash, and below which of its values an item's weight is 0, at most 1, and so on: Poisson with mean 1.
_MOD = 2_147_483_647
POISSON = tuple(int(_MOD * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))
#: Replicates and items that are weighted at a time.
_REPLICATES, _ITEMS = 256, 4096


@dataclass(frozen=True)
class Draws:
    """Replicates of a Poisson bootstrap: how often replicate b holds an item follows from (seed, item, b) alone.

    Items hold numbers from 0 that stand for the same thing in every run, so runs are resampled together; samples with items of
    their own are resampled independently. As sizes of replicates vary, it serves statistics that are ratios of sums.
    """

    n_boot: int = 10_000
    seed: int = 13

    def weights(self, item: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(items, replicates) of weights."""
        key = _mixed((item.astype(np.int64) * 40_692 + self.seed * 1_000_003 + 1) % _MOD)
        u = _mixed((key[:, None] + (b.astype(np.int64) + 1) * 1_566_083) % _MOD)
        return np.searchsorted(np.array(POISSON), u, "right")


_ROUNDS = ((15, 48_271), (13, 69_621), (16, 39_373))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in _ROUNDS:
        x = (x ^ (x >> shift)) * factor % _MOD
    return x


def numpy_weights(spark: SparkSession, n: int, n_boot: int = 10_000, seed: int = 13) -> DataFrame:
    """(b, item, w): how often replicate b draws item 0..n-1, as numpy's default generator draws them row by row."""
    if n * n_boot > MAX_WEIGHTS:
        raise ValueError("too many weights for the driver; use Draws")
    rng = np.random.default_rng(seed)
    frames = []
    for start in range(0, n_boot, 1000):
        draws = rng.integers(0, n, (min(1000, n_boot - start), n))
        b = np.repeat(np.arange(start, start + len(draws)), n)
        pair, w = np.unique(b * n + draws.ravel(), return_counts=True)
        frames.append(pd.DataFrame({"b": (pair // n).astype("int32"), "item": (pair % n).astype("int32"), "w": w.astype("int32")}))
    return spark.createDataFrame(pd.concat(frames))


def lcg_weights(spark: SparkSession, n: int, n_boot: int) -> DataFrame:
    """(b, item, w) from a congruential expression; the draws are not numpy's."""
    b, j = F.col("b"), F.col("j")
    draws = spark.range(n_boot).withColumnRenamed("id", "b").select("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    drawn = ((b * 7919 + j * 104729 + (b * j) % 613) * 31 % 2147483647) % n
    return draws.select(b.cast("int").alias("b"), drawn.cast("int").alias("item")).groupBy("b", "item").agg(F.count(F.lit(1)).cast("int").alias("w"))


def numbered(items: DataFrame, id: str = "id") -> DataFrame:
    """Items with ``item`` 0..n-1 in the order of their ids."""
    return items.join(positioned(items.select(id).distinct(), "item", id), id)


def _valued(sums: DataFrame, metrics: Sequence[Metric], named: dict[str, list[str]], by: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m.name).alias("metric"), m.value([F.col(c) for c in named[m.name]]).alias("value")) for m in metrics])
    return sums.select(*by, "b", F.explode(pairs).alias("p")).select(*by, "b", "p.*")


def _sums(items: DataFrame, weights: DataFrame | Draws, metrics: Sequence[Metric], by: Sequence[str]) -> DataFrame:
    named = {m.name: [f"{m.name}_{k}" for k in range(len(m.terms()))] for m in metrics}
    if isinstance(weights, Draws):
        return _valued(_drawn_sums(items, weights, metrics, named, by), metrics, named, by)
    joined = items.join(weights, "item")
    aggs = [F.sum(term * F.col("w")).alias(c) for m in metrics for c, term in zip(named[m.name], m.terms(), strict=True)]
    return _valued(joined.groupBy(*by, "b").agg(*aggs), metrics, named, by)


def _drawn_sums(items: DataFrame, draws: Draws, metrics: Sequence[Metric], named: dict[str, list[str]], by: Sequence[str]) -> DataFrame:
    """(by, b, a sum per term): each task adds up its items for all replicates, then the tasks' sums are added up.

    A replicate that holds no item of a group has sums of 0 there.
    """
    columns = [c for m in metrics for c in named[m.name]]
    # Missing values count for nothing, as in a sum.
    terms = [F.coalesce(t, F.lit(0.0)).alias(c) for m in metrics for c, t in zip(named[m.name], m.terms(), strict=True)]
    group = F.to_json(F.struct(*by)).alias("group") if by else F.lit("").alias("group")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        replicates = np.arange(draws.n_boot)
        for batch in batches:
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            values = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            item = batch.column("item").to_numpy()
            for name in dict.fromkeys(groups):
                total = held.setdefault(name, np.zeros((draws.n_boot, len(columns))))
                at = np.flatnonzero(groups == name)
                for i in range(0, len(at), _ITEMS):
                    mine = at[i : i + _ITEMS]
                    for k in range(0, draws.n_boot, _REPLICATES):
                        b = replicates[k : k + _REPLICATES]
                        total[b] += draws.weights(item[mine], b).T.astype(np.float64) @ values[mine]
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * draws.n_boot), pa.array(replicates), *map(pa.array, total.T)], names=["group", "b", *columns])

    schema = "group string, b long, " + ", ".join(f"`{c}` double" for c in columns)
    sums = items.select(group, F.col("item").cast("long").alias("item"), *terms).mapInArrow(add, schema)
    out = sums.groupBy("group", "b").agg(*[F.sum(c).alias(c) for c in columns])
    kinds = ", ".join(f"`{c}` {t}" for c, t in items.select(*by).dtypes)
    return out.select(F.from_json("group", kinds).alias("g"), "b", *columns).select("g.*", "b", *columns) if by else out.drop("group")


def points(items: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = ("run",)) -> DataFrame:
    """(by, metric, value) on all items."""
    named = {m.name: [f"{m.name}_{k}" for k in range(len(m.terms()))] for m in metrics}
    aggs = [F.sum(term).alias(c) for m in metrics for c, term in zip(named[m.name], m.terms(), strict=True)]
    return _valued(items.groupBy(*by).agg(*aggs).withColumn("b", F.lit(0)), metrics, named, by).drop("b")


def bootstrap_ci(items: DataFrame, weights: DataFrame | Draws, metrics: Sequence[Metric], by: Sequence[str] = ("run",), alpha: float = 0.05) -> DataFrame:
    """(by, metric, point, lo, hi): percentile intervals; replicates without a denominator don't count."""
    draws = _sums(items, weights, metrics, by).filter("value IS NOT NULL AND NOT isnan(value)")
    q = lambda p: F.percentile("value", F.lit(p))
    bounds = draws.groupBy(*by, "metric").agg(q(alpha / 2).alias("lo"), q(1 - alpha / 2).alias("hi"))
    return points(items, metrics, by).withColumnRenamed("value", "point").join(bounds, [*by, "metric"])


def paired_diff(items: DataFrame, weights: DataFrame | Draws, metrics: Sequence[Metric], run: str, against: str, alpha: float = 0.05) -> DataFrame:
    """(metric, diff, lo, hi) of run minus against, both resampled with the same weights."""
    pick = lambda df, keys: df.filter(F.col("run") == run).select(*keys, F.col("value").alias("a")).join(df.filter(F.col("run") == against).select(*keys, F.col("value").alias("z")), keys).select(*keys, (F.col("a") - F.col("z")).alias("d"))
    draws = pick(_sums(items, weights, metrics, ["run"]), ["b", "metric"]).filter("d IS NOT NULL AND NOT isnan(d)")
    q = lambda p: F.percentile("d", F.lit(p))
    bounds = draws.groupBy("metric").agg(q(alpha / 2).alias("lo"), q(1 - alpha / 2).alias("hi"))
    return pick(points(items, metrics), ["metric"]).withColumnRenamed("d", "diff").join(bounds, "metric")


def fold_of(n: int, k: int, seed: int = 13) -> dict[int, int]:
    """Fold of each item: one permutation, cut into k parts whose sizes differ by one at most."""
    if not 2 <= k <= n:
        raise ValueError("there must be at least two folds and no more than items")
    parts = np.array_split(np.random.default_rng(seed).permutation(n), k)
    return {int(i): f for f, part in enumerate(parts) for i in part}


def fold_points(items: DataFrame, folds: dict[int, int] | DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """(run, fold, metric, value); folds: each item's, as a dict or a table."""
    table = folds if isinstance(folds, DataFrame) else items.sparkSession.createDataFrame(pd.DataFrame({"item": list(folds), "fold": list(folds.values())}).astype("int32"))
    return points(items.join(table, "item"), metrics, ("run", "fold"))


def hashed_folds(items: DataFrame, k: int, seed: int = 13) -> DataFrame:
    """(item, fold): the items in the order of a hash of (seed, item), cut into k parts whose sizes differ by one at most."""
    numbers = items.select("item").distinct()
    n = numbers.count()
    if not 2 <= k <= n:
        raise ValueError("there must be at least two folds and no more than items")
    key = (F.col("item").cast("long") * 40_692 + seed * 1_000_003 + 1) % _MOD
    for shift, factor in _ROUNDS:
        key = bind(key, lambda x: x.bitwiseXOR(F.shiftright(x, shift)) * factor % _MOD)  # noqa: B023
    placed = positioned(numbers.withColumn("key_", key), "place_", "key_", "item", kind="long")
    size, longer = divmod(n, k)
    at = F.col("place_")
    fold = F.when(at < longer * (size + 1), F.floor(at / (size + 1))).otherwise(longer + F.floor((at - longer * (size + 1)) / size))
    return placed.select("item", fold.cast("int").alias("fold"))


def n_folds(items: int) -> int:
    """Three folds below 400 items, else five."""
    return 3 if items < 400 else 5


def ranks(values: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = ()) -> DataFrame:
    """``values`` with ``rank`` from 1 per metric (and by): the better value first, no value last, ties by run order."""
    better = F.lit(False)
    for m in metrics:
        better = F.when(F.col("metric") == m.name, m.higher_better).otherwise(better)
    v = F.when(better, -F.col("value")).otherwise(F.col("value"))
    missing = F.col("value").isNull() | F.isnan("value")
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("metric", *by).orderBy(missing, v, "run")))


def select_best(values: DataFrame, metrics: Sequence[Metric], order: Sequence[str]) -> DataFrame:
    """The run with the best first metric of ``order``, ties by the following ones; four decimals, a missing value counts as 0."""
    signs = {m.name: -1.0 if m.higher_better else 1.0 for m in metrics}
    wide = values.groupBy("run").pivot("metric", list(order)).agg(F.first("value"))
    keys = [F.round(F.lit(signs[m]) * F.coalesce(F.nanvl(F.col(m), F.lit(0.0)), F.lit(0.0)), 4) for m in order]
    return wide.orderBy(*keys, "run").limit(1)


#: Rows of a block of a rolling window; a wider window has blocks of its own width.
ROLLING_BLOCK = 1024


def rolling_places(items: DataFrame, num: str, den: str, width: int) -> DataFrame:
    """(run, i, rate, place): ``rolling_rate`` with the 0-based place of each full window's last item in its run.

    Rows get their places from a sort that stays dealt out, and are windowed in blocks: each block also holds the last
    ``width - 1`` rows of the one before, so no task needs a whole run.
    """
    at = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    rows = positioned(items.select("run", at.alias("i"), "id", F.col(num).alias("num_"), F.col(den).alias("den_")), "all_", "run", "i", "id", kind="long")
    first = rows.groupBy("run").agg(F.min("all_").alias("first_"))
    block = max(ROLLING_BLOCK, width)
    rows = rows.join(first, "run").withColumn("place", F.col("all_") - F.col("first_")).withColumn("own_", F.floor(F.col("place") / block))
    # The last rows of a block are the halo of the next one.
    into = F.when(F.col("place") % block > block - width, F.array("own_", F.col("own_") + 1)).otherwise(F.array("own_"))
    dealt = rows.withColumn("block_", F.explode(into))
    last = Window.partitionBy("run", "block_").orderBy("place").rowsBetween(-(width - 1), 0)
    rate = F.try_divide(F.sum("num_").over(last), F.sum("den_").over(last))
    return dealt.withColumn("rate", rate).filter((F.col("block_") == F.col("own_")) & (F.col("place") >= width - 1)).select("run", "i", "rate", "place")


def rolling_rate(items: DataFrame, num: str, den: str, width: int = 75) -> DataFrame:
    """(run, i, rate): ratio of sums over the last ``width`` items by the integer that ends an id; full windows only."""
    return rolling_places(items, num, den, width).drop("place")


def independent_diff(a: Sequence[float], b: Sequence[float], n_boot: int = 10_000, seed: int = 13) -> tuple[float, float, float]:
    """Difference of two means of short samples with bounds from separate resamples by Python's generator (sorted draws, no interpolation)."""
    import random

    rng = random.Random(seed)
    mean = lambda x: sum(x) / len(x)
    draws = sorted(mean([rng.choice(a) for _ in a]) - mean([rng.choice(b) for _ in b]) for _ in range(n_boot))
    return mean(a) - mean(b), draws[int(0.025 * n_boot)], draws[int(0.975 * n_boot)]


def independent_bounds(items: DataFrame, draws: Draws, metric: Metric, group: str, first: object, second: object, alpha: float = 0.05) -> DataFrame:
    """One row (diff, lo, hi): the metric over the items of ``first`` minus that of ``second``, resampled independently.

    ``item`` numbers the items of both samples together. Bounds are replicates by rank, without interpolation; those that
    miss a sample don't count. Nulls where a sample is empty.
    """
    at = lambda df, value, name: df.filter(F.col(group) == value).select("b", F.col("value").alias(name))
    sums = _sums(items.filter(F.col(group).isin(first, second)), draws, [metric], [group])
    d = at(sums, first, "x").join(at(sums, second, "y"), "b").select((F.col("x") - F.col("y")).alias("d")).filter("d IS NOT NULL AND NOT isnan(d)")
    ranked = F.array_sort(F.collect_list("d")).alias("d")  # as many as there are replicates, whatever the items
    spot = lambda p: F.get("d", F.floor(p * F.size("d")).cast("int"))
    bounds = d.agg(ranked).select(spot(F.lit(alpha / 2)).alias("lo"), spot(F.lit(1 - alpha / 2)).alias("hi"))
    value = lambda v: F.max(F.when(F.col(group) == v, F.col("value")))
    point = points(items, [metric], [group]).agg((value(first) - value(second)).alias("diff"))
    return point.join(bounds)


def common_ids(items: DataFrame) -> DataFrame:
    """Ids that every run has."""
    runs = items.select("run").distinct().count()
    return items.groupBy("id").agg(F.count_distinct("run").alias("n")).filter(F.col("n") == runs).select("id")


def active_metrics(items: DataFrame, metrics: Sequence[Metric]) -> list[Metric]:
    """Metrics whose columns all items have and whose denominator isn't zero in every run."""
    have = [m for m in metrics if set(m.columns) <= set(items.columns)]
    if not have:
        return []
    aggs = []
    for m in have:
        full = F.bool_and(F.lit(True))
        for c in m.columns:
            full = full & F.bool_and(F.col(c).isNotNull())
        positive = F.sum(F.col(m.columns[1])) > 0 if m.kind == "ratio" else F.lit(True)
        aggs.append((full & positive).alias(m.name))
    row = items.agg(*aggs).first()
    return [m for m in have if row[m.name]]
