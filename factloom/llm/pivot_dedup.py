"""Near-duplicate embeddings by a pivot-permutation index: links at a cosine of at least 0.9, and their components.

1. Equal vectors are one class from here on. Reference points are chosen by farthest-first traversal of a sample by hash
   (``SAMPLE`` classes, within ``SAMPLE_BYTES``; every class is indexed), so a crowd of near copies holds one of them at most.
2. A class is described by its ``PREFIX`` nearest reference points, in order.
3. Classes close round a leader form a ball, within which all link: in each of ``ROUNDS`` rounds, the class of least hash
   among the free ones of each first reference point leads, and takes in those so close to it that any two of them are linked by the
   triangle inequality. Other classes are balls of their own. So a crowd of near copies is compared as a few balls.
4. Inverted lists: two prefixes share ``SHARED`` reference points exactly if they share a set of that many, so lists are kept per
   set, which keeps them short; a list per point would hold a row in ``PIVOTS / PREFIX``. Balls that meet in a list are candidates. A
   list longer than ``LONG`` is dealt out as pairs of blocks that are compared by matrix products, so no task holds more than two
   blocks and no pair is emitted that can't link.
5. Candidate balls all of whose classes link, or none, by angle and radii, need no look at their classes; others are verified
   class by class, in blocks, which return counts and never pairs. Components come from a distributed minimum-label iteration.

A pair is looked at if its prefixes share ``SHARED`` points: by simulation of random directions in 64 dimensions 0.96 of pairs
at a cosine of 0.9, 0.98 at 0.92 and 0.9998 at 0.95; no cosine below 0.9 links. There is no cap on candidates or partners.

Defined results: a vector that is null, empty or zero, holds a null or non-finite entry, or whose length isn't the most
frequent (of two as frequent, the larger) links to nothing and is a component of its own; null ids take part, a component is
named by its smallest id that isn't null, and by null if it has none (a row is kept whose id equals that name, null equal to
null); repeated rows each have a row and link to each other; equal cosines need no order; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop_staged, stage, trimmed
from factloom.llm.jaccard_join import minimum_labels
from factloom.llm.vectors import dimension, lists, matrix, usable

THRESHOLD = 0.9
PIVOTS, PREFIX, SHARED = 2048, 10, 3
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
ROUNDS = 4
#: Balls of a list that are paired by their numbers; longer lists go by blocks.
LONG = 64
BLOCK = 512
_CHUNK = 1024
#: Angles nearer than this to a decision are not decided by it.
_MARGIN = 1e-6


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no product overflows or vanishes; cosines stay the same to the bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``a`` and ``b``, in double precision."""
    return (a @ b.T) / np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def reference_points(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Rows of ``sample`` by farthest-first traversal: each the one whose nearest so far is farthest, while below ``apart``."""
    unit = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(most, len(unit)):
        k = int(nearest.argmin())
        if nearest[k] >= apart:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, unit @ unit[k])
    return unit[chosen]


def _classes(table: DataFrame, id: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """Every row's id and class (a 128-bit hash of its vector, null if it links to nothing); the staged classes; their dimension."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id).cast("long").alias("id"), v.alias("v"))
    good = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    width = dimension(rows.filter(good), "v")
    good = F.coalesce(good & (F.size("v") == width), F.lit(False))
    named = rows.select("id", *[F.when(good, F.xxhash64(F.lit(s), "v")).alias(h) for s, h in ((1, "h"), (2, "g"))], F.when(good, F.col("v")).alias("v"))
    found = named.filter("h IS NOT NULL").groupBy("h", "g").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return named.select("id", "h", "g"), stage(found.withColumn("cid", F.monotonically_increasing_id()), "classes"), width


def _sample(classes: DataFrame, n: int, width: int) -> np.ndarray:
    """About ``SAMPLE`` classes by hash, all of them if there are no more."""
    most = max(PREFIX, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    part = classes if n <= most else classes.filter(F.pmod("h", F.lit(1 << 40)) < (most << 40) // n)
    rows = sorted((r.h, r.g, r.v) for r in part.select("h", "g", "v").collect())
    return scaled(np.array([v for *_, v in rows], np.float64)) if rows else np.array([classes.first().v])


def _nearest(v: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """The k nearest reference points of each row, the nearest first."""
    near = v @ points.T
    top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(points) else np.tile(np.arange(len(points)), (len(v), 1))
    order = np.lexsort((top, -np.take_along_axis(near, top, axis=1)), axis=1)
    return np.take_along_axis(top, order, axis=1)


def _describe(classes: DataFrame, points: np.ndarray, width: int) -> DataFrame:
    k = min(PREFIX, len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                v = scaled(matrix(part.column("v"), width))
                kept = [part.column(c) for c in ("cid", "h", "g", "least", "copies")]
                yield pa.RecordBatch.from_arrays([*kept, lists(v, pa.float64()), lists(_nearest(v, points, k), pa.int32())], names=["cid", "h", "g", "least", "copies", "v", "points"])

    out = classes.select("cid", "h", "g", "least", "copies", "v").mapInArrow(trimmed(run), "cid long, h long, g long, least long, copies long, v array<double>, points array<int>")
    return stage(out, "described")


def _balls(described: DataFrame, width: int, threshold: float) -> DataFrame:
    """``described`` with the class that leads each one's ball and the angle to it; a round has a leader per reference point at most."""
    within = math.acos(threshold) / 2 - _MARGIN
    rounds: list[dict[int, tuple[int, np.ndarray]]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, first = matrix(batch.column("v"), width), batch.column("points").flatten().to_numpy().reshape(batch.num_rows, -1)[:, 0]
            cid = batch.column("cid").to_numpy()
            ball, angle, free = cid.copy(), np.zeros(len(cid)), np.ones(len(cid), bool)
            for leaders in rounds:
                for point in np.unique(first[free]).tolist():
                    if point in leaders:
                        at = np.flatnonzero(free & (first == point))
                        number, leader = leaders[point]
                        far = np.where(cid[at] == number, 0.0, angles(cosines(v[at], leader[None])[:, 0]))
                        near = at[far <= within]
                        ball[near], angle[near], free[near] = number, far[far <= within], False
            columns = [batch.column(c) for c in ("cid", "h", "g", "least", "copies", "v", "points")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ball), pa.array(angle), pa.array(free)], names=["cid", "h", "g", "least", "copies", "v", "points", "ball", "angle", "free"])

    schema = described.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", ball long, angle double, free boolean"
    for _ in range(ROUNDS):
        free = described.mapInArrow(trimmed(run), schema).filter("free")
        found = free.groupBy(F.col("points")[0].alias("point")).agg(F.min_by(F.struct("cid", "v"), F.struct("h", "g")).alias("led")).collect()
        rounds.append({r.point: (r.led.cid, np.array(r.led.v)) for r in found})
    return stage(described.mapInArrow(trimmed(run), schema).drop("free"), "members")


def _lists(members: DataFrame) -> DataFrame:
    """(key, ball): the balls of each set of ``SHARED`` reference points that some prefix holds, once each; lists of one are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                points = np.sort(part.column("points").flatten().to_numpy().reshape(part.num_rows, -1), axis=1).astype(np.int64)
                keys = np.zeros((part.num_rows, 0), np.int64)
                for chosen in combinations(range(points.shape[1]), min(SHARED, points.shape[1])):
                    key = np.zeros(part.num_rows, np.int64)
                    for c in chosen:
                        key = key * PIVOTS + points[:, c]
                    keys = np.hstack([keys, key[:, None]])
                ball = np.repeat(part.column("ball").to_numpy(), keys.shape[1])
                both = np.unique(np.stack([keys.ravel(), ball]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["key", "ball"])

    held = stage(members.select("points", "ball").mapInArrow(trimmed(run), "key long, ball long").distinct(), "lists")
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    out = stage(held.join(counts, "key"), "lists")
    drop_staged(held)
    return out


def _may_link(angle: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> np.ndarray:
    return angle - ra - rb <= math.acos(threshold) + _MARGIN


def _close_balls(lists_: DataFrame, balls: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, all): the pairs of balls that meet in a list and may link, and whether all of their classes surely do."""
    surely = math.acos(threshold) - _MARGIN
    short = lists_.filter(F.col("m") <= LONG).groupBy("key").agg(F.array_sort(F.collect_list("ball")).alias("l"))
    later = lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = short.select(F.explode(F.flatten(F.transform("l", later))).alias("p")).select("p.a", "p.b").distinct()
    side = lambda s: balls.select(F.col("ball").alias(s), F.col("v").alias(f"v{s}"), F.col("radius").alias(f"r{s}"))

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column("va"), width), matrix(batch.column("vb"), width)
            ra, rb = batch.column("ra").to_numpy(), batch.column("rb").to_numpy()
            angle = angles((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)))
            yes = pa.array(_may_link(angle, ra, rb, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(yes), batch.column("b").filter(yes), pa.array(angle + ra + rb <= surely).filter(yes)], names=["a", "b", "every"])

    schema = "a long, b long, every boolean"
    found = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(trimmed(one_by_one), schema)

    def block_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (na, a, ra), (nb, b, rb) = (_block(batch.column(s)[k], width, "ball", "radius") for s in ("x", "y"))
                angle = angles(cosines(a, b))
                i, j = np.nonzero(_may_link(angle, ra[:, None], rb[None, :], threshold) & (na[:, None] != nb[None, :]))
                low, high = np.minimum(na[i], nb[j]), np.maximum(na[i], nb[j])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(angle[i, j] + ra[i] + rb[j] <= surely)], names=["a", "b", "every"])

    part = F.pmod(F.xxhash64("ball"), F.ceil(F.col("m") / BLOCK)).alias("part")
    blocks = lists_.filter(F.col("m") > LONG).select("key", "ball", part).join(balls.select("ball", "v", "radius"), "ball")
    blocks = stage(blocks.groupBy("key", "part").agg(F.collect_list(F.struct("ball", "v", "radius")).alias("rows")), "blocks")
    x, y = (blocks.select("key", F.col("part").alias(f"p{s}"), F.col("rows").alias(s)) for s in ("x", "y"))
    far = x.join(y, "key").filter("px <= py").select("x", "y").mapInArrow(trimmed(block_by_block), schema)
    return stage(found.union(far).groupBy("a", "b").agg(F.max("every").alias("every")), "close")


def _block(rows: pa.StructScalar, width: int, number: str, weight: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, vectors and weights of a list of (number, v, weight)."""
    values = rows.values
    return values.field(number).to_numpy(), matrix(values.field("v"), width), values.field(weight).to_numpy()


def _verified(members: DataFrame, close: DataFrame, balls: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For pairs of balls that neither surely link throughout nor surely don't: (cid, links) and the pairs (a, b) with a link."""
    open_ = close.filter("NOT every").select("a", "b")
    wanted = open_.select(F.col("a").alias("ball")).union(open_.select("b")).distinct()
    size = balls.select("ball", "classes")
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("classes") / BLOCK)).alias("part")
    held = members.join(wanted, "ball", "left_semi").join(size, "ball").select("ball", "cid", "v", "copies", part)
    blocks = stage(held.groupBy("ball", "part").agg(F.collect_list(F.struct("cid", "v", "copies")).alias("rows")), "blocks")
    side = lambda s: blocks.select(F.col("ball").alias(s), F.col("rows").alias(f"rows_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, links, pairs = [], [], []
            for k in range(batch.num_rows):
                (na, a, wa), (nb, b, wb) = (_block(batch.column(f"rows_{s}")[k], width, "cid", "copies") for s in "ab")
                yes = cosines(a, b) >= threshold
                if yes.any():
                    pairs.append((batch.column("a")[k].as_py(), batch.column("b")[k].as_py()))
                    cids += [na, nb]
                    links += [yes @ wb, wa @ yes]
            cid, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cids, links))
            ends = np.array(pairs, np.int64).reshape(-1, 2)
            nulls = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(cid, pa.int64()), nulls(len(ends), pa.int64())]), pa.concat_arrays([pa.array(n, pa.int64()), nulls(len(ends), pa.int64())]),
                 *[pa.concat_arrays([nulls(len(cid), pa.int64()), pa.array(ends[:, e], pa.int64())]) for e in (0, 1)]], names=["cid", "links", "a", "b"],
            )

    both = open_.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rows_a", "rows_b")
    out = stage(both.mapInArrow(trimmed(run), "cid long, links long, a long, b long"), "verified")
    return out.filter("cid IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links")), out.filter("a IS NOT NULL").select("a", "b").distinct()


def link(table: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``table``: id, n_links, component_id (the smallest id reachable by links) and kept (that id is its own)."""
    rows, classes, width = _classes(table, id, vector)
    n = classes.count()
    if n:
        per_class = _link_classes(classes, n, width, threshold)
    else:
        per_class = classes.select("h", "g", F.col("copies").alias("n_links"), F.col("least").alias("component"))
    found = rows.join(per_class.select(F.col("h").alias("ch"), F.col("g").alias("cg"), "n_links", "component"), (F.col("h") == F.col("ch")) & (F.col("g") == F.col("cg")), "left")
    component = F.when(F.col("ch").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _link_classes(classes: DataFrame, n: int, width: int, threshold: float) -> DataFrame:
    """(h, g, n_links, component) of each class."""
    points = reference_points(_sample(classes, n, width), PIVOTS, threshold)
    described = _describe(classes, points, width)
    members = _balls(described, width, threshold)
    balls = members.groupBy("ball").agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("classes"), F.max("angle").alias("radius"), F.min("least").alias("least"),
        F.max(F.when(F.col("cid") == F.col("ball"), F.col("v"))).alias("v"),
    )
    balls = stage(balls, "balls", rows=n)
    met = _lists(members)
    close = _close_balls(met, balls, width, threshold)
    links, edges = _verified(members, close, balls, width, threshold)
    links = stage(links, "links", rows=n)

    sure = close.filter("every").select("a", "b")
    rows_of = balls.select(F.col("ball").alias("other"), F.col("rows").alias("other_rows"))
    both = sure.select(F.col("a").alias("ball"), F.col("b").alias("other")).union(sure.select("b", "a"))
    whole = both.join(rows_of, "other").groupBy("ball").agg(F.sum("other_rows").alias("whole"))
    labels = minimum_labels(sure.union(edges), "a", "b", n)
    named = stage(balls.select("ball", "rows", "least").join(whole, "ball", "left").join(labels.withColumnRenamed("node", "ball"), "ball", "left").withColumn("label", F.coalesce("label", "ball")), "named", rows=n)
    tops = stage(named.groupBy("label").agg(F.min("least").alias("component")), "tops", rows=n)
    per_ball = stage(named.join(tops, "label").select("ball", "rows", F.coalesce("whole", F.lit(0)).alias("whole"), "component"), "per-ball", rows=n)
    out = members.select("ball", "cid", "h", "g").join(per_ball, "ball").join(links, "cid", "left")
    out = stage(out.select("h", "g", (F.col("rows") - 1 + F.col("whole") + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "per-class", rows=n)
    drop_staged(classes, described, members, met, close, balls, named)
    return out
