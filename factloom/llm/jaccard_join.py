"""Self-join of documents on the Jaccard similarity of their word n-grams, by MinHash banding.

1. Each document gets a 128-bit fingerprint of its word sequence and one hash per band of its MinHash signature; band
   and row counts follow from the threshold and the target recall. Equal sequences are one class from here on.
2. Classes meet in the buckets of their band hashes. Buckets with the same members count once. Classes linked by
   buckets form candidate components.
3. The n-gram sets of candidates only are computed again and dealt out by component, or by bucket where a component is
   larger than ``MOST_COMPONENT``. A group larger than ``BLOCK`` sets is dealt out as pairs of blocks, so no task holds
   more than two blocks. Within a group all pairs are verified at once on their full sets (64-bit n-gram
   fingerprints) by matrix products; a task returns a row per class with its count of links and a root, never pairs.
4. Components of verified links come from a distributed minimum-label iteration over those rows.

Words are runs of letters and digits (and all non-ASCII), A-Z as a-z. Defined results: a document of fewer words than
an n-gram has its whole sequence as its one n-gram; one without words (null, empty) links to nothing and is a class of
its own; repeated ids and rows keep a row each; a null id takes part and sorts as the largest when a class is named;
an empty table gives an empty result; a text of any length is compared by its whole set; ``keep_one`` passes all columns
through untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import bounded, doc_chunks, drop_staged, stage, string_bytes, trimmed
from factloom.llm.wordhash import ALNUM, Words, mix, scan, shingles

NGRAM = 5
#: A link is a similarity of at least this, as a fraction, unless a call gives another.
THRESHOLD = (4, 5)
#: Hashes of a band, and the share of pairs at the threshold that share a band: the number of bands follows.
ROWS, RECALL = 4, 0.99999
BLOCK, BLOCK_NGRAMS = 512, 1 << 20
MOST_COMPONENT = 8192
_CHUNK = 1 << 20
_U = np.uint64


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """How many bands of ``rows`` hashes find a pair at the threshold with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def ngrams(words: Words, k: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-grams of each row, one row after another, and n + 1 offsets."""
    n = np.diff(words.rows)
    counts = np.where(n >= k, n - k + 1, n > 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.uint64)
    every = shingles(words.hashes, k)
    long = n >= k
    at = np.repeat(words.rows[:-1][long] - (np.cumsum(counts[long]) - counts[long]), counts[long]) + np.arange(counts[long].sum())
    out[np.repeat(long, counts)] = every[at] if len(at) else 0
    for r in np.flatnonzero((n > 0) & ~long):
        out[offsets[r]] = mix(shingles(words.hashes[words.rows[r] : words.rows[r + 1]], int(n[r])) + _U(n[r]))[0]
    return out, offsets


def fingerprints(words: Words) -> list[bytes]:
    """128 bits of each row's word sequence."""
    raw = words.hashes.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True)]


def band_hashes(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows of the input, bands): a hash of each band of the MinHash signatures; zero where a row has no n-gram."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    if not len(full):
        return out
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    for b in range(bands):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            s = 2 * (b * rows + r)
            key = mix(key * _U(0xD1342543DE82EF95) + np.minimum.reduceat((grams ^ seeds[s]) * (seeds[s + 1] | _U(1)), offsets[:-1][full]))
        out[full, b] = key
    return out


def _signer(bands: int, rows: int):
    """A function for ``mapInArrow`` from (id, text) to (id, fp, n, bands)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = string_bytes(batch.column(1))
            for i, j in doc_chunks(offsets, _CHUNK):
                words = scan(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                grams, at = ngrams(words)
                hashes = band_hashes(grams, at, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(hashes.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fingerprints(words), pa.binary()), pa.array(np.diff(at)), lists], names=["id", "fp", "n", "bands"])

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = string_bytes(batch.column(1))
        for i, j in doc_chunks(offsets, _CHUNK):
            words = scan(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
            grams, at = ngrams(words)
            sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(words), pa.binary()), pa.array(sets, pa.binary())], names=["fp", "grams"])


def linked(sets: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets (of distinct values) reach the threshold, as a symmetric boolean matrix."""
    g, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    values, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g), sizes.astype(np.int64))
    shared = count > 1
    column = (np.cumsum(shared) - 1)[back]
    use = shared[back]
    owner, column = owner[use], column[use]
    both, width = np.zeros((g, g)), 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (c, c + width))
        part = np.zeros((g, width), np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        both += part @ part.T
    num, den = threshold
    out = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows of a group come one after another; returns (fp, links, root) for each class with a link."""
    done: list[tuple[bytes, int, bytes]] = []

    def close(key, rows) -> None:
        if len(rows) < 2:
            return
        yes = linked([np.frombuffer(r[3], np.uint64) for r in rows], threshold)
        if key[1] != key[2]:
            side = np.array([r[0] for r in rows])
            yes &= side[:, None] != side[None, :]
        pairs = yes
        if len(rows[0][4]):  # by bucket: a pair counts in the first bucket that it shares
            mine = np.array([r[4] for r in rows], np.int64)
            i, j = np.nonzero(yes)
            same = (mine[i] == mine[j]) & (mine[i] != 0)
            first = mine[i, same.argmax(axis=1)]
            pairs = np.zeros_like(yes)
            pairs[i, j] = first == key[0]
        copies = np.array([r[2] for r in rows], np.int64)
        links = pairs @ copies
        root = np.arange(len(rows))
        while True:
            low = np.minimum(root, np.where(yes, root[None, :], len(rows)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        for k in np.flatnonzero(yes.any(axis=1)):
            done.append((rows[k][1], int(links[k]), rows[root[k]][1]))

    key, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "a", "b", "side", "fp", "copies", "grams", "buckets")]
        for k, a, b, *row in zip(*columns, strict=True):
            if (k, a, b) != key:
                close(key, held)
                key, held = (k, a, b), []
            held.append(row)
        if done:
            yield _rows(done)
    close(key, held)
    yield _rows(done)


def _rows(done: list) -> pa.RecordBatch:
    fps, links, roots = zip(*done, strict=True) if done else ([], [], [])
    done.clear()
    return pa.RecordBatch.from_arrays([pa.array(list(fps), pa.binary()), pa.array(list(links), pa.int64()), pa.array(list(roots), pa.binary())], names=["fp", "links", "root"])


def minimum_labels(edges: DataFrame, a: str, b: str, rows: int) -> DataFrame:
    """(node, label): the smallest node of each node's component, by min-label steps with pointer jumping.

    Every step is a partial aggregation and two joins over staged tables; it ends when no label changes. Before, each node of
    side ``a``, of which a few edges at most may go, is tied to the smallest at their ends, and those to each other: a node of
    a large group brings one edge into the steps, however often it was linked. rows: a bound on the number of nodes.
    """
    ends = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).withColumn("low", F.min("v").over(Window.partitionBy("u"))), "ends", rows=rows)
    edges = ends.select(F.col("u").alias(a), F.col("low").alias(b)).union(ends.filter("v <> low").select(F.col("v").alias(a), F.col("low").alias(b))).distinct()
    both = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges", rows=2 * rows)
    labels = held = stage(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("label")), "labels", rows=rows)
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        far = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        jumped = stage(step.join(far, "label", "left").select("u", F.least("label", F.coalesce("far", "label")).alias("label"), "was"), "labels", rows=rows)
        drop_staged(held)
        held, labels = jumped, jumped.select("u", "label")
        if jumped.filter(F.col("label") != F.col("was")).isEmpty():
            drop_staged(both, ends)
            return labels.select(F.col("u").alias("node"), "label")


def _candidate_components(members: DataFrame, rows: int) -> DataFrame:
    """(fp, comp): classes that are linked by buckets, however far, share a component.

    A bucket's members are tied to its smallest one; those of a large bucket to the smallest of one of its parts, and
    the parts' to each other, so no bucket gathers in a task.
    """
    parted = members.select("fp", "bucket", F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK))).alias("part"))
    hubs = stage(parted.groupBy("bucket", "part").agg(F.min("fp").alias("hub")), "hubs", rows=rows)
    tops = hubs.groupBy("bucket").agg(F.min("hub").alias("top"))
    ties = parted.join(hubs, ["bucket", "part"]).select("fp", "hub").union(hubs.join(tops, "bucket").filter("hub <> top").select(F.col("hub").alias("fp"), F.col("top").alias("hub")))
    labels = minimum_labels(ties.distinct(), "fp", "hub", rows)
    return labels.select(F.col("node").alias("fp"), F.xxhash64("label").alias("comp"))


def _blocks_of(count, weight):
    return F.ceil(F.greatest(count / BLOCK, weight / BLOCK_NGRAMS)).cast("int")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: id, fp, whether it has words, n_copies and n_links (other documents of the same sequence,
    and at or over the threshold), and the id and fp of its group's representative: the smallest id, then fp.

    threshold: a fraction (numerator, denominator). Pairs at it share one of the bands, of ``rows`` hashes each, with
    probability ``recall``; those above it with more.
    """
    bands = bands_for(threshold[0] / threshold[1], rows, recall)
    picked = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stage(picked.mapInArrow(trimmed(_signer(bands, rows)), "id long, fp binary, n long, bands array<long>"), "signatures")
    n = signed.count()
    own = stage(signed.filter("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes", rows=n)

    put = own.select("fp", "n", F.explode("bands").alias("bucket"))
    buckets = put.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("fp")).alias("x")).filter("m > 1")
    kept = stage(buckets.groupBy("m", "w", "x").agg(F.min("bucket").alias("bucket")), "buckets", rows=n)
    members = stage(put.join(bounded(kept.select("bucket", "m", "w"), 64), "bucket"), "members", rows=n * bands)
    comps = stage(_candidate_components(members, n).join(own.select("fp", "n"), "fp"), "candidates", rows=n)
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("cm"), F.sum("n").alias("cw"))
    buckets_of = members.groupBy("fp").agg(F.collect_list(F.struct("bucket", "m", "w")).alias("in"))
    candidates = stage(comps.join(sizes, "comp").join(buckets_of, "fp").join(own.select("fp", "rep", "copies", "bands"), "fp"), "candidates", rows=n)

    wanted = bounded(stage(candidates.select(F.col("rep").alias("want")).distinct(), "wanted", rows=n), 32)
    texts = picked.join(wanted, F.col("id").eqNullSafe(F.col("want")), "left_semi")
    sets = texts.mapInArrow(trimmed(_sets), "fp binary, grams binary").groupBy("fp").agg(F.first("grams").alias("grams"))

    own_block = lambda nb: F.pmod(F.xxhash64("fp"), nb).cast("int")
    small = F.col("cm") <= MOST_COMPONENT
    empty = F.array().cast("array<bigint>")
    # The bucket of each band if it is one of the kept ones, else 0.
    kept_bands = F.transform("bands", lambda h: F.when(F.array_contains(F.transform("in", lambda x: x["bucket"]), h), h).otherwise(F.lit(0).cast("long")))
    groups = F.when(small, F.array(F.struct(F.col("comp").alias("key"), _blocks_of(F.col("cm"), F.col("cw")).alias("nb")))).otherwise(
        F.transform("in", lambda x: F.struct(x["bucket"].alias("key"), _blocks_of(x["m"], x["w"]).alias("nb")))
    )
    ready = candidates.join(sets, "fp").select("fp", "copies", "grams", F.when(small, empty).otherwise(kept_bands).alias("buckets"), F.explode(groups).alias("g"))
    ready = ready.select("fp", "copies", "grams", "buckets", F.col("g.key").alias("key"), own_block(F.col("g.nb")).alias("side"), F.explode(F.sequence(F.lit(0), F.col("g.nb") - 1)).alias("other"))
    ready = ready.select("key", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "fp", "copies", "grams", "buckets")
    found = stage(ready.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(trimmed(lambda b: _verify(b, threshold)), "fp binary, links long, root binary"), "links", rows=n)

    counts = found.groupBy("fp").agg(F.sum("links").alias("links"))
    labels = minimum_labels(found.filter("fp <> root").select("fp", "root"), "fp", "root", n).withColumnRenamed("node", "fp")
    named = own.select("fp", "rep", "copies").join(counts, "fp", "left").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stage(named, "named", rows=n)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), F.col("fp").alias("fp"))).alias("first")
    # Staged, so that a label that many classes share is a skewed join, which is split at run time.
    tops = bounded(stage(named.groupBy("label").agg(first), "tops", rows=n), 64)
    per_class = named.join(tops, "label").select("fp", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("first.rep").alias("top"), F.col("first.fp").alias("top_fp"))
    per_class = stage(per_class, "per-class", rows=n)
    drop_staged(members, candidates, found, named)
    per_class = bounded(per_class, 96)
    out = signed.select("id", "fp", "n").join(per_class.withColumnRenamed("fp", "c_fp"), (F.col("fp") == F.col("c_fp")) & (F.col("n") > 0), "left")
    has = F.col("c_fp").isNotNull()
    return out.select(
        "id", "fp", has.alias("has_words"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
        F.when(has, F.col("top")).otherwise(F.col("id")).alias("class_id"), F.when(has, F.col("top_fp")).otherwise(F.col("fp")).alias("class_fp"),
    )


def join_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links and, of those, n_copies with the same words; options as of ``classes``."""
    return classes(docs, **options).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row of each group, that of the smallest id, with all columns; rows without words all stay."""
    judged = stage(classes(docs, id, text, threshold), "groups")
    n = judged.count()
    stays = ~F.col("has_words") | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("fp") == F.col("class_fp")))
    per_id = stage(judged.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(stays).alias("kept")), "ids", rows=n)
    drop = bounded(stage(per_id.filter("kept = 0").select(F.col("id").alias("drop_id")), "dropped", rows=n), 32)
    docs_id = F.col(id).cast("long")
    out = docs.join(drop, docs_id.eqNullSafe(F.col("drop_id")), "left_anti")
    many = stage(per_id.filter("kept > 0 AND rows > 1").select(F.col("id").alias("many_id")), "repeated", rows=n)
    if many.isEmpty():
        return out
    # Ids with several rows, some of which stay: choose by fingerprint, and one of rows that are alike.
    many = bounded(many, 32)
    single = out.join(many, docs_id.eqNullSafe(F.col("many_id")), "left_anti")
    wrapped = out.join(many, docs_id.eqNullSafe(F.col("many_id")), "left_semi").select(docs_id.alias("id"), F.col(text).alias("text"), F.struct(*[out[c] for c in docs.columns]).alias("row"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = string_bytes(batch.column(1))
            words = scan(buf, offsets, ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(words), pa.binary()), pa.array(np.diff(words.rows) > 0), batch.column(2)], names=["id", "fp", "has_words", "row"])

    schema = f"id long, fp binary, has_words boolean, row {wrapped.schema['row'].dataType.simpleString()}"
    marked = wrapped.mapInArrow(mark, schema)
    right = judged.filter(stays & F.col("has_words")).select(F.col("id").alias("k_id"), F.col("fp").alias("k_fp")).distinct()
    worded = marked.filter("has_words").join(right, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("fp") == F.col("k_fp")), "left_semi")
    one = worded.groupBy("id", "fp").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return single.unionByName(marked.filter("NOT has_words").select("row.*")).unionByName(one)
