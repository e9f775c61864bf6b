"""Benchmark decontamination with suffix arrays over the training words.

Each chunk of documents is a shard with a suffix array of its own: all suffixes of its word sequence, sorted by prefix
doubling to ``WINDOW`` words or more; a suffix ends with its document. Every test suffix (each window of 13 consecutive
item words; a shorter item is one window) is binary-searched in it, all at once, but for those with a word that the shard
doesn't hold; the interval found gives every place where the window stands. Places on one diagonal join into maximal
verbatim matches, of which the longest of each (document, item) is reported. A shard's array serves all blocks of the
benchmark and is gone with its chunk: it takes a tenth of a second a megabyte to sort, and no other stage reads it.

The benchmark is written into blocks of bounded size in the shared folder, as the words of their items and the windows
that differ; tasks map block after block, so neither the driver nor a task ever holds it whole. Words are 64-bit
fingerprints.

Defined results: null texts have no words; an item without words has no window; repeated items and ids count once per
id, and a null item_id counts as the empty string; repeated documents keep a row each; a document without hits has no
items; a document without words is clean; an empty benchmark leaves all documents clean; a text of any length is searched
whole; other columns pass through ``remove_contaminated`` untouched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import elias_fano
from factloom.llm.common import doc_chunks, shared_dir, string_bytes, trimmed
from factloom.llm.wordhash import ALNUM, mix, scan

WINDOW = 13
BLOCK_BYTES = 4 << 20
_CHUNK = 8 << 20
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)


def suffix_array(ranks: np.ndarray, ends: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Places of the suffixes in the order of their first ``depth`` words or more.

    ranks: of each word, from 1; ends: of each word, where its document ends. A suffix that ends sorts before one that
    goes on.
    """
    place, now, done = np.arange(len(ranks)), ranks.astype(np.uint64), 1
    order = np.argsort(now)
    while done < depth and len(ranks):
        after = np.zeros(len(now), np.uint64)
        after[:-done] = np.where(place[:-done] + done < ends[:-done], now[done:], _U(0))
        key = (now << _U(32)) | after
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        now[order] = np.cumsum(new).astype(np.uint64)
        done *= 2
        if new.all():
            break
    return order


class Shard:
    """The words of some documents and their suffix array."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """rows: n + 1 word offsets of the n documents."""
        self.known, ranks = np.unique(hashes, return_inverse=True)
        self.ranks = (ranks + 1).astype(np.int32)
        self.ends = np.repeat(rows[1:], np.diff(rows))
        self.array = suffix_array(self.ranks, self.ends)

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of every place where a window of the block stands."""
        at = np.searchsorted(self.known, block.words)
        held = self.known[np.minimum(at, len(self.known) - 1)] == block.words if len(self.known) else np.zeros(len(at), bool)
        rank = np.where(held, at + 1, 0).astype(np.int32)[block.text]
        missing = np.concatenate([[0], np.cumsum(rank == 0)])
        windows = np.flatnonzero(missing[block.start + block.length] == missing[block.start])
        if not len(windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = block.start[windows][:, None] + np.arange(WINDOW)
        used = np.arange(WINDOW) < block.length[windows][:, None]
        wanted = np.where(used, rank[np.minimum(index, len(rank) - 1)], 0)
        low, high = (self._bound(wanted, used, after) for after in (False, True))
        n = high - low
        which = np.repeat(windows, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return self.array[place], which

    def _bound(self, wanted: np.ndarray, used: np.ndarray, after: bool) -> np.ndarray:
        """For each window the number of suffixes that sort before it, those that begin with it included if ``after``."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.array))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            index = self.array[mid][:, None] + np.arange(WINDOW)
            have = np.where(index < self.ends[self.array[mid]][:, None], self.ranks[np.minimum(index, len(self.ranks) - 1)], 0)
            want = wanted[open_]
            differs = (have != want) & used[open_]
            first = differs.argmax(axis=1)
            k = np.arange(len(open_))
            before = np.where(differs[k, first], have[k, first] < want[k, first], after)
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        return low


class Block:
    """The windows of some items, each once, and where they stand.

    words: the distinct words; text: their numbers, item after item; start, length: of each window in the text; bounds,
    item, at: where each stands, by window.
    """

    FIELDS = ("words", "text", "start", "length", "bounds", "item", "at")

    def __init__(self, ids: list[str], arrays: dict[str, np.ndarray]) -> None:
        self.ids = ids
        self.words, self.text, self.start, self.length, self.bounds, self.item, self.at = (arrays[f] for f in self.FIELDS)

    @staticmethod
    def of(ids: list[str], buf: np.ndarray, offsets: np.ndarray) -> Block:
        found = scan(buf, offsets, ALNUM)
        words, text = np.unique(found.hashes, return_inverse=True)
        n = np.diff(found.rows)
        per_item = np.where(n >= WINDOW, n - WINDOW + 1, n > 0)
        item = np.repeat(np.arange(len(n)), per_item)
        at = np.arange(len(item)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        length, start = np.minimum(n[item], WINDOW), found.rows[item] + at
        key = length.astype(np.uint64)
        for d in range(WINDOW):
            key = mix(key * _STEP + np.where(d < length, found.hashes[np.minimum(start + d, max(len(text) - 1, 0))] if len(text) else _U(0), _U(0)))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(len(first) + 1))
        return Block(ids, dict(zip(Block.FIELDS, (words, text.astype(np.int32), start[first], length[first], bounds, item[order], at[order]), strict=True)))

    def save(self, uri: str) -> None:
        names = np.frombuffer(json.dumps(self.ids).encode(), np.uint8)
        elias_fano.save(uri, {f: getattr(self, f) for f in self.FIELDS} | {"ids": names})


@lru_cache(maxsize=64)
def _block(uri: str) -> Block:
    arrays = elias_fano.load(uri)
    return Block(json.loads(arrays["ids"].tobytes()), arrays)


def write_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[str]:
    """Write the benchmark into files of about ``BLOCK_BYTES``; returns their names."""
    folder = shared_dir(benchmark.sparkSession, "benchmark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = [], 0, []

        def flush() -> None:
            nonlocal held, size
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                names.append(f"{folder}/{uuid.uuid4().hex}.block")
                Block.of(table.column(0).to_pylist(), *string_bytes(table.column(1))).save(names[-1])
                held, size = [], 0

        for batch in batches:
            _, offsets = string_bytes(batch.column(1))
            for i, j in doc_chunks(offsets, BLOCK_BYTES):
                if size + offsets[j] - offsets[i] > BLOCK_BYTES:
                    flush()
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["uri"])

    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # One name per block of a fixed number of bytes.
    return [r.uri for r in items.coalesce(total // BLOCK_BYTES + 1).mapInArrow(write, "uri string").collect()]


class _Judged:
    """What the search says about each row of a column of texts."""

    def __init__(self, column: pa.Array, uris: list[str]) -> None:
        buf, offsets = string_bytes(column)
        rows = len(offsets) - 1
        self.n_words, self.n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.matches: dict[int, dict[str, tuple[int, int, int]]] = {}
        for i, j in doc_chunks(offsets, _CHUNK):
            words = scan(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
            self.n_words[i:j] = np.diff(words.rows)
            if not len(words.hashes):
                continue
            shard = Shard(words.hashes, words.rows)
            delta = np.zeros(len(words.hashes) + 1, np.int64)
            for uri in uris:
                block = _block(uri)
                at, which = shard.search(block)
                if len(at):
                    delta += np.bincount(at, minlength=len(delta)) - np.bincount(at + block.length[which], minlength=len(delta))
                    self._join(block, at, which, np.searchsorted(words.rows, at, "right") - 1, words.rows, i)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
            self.n_hit[i:j] = covered[words.rows[1:]] - covered[words.rows[:-1]]

    def _join(self, block: Block, at: np.ndarray, which: np.ndarray, row: np.ndarray, rows: np.ndarray, base: int) -> None:
        """Places on one diagonal of (document, item) become maximal matches; the longest (then first) is kept."""
        n = block.bounds[which + 1] - block.bounds[which]
        k = np.repeat(np.arange(len(at)), n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.bounds[which], n)
        item, there, here, length = block.item[entry], block.at[entry], (at - rows[row])[k], block.length[which][k]
        doc = row[k]
        order = np.lexsort((here, here - there, item, doc))
        doc, item, there, here, length = (x[order] for x in (doc, item, there, here, length))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (here[1:] != here[:-1] + 1) | (there[1:] != there[:-1] + 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(doc))) - 1 + length[first]
        for d, m, a, b, s in zip((doc[first] + base).tolist(), item[first].tolist(), here[first].tolist(), there[first].tolist(), size.tolist(), strict=True):
            best = self.matches.setdefault(d, {})
            name = block.ids[m]
            if name not in best or (-s, a, b) < (-best[name][2], best[name][0], best[name][1]):
                best[name] = (a, b, s)

    @property
    def contaminated(self) -> np.ndarray:
        return (self.n_hit > 0) & (20 * self.n_hit >= self.n_words)


_MATCH = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))


def find_matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, contaminated, and for each item with a hit (in order of its id) the
    longest verbatim match and where it stands in both, in words."""
    uris = write_blocks(benchmark, item_id, item_text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Judged(batch.column(1), uris)
            matches = [[{"item_id": m, "doc_word": a, "item_word": b, "n_words": s} for m, (a, b, s) in sorted(found.matches.get(i, {}).items())] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.n_words), pa.array(found.n_hit), pa.array(found.contaminated), pa.array(matches, _MATCH_TYPE)],
                names=["doc_id", "n_words", "n_hit", "contaminated", "matches"],
            )

    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(trimmed(judge), f"doc_id long, n_words long, n_hit long, contaminated boolean, matches {_MATCH}")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``find_matches`` with the items as a count and a digest, and the length of the longest match."""
    items = F.transform("matches", lambda m: m["item_id"])
    return find_matches(docs, benchmark, **columns).select(
        "doc_id", "n_words", "n_hit", F.size("matches").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated", F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns."""
    uris, at = write_blocks(benchmark, item_id, item_text), docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_Judged(batch.column(at), uris).contaminated))

    return docs.mapInArrow(trimmed(clean), docs.schema)
