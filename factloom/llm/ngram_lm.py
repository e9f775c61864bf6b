"""An n-gram language model in an Elias-Fano trie: trained on the whole corpus, memory-mapped, queried in batches.

Counts. Words are 64-bit fingerprints; one pass counts them and numbers them, and another writes every document as word
numbers. For each further order a pass leads the documents through the trie built so far and counts (context node,
word). A chunk's counts travel as compressed runs of sorted keys. Where a run is cut follows from the counts of the
order below: a shard takes a range of contexts of about ``SHARD_TOKENS`` occurrences, and a context with more of them
is split over several shards by word, so no word or context is hot. Nothing is pruned.

Trie. A shard holds, for each context of its range, a pointer to its first child; the children's word numbers relative
to their context (raised by what stands before, so that one monotone sequence results); both are Elias-Fano sequences.
Beside them stand the discounted probabilities of the children and what each context leaves to the shorter one, in 16-bit
log bins. A lookup takes a context's pointers and searches the successor of (base + word) within that range. What a
context that is split leaves stands in the model.

Smoothing is interpolated absolute discounting: p(w|c) = max(n(cw) - D, 0) / n(c) + left(c) p(w|shorter c), down to
(n(w) + 1) / (N + V + 1). A document begins in the context of an end token.

A worker keeps the last ``OPEN_SHARDS`` shards open; all that they hold stays in the mapped file, so one that was closed is
opened again for little. ``GROUP_TOKENS`` tokens, of several chunks, ask a level together: each shard is visited once for all of
them. Contexts and words are compared as pairs; packed into 64 bits is only what
stands in one shard or one chunk, whose contexts are numbered from 0 there (shards are smaller where words need many bits), so
a model's size bounds no key.

Defined results: null texts count as empty and are one end token; a null id counts as an empty text when documents are
held out; repeated rows count and are scored one by one; with nothing to train on every word is unknown; an empty
table gives an empty result; a document is handled by one task whatever its length; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import elias_fano as ef
from factloom.llm.common import doc_chunks, drop_staged, give_back, shared_dir, stage, string_bytes
from factloom.llm.wordhash import NONSPACE, scan

ORDER = 3
DISCOUNT = 0.75
#: Occurrences of n-grams that a shard gathers.
SHARD_TOKENS = 1_000_000
OPEN_SHARDS = 512
#: Bytes of text that are led through the trie at once.
_CHUNK = 4 << 20
#: Tokens of chunks that ask the shards together.
GROUP_TOKENS = 3_000_000
_U = np.uint64
END = _U(0x5EED0E4D)
_BIN = 2.0**12


def _pack_log(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-15)) * _BIN), 0, 65535).astype(np.uint16)


_LOGS = 10.0 ** (np.arange(1 << 16) / -_BIN)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of each row, then an end; and n + 1 offsets."""
    words = scan(buf, offsets, NONSPACE)
    out = np.insert(words.hashes, words.rows[1:], END)
    return out, words.rows + np.arange(len(words.rows))


class Level(NamedTuple):
    """The shards of one order: their folder, the first key of each (a fingerprint, or a context and a word), the number of its
    first node (and how many nodes there are), and the contexts that lie in several shards with what they leave."""

    folder: str
    cuts: np.ndarray
    cut_words: np.ndarray
    bases: np.ndarray
    split: np.ndarray
    left: np.ndarray

    def uri(self, k: int) -> str:
        return f"{self.folder}/{k:08d}.ef"


class Model(NamedTuple):
    """words: the level of fingerprints; total: tokens; levels: those of orders from 2 on; word_bits: the least for a word number."""

    words: Level
    total: int
    levels: list[Level]
    word_bits: int = 0

    @property
    def distinct(self) -> int:
        return int(self.words.bases[-1])

    @property
    def bits(self) -> int:
        """Bits of a word number; the number after the last stands for an unknown word."""
        return max(self.word_bits, self.distinct.bit_length())


@lru_cache(maxsize=OPEN_SHARDS)
def _open(uri: str) -> dict:
    arrays = ef.load(uri)
    names = {k.rpartition(".")[0] for k in arrays if k.endswith(".meta")}
    return {k: v for k, v in arrays.items() if "." not in k} | {k: ef.EliasFano.load(arrays, k) for k in names}


def _edges(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where the sorted keys are cut."""
    return np.concatenate([[0], np.searchsorted(keys, cuts[1:]), [len(keys)]])


def _pair_edges(context: np.ndarray, word: np.ndarray, cuts: np.ndarray, cut_words: np.ndarray) -> np.ndarray:
    """Where the sorted pairs (context, word) are cut."""
    edges, ends = np.searchsorted(context, cuts[1:]), np.searchsorted(context, cuts[1:], "right")
    for k in np.flatnonzero((cut_words[1:] > 0) & (ends > edges)).tolist():
        edges[k] += np.searchsorted(word[edges[k] : ends[k]], cut_words[k + 1])
    return np.concatenate([[0], edges, [len(context)]])


def _shards(level: Level, *edges: np.ndarray) -> Iterator[tuple[int, list[tuple[int, slice]]]]:
    """The shards that may hold some of the keys of lists that are cut so, and the range of those keys in each list."""
    sizes = np.diff(np.stack(edges), axis=1)
    for k in np.flatnonzero((sizes > 0).any(axis=0) & (np.diff(level.bases) > 0)).tolist():
        yield k, [(i, slice(int(edges[i][k]), int(edges[i][k + 1]))) for i in np.flatnonzero(sizes[:, k]).tolist()]


def distinct_pairs(context: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (context, word) of a chunk, where each pair of the input stands among them, and how often."""
    contexts, rank = np.unique(context, return_inverse=True)
    words = None
    if len(contexts).bit_length() + bits > 64:
        words, word = np.unique(word, return_inverse=True)
        bits = len(words).bit_length()
    keys, back, counts = np.unique((rank.astype(np.uint64) << _U(bits)) | word.astype(np.uint64), return_inverse=True, return_counts=True)
    found = keys & _U((1 << bits) - 1)
    return contexts[keys >> _U(bits)], found if words is None else words[found].astype(np.uint64), back, counts


def look_up_words(level: Level, keys: np.ndarray) -> np.ndarray:
    """Numbers of sorted fingerprints; -1: unknown."""
    ids = np.full(len(keys), -1, np.int64)
    for k, [(_, at)] in _shards(level, _edges(keys, level.cuts)):
        found = _open(level.uri(k))["keys"].find(keys[at] - level.cuts[k])
        ids[at] = np.where(found >= 0, found + level.bases[k], -1)
    return ids


def word_counts(level: Level, ids: np.ndarray) -> np.ndarray:
    """How often the sorted word numbers occur; -1: never."""
    out = np.zeros(len(ids), np.int64)
    for k, [(_, at)] in _shards(level, _edges(ids, level.bases[:-1])):
        out[at] = np.where(ids[at] >= 0, _open(level.uri(k))["counts"][ids[at] - level.bases[k]], 0)
    return out


def look_up_children(level: Level, asked: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node or -1, discounted probability, what the context leaves) of each list of sorted pairs (contexts, words)."""
    out = [(np.full(len(words), -1, np.int64), np.zeros(len(words)), np.ones(len(words))) for _, words in asked]
    edges = [_pair_edges(contexts, words, level.cuts, level.cut_words) for contexts, words in asked]
    for k, spans in _shards(level, *edges) if asked else ():
        shard = _open(level.uri(k))
        context, word = (np.concatenate([asked[i][c][at] for i, at in spans]) for c in (0, 1))
        new = np.concatenate([[True], context[1:] != context[:-1]])
        back = np.cumsum(new) - 1
        parent = context[new] - int(level.cuts[k])
        inside = parent < len(shard["left"])
        parent = np.where(inside, parent, 0)
        first, stop = (shard["pointers"].get(parent + d).astype(np.int64) for d in (0, 1))
        stop[~inside] = first[~inside]
        base = np.where(first > 0, shard["children"].get(np.maximum(first - 1, 0)), _U(0))
        given = np.where(inside, _LOGS[shard["left"][parent]], 1.0)
        if len(level.split):
            there = np.minimum(np.searchsorted(level.split, context[new]), len(level.split) - 1)
            given = np.where(level.split[there] == context[new], level.left[there], given)
        found = shard["children"].find(base[back] + word + _U(1))
        right = (found >= first[back]) & (found < stop[back])
        found = np.where(right, found, 0)
        values = np.where(right, found + level.bases[k], -1), np.where(right, _LOGS[shard["p"][found]], 0.0), given[back]
        done = 0
        for i, at in spans:
            n = at.stop - at.start
            for to, value in zip(out[i], values, strict=True):
                to[at] = value[done : done + n]
            done += n
    return out


def _squeeze(values: np.ndarray) -> bytes:
    """Little-endian values, byte planes apart, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unsqueeze(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).ravel().view(dtype)


# -- documents as word numbers: a row holds some documents of one task

_IDS = "ids array<long>, held array<boolean>, sizes array<long>, words binary"


class Part(NamedTuple):
    """Some documents: their token counts, and the word number of each token (-1: unknown)."""

    ids: pa.Array
    held: np.ndarray
    sizes: np.ndarray
    words: np.ndarray


def _groups(parts: Iterator, tokens_of) -> Iterator[list]:
    """Lists of parts of ``GROUP_TOKENS`` tokens or a few more."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += tokens_of(part)
        if n >= GROUP_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _distinct(lists: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(lists))


def _as_numbers(docs: DataFrame, words: Level) -> DataFrame:
    """Rows of ``_IDS`` for the rows (id, held, text) of ``docs``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            buf, offsets = string_bytes(batch.column(2))
            for i, j in doc_chunks(offsets, _CHUNK):
                seen, rows = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                unique, back = np.unique(seen, return_inverse=True)
                # Ids are copied, so that no batch of texts is held for them.
                ids, held = (pa.concat_arrays([batch.column(c).slice(i, j - i)]).take(pa.array(np.arange(j - i))) for c in (0, 1))
                yield ids, held, np.diff(rows), unique, back.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint32 if words.bases[-1] < (1 << 32) - 1 else np.uint64
        for group in _groups(chunks(batches), lambda c: len(c[4])):
            every = _distinct([unique for *_, unique, _ in group])
            known = (look_up_words(words, every) + 1).astype(kind)
            for ids, held, sizes, unique, back in group:
                numbers = known[np.searchsorted(every, unique)][back]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                columns = [one(ids), one(held), one(pa.array(sizes)), pa.array([_squeeze(numbers)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "held", "sizes", "words"])
                del numbers, columns
            del group, every, known
            give_back()

    return docs.mapInArrow(run, _IDS)


def _parts(batches: Iterator[pa.RecordBatch], words: Level) -> Iterator[Part]:
    kind = np.uint32 if words.bases[-1] < (1 << 32) - 1 else np.uint64
    for batch in batches:
        for r in range(batch.num_rows):
            ids, held, sizes = (batch.column(c).slice(r, 1).flatten() for c in range(3))
            numbers = _unsqueeze(batch.column(3)[r].as_buffer(), kind).astype(np.int64) - 1
            yield Part(ids.take(pa.array(np.arange(len(ids)))), held.to_numpy(zero_copy_only=False).astype(bool), np.array(sizes.to_numpy()), numbers)


class Asked(NamedTuple):
    """What a level says of the tokens with a known context, which stand at ``at``."""

    at: np.ndarray
    nodes: np.ndarray
    p: np.ndarray
    left: np.ndarray


class Walk:
    """The tokens of some documents led through the levels of a model, one order at a time."""

    def __init__(self, model: Model, words: np.ndarray, sizes: np.ndarray, end_id: int) -> None:
        self.model, self.words = model, words
        self.first = np.cumsum(sizes) - sizes
        #: The node of each token's context at the order at hand; -1: unknown.
        self.context = np.concatenate([[end_id], words[:-1]])[: len(words)]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, contexts, words) of the tokens whose context is known."""
        at = np.flatnonzero(self.context >= 0)
        return at, self.context[at], np.where(self.words[at] >= 0, self.words[at], self.model.distinct)

    def ask(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct sorted pairs (contexts, words) that these tokens ask the level at hand."""
        at, context, word = self.keys()
        contexts, words, back, _ = distinct_pairs(context, word, self.model.bits)
        self._at, self._back = at.astype(_index(at, len(self.words))), back.astype(_index(back, len(words)))
        return contexts, words

    def take(self, answers: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Asked:
        """What the level says of the pairs asked; contexts become those of the next one."""
        nodes, p, left = (x[self._back] for x in answers)
        here = np.full(len(self.words), -1, np.int64)
        here[self._at] = nodes
        # A document's first token has no longer context.
        self.context = np.concatenate([[-1], here[:-1]])[: len(here)]
        self.context[self.first] = -1
        return Asked(self._at, nodes, p, left)


def _index(places: np.ndarray, n: int):
    return np.int32 if n < 1 << 31 else places.dtype


def descend(walks: list[Walk], order: int) -> Iterator[Asked]:
    """Asks the level of this order for several walks at once; what it says of each."""
    if walks:
        answers = look_up_children(walks[0].model.levels[order - 2], [walk.ask() for walk in walks])
        for k, walk in enumerate(walks):
            yield walk.take(answers[k])
            answers[k] = None


# -- building a level

_RUNS = "shard long, keys binary, counts binary"
_BUILT = "shard long, n long, total long, at array<long>, pieces array<long>, of array<long>, split array<long>, types array<long>"


def _runs(spans: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(shard, its sorted keys from 0 on, their counts) as rows."""
    squeezed = [(_squeeze(np.diff(keys, prepend=_U(0))), _squeeze(counts.astype(np.uint32))) for _, keys, counts in spans]
    columns = [pa.array([k for k, _, _ in spans], pa.int64()), pa.array([x for x, _ in squeezed], pa.binary()), pa.array([x for _, x in squeezed], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts"])


def _spans(edges: np.ndarray) -> list[tuple[int, slice]]:
    return [(k, slice(int(edges[k]), int(edges[k + 1]))) for k in np.flatnonzero(np.diff(edges) > 0).tolist()]


def _cut(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where nodes with these counts are cut as contexts of the next order: (places, pieces of that context, its count)."""
    before = (np.cumsum(counts) - counts) // most
    pieces = -(-counts // most)
    at = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]) | (pieces > 1)) if len(counts) else np.zeros(0, np.int64)
    return at, np.maximum(pieces[at], 1), counts[at]


def _word_shard(keys: np.ndarray, counts: np.ndarray, shard: int):
    return _named("keys", keys) | {"counts": counts}, [], []


def _children_shard(cuts: np.ndarray, cut_words: np.ndarray, of_cut: np.ndarray, bits: int, discount: float):
    """A function from (sorted keys, contexts in them counted from the shard's first one, counts, shard) to its arrays, the
    contexts that it shares with other shards and their types."""

    def build(keys: np.ndarray, counts: np.ndarray, shard: int):
        begin = int(cuts[shard])
        context, word = keys >> _U(bits), keys & _U((1 << bits) - 1)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        types = np.diff(np.append(first, len(keys)))
        of = np.add.reduceat(counts, first)
        owner = context[first]
        shared = []
        if cut_words[shard] and owner[0] == 0:
            of[0] = of_cut[shard]
            shared.append(0)
        if shard + 1 < len(cuts) and cut_words[shard + 1] and int(owner[-1]) + begin == cuts[shard + 1]:
            of[-1] = of_cut[shard + 1]
            shared.append(len(owner) - 1)
        shared = sorted(set(shared))
        parent = owner.astype(np.int64)
        sizes = np.zeros(int(parent[-1]) + 1, np.int64)
        sizes[parent] = types
        left = np.ones(len(sizes))
        left[parent] = discount * types / of
        last = first + types - 1
        base = np.concatenate([[_U(0)], np.cumsum(word[last] + _U(1))[:-1]]).astype(np.uint64)
        arrays = _named("pointers", np.concatenate([[0], np.cumsum(sizes)])) | _named("children", word + _U(1) + np.repeat(base, types))
        arrays |= {"p": _pack_log((counts - discount) / np.repeat(of, types)), "left": _pack_log(left)}
        return arrays, (parent[shared] + begin).tolist(), types[shared].tolist()

    return build


def _named(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in ef.EliasFano.encode(values.astype(np.uint64)).items()}


def _build(runs: DataFrame, folder: str, build, most: int) -> list:
    """Add up the runs of each shard and write it; a row per shard comes to the driver."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []

        def close() -> None:
            if held:
                keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order].astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, counts = keys[first], np.add.reduceat(counts, first)
                arrays, split, types = build(keys, counts, now)
                ef.save(f"{folder}/{now:08d}.ef", arrays)
                done.append((now, len(keys), int(counts.sum()), *(x.tolist() for x in _cut(counts, most)), split, types))
                give_back()

        _open.cache_clear()
        for batch in batches:
            for shard, keys, counts in zip(*(batch.column(x) for x in range(3)), strict=True):
                if shard.as_py() != now:
                    close()
                    now = shard.as_py()
                held.append((np.cumsum(_unsqueeze(keys.as_buffer(), np.uint64), dtype=np.uint64), _unsqueeze(counts.as_buffer(), np.uint32)))
        close()
        lists = [pa.array([r[c] for r in done], pa.int64() if c < 3 else pa.list_(pa.int64())) for c in range(8)]
        yield pa.RecordBatch.from_arrays(lists, names=[x.split()[0] for x in _BUILT.split(", ")])

    return stage(runs.repartition("shard").sortWithinPartitions("shard").mapInArrow(write, _BUILT), "built").collect()


def _level(folder: str, cuts: np.ndarray, cut_words: np.ndarray, counts: dict[int, int], rows: list, discount: float) -> Level:
    """The level of the shards written. counts: of the contexts that lie in several shards."""
    sizes = np.zeros(len(cuts), np.int64)
    for r in rows:
        sizes[r.shard] = r.n
    types: dict[int, int] = {}
    for r in rows:
        for c, t in zip(r.split, r.types, strict=True):
            types[c] = types.get(c, 0) + t
    split = np.array(sorted(types), np.int64)
    left = np.array([discount * types[c] / counts[c] for c in split.tolist()], np.float64)
    return Level(folder, cuts, cut_words, np.concatenate([[0], np.cumsum(sizes)]), split, left)


def _next_cuts(rows: list, level: Level, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First context and word of the shards of the next order, and the count of the context that each one cuts in two (else 0)."""
    rows = sorted(rows, key=lambda r: r.shard)
    empty = [np.zeros(0, np.int64)]
    nodes = np.concatenate(empty + [np.array(r.at, np.int64) + level.bases[r.shard] for r in rows])
    pieces, of = (np.concatenate(empty + [np.array(getattr(r, c), np.int64) for r in rows]) for c in ("pieces", "of"))
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    word = np.array([j * distinct // k for j, k in zip(piece.tolist(), np.repeat(pieces, pieces).tolist(), strict=True)], np.uint64)
    of_cut = np.where(word > 0, np.repeat(of, pieces), 0)
    # Nodes ascend, and the pieces' words in each; a shard that would begin where the one before does is left out.
    contexts, words, of_cut = (np.concatenate([[0], x]).astype(kind) for x, kind in ((np.repeat(nodes, pieces), np.int64), (word, np.uint64), (of_cut, np.int64)))
    new = np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])])
    return contexts[new], words[new], of_cut[new]


def _count_words(texts: DataFrame, folder: str, most: int) -> tuple[Level, int, list]:
    shards = max(1, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (8 * most))
    cuts = np.array([-(-(k << 64) // shards) for k in range(shards)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = string_bytes(batch.column(0))
            for i, j in doc_chunks(offsets, _CHUNK):
                keys, counts = np.unique(tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True)
                yield _runs([(k, keys[s] - cuts[k], counts[s]) for k, s in _spans(_edges(keys, cuts))])

    rows = _build(texts.mapInArrow(count, _RUNS), folder, _word_shard, most)
    return _level(folder, cuts, np.zeros(len(cuts), np.uint64), {}, rows, 0.0), sum(r.total for r in rows), rows


def _end_id(model: Model) -> int:
    return int(look_up_words(model.words, np.array([END]))[0])


def _count_ngrams(numbers: DataFrame, model: Model, order: int, cuts: np.ndarray, cut_words: np.ndarray) -> DataFrame:
    """Runs of the n-grams of one order in the documents that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = _end_id(model)
        for group in _groups(_parts(batches, model.words), lambda part: len(part.words)):
            walks = [Walk(model, part.words[np.repeat(~part.held, part.sizes)], part.sizes[~part.held], end) for part in group]
            del group
            for lower in range(2, order):
                for _ in descend(walks, lower):
                    pass
            for walk in walks:
                contexts, words, _, counts = distinct_pairs(*walk.keys()[1:], model.bits)
                local = lambda k, s: ((contexts[s] - cuts[k]).astype(np.uint64) << _U(model.bits)) | words[s]  # noqa: B023, E731
                yield _runs([(k, local(k, s), counts[s]) for k, s in _spans(_pair_edges(contexts, words, cuts, cut_words))])
                del contexts, words, counts
            del walk, walks
            give_back()

    return numbers.mapInArrow(count, _RUNS)


def _train(picked: DataFrame, order: int, discount: float, most: int, word_bits: int = 0) -> tuple[Model, DataFrame]:
    """The model of the rows (id, held, text) that aren't held out, and all rows as word numbers."""
    folder = shared_dir(picked.sparkSession, "lm")
    words, total, rows = _count_words(picked.filter("NOT held").select("text"), f"{folder}/1", most)
    model = Model(words, total, [], word_bits)
    # A shard has a context per occurrence at most; these and a word number go into 64 bits.
    most = min(most, 1 << (63 - model.bits))
    numbers = stage(_as_numbers(picked, words), "numbers")
    level = words
    for k in range(2, order + 1):
        cuts, cut_words, of_cut = _next_cuts(rows, level, model.distinct)
        rows = _build(_count_ngrams(numbers, model, k, cuts, cut_words), f"{folder}/{k}", _children_shard(cuts, cut_words, of_cut, model.bits, discount), most)
        contexts = {int(c): int(n) for c, n in zip(cuts, of_cut, strict=True) if n}
        level = _level(f"{folder}/{k}", cuts, cut_words, contexts, rows, discount)
        model = model._replace(levels=[*model.levels, level])
    return model, numbers


def train(texts: DataFrame, text: str = "text", order: int = ORDER, discount: float = DISCOUNT, shard_tokens: int = SHARD_TOKENS) -> Model:
    """A model of all rows of ``texts``."""
    model, numbers = _train(texts.select(F.lit(None).cast("long").alias("id"), F.lit(False).alias("held"), F.col(text).alias("text")), order, discount, shard_tokens)
    drop_staged(numbers)
    return model


def held_out(id: Column) -> Column:
    """Whether a document is not learned from: crc32 of its id as text, mod 7, is 2."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _scored(numbers: DataFrame, model: Model) -> DataFrame:
    below = math.log10(model.total + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = _end_id(model)
        for group in _groups(_parts(batches, model.words), lambda part: len(part.words)):
            every = _distinct([part.words for part in group])
            known = np.log10(word_counts(model.words, every) + 1.0) - below
            bases = [known[np.searchsorted(every, part.words)] for part in group]
            base_sums = [np.add.reduceat(base, np.cumsum(part.sizes) - part.sizes) for base, part in zip(bases, group, strict=True)]
            ps = [10.0**base for base in bases]
            del bases
            walks = [Walk(model, part.words, part.sizes, end) for part in group]
            for order in range(2, len(model.levels) + 2):
                for p, asked in zip(ps, descend(walks, order), strict=True):
                    p[asked.at] = asked.p + asked.left * p[asked.at]
            for part, p, base, walk in zip(group, ps, base_sums, walks, strict=True):
                score, n_known = np.add.reduceat(np.log10(p), walk.first), np.add.reduceat((part.words >= 0).astype(np.int64), walk.first)
                yield pa.RecordBatch.from_arrays(
                    [part.ids, pa.array(part.held), pa.array(part.sizes), pa.array(n_known), pa.array(np.full(len(part.sizes), model.total, np.int64)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            del group, walks, ps, part, p, walk
            give_back()

    return numbers.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _picked(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), held_out(F.col(id)).alias("held"), F.col(text).alias("text"))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return _scored(_as_numbers(_picked(docs, id, text), model.words), model)


def train_and_score(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, shard_tokens: int = SHARD_TOKENS, word_bits: int = 0) -> DataFrame:
    """Learn from the documents that aren't held out; score all. word_bits: room for a vocabulary of that size."""
    model, numbers = _train(_picked(docs, id, text), order, DISCOUNT, shard_tokens, word_bits)
    return _scored(numbers, model)
