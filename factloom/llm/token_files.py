"""Token ids in Arrow stream files of equal-length sequences, readable at random without copies.

A shard is one file in Arrow's stream format with two fixed-size-list columns: ``ids`` and ``mask`` (false on the
padding of the shard's last sequence). All batches but the last hold ``BATCH_ROWS`` sequences, so a batch begins at
a multiple of one stride and a sequence is a view into the memory-mapped file. Documents follow each other in
ascending id (ties by text), each closed by the end id, over sequences and shards. Ids take 16 bits where the
vocabulary allows it.

Shards are the range partitions of the documents by id; a shard is written under a name of its own and renamed, and
the index of documents is staged, so a lost executor costs a repeated task only. Starts over all shards are a
running sum over one row per shard.

Defined results: a null text counts as empty and gives the end id alone; a null id sorts first; repeated ids keep a
row each; an empty table writes no shard and gives an empty result; a text of any length is one document, over as many
sequences as it takes; other columns are not looked at; ids of the index are 64-bit integers.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import bounded, doc_chunks, open_fs, read_bytes, shared_dir, stage, string_bytes, trimmed
from factloom.llm.wordhash import mix

SEQUENCE, BATCH_ROWS = 2048, 64
_CHUNK = 1 << 19
#: Characters of a text that deal out rows of one id.
TIE_CHARS = 16
#: Pre-tokens that a worker remembers before it begins anew.
CACHE = 600_000
_U = np.uint64
_SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def _classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    import regex

    table = np.full(0x110000, 3, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    at = np.array(points)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    table[list(_SPACES)] = 0
    return table


def split_points(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokens of the rows begin.

    points: code points of all rows; offsets: n + 1 row offsets. The rule is the byte-level pattern of the public
    50k vocabulary: contractions, runs of letters, numbers or other signs with at most one leading space, and white
    space, of which a run leaves its last character to what follows.
    """
    n = len(points)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    begin = begin[:n]
    kind = _classes()[points]
    change = begin.copy()
    change[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 32
    after_blank &= ~begin
    solid = kind != 0
    start = change & ~(solid & after_blank)
    after_space = np.zeros(n, bool)
    after_space[1:] = ~solid[:-1]
    start[np.flatnonzero(change & solid & ~begin & after_space) - 1] = True
    marks = np.flatnonzero((points == 39) & start)
    if len(marks):
        end = offsets[np.searchsorted(offsets, marks, "right")]
        at = lambda d: np.where(marks + d < end, points[np.minimum(marks + d, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for hit, length in ((short, 2), (long, 3)):
            first, stop = marks[hit], end[hit]
            start[first + 1] = False
            follow = first + length
            start[follow[follow < stop]] = True
    return np.flatnonzero(start)


class Encoder:
    """Token ids of whole columns by the tokenizers library.

    For a plain byte-level BPE file each distinct pre-token is given to the library once and remembered by a 64-bit
    fingerprint; other files are given whole texts. Strings of special tokens in a text are ordinary text, as the
    description of the vocabulary files has it: a document can't forge an end.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.model = self.library.model
        if self.plain:
            self.model._resize_cache(0)
            shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
            hidden = [c for c in range(256) if c not in set(shown)]
            self.letters = {**{c: chr(c) for c in shown}, **{c: chr(256 + k) for k, c in enumerate(hidden)}}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.spans = np.zeros((1 << 12, 2), np.int64)

    def _learn(self, key: int, word: str) -> int:
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        k = self.known[key] = len(self.known)
        if k >= len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.spans[k] = self.used, len(ids)
        self.used += len(ids)
        return k

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, one after another, and how many each row has."""
        try:
            text = buf.tobytes().decode()
        except UnicodeDecodeError:
            return self._whole([buf[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        if not self.plain:
            return self._whole([buf[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        if not text:
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        count = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=count[1:])
        rows = count[offsets]
        starts = split_points(points, rows)
        ends = np.append(starts[1:], len(points))
        power, inverse = _code_powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + _U(1)) * power[: len(points)], out=total[1:])
        keys, where, back = np.unique(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._forget()
        get, a, b = self.known.get, starts[where].tolist(), ends[where].tolist()
        slots = np.array([k if (k := get(key)) is not None else self._learn(key, text[a[i] : b[i]]) for i, key in enumerate(keys.tolist())], np.int64)
        spans = self.spans[slots[back]]
        sizes = spans[:, 1]
        stop = np.cumsum(sizes)
        ids = self.flat[np.arange(stop[-1]) + np.repeat(spans[:, 0] - (stop - sizes), sizes)]
        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, rows)]
        return ids, np.diff(bounds)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), self.dtype), np.array([len(x) for x in found], np.int64)


_tables: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _code_powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        n = max(n, _CHUNK + 1)
        base = 0x2545F4914F6CDD1D
        for k, x in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _tables[k] = np.multiply.accumulate(steps)
    return _tables


class ShardWriter:
    """Writes ids into one shard, sequence by sequence."""

    def __init__(self, uri: str, dtype) -> None:
        import uuid

        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.dtype, self.held, self.n = dtype, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.ipc = pa.ipc.new_stream(self.out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= SEQUENCE * BATCH_ROWS:
            flat, size = np.concatenate(self.held), SEQUENCE * BATCH_ROWS
            whole = len(flat) // size * size
            for i in range(0, whole, size):
                self._batch(flat[i : i + size], size)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(x, SEQUENCE) for x in (pa.array(ids), mask)]
        self.ipc.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.zeros(-(-self.n // SEQUENCE) * SEQUENCE, self.dtype)
            flat[: self.n] = np.concatenate(self.held)
            self._batch(flat, self.n)
        self.ipc.close()
        self.out.close()
        self.fs.move(self.tmp, self.path)


class Shard:
    """A shard for reading. ``sequence(k)`` and ``mask(k)`` are views into the file's memory."""

    def __init__(self, uri: str) -> None:
        self.buffer = read_bytes(uri)
        source = pa.BufferReader(self.buffer)
        reader = pa.ipc.open_stream(source)
        self.raw = np.frombuffer(self.buffer, np.uint8)
        self.head, self.schema = source.tell(), reader.schema
        batch = next(iter(reader), None)
        self.rows = 0
        if batch is not None:
            ids, mask = (batch.column(k).values for k in (0, 1))
            self.dtype = np.dtype(ids.type.to_pandas_dtype())
            self.stride = source.tell() - self.head
            self.ids_at, self.mask_at = (x.buffers()[1].address - self.buffer.address for x in (ids, mask))
            self.rows = len(batch)

    def sequence(self, k: int) -> np.ndarray:
        at = self.ids_at + k // self.rows * self.stride + k % self.rows * SEQUENCE * self.dtype.itemsize
        return self.raw[at : at + SEQUENCE * self.dtype.itemsize].view(self.dtype)

    def mask(self, k: int) -> np.ndarray:
        """Packed bits, lowest first."""
        at = self._mask_at(k)
        return self.raw[at : at + SEQUENCE // 8]

    def _mask_at(self, k: int) -> int:
        # A shorter last batch has its mask nearer to its ids.
        last = (len(self.raw) - self.ids_at) // self.stride if self.rows == BATCH_ROWS else 0
        if k // self.rows < last:
            return self.mask_at + k // self.rows * self.stride + k % self.rows * (SEQUENCE // 8)
        message = pa.ipc.read_message(pa.BufferReader(self.buffer.slice(self.head + k // self.rows * self.stride)))
        batch = pa.ipc.read_record_batch(message, self.schema)
        return batch.column(1).values.buffers()[1].address - self.buffer.address + k % self.rows * (SEQUENCE // 8)

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the shard's ``start``-th on."""
        parts, size = [], SEQUENCE * self.rows
        while n > 0:
            b, at = divmod(start, size)
            take = min(n, size - at)
            where = self.ids_at + b * self.stride + at * self.dtype.itemsize
            parts.append(self.raw[where : where + take * self.dtype.itemsize].view(self.dtype))
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.arrows"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Write the shards; returns their folder and the index (doc_id, shard, shard_start, n_tokens)."""
    folder = shared_dir(docs.sparkSession, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = writer = None
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or _encoder(tokenizer)
            writer = writer or ShardWriter(shard_uri(folder, shard), encoder.dtype)
            buf, offsets = string_bytes(batch.column(1))
            counts = []
            for i, j in doc_chunks(offsets, _CHUNK):
                ids, n = encoder(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                writer.add(np.insert(ids, np.cumsum(n), end_id))
                counts.append(n + 1)
            n = np.concatenate(counts)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.full(len(n), shard, np.int64)), pa.array(starts), pa.array(n)], names=["doc_id", "shard", "shard_start", "n_tokens"])
        if writer:
            writer.close()

    # Ranges are sampled on the driver: of a text only its beginning goes there, which parts equal ids as the order by text does.
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = picked.repartitionByRange("doc_id", F.substring("text", 1, TIE_CHARS)).sortWithinPartitions("doc_id", "text")
    return folder, stage(dealt.mapInArrow(trimmed(encode), "doc_id long, shard long, shard_start long, n_tokens long"), "token-index")


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def read_tokens(folder: str, index: DataFrame) -> DataFrame:
    """Per document, read back from the shards: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Shard] = {}
        for batch in batches:
            crcs = np.empty(batch.num_rows, np.int64)
            for i, (s, at, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("shard", "shard_start", "n_tokens")), strict=True)):
                if s not in opened:
                    while len(opened) >= 4:
                        opened.pop(next(iter(opened)))
                    opened[s] = Shard(shard_uri(folder, s))
                crcs[i] = zlib.crc32(opened[s].read(at, n).astype("<u4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = shards.select(F.col("shard").alias("b_shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    # One row per shard, of which there are as many as tasks.
    bases = bounded(stage(bases, "bases"), 32)
    placed = index.join(bases, F.col("shard") == F.col("b_shard")).withColumn("start", F.col("base") + F.col("shard_start"))
    return placed.select("doc_id", "start", "n_tokens", "shard", "shard_start").mapInArrow(trimmed(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
