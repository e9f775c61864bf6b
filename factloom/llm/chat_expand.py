"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

The output holds a row per turn, with the formatted turn, and a row per example: an assistant turn is exploded into its
reply, which alone is trainable, and a reference to its context, which is everything of its conversation's stream before
it: context = stream[0:context_to], target = stream[target_from:target_to]. Written out in each row, the contexts would
take the square of a long conversation; ``examples`` writes them out as it is read. The loss is read from the example
rows.

Template of a turn: ``<s>ROLE[INST]TEXT[/INST]</s>``. Inside ROLE and TEXT a backslash is doubled and every control
string gets a backslash after its first character, so escaped text never holds one and unescaping is exact.

Defined results: null role or text counts as empty; turns of a conversation are ordered by turn, then role, then
text, nulls first, and repeated rows all stay; a null conv_id is a conversation like any other; a conversation
without assistant turns has no example and an empty loss; an empty table gives an empty result; other columns are
not carried. A conversation is streamed in turn order by one task, which holds one Arrow batch of it at a time: its
digests are sequential. Nothing is gathered per conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stage

#: Characters of examples that a batch gathers before it is passed on; a longer example is a batch of its own.
EXAMPLE_CHARS = 8 << 20

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.S)
TRAINED_ROLE = "assistant"
TURN_END = "[/INST]</s>"


def escape(text: str) -> str:
    """``text`` without control strings, reversibly."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its escaped text begins and ends in it."""
    head, body = f"<s>{escape(role)}[INST]", escape(text)
    return f"{head}{body}{TURN_END}", len(head), len(head) + len(body)


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = segment.removeprefix("<s>").partition("[INST]")
    return unescape(role), unescape(rest.removesuffix(TURN_END))


_OUTPUT = "conv_id long, ordinal long, segment string, stream_from long, context_to long, target_from long, target_to long, target string"
_ROWS = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in _OUTPUT.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, ordinal, at, begun = None, 0, 0, False
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if not begun or c != conv:
                conv, ordinal, at, begun = c, 0, 0, True
            segment, a, b = format_turn(role or "", text or "")
            out.append((c, ordinal, segment, at, None, None, None, None))
            if role == TRAINED_ROLE:
                out.append((c, ordinal, None, None, at + a, at + a, at + b, segment[a:b]))
            ordinal, at = ordinal + 1, at + len(segment)
        yield _batch(out, _ROWS)


def expand(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The written output: a row per turn (with ``segment``) and a row per example (with ``target``)."""
    turns = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(dealt.mapInArrow(_format, _OUTPUT), "chat")


def render(output: DataFrame, conv_id: int, ordinal: int) -> tuple[str, str]:
    """(context, target) of one example, read from the output."""
    mine = output.filter((F.col("conv_id") == conv_id) & (F.col("ordinal") <= ordinal))
    stream = "".join(r.segment for r in mine.filter("segment IS NOT NULL").orderBy("ordinal").collect())
    example = mine.filter((F.col("ordinal") == ordinal) & F.col("target").isNotNull()).first()
    return stream[: example.context_to], example.target


def _in_order(output: DataFrame) -> DataFrame:
    """Rows of a conversation together, each turn before its example."""
    return output.repartition("conv_id").sortWithinPartitions("conv_id", "ordinal", F.col("target").isNotNull())


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, stream, begun, size = None, "", False, 0
    rows: list[tuple] = []
    for batch in batches:
        for c, ordinal, segment, to, target in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "ordinal", "segment", "context_to", "target")), strict=True):
            if not begun or c != conv:
                conv, stream, begun = c, "", True
            if segment is not None:
                stream += segment
                continue
            if rows and size + to + len(target) > EXAMPLE_CHARS:
                yield _batch(rows, _EXAMPLES)
                size = 0
            rows.append((c, ordinal, stream[:to], target))
            size += to + len(target)
    yield _batch(rows, _EXAMPLES)


_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("ordinal", pa.int64()), ("context", pa.string()), ("target", pa.string())])


def examples(output: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, ordinal, context (all before its text) and target, from the output.

    A task holds the stream of the conversation at hand. Written out, the contexts of a conversation take the square of its turns.
    """
    return _in_order(output).mapInArrow(_examples, "conv_id long, ordinal long, context string, target string")


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"
_DIGEST_SCHEMA = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in _DIGESTS.split(", ")])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    now = None

    def close() -> None:
        if now is not None:
            conv, n, turns, chars, loss, formatted, examples, expanded = now
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, examples, expanded))

    for batch in batches:
        for conv, segment, to, a, b, target in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "context_to", "target_from", "target_to", "target")), strict=True):
            if now is None or now[0] != conv:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            if segment is not None:
                role, text = parse_turn(segment)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[5] += len(segment)
                continue
            reply = unescape(target)
            now[3] += len(reply)
            now[4].update(reply.encode())
            now[6] += 1
            now[7] += to + (b - a) + len(TURN_END)
        yield _batch(done, _DIGEST_SCHEMA)
    close()
    yield _batch(done, _DIGEST_SCHEMA)


def digests(output: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: turns from their rows, what the loss covers from the examples' rows.

    formatted_chars counts the stored stream; example_chars what the examples would take with contexts written out.
    """
    return _in_order(output).mapInArrow(_digest, _DIGESTS)
