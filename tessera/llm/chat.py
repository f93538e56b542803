"""Operator 8: chat formatting by event-sourced reconstruction.

A log holds events (conv_id, message, seq, kind, role, text): ``message`` opens a message, ``delta`` appends streamed text, ``edit``
replaces the text, ``regenerate`` empties it for the deltas to come, ``delete`` drops it. The log is partitioned by conversation,
sorted by message and sequence, and folded into final messages, which are rendered by the template with a loss mask
over assistant texts.

The template marks turns by control strings. Inside roles and texts a control string is escaped by one backslash, and backslashes
before it (or at the end) are doubled; so a control string is one of the template's if and only if an even number of backslashes precedes it.

Null roles and texts are empty. Events of one message without an opening event open it; unknown kinds count as ``message``. Events that tie in sequence
come in the order of kind, role and text; repeated ``message`` events are messages of their own. A null conv_id is a conversation of
its own. Extra columns are ignored; an empty log gives no rows.

Folding, rendering and reading back stream over sorted partitions: a task holds one message and one piece of output at a time, however long
the conversation. Pieces end at message borders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
PIECES = "conv_id long, piece long, formatted string, mask array<struct<start: long, end: long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Code points after which a piece ends at the next message border, and rows put into one batch.
PIECE, BATCH = 1 << 20, 512
#: The template's control strings.
CONTROL = re.compile(r"(\\*)(</?s>|\[/?(?:INST|ROLE)\])")
ESCAPABLE = re.compile(r"(\\*)(</?s>|\[/?(?:INST|ROLE)\]|\Z)")


def escape(text: str) -> str:
    if "<" not in text and "[" not in text and not text.endswith("\\"):
        return text
    return ESCAPABLE.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return ESCAPABLE.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """Final (conv_id, message, role, text) of events (conv_id, message, kind, role, text) in order."""
    key, role, parts = None, "", None
    for conv, message, kind, r, text in events:
        if parts is not None and ((conv, message) != key or kind not in ("delta", "edit", "regenerate", "delete")):
            yield *key, role, "".join(parts)
            parts = None
        if (conv, message) != key or kind not in ("delta", "edit", "regenerate", "delete"):
            key, role, parts = (conv, message), r or "", []
        if parts is None:  # an event of a deleted message
            continue
        if kind == "delete":
            parts = None
        elif kind in ("edit", "regenerate"):
            parts = [text or ""] if kind == "edit" else []
        else:
            parts.append(text or "")
    if parts is not None:
        yield *key, role, "".join(parts)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text lies."""
    head, body = f"<s>[ROLE]{escape(role)}[/ROLE][INST]", escape(text)
    return f"{head}{body}[/INST]</s>\n", len(head), len(head) + len(body)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a piece: (role, text)."""
    real = [m for m in CONTROL.finditer(formatted) if len(m[1]) % 2 == 0]
    at = {}
    for m in real:
        at[m[2]] = m
        if m[2] == "</s>":
            role = formatted[at["[ROLE]"].end() : at["[/ROLE]"].start(2)]
            text = formatted[at["[INST]"].end() : at["[/INST]"].start(2)]
            yield unescape(role), unescape(text)


def pieces(messages: Iterable[tuple]) -> Iterator[tuple]:
    """Renders messages in order: (conv_id, piece, formatted, mask)."""
    conv, n, out, mask, size, started = None, 0, [], [], 0, False
    for c, _, role, text in messages:
        if started and (c != conv or size >= PIECE):
            yield conv, n, "".join(out), mask
            n, out, mask, size = n + 1 if c == conv else 0, [], [], 0
        conv, started = c, True
        turn, a, b = rendered(role, text)
        if role == "assistant":
            mask.append({"start": size + a, "end": size + b})
        out.append(turn)
        size += len(turn)
    if started:
        yield conv, n, "".join(out), mask


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            yield from zip(*(c.slice(at, 4096).to_pylist() for c in b.columns))


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == BATCH or size > 4 * PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def ordered(events: DataFrame, dealt: bool = False) -> DataFrame:
    """The log by conversation, message and sequence; ``dealt``: it already lies by conversation."""
    by = events if dealt else events.repartition("conv_id")
    return by.sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text").select("conv_id", "message", "kind", "role", "text")


def folded(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final messages of a log."""
    ddl = "conv_id long, message long, role string, text string"
    schema = arrow(ddl)
    return ordered(events).mapInArrow(lambda batches: batched(fold(columns(batches)), schema), ddl)


def chat_format(events: DataFrame, dealt: bool = False) -> DataFrame:
    """conv_id, piece, formatted, mask: the rendered conversations of a log, sorted within partitions."""
    schema = arrow(PIECES)
    return ordered(events, dealt).mapInArrow(lambda batches: batched(pieces(fold(columns(batches))), schema), PIECES)


def messages_as_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of opening events."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("message"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed_log(rows: DataFrame) -> DataFrame:
    """The log that leads to a table of finished turns (conv_id, turn, role, text), laid out by conversation: by a hash of its place a turn is
    written at once, streamed in deltas, a draft that is edited, or an answer that is broken off, generated anew and streamed. Turns that share their
    place are written at once, so their events don't mix."""
    place = Window.partitionBy("conv_id", "turn")
    one = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").withColumn("tied", F.count("*").over(place) > 1)
    n, way = F.char_length("text"), F.when(F.col("tied"), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    third = F.floor(n / 3).cast("int")
    thirds = [F.left("text", third), F.substring(F.col("text"), third + 1, third), F.substring(F.col("text"), 2 * third + 1, n)]
    deltas = lambda at: [event(at + k, "delta", x) for k, x in enumerate(thirds)]
    log = (
        F.when(way == 1, F.array(event(0, "message", F.lit("")), *deltas(1)))
        .when(way == 2, F.array(event(0, "message", F.concat("text", F.lit(" (draft)"))), event(1, "edit", F.col("text"))))
        .when(way == 3, F.array(event(0, "message", F.lit("")), event(1, "delta", thirds[1]), event(2, "regenerate", F.lit(None).cast("string")), *deltas(3)))
        .otherwise(F.array(event(0, "message", F.col("text"))))
    )
    return one.select("conv_id", F.col("turn").alias("message"), "role", F.explode(log).alias("e")).select("conv_id", "message", "e.seq", "e.kind", "role", "e.text")


def read_back(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Digests of rendered conversations, from their pieces in order."""
    conv, started, n, chars, total, turns, loss = None, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    for c, _, formatted, mask in rows:
        if started and c != conv:
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total
            n, chars, total, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        conv, started = c, True
        for role, text in parsed(formatted):
            n += 1
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for m in mask:
            text = unescape(formatted[m["start"] : m["end"]])
            chars += len(text)
            loss.update(text.encode("utf-8", "surrogatepass"))
        total += len(formatted)
    if started:
        yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ``chat_format``'s result."""
    schema = arrow(DIGESTS)
    return formatted.mapInArrow(lambda batches: batched(read_back(columns(batches)), schema), DIGESTS)
