r"""Chat formatting from an event log.

A chat is stored as events: messages open, stream in deltas, are edited and regenerated. The log is
partitioned by conversation, sorted by sequence number and folded into the final messages, which are
then rendered with a loss mask over the assistant's texts.

The template of a turn is ``### role: text</turn>`` and a line feed. A backslash in a text is doubled and
a control string (``###``, ``</turn>``) gets a backslash in front, so no text can end its turn or begin
another; in a role, the colon gets one too. Reading takes the character after each backslash as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEAD, COLON, END, BREAK = "### ", ": ", "</turn>", "\n"
CONTROLS = ("###", "</turn>")
LEARNED = "assistant"
PIECE = 256  # code points of a streamed delta
MESSAGE_BITS = 32

#: open: message, role. delta: message, text to append. edit: message, text in place of ``length`` code points
#: from ``at``, or of the whole message without ``at``. regenerate: message begins anew, later ones are withdrawn.
KINDS = ("open", "delta", "edit", "regenerate")
EVENT_COLUMNS = ["conv_id", "seq", "kind", "message", "role", "text", "at", "length"]

Message = tuple[str, str]


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, "\\" + control)
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(messages: Iterable[Message]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) code points of the assistant's texts."""
    parts: list[str] = []
    loss: list[tuple[int, int]] = []
    at = 0
    for role, text in messages:
        head, body = HEAD + escaped(role).replace(":", "\\:") + COLON, escaped(text)
        start = at + len(head)
        if role == LEARNED:
            loss.append((start, start + len(body)))
        parts += [head, body, END, BREAK]
        at = start + len(body) + len(END) + len(BREAK)
    return "".join(parts), loss


_TURN = re.compile(
    re.escape(HEAD) + r"((?:[^\\:]|\\.)*+)" + re.escape(COLON) + r"((?:[^\\<]|\\.|<(?!/turn>))*+)" + re.escape(END + BREAK),
    re.DOTALL)


def read_turns(formatted: str) -> list[Message]:
    """The (role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at code point {at}")
        turns.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return turns


class Conversation:
    """The messages that the events so far have left."""

    def __init__(self) -> None:
        self.messages: dict[int, tuple[str, list[str]]] = {}
        self.events = self.ignored = 0

    def add(self, kind: str, message: int, role: str | None, text: str | None, at: int | None,
            length: int | None) -> None:
        self.events += 1
        if kind == "open" and message not in self.messages and message is not None:
            self.messages[message] = (role or "", [])
        elif kind == "delta" and message in self.messages:
            self.messages[message][1].append(text or "")
        elif kind == "edit" and message in self.messages:
            pieces = self.messages[message][1]
            if at is None:
                pieces[:] = [text or ""]
            else:
                old, start = "".join(pieces), max(at, 0)
                pieces[:] = [old[:start], text or "", old[start + max(length or 0, 0):]]
        elif kind == "regenerate" and message in self.messages:
            ids = list(self.messages)
            for later in ids[ids.index(message) + 1:]:
                del self.messages[later]
            self.messages[message][1].clear()
        else:
            self.ignored += 1

    def rendered(self) -> tuple[str, list[tuple[int, int]]]:
        return render((role, "".join(pieces)) for role, pieces in self.messages.values())


def _fold(schema: pa.Schema, chars: int = 1 << 24):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Events come sorted; one conversation is held at a time."""
        done: list[tuple] = []
        held, current, last, open_one = 0, None, None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def close() -> int:
            formatted, loss = open_one.rendered()
            spans = [{"start": a, "end": b} for a, b in loss]
            done.append((current, formatted, spans, len(open_one.messages), open_one.events, open_one.ignored))
            return len(formatted)

        for rows in batches:
            for conv, seq, *event in zip(*(rows.column(c).to_pylist() for c in EVENT_COLUMNS)):
                if open_one is None or conv != current:
                    if open_one is not None:
                        held += close()
                        if held > chars:
                            yield batch()
                            done, held = [], 0
                    open_one, current, last = Conversation(), conv, None
                if last is not None and seq == last:
                    continue  # the log delivered an event again
                last = seq
                open_one.add(*event)
        if open_one is not None:
            close()
        yield batch()

    return fold


def format_chats(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start, end), n_turns, n_events, n_ignored.

    ``events`` has EVENT_COLUMNS. Within a conversation events are applied by ``seq``; of those that share a number the
    first by kind, message, role, text, at and length counts, which drops events delivered twice. Events of a message that
    is not open, or was withdrawn, opening an open one, unknown and null kinds are ignored and counted. Null role and text
    are empty, a null conv_id is a conversation, a null seq comes first. A conversation without messages is an empty
    string. An empty log gives no rows; other columns are ignored.

    A task streams over its sorted events and holds one conversation, which ends up as one string in any case.
    """
    rows = events.select(*EVENT_COLUMNS)
    kept = StructType([rows.schema["conv_id"]])
    tail = ("formatted string, loss array<struct<start: long, end: long>>, n_turns long, n_events long, "
            "n_ignored long")
    schema = StructType([*kept.fields, *StructType.fromDDL(tail).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered = rows.repartition("conv_id").sortWithinPartitions(*EVENT_COLUMNS)
    return ordered.mapInArrow(_fold(to_arrow_schema(schema)), schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text and formatted_chars from the output of format_chats.

    Turns are parsed from the text; loss_text is what lies under the loss spans, unescaped, one after the other.
    """
    schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL(
        "turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in read_turns(x)] for x in texts]
            loss = ["".join(unescaped(x[s["start"]:s["end"]]) for s in own) for x, own in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").cast(arrow.field("conv_id").type), pa.array(turns, arrow.field("turns").type),
                 pa.array(loss, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=arrow)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(read, schema)


def _event(kind: str, text: Column | None = None, role: Column | None = None, at: Column | None = None,
           length: Column | None = None) -> Column:
    def of(c: Column | None, kind_of: str) -> Column:
        return (F.lit(None) if c is None else c).cast(kind_of)

    return F.struct(F.lit(kind).alias("kind"), of(role, "string").alias("role"), of(text, "string").alias("text"),
                    of(at, "long").alias("at"), of(length, "long").alias("length"))


def log_of(messages: DataFrame, piece: int = PIECE) -> DataFrame:
    """A table of final messages (conv_id, turn, role, text) as the event log of a live chat.

    Texts stream in deltas of ``piece`` code points. By the text's CRC, a third of the messages first stream a draft
    that is then regenerated, and a third stream a slip in the first delta that an edit mends; folded, the log
    gives the messages again, in the order of turn, role and text. Null texts and roles are empty.
    """
    rows = messages.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % piece), F.lit(0))
    first = F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))
    rest = F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0)))
    role = F.col("role")

    def deltas(texts: Column) -> Column:
        return F.transform(texts, lambda x: _event("delta", x))

    slip = F.reverse(first)
    way = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(3))
    opened = F.array(_event("open", role=role))
    events = (
        F.when(way == 0, F.concat(opened, F.array(_event("delta", slip), _event("regenerate")), deltas(F.col("pieces"))))
        .when(way == 1, F.concat(opened, F.array(_event("delta", slip)), deltas(rest), F.array(
            _event("edit", first, at=F.lit(0), length=F.length(slip)))))
        .otherwise(F.concat(opened, deltas(F.col("pieces")))))
    return (
        rows.withColumn("message", F.row_number().over(order).cast("long")).withColumn("pieces", pieces)
        .select("conv_id", "message", F.posexplode(events).alias("pos", "event"))
        .select("conv_id", (F.shiftleft("message", MESSAGE_BITS) + F.col("pos")).alias("seq"), "message", "event.*")
        .select(*EVENT_COLUMNS))
