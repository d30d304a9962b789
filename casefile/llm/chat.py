"""Chat formatting with a grammar round trip: conversations as template text with loss spans, and back.

A template marks the turns with control strings. Its grammar is deterministic: heads of turns are prefix-free, and a body
ends at the next control string, which has to be its turn's own. A rendered turn is parsed again and compared with the turn it
came from. Where it differs, the text conflicts with the template: every control string in it, and everything that
reads like an escaped one, gets one more backslash after its first character. That goes on until the parser gives the turn
back. Texts without conflicts stay as they are. The parser takes one backslash off, so escaping is reversible for any text.

The turns of all conversations are sorted in ranges of (conversation, turn), and a range is rendered as a stream into pieces of
bounded size, so a conversation of any length is spread over tasks and never held as a whole. A piece holds whole turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import drop, tidy
from .scratch import Workspace, written

#: Code points of a piece at which it is closed; a longer turn is a piece of its own.
PIECE = 1 << 14
PIECES = "conv_id long, place long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"


class Malformed(ValueError):
    """Text that is not in the template's language."""


@dataclass(frozen=True)
class Template:
    """Head and close of a turn by role; roles without their own are named between ``named[0]`` and ``named[1]``.

    ``controls`` are the strings that the texts of turns must not hold, ``learn`` the roles under the loss mask.
    """

    roles: dict[str, tuple[str, str]]
    named: tuple[str, str, str]
    controls: tuple[str, ...]
    learn: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))

    def __post_init__(self) -> None:
        heads = [h for h, _ in self.roles.values()] + [self.named[0]]
        if any(a.startswith(b) for i, a in enumerate(heads) for j, b in enumerate(heads) if i != j):
            raise ValueError("a head that begins with another is ambiguous")
        if any(self.control.search(c) is None for c in (*(c for _, c in self.roles.values()), *self.named[1:])):
            raise ValueError("a turn has to close with a control string")

    @cached_property
    def control(self) -> re.Pattern[str]:
        return re.compile("|".join(map(re.escape, self.controls)))

    @cached_property
    def conflict(self) -> re.Pattern[str]:
        """A control string with any number of backslashes after its first character."""
        return re.compile("|".join(f"(?<={re.escape(c[0])})\\\\*(?={re.escape(c[1:])})" for c in self.controls))

    @cached_property
    def escape_mark(self) -> re.Pattern[str]:
        return re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        return self.conflict.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self.escape_mark.sub("", text) if "\\" in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn from texts as they are, and where its body lies in it."""
        if role in self.roles:
            head, close = self.roles[role]
        else:
            head, close = self.named[0] + role + self.named[1], self.named[2]
        return head + text + close, len(head), len(head) + len(text)

    def body(self, formatted: str, at: int, close: str) -> tuple[str, int]:
        """The text from ``at`` up to the close, which must be at the next control string, and the place behind it."""
        found, sign = self.control.search(formatted, at), self.control.search(close)
        start = found.start() - sign.start() if found else -1
        if start < at or not formatted.startswith(close, start):
            raise Malformed(f"no close after character {at}")
        return self.unescape(formatted[at:start]), start + len(close)

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of each turn; start and end are those of its body in ``formatted``."""
        turns, at = [], 0
        while at < len(formatted):
            known = next(((r, h, c) for r, (h, c) in self.roles.items() if formatted.startswith(h, at)), None)
            if known:
                role, head, close = known
                at += len(head)
            elif formatted.startswith(self.named[0], at):
                role, at = self.body(formatted, at + len(self.named[0]), self.named[1])
                close = self.named[2]
            else:
                raise Malformed(f"no turn begins at character {at}")
            text, after = self.body(formatted, at, close)
            turns.append((role, text, at, after - len(close)))
            at = after
        return turns

    def survives(self, role: str, text: str, formatted: str) -> bool:
        try:
            return [t[:2] for t in self.parse(formatted)] == [(role, text)]
        except Malformed:
            return False

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn whose parse gives ``role`` and ``text``, and where its body lies in it."""
        as_role, as_text = role, text
        formatted = self.turn(as_role, as_text)
        while not self.survives(role, text, formatted[0]):
            harder = (as_role if role in self.roles else self.escape(as_role)), self.escape(as_text)
            if harder == (as_role, as_text):
                raise Malformed(f"no escaping recovers a turn of role {role[:40]!r}")
            as_role, as_text = harder
            formatted = self.turn(as_role, as_text)
        return formatted


INST = Template(
    roles={"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")},
    named=("[ROLE]", "[TEXT]", "[/ROLE]"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]"),
)


def render(turns: DataFrame, template: Template = INST, piece: int = PIECE) -> DataFrame:
    """conv_id, place, n_turns, formatted, loss: the conversations of (conv_id, turn, role, text) in pieces by place.

    The pieces of a conversation, joined by place, are its formatted text; loss holds the spans of texts to learn, in code
    points of the piece. A null text or role is the empty string, a null conv_id a conversation of its own, a null turn the
    first. Rows that share a turn stand by role and the MD5 of their text; rows that repeat one are turns of their own.
    Other columns are ignored.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tie", F.md5("text"))
    order = ["conv_id", "turn", "role", "tie"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        place = TaskContext.get().partitionId() << 40
        now, parts, loss, length = None, [], [], 0
        ready: list[tuple] = []

        def close() -> None:
            nonlocal parts, loss, length, place
            if parts:
                ready.append((now, place, len(parts), "".join(parts), loss))
                parts, loss, length, place = [], [], 0, place + 1

        def flush() -> pa.RecordBatch:
            ids, places, counts, texts, spans = zip(*ready, strict=True)
            ready.clear()
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "place", "n_turns", "formatted", "loss"])

        for batch in tidy(batches):
            for i in range(batch.num_rows):
                conv, role, text = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                if conv != now or length >= piece:
                    close()
                    now = conv
                if len(ready) >= 256:
                    yield flush()
                formatted, start, end = template.render(role, text)
                if parts and length + len(formatted) > piece:
                    close()
                if role in template.learn:
                    loss.append({"start": length + start, "end": length + end})
                parts.append(formatted)
                length += len(formatted)
        close()
        if ready:
            yield flush()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("conv_id", "role", "text").mapInArrow(stream, PIECES)


def turns_of(pieces: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, place, nth (within the piece), role, text, learn of every turn, parsed from the formatted text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in tidy(batches):
            for conv, place, formatted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = template.parse(formatted)
                rows = [(conv, place, i, role, text, role in template.learn) for i, (role, text, _, _) in enumerate(turns)]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "place", "nth", "role", "text", "learn"])

    return pieces.select("conv_id", "place", "formatted").mapInArrow(read, "conv_id long, place long, nth long, role string, text string, learn boolean")


def digests(pieces: DataFrame, template: Template = INST) -> DataFrame:
    """A row per conversation, read back from ``render``'s table.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed per turn), loss_chars and loss_sha256 (of the text
    under the loss mask, without escapes), formatted_chars. The pieces of a conversation pass in order through one
    task, as a digest asks for, one at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        now: object = batches  # no conversation yet; None is one
        all_text, learnt = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        ready: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)]
            ready.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in tidy(batches):
            for i in range(batch.num_rows):
                conv, formatted, loss = (batch.column(c)[i].as_py() for c in range(3))
                if now is batches or conv != now:
                    if now is not batches:
                        ready.append((now, n_turns, all_text.hexdigest(), loss_chars, learnt.hexdigest(), chars))
                    if len(ready) >= 4096:
                        yield flush()
                    now, all_text, learnt = conv, hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = chars = 0
                for role, text, _, _ in template.parse(formatted):
                    all_text.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                for span in loss:
                    text = template.unescape(formatted[span["start"] : span["end"]])
                    learnt.update(text.encode())
                    loss_chars += len(text)
                chars += len(formatted)
        if now is not batches:
            ready.append((now, n_turns, all_text.hexdigest(), loss_chars, learnt.hexdigest(), chars))
            yield flush()

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(read, schema)


def format_and_read(turns: DataFrame, template: Template = INST, piece: int = PIECE) -> DataFrame:
    """``digests`` of the table that ``render`` writes for the conversations of ``turns``."""
    with Workspace() as work:
        pieces = work.keep(written(render(turns, template, piece), "chat-pieces"))
    return digests(pieces, template)
