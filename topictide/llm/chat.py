"""Chat formatting: a finite-state machine over roles turns conversations into text segments
with loss flags, by a declarative template that can be read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role, and the order of roles.

    ``other`` frames roles without marks of their own; its first two parts stand around
    the role's name. A role whose opening mark is empty is the one read where no mark
    opens a turn. Inside texts and names every control string gets ``escape`` after its
    first character and each ``escape`` is doubled, so no control string is left there."""

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")})
    other: tuple[str, str, str] = ("<|role:", "|>", "<|end|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    escape: str = "\\"

    @property
    def controls(self) -> list[str]:
        found = [self.begin, *self.other, *(m for pair in self.marks.values() for m in pair)]
        return sorted({c.strip() for c in found if c.strip()}, key=lambda c: (-len(c), c))


SCHEMA = "conv_id long, turn long, seq long, text string, loss boolean, valid boolean"
READ_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long, valid boolean")


def escaper(t: Template):
    """(escape, unescape) for texts."""
    control = re.compile("|".join(map(re.escape, t.controls)))
    back = re.compile(re.escape(t.escape) + "(.)", re.S)

    def escape(text: str) -> str:
        return control.sub(lambda m: m[0][0] + t.escape + m[0][1:], text.replace(t.escape, t.escape * 2))

    return escape, lambda text: back.sub(r"\1", text)


def format_conversations(df: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, turn, seq, text, loss, valid) of the rows (conv_id, turn, role, text),
    in order within a partition; joined by seq they are the formatted conversation.

    A conversation streams through one task in order of turn, so memory doesn't grow with its
    length. ``valid`` says whether the roles so far were in an order the template allows;
    conversations out of order are formatted all the same. Null text and role are empty,
    a null conv_id is a conversation of its own, null turns come first, ties and repeated rows
    are all kept, ordered by role and text; other columns are ignored; no rows give no segments."""
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "turn", "seq", "text", "loss", "valid"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]):
        escape, _ = escaper(template)
        begun, conv, state, seq, valid = False, None, "", 0, True
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fresh = not begun or c != conv
                if fresh:
                    begun, conv, state, seq, valid = True, c, "", 0, True
                valid = valid and role in template.turns.get(state, ())
                state = role
                pair = template.marks.get(role)
                first, last = pair or (template.other[0] + escape(role) + template.other[1], template.other[2])
                loss = role in template.loss_roles
                for piece, under in (((template.begin if fresh else "") + first, False), (escape(text), loss), (last, False)):
                    for column, value in zip(out, (c, turn, seq, piece, under, valid)):
                        column.append(value)
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    return rows.mapInArrow(run, SCHEMA)


class _Reader:
    """Reads one formatted conversation, segment by segment, and keeps digests only."""

    def __init__(self, t: Template, conv):
        self.t, self.conv, self.valid = t, conv, True
        _, self.unescape = escaper(t)
        opening = {p[0]: role for role, p in t.marks.items() if p[0]}
        self.default = next((role for role, p in t.marks.items() if not p[0]), None)
        marks = [t.begin, *t.other, *(m for p in t.marks.values() for m in p if m)]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(set(marks), key=len, reverse=True))) + ")")
        self.opening, self.role, self.part, self.in_name = opening, None, [], False
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid = valid
        if loss:
            said = self.unescape(text)
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        t = self.t
        for token in self.split.split(text):
            closing = t.marks[self.role][1] if self.role in t.marks else t.other[2]
            if self.role is None and token in self.opening:
                self.role = self.opening[token]
            elif self.role is None and token == t.other[0]:
                self.in_name = True
            elif self.in_name and token == t.other[1]:
                self.role, self.part, self.in_name = self.unescape("".join(self.part)), [], False
            elif self.role is not None and token == closing:
                self.end(self.role)
            elif self.role is None and not self.in_name and token == t.marks.get(self.default, ("", None))[1]:
                self.end(self.default)
            elif token != t.begin:
                self.part.append(token)

    def end(self, role: str) -> None:
        self.turns.update(f"{role}\n{self.unescape(''.join(self.part))}\n".encode())
        self.role, self.part = None, []
        self.n_turns += 1

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what its formatted text says: turns and text under the loss mask as
    digests. ``segments`` are those of ``format_conversations``, in its partitions and order;
    only their text, loss and valid columns are used."""
    names = READ_SCHEMA.split(", ")
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]):
        reader = None

        def rows(done):
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*done), types)], [n.split()[0] for n in names])

        for batch in batches:
            done = []
            for conv, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if reader is None or conv != reader.conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(template, conv)
                reader.feed(text, loss, valid)
            if done:
                yield rows(done)
        if reader is not None:
            yield rows([reader.row()])

    return segments.select("conv_id", "text", "loss", "valid").mapInArrow(run, READ_SCHEMA)
