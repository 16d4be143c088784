"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags, and reading them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "start", "end"


@dataclass(frozen=True)
class Template:
    """What surrounds the text of each role, which roles are trained on, and which order of roles is valid.

    ``control`` lists the strings that mark structure. In a text, an escape sign is doubled and the first character of each control string (they may overlap) gets an escape sign
    after it, so no control string is left in it and :meth:`unescape` gives the text back.
    """

    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    control: tuple[str, ...]
    trained: tuple[str, ...]
    moves: dict[str, tuple[str, ...]] = field(default_factory=dict)
    finals: tuple[str, ...] = ()
    sign: str = "\\"

    @cached_property
    def _found(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.sign)}|(?={'|'.join(map(re.escape, self.control))}).", re.DOTALL)

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(re.escape(self.sign) + "(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._found.sub(lambda m: m[0] + self.sign, text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def marks(self, role: str) -> tuple[str, str]:
        """What comes before and after a text of the role; the mark of a role that the template doesn't name holds its escaped name."""
        if role in self.roles:
            return self.roles[role]
        begin, middle, close = self.other
        return begin + self.escape(role) + middle, close

    def step(self, state: str, role: str) -> str | None:
        """The state after a turn: the role itself, or None when the order of turns doesn't allow it."""
        return role if role in self.moves.get(state, ()) else None

    @cached_property
    def _opening(self) -> re.Pattern:
        begin, middle, _ = self.other
        named = "|".join(f"(?P<r{i}>{re.escape(b)})" for i, (b, _) in enumerate(self.roles.values()))
        return re.compile(f"{named}|{re.escape(begin)}(?P<other>.*?){re.escape(middle)}", re.DOTALL)

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, escaped text) of every turn of a formatted conversation."""
        names, at = list(self.roles), 0
        while at < len(formatted):
            m = self._opening.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn begins at {at}")
            role = self.unescape(m["other"]) if m.lastgroup == "other" else names[int(m.lastgroup[1:])]
            close = self.marks(role)[1]
            end = formatted.index(close, m.end())
            yield role, formatted[m.end() : end]
            at = end + len(close)


#: Instruction marks around user texts, an end mark after assistant texts; only assistant texts are trained on.
INSTRUCT = Template(
    roles={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")},
    other=("<|", "|>\n", "\n<|end|>\n"),
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>"),
    trained=("assistant",),
    moves={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    finals=("assistant",),
)

SEGMENTS = "conv long, part long, role string, text string, loss boolean, valid boolean, last boolean"


def format_chats(turns: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of every conversation in order within each partition: (conv, part, role, text, loss, valid, last).

    The concatenated texts of a conversation are its formatted form; ``loss`` marks what is trained on. ``valid`` says whether the turns so far, on the ``last`` segment the whole conversation, pass
    the state machine; a conversation out of order is formatted all the same. Turns go by ``turn``, ties by role and text, nulls first; a null text or role is empty; null is a
    conversation of its own; repeated rows are turns of their own.

    One shuffle by conversation, sorted outside memory; a task then streams over its rows and holds one turn at a time, whatever the length of a conversation.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "part", "role", "text", "loss", "valid", "last"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
        out: list[tuple] = []
        held: tuple | None = None  # the closing segment of the last turn, until it is known whether the conversation goes on
        part, state = 0, START

        def close(last: bool) -> None:
            c, p, r, t, good = held
            out.append((c, p, r, t, False, good and (not last or r in template.finals), last))

        for batch in batches:
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                same = held is not None and held[0] == c
                if held is not None:
                    close(not same)
                if not same:
                    part, state = 0, START
                state = template.step(state, r) if state is not None else None
                begin, end = template.marks(r)
                good = state is not None
                out.append((c, part, r, begin, False, good, False))
                out.append((c, part + 1, r, template.escape(t), r in template.trained, good, False))
                held, part = (c, part + 2, r, end, good), part + 3
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
                out = []
        if held is not None:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of formatted conversations, read from the segments alone: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid).

    ``segments`` is :func:`format_chats`'s output, still in its order. A turn is parsed as soon as its closing mark is complete, so a task holds one turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        now, waiting, out = fresh(), [], []
        for batch in batches:
            for c, _, _, text, loss, valid, last in zip(*(batch.column(i).to_pylist() for i in range(7))):
                now[4] += len(text)
                waiting.append(text)
                if loss:
                    plain = template.unescape(text)
                    now[2] += len(plain)
                    now[3].update(plain.encode())
                if len(waiting) == 3:
                    for role, escaped in template.read("".join(waiting)):
                        now[0] += 1
                        now[1].update(f"{role}\n{template.unescape(escaped)}\n".encode())
                    waiting = []
                if last:
                    out.append((c, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], valid))
                    now = fresh()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
                out = []

    return segments.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
