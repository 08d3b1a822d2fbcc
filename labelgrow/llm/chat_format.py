"""Chat formatting by a finite-state machine over roles, with loss flags, and reading it back.

A conversation becomes formatted text with the spans under the loss mask. Turns come to a task sorted
by conversation and turn and stream through the machine; a long conversation is written in pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

#: Code points after which a piece of a formatted conversation ends, at the end of a turn.
PIECE = 1 << 20
MARK = "\\"


@dataclass(frozen=True)
class Turn:
    """How a role's turns are written: marks before and after the text, and whether the text is learnt."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A chat template. One role may have an empty opening mark; its turns are known by having no other's.

    ``moves`` has the state after a role's turn in a state; a turn without a move is out of order and
    leads to the state of its role. ``controls`` are escaped in texts: each begins with a character that
    no control string has at another place.
    """

    beginning: str
    roles: dict[str, Turn]
    #: Marks of roles that have none of their own; the role's name goes between the first two.
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    moves: dict[tuple[str, str], str]
    final: frozenset[str] = field(default_factory=frozenset)
    start: str = "start"

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if any(x in c[1:] for c in self.controls for x in firsts) or MARK in "".join(self.controls):
            raise ValueError("a control string's first character stands inside one, or one has the escape mark")
        marks = [self.beginning, self.other[0], self.other[2], *(m for t in self.roles.values() for m in (t.opening, t.closing) if m)]
        if not all(any(c in m for c in self.controls) for m in marks) or sum(not t.opening for t in self.roles.values()) > 1:
            raise ValueError("a mark has no control string")
        object.__setattr__(self, "firsts", firsts)
        object.__setattr__(self, "unmarked", self._pattern(""))
        object.__setattr__(self, "marked", self._pattern(re.escape(MARK)))

    def _pattern(self, found: str) -> re.Pattern:
        """The place after a control string's first character, with ``found`` there; marks may stand in between."""
        return re.compile("|".join(f"(?<={re.escape(c[0])}){found}(?={re.escape(MARK)}*+{re.escape(c[1:])})" for c in self.controls))


#: The marks and states of the registered query.
INSTRUCT = Template(
    beginning="<s>",
    roles={"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("", "</s>", loss=True)},
    other=("[ROLE ", "] ", " [/ROLE]"),
    controls=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE", "[/ROLE]"),
    moves={
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    },
    final=frozenset({"assistant"}),
)


def escape(text: str, template: Template = INSTRUCT) -> str:
    """One more mark goes behind the first character of each control string, marked already or not."""
    return template.unmarked.sub(lambda _: MARK, text) if any(c in text for c in template.firsts) else text


def unescape(text: str, template: Template = INSTRUCT) -> str:
    return template.marked.sub("", text) if MARK in text else text


def segments(role: str, text: str, template: Template = INSTRUCT) -> list[tuple[str, bool]]:
    """(text, under the loss mask) of one turn: mark, text, mark."""
    if turn := template.roles.get(role):
        return [(turn.opening, False), (escape(text, template), turn.loss), (turn.closing, False)]
    before, between, after = template.other
    return [(before + quote(role, safe="") + between, False), (escape(text, template), False), (after, False)]


def read_turns(text: str, template: Template = INSTRUCT, first: bool = True) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted piece; ``first`` says that it begins the conversation."""
    at = len(template.beginning) if first else 0
    if first and not text.startswith(template.beginning):
        raise ValueError("no beginning")
    plain = next((r for r, t in template.roles.items() if not t.opening), None)
    while at < len(text):
        role = next((r for r, t in template.roles.items() if t.opening and text.startswith(t.opening, at)), None)
        if role is not None:
            at, closing = at + len(template.roles[role].opening), template.roles[role].closing
        elif text.startswith(template.other[0], at):
            end = text.index(template.other[1], at)
            role, at, closing = unquote(text[at + len(template.other[0]) : end]), end + len(template.other[1]), template.other[2]
        elif plain is not None:
            role, closing = plain, template.roles[plain].closing
        else:
            raise ValueError("no turn begins here")
        end = text.index(closing, at)
        yield role, unescape(text[at:end], template)
        at = end + len(closing)


FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("problem", pa.string())]
)
_FORMATTED = "conv_id long, piece int, last boolean, text string, loss array<struct<start:int,end:int>>, problem string"


class _Conversation:
    """One conversation on its way through the machine."""

    def __init__(self, conv: int | None, template: Template) -> None:
        self.conv, self.template, self.state, self.n, self.piece, self.problem = conv, template, template.start, 0, 0, None
        self.parts, self.size, self.loss = [template.beginning], len(template.beginning), []

    def add(self, role: str, text: str) -> None:
        self.n += 1
        state = self.template.moves.get((self.state, role))
        if state is None:
            self.problem = self.problem or f"turn {self.n}: {role[:40] or 'no role'} after {self.state[:40]}"
        self.state = state or role
        for part, learnt in segments(role, text, self.template):
            if learnt:
                self.loss.append({"start": self.size, "end": self.size + len(part)})
            self.parts.append(part)
            self.size += len(part)

    def row(self, last: bool) -> dict:
        if last and self.state not in self.template.final:
            self.problem = self.problem or f"ends after {self.state[:40]}"
        out = {"conv_id": self.conv, "piece": self.piece, "last": last, "text": "".join(self.parts), "loss": self.loss, "problem": self.problem}
        self.parts, self.size, self.loss, self.piece = [], 0, [], self.piece + 1
        return out


def format_chats(df: DataFrame, template: Template = INSTRUCT, piece: int = PIECE) -> DataFrame:
    """Formatted conversations of a table (conv_id, turn, role, text): conv_id, piece, last, text, loss, problem.

    ``loss`` has the spans of ``text``, in code points, that are under the loss mask. Turns go by ``turn``,
    nulls first, equal ones by role, then text; rows without conv_id are one conversation; a null role or
    text is empty. A conversation is one row, or pieces of about ``piece`` code points, cut between turns;
    ``last`` marks its end. Every conversation is formatted; ``problem`` in its last piece says what is
    out of order first, or null. An empty table gives an empty one.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, held = None, [], 0
        for batch in batches:
            for conv, r, t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        held += now.size
                        done.append(now.row(True))
                    now = _Conversation(conv, template)
                elif now.size >= piece:
                    held += now.size
                    done.append(now.row(False))
                now.add(r, t)
                if held >= piece:
                    yield pa.RecordBatch.from_pylist(done, schema=FORMATTED)
                    done, held = [], 0
        if now:
            yield pa.RecordBatch.from_pylist([*done, now.row(True)], schema=FORMATTED)

    return text_batches(ordered).mapInArrow(run, _FORMATTED)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("problem", pa.string())])
_READ_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, problem string"


def read_chats(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What formatted conversations say, by conversation: counts and digests of turns and of the text to learn.

    Conversations of one piece are read where they are; pieces of others are brought together in order.
    Nothing but digests is kept of what was read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, learnt, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                for role, text in read_turns(row["text"], template, row["piece"] == 0):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]], template)
                    learnt.update(text.encode())
                    chars += len(text)
                size += len(row["text"])
                if row["last"]:
                    done.append((row["conv_id"], n, turns.hexdigest(), chars, learnt.hexdigest(), size, row["problem"]))
                    turns, learnt, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(_READ)], schema=_READ)

    alone = (F.col("piece") == 0) & F.col("last")
    pieces = formatted.filter(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    both = [text_batches(part).mapInArrow(run, _READ_SQL) for part in (formatted.filter(alone), pieces)]
    return both[0].unionByName(both[1])
