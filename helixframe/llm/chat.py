"""Chat formatting: a state machine over roles and a declarative template with loss flags."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: State -> role -> next state. A role without an arrow leads to "invalid", which is final.
TURN_ORDER = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
    "invalid": {},
}
ACCEPTING = {"assistant"}


@dataclass(frozen=True)
class Template:
    """Text before and after a turn of each role, and whether the text between counts for the loss.

    `other` serves roles that the template does not name; its {role} is escaped like a text.
    Inside texts the escape character goes before itself, and behind the first character of each
    control string, so that no control string stands in an escaped text.
    """

    heads: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### ({role}): "
    tail: str = "</turn>\n"
    loss: frozenset = frozenset({"assistant"})
    controls: tuple = ("### ", "</turn>", "): ")
    escape: str = "\\"

    def quoted(self, text: str) -> str:
        e = self.escape
        pattern = "|".join(map(re.escape, (e, *self.controls)))
        return re.sub(pattern, lambda m: e + m[0] if m[0] == e else m[0][0] + e + m[0][1:], text)

    def plain(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str):
        """(text, counts for the loss) of one turn."""
        head = self.heads.get(role) or self.other.format(role=self.quoted(role))
        yield head, False
        yield self.quoted(text), role in self.loss
        yield self.tail, False

    def role_of(self, head: str) -> str:
        for role, text in self.heads.items():
            if head == text:
                return role
        left, right = self.other.split("{role}")
        return self.plain(head[len(left):len(head) - len(right)])


SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.int64()), ("text", pa.string()),
    ("loss", pa.bool_()), ("state", pa.string()),
])
BATCH = 2048


def _rows(batches, columns: int):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(columns)))


def _batches(rows, schema: pa.Schema):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation: conv_id, turn, segment (from 0 in each conversation), text,
    loss, state (of the machine after the turn).

    Rows of a conversation stand together, in order of turn (ties by role, then text). They pass
    through the tasks as a stream: a very long conversation is never held whole. A null text or
    role is empty; a null conv_id is a conversation of its own; null turns come first. Invalid
    turn orders are formatted too; their state is `invalid` from the first wrong turn on. Roles
    compare exactly.
    """
    template = template or Template()

    def run(batches):
        def rows():
            current, number, state = object(), 0, "start"
            for conv, turn, role, text in _rows(batches, 4):
                if conv != current:
                    current, number, state = conv, 0, "start"
                state = TURN_ORDER[state].get(role, "invalid")
                for piece, loss in template.segments(role, text):
                    yield conv, turn, number, piece, loss, state
                    number += 1
        yield from _batches(rows(), SEGMENT)

    ordered = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, turn bigint, segment bigint, text string, loss boolean, state string")


DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()),
])


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, from its formatted text alone.

    The segments of a conversation must stand together and in order (as `format_conversations`
    leaves them, or after repartition by conv_id and a sort by conv_id, segment). The text is
    parsed at the template's tail and heads; only the loss mask comes from the flags.
    """
    template = template or Template()

    def run(batches):
        def rows():
            current, state = None, None
            for conv, _, _, text, loss, machine in _rows(batches, 6):
                if state is None or conv != current:
                    if state is not None:
                        yield current, *finish(state)
                    current, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "open": "", "last": None}
                state["all"] += len(text)
                state["last"] = machine
                if loss:
                    unquoted = template.plain(text)
                    state["loss"].update(unquoted.encode())
                    state["chars"] += len(unquoted)
                state["open"] += text
                if text.endswith(template.tail) and template.tail in state["open"]:
                    *whole, state["open"] = state["open"].split(template.tail)
                    for turn in whole:
                        role, body = split_turn(turn)
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{body}\n".encode())
            if state is not None:
                yield current, *finish(state)
        yield from _batches(rows(), DIGEST)

    def split_turn(turn: str) -> tuple[str, str]:
        for role, head in template.heads.items():
            if turn.startswith(head):
                return role, template.plain(turn[len(head):])
        right = template.other.split("{role}")[1]
        cut = turn.index(right) + len(right)
        return template.role_of(turn[:cut]), template.plain(turn[cut:])

    def finish(state):
        return (state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["last"] in ACCEPTING)

    return segments.mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
