r"""Chat formatting with a grammar that can be read back.

A conversation is its turns one after another, each in this form::

    ### Assistant: text
    </turn>

In a text, a control string (``CONTROL``) is live unless a backslash stands before it. Backslashes
before a control string are doubled up by one each, and the reader takes one away again; everything
else stays as it is. A turn is rendered, read back, and escaped until the reader gives the same turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template, and those of common templates that texts should not imitate.
OPEN = "### "
END = "</turn>"
CONTROL = ("</turn>", "### System:", "### User:", "### Assistant:", "### Tool:")
TRAINED_ROLE = "assistant"

_ANY = "|".join(map(re.escape, CONTROL))
_TO_ESCAPE = re.compile(rf"\\*(?:{_ANY})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_ANY}))")
_LIVE = re.compile(rf"(?<!\\)(?:{_ANY})")
_ROLE_END = re.compile(r"(?<!\\)(?:\\\\)*:")


class Unreadable(ValueError):
    """Text that the grammar does not produce."""


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted text, and where in it the text begins and ends."""
    name = re.sub(r"([\\:])", r"\\\1", role[:1].upper() + role[1:]) if _named(role) else "=" + re.sub(
        r"([\\:])", r"\\\1", role
    )
    head = f"{OPEN}{name}: "
    return f"{head}{text}\n{END}\n", len(head), len(head) + len(text)


def _named(role: str) -> bool:
    """Whether a role can be written with a capital and read back."""
    return bool(role) and (role[:1].upper() + role[1:])[:1].lower() == role[:1] and role[0].isascii() and role[0].isalpha()


def read(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of `formatted`; the text lies at start to end, escaped.

    The grammar is deterministic: a turn opens, its role ends at the first bare colon, its text at the
    first live end mark. A live control string inside a text, or anything else, is ``Unreadable``.
    """
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise Unreadable(f"no turn at {at}")
        head = _ROLE_END.search(formatted, at + len(OPEN))
        if head is None or formatted[head.end() : head.end() + 1] != " ":
            raise Unreadable(f"no role at {at}")
        name = re.sub(r"\\([\\:])", r"\1", formatted[at + len(OPEN) : head.end() - 1])
        role = name[1:] if name.startswith("=") else name[:1].lower() + name[1:]
        start = head.end() + 1
        live = _LIVE.search(formatted, start)
        if live is None or live.group() != END or formatted[live.start() - 1] != "\n" or live.start() - 1 < start:
            raise Unreadable(f"no end of the turn at {at}")
        end = live.start() - 1
        yield role, _ESCAPED.sub(r"\1", formatted[start:end]), start, end
        at = live.end() + 1
        if formatted[live.end() : at] != "\n":
            raise Unreadable(f"no line end at {live.end()}")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m.group(), text)


def reads_back(formatted: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in read(formatted)] == [(role, text)]
    except Unreadable:
        return False


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn rendered so that it reads back as it was; (formatted, text start, text end)."""
    inner = text
    formatted = render(role, inner)
    while not reads_back(formatted[0], role, text):
        escaped = escape(inner)
        if escaped == inner:
            raise Unreadable(f"a turn of {role!r} cannot be formatted")
        inner, formatted = escaped, render(role, escaped)
    return formatted


FORMATTED = "conv_id long, seq long, formatted string, loss_start int, loss_end int"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, seq = ..., 0
    for batch in batches:
        convs, roles, texts = (c.to_pylist() for c in batch.columns)
        out: list[list] = [[], [], [], [], []]
        for conv, role, text in zip(convs, roles, texts):
            seq = seq + 1 if conv == last else 0
            last, role = conv, role or ""
            formatted, start, end = format_turn(role, text or "")
            trained = role == TRAINED_ROLE
            for column, v in zip(
                out, (conv, seq, formatted, start if trained else None, end if trained else None)
            ):
                column.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()))],
            names=["conv_id", "seq", "formatted", "loss_start", "loss_end"],
        )


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, formatted, loss_start, loss_end): one row per turn, in order within partitions.

    A conversation's formatted text is its rows' `formatted` by `seq`, end to end; the loss mask covers
    loss_start to loss_end of a row, in code points, where an assistant's text is. A conversation is
    never gathered: rows are sorted by (turn, role, text) and pass one by one, so a hot conversation
    costs a task time and no memory.

    Nulls: a text is empty, a role is the empty one, a turn comes first; rows without a conv_id make
    one conversation. Repeated rows are turns like others. An empty table gives an empty one. Other
    columns are not read. Any role and any text reads back.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return (
        rows.repartition("conv_id").sortWithinPartitions(*order)
        .select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)
    )


SUMMARY = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    last, state = ..., None

    def done(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    def row() -> list:
        n, turns, chars, loss, formatted = state
        return [last, n, turns.hexdigest(), chars, loss.hexdigest(), formatted]

    for batch in batches:
        out = []
        for conv, formatted, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if conv != last:
                if state:
                    out.append(row())
                last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, a, b in read(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None and (a, b) == (start, end):
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(formatted)
        if out:
            yield done(out)
    if state:
        yield done([row()])


def summarise(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_conversations`` and its loss mask."""
    return formatted.mapInArrow(_summarise, SUMMARY)
