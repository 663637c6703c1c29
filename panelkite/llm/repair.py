"""Repair of the structure of conversations.

A conversation should be `(s?(ua)+)?` in the initials of its roles. Four states read that: nothing yet,
after the system's turn, after a user's, after an assistant's. Each row takes some edits that lead from
a state to another; the cheapest edits of all rows are found by divide and conquer (Hirschberg): the cost
vector of the first half, forward, and of the second, backward, meet in the middle, the best crossing is
chosen, and both halves are solved alike, in linear space.

Costs alone do not tell equally cheap edits apart, so a forward vector also ranks the least audits that
lead to its states. Audits of the same rows are never beginnings of one another when insertions are
counted to the row after them, so ranks can be carried on like costs.

Conversations of any length are cut into blocks of rows. A block is summed up as a vector for each state
it may begin in; blocks of blocks likewise, and the crossings found above are handed down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import in_order, numbered
from .shared import ASCII_SPACE, settled
from .words import slices

# Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

BLOCK_BITS = 12
FAN = 1024

# --- states and steps --------------------------------------------------------------------------

STATES = 4
#: What an initial leads to from each state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may be inserted or given in each state.
GIVEN = ("u", "u", "a", "u")
#: Insertions that end a conversation from each state.
ENDS = ("", INSERT * 2, INSERT, "")
FAR = 1 << 60

INITIALS = "sua?"
SOUND, TRUNCATED, DROPPED = range(3)  # what is wrong with a row


def _steps(initial: str, fault: int) -> list[list[tuple[int, str] | None]]:
    """The cheapest, then least edits of a row for each pair of states, insertions before it included."""
    out: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for begin in range(STATES):
        state = begin
        for k in range(3):
            found = [(state, DELETE_COST, DELETE)]
            if fault != DROPPED:
                found.append((NEXT[state][GIVEN[state]], REROLE_COST + extra, REROLE))
                if initial in NEXT[state]:
                    found.append((NEXT[state][initial], extra, KEEP))
            for end, cost, edit in found:
                new = (cost + k * INSERT_COST, INSERT * k + edit)
                out[begin][end] = min(out[begin][end] or new, new)
            state = NEXT[state][GIVEN[state]]
    return out


STEPS = [_steps(initial, fault) for initial in INITIALS for fault in (SOUND, TRUNCATED, DROPPED)]

#: Costs and ranks of the least audits to each state; an item has one for each state it may begin in.
Vector = tuple[list[int], list[int]]
Item = list[Vector]


def _ranked(costs: list[int], keys: list) -> Vector:
    order = sorted((key, state) for state, key in enumerate(keys) if costs[state] < FAR)
    ranks = [STATES] * STATES
    for rank, (_, state) in enumerate(order):
        ranks[state] = rank
    return costs, ranks


def _row_item(steps) -> Item:
    return [
        _ranked([step[0] if step else FAR for step in row], [step[1] if step else "" for step in row]) for row in steps
    ]


ROW_ITEMS = [_row_item(steps) for steps in STEPS]


def begin_in(state: int) -> Vector:
    return _ranked([0 if s == state else FAR for s in range(STATES)], [0] * STATES)


def forward(vector: Vector, items: Sequence[Item]) -> Vector:
    """The vector behind `items`; among equal costs the least audit counts."""
    for item in items:
        costs, ranks = vector
        best: list[tuple[int, int, int] | None] = [None] * STATES
        for via in range(STATES):
            if costs[via] >= FAR:
                continue
            more, below = item[via]
            for end in range(STATES):
                if more[end] < FAR:
                    new = (costs[via] + more[end], ranks[via], below[end])
                    best[end] = min(best[end] or new, new)
        vector = _ranked([b[0] if b else FAR for b in best], [b[1:] if b else () for b in best])
    return vector


def backward(items: Sequence[Item], end: int) -> list[int]:
    """Cost from each state before `items` to the state `end` behind them."""
    costs = [0 if s == end else FAR for s in range(STATES)]
    for item in reversed(items):
        costs = [min(a + b for a, b in zip(item[s][0], costs)) for s in range(STATES)]
        costs = [min(c, FAR) for c in costs]
    return costs


def crossings(items: Sequence[Item], begin: int, end: int) -> list[int]:
    """The states between `items` on the least of the cheapest ways, `begin` first and `end` last."""
    out = [begin] * (len(items) + 1)
    out[-1] = end
    waiting = [(0, len(items), begin, end)]
    while waiting:
        a, b, first, last = waiting.pop()
        if b - a < 2:
            continue
        middle = (a + b) // 2
        costs, ranks = forward(begin_in(first), items[a:middle])
        rest = backward(items[middle:b], last)
        out[middle] = min((costs[s] + rest[s], ranks[s], s) for s in range(STATES))[2]
        waiting += [(a, middle, first, out[middle]), (middle, b, out[middle], last)]
    return out


def whole(items: Sequence[Item]) -> Item:
    """The items as one."""
    return [forward(begin_in(s), items) for s in range(STATES)]


def last_state(vector: Vector) -> tuple[int, int]:
    """Cost and last state of the least of the cheapest ways through a conversation."""
    costs, ranks = vector
    return min((costs[s] + len(ENDS[s]) * INSERT_COST, ranks[s], s) for s in range(STATES))[::2]


# --- rows --------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after the damage; `conv` is conv_id as text, empty for null."""
    number, text = F.col("turn").cast("string"), F.coalesce("text", F.lit(" "))
    role = F.coalesce("role", F.lit(" "))
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(number, F.lit(" ")))
    hit = F.crc32(F.encode(named, "utf-8")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(hit != 0).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _tie(text: Column) -> Column:
    return F.md5(F.encode(text, "utf-8"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, tie, seq, initial, fault, blank, truncated, duplicate), ordered by `seq`.

    `tie` is a digest of the text, which stays behind: neither sorting nor counting moves texts.
    """
    bare = F.rtrim("text", F.lit(ASCII_SPACE))
    blank = bare == ""
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv", "turn", "role", _tie(F.col("text")).alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        F.when(initial.isin(*"sua"), initial).otherwise("?").alias("initial"),
        blank.alias("blank"), (~blank & ~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open_end"),
        F.md5(F.encode(F.concat_ws(":", "conv", "role", _tie(F.col("text"))), "utf-8")).alias("same"),
    )
    placed = in_order(settled(narrow, "turns"), ["conv", "turn", "role", "tie", "salt"], "turn-order").drop("salt")
    spoken = placed.where(~F.col("blank")).groupBy("same").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    repeats = settled(spoken.where("n > 1").drop("n"), "repeats")
    duplicate = F.coalesce(~F.col("blank") & (F.col("seq") > F.col("first")), F.lit(False))
    out = placed.join(repeats, "same", "left").withColumn("duplicate", duplicate)
    truncated = F.col("open_end") & ~F.col("duplicate")
    fault = F.when(F.col("blank") | F.col("duplicate"), DROPPED).when(truncated, TRUNCATED).otherwise(SOUND)
    out = out.withColumn("truncated", truncated).withColumn("fault", fault)
    return settled(out.drop("same", "first", "open_end"), "marked-turns")


# --- blocks ------------------------------------------------------------------------------------

ITEM = "costs array<long>, ranks array<int>, opens string, closes string, illegal long"


def _flat(item: Item) -> dict[str, list[int]]:
    return {"costs": [c for costs, _ in item for c in costs], "ranks": [r for _, ranks in item for r in ranks]}


def _item(row: dict) -> Item:
    parts = range(0, STATES * STATES, STATES)
    return [(row["costs"][k : k + STATES], row["ranks"][k : k + STATES]) for k in parts]


def _code(row: dict) -> int:
    return INITIALS.index(row["initial"]) * 3 + row["fault"]


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _runs(rows: list[dict]) -> Iterator[list[dict]]:
    """The rows of each conversation, in order."""
    begin = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k]["conv"] != rows[begin]["conv"]:
            yield rows[begin:k]
            begin = k


def _table(rows: list[dict], like: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=like)


_ITEM_FIELDS = [
    ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("opens", pa.string()), ("closes", pa.string()),
    ("illegal", pa.int64()),
]
_SEGMENT = pa.schema([("conv", pa.string()), ("block", pa.int64()), *_ITEM_FIELDS])
_PARENT = pa.schema([("conv", pa.string()), ("pos", pa.int64()), *_ITEM_FIELDS])
_CROSSED = pa.schema([("conv", pa.string()), ("pos", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("ends", pa.string())])
_EDITS = pa.schema(
    [("conv", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()), ("seq", pa.int64()), ("edits", pa.string())]
)


def _segments(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["seq"])
    out = []
    for run in _runs(rows):
        initials = [r["initial"] for r in run]
        item = whole([ROW_ITEMS[_code(r)] for r in run])
        out.append(
            {
                "conv": run[0]["conv"], "block": run[0]["block"], **_flat(item), "opens": initials[0],
                "closes": initials[-1], "illegal": _illegal(initials),
            }
        )
    return _table(out, _SEGMENT)


def _joined(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
    between = sum(a["closes"] + b["opens"] not in LEGAL for a, b in zip(rows, rows[1:]))
    parent = {
        "conv": rows[0]["conv"], "pos": rows[0]["parent"], **_flat(whole([_item(r) for r in rows])),
        "opens": rows[0]["opens"], "closes": rows[-1]["closes"], "illegal": between + sum(r["illegal"] for r in rows),
    }
    return _table([parent], _PARENT)


def _handed_down(group: pa.Table, above: pa.Table) -> pa.Table:
    """The states in which the children of one parent begin and end."""
    rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
    parent = above.to_pylist()[0]
    states = crossings([_item(r) for r in rows], parent["enter"], parent["leave"])
    out = [
        {"conv": r["conv"], "pos": r["pos"], "enter": states[k], "leave": states[k + 1], "ends": ""} for k, r in enumerate(rows)
    ]
    out[-1]["ends"] = parent["ends"]
    return _table(out, _CROSSED)


def _edits(group: pa.Table, crossed: pa.Table) -> pa.Table:
    """The edits of each row of a block."""
    states = {r["conv"]: r for r in crossed.to_pylist()}
    out = []
    for run in _runs(sorted(group.to_pylist(), key=lambda r: r["seq"])):
        known, codes = states[run[0]["conv"]], [_code(r) for r in run]
        way = crossings([ROW_ITEMS[c] for c in codes], known["enter"], known["leave"])
        for k, row in enumerate(run):
            edits = STEPS[codes[k]][way[k]][way[k + 1]][1] + (known["ends"] if k == len(run) - 1 else "")
            out.append({**{c: row[c] for c in ("conv", "turn", "role", "tie", "seq")}, "edits": edits})
    return _table(out, _EDITS)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and last state of the items that are whole conversations."""
    for batch in batches:
        rows = batch.to_pylist()
        found = [last_state(_item(r)[0]) for r in rows]
        yield pa.record_batch(
            [
                batch["conv"], pa.array([c for c, _ in found], pa.int64()), batch["illegal"],
                pa.array([s for _, s in found], pa.int32()), pa.array([ENDS[s] for _, s in found], pa.string()),
            ],
            ["conv", "cost", "illegal", "leave", "ends"],
        )


def _solved(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, cost, illegal) of each conversation, and (conv, block, enter, leave, ends) of each segment."""
    ended = "conv string, cost long, illegal long, leave int, ends string"
    crossed = "conv string, pos long, enter int, leave int, ends string"
    placed = settled(numbered(segments, "conv", ["block"], "segment-order"), "segments")
    # Most conversations are one segment and need no crossings from above.
    whole_ones, levels = placed.where("total = 1"), [placed.where("total > 1")]
    while not levels[-1].where("pos > 0").isEmpty():
        below = levels[-1].withColumn("parent", F.floor(F.col("pos") / FAN))
        joined = below.drop("block", "total").groupBy("conv", "parent").applyInArrow(_joined, f"conv string, pos long, {ITEM}")
        levels.append(settled(joined, "joined-segments"))
    last = [frame.drop("block", "total") for frame in (whole_ones, levels[-1])]
    tops = [settled(frame.mapInArrow(_ended, ended), "ended") for frame in last]
    entered = [
        top.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("enter"), "leave", "ends") for top in tops
    ]
    states = entered[1]
    for level in reversed(levels[:-1]):
        below = level.drop("block", "total").withColumn("parent", F.floor(F.col("pos") / FAN))
        above = states.withColumnRenamed("pos", "parent").groupBy("conv", "parent")
        states = settled(below.groupBy("conv", "parent").cogroup(above).applyInArrow(_handed_down, crossed), "crossed")
    states = entered[0].unionByName(states)
    found = tops[0].unionByName(tops[1]).select("conv", "cost", "illegal")
    return found, placed.select("conv", "pos", "block").join(states, ["conv", "pos"])


# --- digests -----------------------------------------------------------------------------------


class Reading:
    """One conversation as it is repaired, read row by row."""

    def __init__(self, conv: str):
        self.conv, self.state, self.audit, self.digest, self.any = conv, 0, [], hashlib.sha256(), False

    def turn(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def edit(self, edits: str, role: str, text: str) -> None:
        self.audit.append(edits)
        for edit in edits:
            given = GIVEN[self.state]
            if edit == DELETE:
                continue
            if edit == KEEP:
                self.turn(role, text)
                given = role[0]
            else:
                self.turn(ROLES[given], "" if edit == INSERT else text)
            self.state = NEXT[self.state][given]

    def row(self) -> tuple[str, str, str]:
        return self.conv, "".join(self.audit), self.digest.hexdigest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit, digest) from rows sorted by conversation, a text before its edits."""
    now, text = None, ""
    for batch in slices(batches):
        done = []
        for row in batch.to_pylist():
            if now is None or now.conv != row["conv"]:
                if now is not None:
                    done.append(now.row())
                now = Reading(row["conv"])
            if row["edits"] is None:
                text = row["text"]
            else:
                now.edit(row["edits"], row["role"], text)
        yield _read_rows(done)
    yield _read_rows([now.row()] if now is not None else [])


def _read_rows(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.record_batch([pa.array(c, pa.string()) for c in columns], ["conv", "audit", "repaired_sha256"])


def by_block(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.shiftright("seq", BLOCK_BITS))


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (conv, turn, role, tie, seq, edits) put to the texts of `rows`: audit and digest by conversation.

    Rows that are equal share one text. A conversation is read as a stream, as a digest has to be; only
    its audit is held.
    """
    none = F.lit(None)
    texts = rows.select(
        "conv", "turn", "role", _tie(F.col("text")).alias("tie"), F.lit(-1).cast("long").alias("seq"),
        none.cast("string").alias("edits"), "text",
    )
    both = texts.unionByName(edits.withColumn("text", none.cast("string")))
    order = ["conv", "turn", "role", "tie", "seq"]
    return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(
        _read, "conv string, audit string, repaired_sha256 string"
    )


def repaired(turns: DataFrame, spoil: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) by conversation.

    `turns` has (conv_id, turn, role, text); `spoil` makes (conv, turn, role, text) of it. Rows stand by
    turn, null first, those of equal turn by role and the md5 of the text. A null role or text is one
    space, so a null text is blank; a null conv_id is a conversation of its own. A role of another
    initial than s, u and a cannot be kept as it is. Repeated rows are duplicates of the first. A
    conversation without rows after the damage has zeros, an empty audit and the digest of the empty
    string. Other columns are ignored, texts count whole, and an empty table gives no rows.
    """
    kind = turns.schema["conv_id"].dataType
    named = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    original = turns.select(named).distinct()
    rows = spoil(turns.select("conv_id", "turn", "role", "text"))
    ordered = marked(rows)
    lists = by_block(ordered.select("conv", "turn", "role", "tie", "seq", "initial", "fault"))
    narrow = lists.select("block", "conv", "seq", "initial", "fault")
    segments = settled(narrow.groupBy("block").applyInArrow(_segments, f"conv string, block long, {ITEM}"), "row-blocks")
    solved, crossed = _solved(segments)
    edits = lists.groupBy("block").cogroup(crossed.groupBy("block")).applyInArrow(
        _edits, "conv string, turn long, role string, tie string, seq long, edits string"
    )
    digests = edited(rows, edits)
    count = lambda c: F.count_if(c).alias(c)
    counts = ordered.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"))
    days = ordered.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    gaps = days.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    found = original.join(counts, "conv", "left").join(gaps, "conv", "left")
    found = found.join(solved, "conv", "left").join(digests, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(
        F.when(F.col("conv") != "", F.col("conv")).cast(kind).alias("conv_id"),
        *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
