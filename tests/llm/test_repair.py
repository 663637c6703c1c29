"""Conversation repair against a plain search that carries audits along."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from panelkite.llm import repair

SPACES = " \t\n\x0b\x0c\r"
GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        for _ in range((hit != 0) + (hit == 3)):
            yield conv, turn, role, text


def inserted(ways):
    """The best (cost, audit, body) of each state with insertions put behind."""
    for _ in range(3):
        for state, (cost, audit, body) in list(ways.items()):
            role, reached = GIVEN[state]
            new = (cost + 3, audit + "I", body + [role + ":"])
            ways[reached] = min(ways.get(reached, new), new)
    return ways


def solve(rows):
    """Cost, audit and body over (role, text, fault)."""
    ways = {0: (0, "", [])}
    for role, text, fault in rows:
        out = {}
        for state, (cost, audit, body) in inserted(ways).items():
            found = [(state, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                given, reached = GIVEN[state]
                found.append((reached, 3 + more, "R", [f"{given}:{text}"]))
                if (state, role[:1]) in NEXT:
                    found.append((NEXT[state, role[:1]], more, "K", [f"{role}:{text}"]))
            for end, price, edit, lines in found:
                new = (cost + price, audit + edit, body + lines)
                out[end] = min(out.get(end, new), new)
        ways = out
    return min(way for state, way in inserted(ways).items() if state in (0, 3))


def brute(rows, after=damage):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in after(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None
            seen.add((role, text))
            faults.append(fault or ("" if bare[-1] in ".!?" else "truncated"))
        turns = {r[1] for r in mine} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, body = solve([(r[2], r[3], f) for r, f in zip(mine, faults)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest(),
        )
    return out


DDL = "conv_id long, turn long, role string, text string, audit int, seq string, block double, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0, "y") for r in rows], DDL).repartition(3)


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "Yes.", "no", "What?", "", " \n", None, "Well! ", "é…", "A longer answer. And more"]
    turn = 0
    for _ in range(n):
        turn += rng.choice([0, 1, 1, 1, 3])
        yield conv, rng.choice([turn] * 9 + [None]), rng.choice(roles), f"{rng.randint(0, 3 * n)} " * rng.randint(0, 1) + (
            rng.choice(texts[:5] + texts[7:])
        ) if rng.random() < 0.9 else None


def some(seed, sizes):
    rng = random.Random(seed)
    return [row for conv, n in enumerate(sizes) for row in talk(rng, conv, n)]


def test_conversations(spark):
    rows = some(1, [0, 1, 1, 2, 2, 3, 5, 8, 13, 40] * 6)
    assert got(repair.repaired(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("bits, fan", [(2, 3), (1, 2), (4, 1024)])
def test_blocks_of_blocks(spark, monkeypatch, bits, fan):
    """One conversation holds most rows and is cut into blocks, and those into blocks again."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = some(2, [3, 120, 1, 7, 4])
    assert got(repair.repaired(frame(spark, rows))) == brute(rows)


def test_edges(spark):
    long = "word " * 60_000 + "end."
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (1, 5, "user", long), (1, 6, "assistant", long), (1, 7, "user", long),
        *[(2, 3, "user", "same.")] * 9, *[(3, None, "assistant", "so.")] * 4, (4, 1, "Ünder", "x."), (4, 2, "tool", "\x00."),
        (5, 1, "user", "a\n"), (5, 2, "assistant", "b.\x85"), (-7, 1, "user", " . \x0b"),
    ]
    assert got(repair.repaired(frame(spark, rows))) == brute(rows)


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(repair.repaired(frame(spark, [(8, turn, "user", "gone.")]))) == {8: empty}


def test_empty(spark):
    assert repair.repaired(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_crossings_give_the_least_audit(seed):
    """Ties between equally cheap ways, without Spark."""
    rng = random.Random(seed)
    rows = [(rng.choice("suat"), f"{k}", rng.choice(["", "", "truncated", "blank"])) for k in range(rng.randint(0, 25))]
    codes = [
        repair.INITIALS.index(r if r in "sua" else "?") * 3 + {"": 0, "truncated": 1, "blank": 2}[f] for r, _, f in rows
    ]
    items = [repair.ROW_ITEMS[c] for c in codes]
    cost, end = repair.last_state(repair.whole(items)[0])
    way = repair.crossings(items, 0, end)
    audit = "".join(repair.STEPS[c][way[k]][way[k + 1]][1] for k, c in enumerate(codes)) + repair.ENDS[end]
    assert (cost, audit) == solve(rows)[:2]
