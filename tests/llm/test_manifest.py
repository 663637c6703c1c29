"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from panelkite.llm import merkle

DDL = (
    "doc_id long, source string, lang string, n_chars long, text string, "
    "leaf string, root int, pos string, total double, seq string"
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    out = ""
    for value in (row[0], row[1], row[2], row[3], text):
        value = None if value is None else str(value)
        out += "-" if value is None else f"{len(value.encode())}:{value}"
    return sha(out)


def climb(nodes):
    """Levels from `nodes` up to the one left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def flanks(levels, place):
    for level in levels[:-1]:
        run, own = place // 8 * 8, place % 8
        nodes = level[run : run + 8]
        yield "".join(nodes[:own]), "".join(nodes[own + 1 :])
        place //= 8


def brute(rows):
    by_lang: dict = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    order = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in order:
        mine = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = mine, climb([leaf(r, r[4]) for r in mine])
    tops = climb([trees[lang][1][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        mine, levels = trees[lang]
        for place, row in enumerate(mine):
            path = [*flanks(levels, place), *flanks(tops, k)]
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            node = leaf(row, text)
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((row[0], levels[0][place], levels[-1][0], tops[-1][0], proof, node, node == tops[-1][0]))
    return sorted(out, key=str)


def given(n, langs):
    return [(i, f"s{i % 3}", langs[i % len(langs)], i * 7, f"Text {i} " + "é" * (i % 4)) for i in range(n)]


CASES = {
    "one": given(1, ["en"]),
    "eight and nine": given(17, ["en", "de"]),
    "more than a block": given(1100, ["en"]) + given(9, ["fr"]),
    "many languages": given(70, [f"l{i}" for i in range(70)]),
    "odd": [
        (None, None, None, None, None), (None, None, None, None, None), (3, "s", None, 1, ""),
        (5, "S", "", 2, "UPPER Ünd"), (5, "S", "", 2, "UPPER Ünd"), (5, "S", "", 2, "other"), (-4, "", "é", -1, "x"),
        (6, "s", "Z", 0, "LONG " * 40_000), (9, "s", "z", 0, "no capitals"), (12, "s", "z", None, None),
    ],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(*r, "x", 1, "p", 2.0, "q") for r in rows], DDL).repartition(4)
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str) == brute(rows)


def test_empty(spark):
    got = merkle.manifest(spark.createDataFrame([], DDL))
    assert got.columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert got.count() == 0


def test_two_rounds_of_blocks(spark, monkeypatch):
    """Blocks of eight leaves: four rounds, among them one whose last block is short."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = given(8**3 + 9, ["en", "en", "de"])
    docs = spark.createDataFrame([(*r, "x", 1, "p", 2.0, "q") for r in rows], DDL)
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str) == brute(rows)
