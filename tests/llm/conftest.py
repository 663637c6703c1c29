from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id -> text of the smallest table."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def edges():
    """Texts at the edges: null, empty, blank, very long, repeated, near copies, odd characters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = sentence(120)
    texts = [
        None, "", " \t\n\r ", "one", "ONE", "two words", "A shared opening line\n" + sentence(30),
        "a SHARED opening line \n\n" + sentence(25), base, base, base.upper(), base + " " + sentence(12),
        base.replace(" ", "\n"), sentence(20_000), sentence(20_000), "x " * 30_000, "a" * 120_000,
        "\n" * 500, "\x00\x1f odd \u2028 \U0001F600 text\x85 here", sentence(9), sentence(9) + "\n" + sentence(9),
    ]
    return dict(enumerate(texts))


@pytest.fixture(scope="session")
def table_of(spark):
    """A documents table from doc_id -> text, with columns whose names clash with results."""

    def make(docs, repeat=(), lang="en"):
        rows = [(d, t, lang, "s", 0, "x", 1.5, 7) for d, t in docs.items()]
        rows += [r for r in rows if r[0] in repeat]
        ddl = (
            "doc_id long, text string, lang string, source string, n_chars long, "
            "shard string, score double, n_lines int"
        )
        return spark.createDataFrame(rows, ddl).repartition(3)

    return make
