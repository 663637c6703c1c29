"""Operators over documents against plain versions, on driver rows, edge cases and empty tables."""

from __future__ import annotations

import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from panelkite.llm import components, decontam, line_dedup, ngram_join, pii, quality_rules


def as_map(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_lines_of_smaller_documents_go(table_of, documents, edges):
    docs = edges | {1000 + k: t for k, t in list(documents.items())[:80]}
    out = line_dedup.dedup_lines(table_of(docs), batches=5, fanout=2)
    assert as_map(out, "text", "n_lines", "n_dropped") == brute.deduped_lines(docs)


def test_repeated_rows_are_one_document(table_of):
    docs = {1: "the very same line\nx", 2: "the very same line\ny", 3: None}
    out = line_dedup.dedup_lines(table_of(docs, repeat=(1, 2, 3)))
    assert out.count() == 3
    assert as_map(out, "text") == {1: ("the very same line\nx",), 2: ("y",), 3: ("",)}


def test_runs_are_compacted_and_dropped(spark, table_of):
    lines = line_dedup.line_digests(table_of({k: f"line number {k} of all\nshared by every text" for k in range(40)}))
    runs = line_dedup.LineRuns(spark, fanout=2)
    dropped = [runs.add(lines.where(F.col("doc_id").between(10 * b, 10 * b + 9))).count() for b in range(4)]
    assert dropped == [9, 10, 10, 10]
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert spark.table(runs.runs[0]).count() == 41
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_similar_groups_are_exact(table_of, documents, edges):
    rng = random.Random(5)
    docs = edges | {1000 + k: t for k, t in documents.items()}
    for k in range(60):  # copies of varied nearness
        words = documents[rng.choice(sorted(documents))].split()[:150]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = "changed"
        docs[5000 + k] = " ".join(words)
    out = ngram_join.similar_groups(table_of(docs))
    assert as_map(out, "n_shingles", "component_id") == brute.similar_groups(docs)


def test_large_regions_are_cut_into_blocks(table_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    docs = {}
    for k in range(50):
        text = words.copy()
        text[rng.randrange(60)] = f"own{k}"
        text[rng.randrange(60)] = f"too{k}"
        docs[k] = " ".join(text)
    out = ngram_join.similar_groups(table_of(docs))
    assert as_map(out, "n_shingles", "component_id") == brute.similar_groups(docs)


def test_tree_loses_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, n)) for n in rng.integers(5, 380, 300)]
    points = np.stack([ngram_join.count_vector(s) for s in sets])
    tree = ngram_join.CountTree(points)
    assert len(tree.levels) > 1
    for k in range(0, 300, 7):
        near = set(tree.near(points[k], len(sets[k])).tolist())
        assert near >= {j for j in range(300) if ngram_join.similar(sets[k], sets[j])}


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(50, 90)] + [(7, 8), (8, 9), (9, 7), (5, 5)]
    out = components.components(spark.createDataFrame(edges, "u long, v long"))
    found = {r.node: r.root for r in out.collect()}
    assert all(found[k] == 100 for k in range(100, 141))
    assert all(found[k] == 1 for k in (1, *range(50, 90)))
    assert found[7] == found[8] == found[9] == 7 and 5 not in found


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "ALPHA beta gamma, delta epsilon zeta eta theta iota kappa lambda mu!"),
    (30, "only four words here"), (4, "single"), (5, None), (6, ""), (7, "..."), (1, "another text of item one"),
]


def test_every_shared_window_is_found(spark, table_of, documents, edges):
    docs = edges | {
        100: "x alpha BETA gamma delta-epsilon zeta eta theta iota kappa lambda y",
        101: "alpha beta gamma delta epsilon zeta eta theta iota",
        102: "here: only four words here only four words here",
        103: "a single word and alpha beta gamma delta epsilon zeta eta theta iota kappa twice "
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu",
    }
    docs |= {1000 + k: t for k, t in list(documents.items())[:60]}
    some = [w.split() for w in list(documents.values())[:60:7]]
    items = ITEMS + [(100 + k, " ".join(w[3:40])) for k, w in enumerate(some)]
    out = decontam.contamination(table_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert as_map(out, "n_words", "n_hit", "item_ids") == brute.contamination(docs, items)


def test_no_items_no_hits(spark, table_of):
    out = decontam.contamination(table_of({1: "a b c"}), spark.createDataFrame([], "item_id long, text string"))
    assert as_map(out, "n_words", "n_hit", "item_ids") == {1: (3, 0, [])}


def test_quality_statistics(table_of, documents, edges):
    repeats = " ".join(f"w{k % 11}" for k in range(60)) + "\n### $ | #\n\n### $ | #\n"
    docs = edges | {100: repeats, 101: "a b c d e f g h x a b c d e f g h"} | {1000 + k: t for k, t in documents.items()}
    out = quality_rules.with_stats(table_of(docs)).drop("text")
    assert as_map(out, *quality_rules.STATS) == {d: brute.quality_stats(t) for d, t in docs.items()}


def test_fences_follow_the_group(spark):
    def text(k, marks):
        return " ".join(f"word{(k * 31 + i) % 997}{'#' * (marks if marks > 1 or i < 2 else 0)}" for i in range(60))

    rows = [(k, text(k, k % 10 == 0), "en", "plain") for k in range(200)] + [(500 + k, text(k, 4), "en", "code") for k in range(200)]
    rows += [(900, text(1, 8), "en", "plain"), (901, text(1, 4), "en", "code"), (902, text(2, 9), None, None), (903, None, "en", None)]
    kept = as_map(quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "kept", "base_failed")
    assert kept[900] == (False, False)  # far beyond its source
    assert kept[901] == (True, False)  # usual in its source
    assert all(kept[k][0] for k in range(200)) and all(kept[500 + k][0] for k in range(200))
    assert kept[903] == (False, True) and set(kept) == {r[0] for r in rows}


PERSONAL = [
    "mail a.b@c.de, x@y@z.org and a@b.co_d@e.fg or none@host",
    "ip 1.2.3.4 and 256.1.1.1 then 10.20.30.40.50 and 1.2.3.004",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 12 34; 5500000000000004 and 123456789012345678901234",
    "call +1 (414) 555-7134 now, +1 2, +123456789012345678, +49.30.123456",
    "+4111111111111111 a@1.2.3.4 é\U0001F600 b@c.d 0000-0000-0000",
    "1" * 40_000, "a" * 50_000, "@" * 2000, "+1" * 5000, "1-" * 9000, "1.2." * 4000, "a@b.c " * 300,
]


def test_pattern_spans(table_of, documents, edges):
    docs = edges | {100 + k: t for k, t in enumerate(PERSONAL)} | {1000 + k: t for k, t in documents.items()}
    out = pii.find(table_of(docs, repeat=(100, 2)))
    rows = out.select("doc_id", pii.labels(F.col("base"), F.col("terms"), False).alias("s")).collect()
    assert len(rows) == len(docs) + 2
    assert {r.doc_id: r.s for r in rows} == {d: brute.pii_spans(t) for d, t in docs.items()}


def test_terms_that_disclose(spark, table_of):
    docs = {k: f"number {k}: write to Zorblatt today at zb@mail.org for offer {k}" for k in range(6)}
    docs |= {20 + k: f"write to us at noon today for offer {k}, number {k}" for k in range(40)}
    docs |= {70 + k: "write to Quibble at qq@mail.org" for k in range(9)}  # one wording only
    out = pii.sanitise(table_of(docs))
    found = {r.doc_id: r for r in out.collect()}
    terms = lambda d: [found[d].text[t.start : t.end] for t in found[d].terms]
    assert all(terms(k) == ["Zorblatt"] for k in range(6)), terms(0)
    assert not any(terms(k) for k in (*range(20, 60), *range(70, 79)))
    assert found[3].clean_text == "number 3: write to  today at [EMAIL] for offer 3"
    assert found[70].clean_text == "write to Quibble at [EMAIL]"


def planted(n=240):
    """Texts with names beside their addresses and keys beside values, and such words elsewhere."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(300)]
    names = ["".join(rng.choices(letters, k=9)) for _ in range(40)]
    docs, truth = {}, set()
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if k < 40:
            words[10], words[30] = f"{names[k]}.{k:02d}@mail{k % 4}.org", names[k].title()
            truth.add((k, names[k].title()))
        elif k < 60:
            key = "".join(rng.choices("0123456789abcdef", k=24)) + "a1"
            words[5], words[40] = f"10.{k}.7.{k}", f'secret = "{key}"'
            truth |= {(k, key), (k, "secret")}
        docs[k] = " ".join(words)
    return docs, truth


def test_planted_names_and_keys(table_of):
    docs, truth = planted()
    out = pii.sanitise(table_of(docs)).where(F.size("terms") > 0).collect()
    got = {(r.doc_id, r.text[t.start : t.end]) for r in out for t in r.terms}
    assert len(got & truth) / len(truth) >= 0.95 and len(got & truth) / len(got) >= 0.95, (got ^ truth)
    assert all(k < 60 for k, _ in got)
    for r in out:
        for t in r.terms:
            assert t.disclosure >= pii.GENERALISE and r.text[t.start : t.end] not in r.clean_text.split()


def test_names_by_chance_are_no_evidence(table_of):
    docs, _ = planted()
    # every text tells another one's name
    names = {k: t.split()[30] for k, t in docs.items() if k < 40}
    moved = {k: t.replace(names[k], names[(k + 1) % 40]) if k < 40 else t for k, t in docs.items()}
    out = pii.find(table_of(moved)).where("doc_id < 40 AND size(terms) > 0")
    assert out.collect() == []


def test_terms_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = pii.sanitise(docs).where("size(terms) > 0").collect()
    keys = [(r, t) for r in rows for t in r.terms if re.fullmatch("[0-9a-f]{32,}", r.text[t.start : t.end])]
    assert keys and all(r.text[t.start : t.end] not in r.clean_text for r, t in keys)
    assert all(not (t.start < b.end and b.start < t.end) for r in rows for t in r.terms for b in r.base)


@pytest.mark.parametrize("run", [
    lambda e, _: line_dedup.dedup_lines(e), lambda e, _: ngram_join.similar_groups(e),
    lambda e, i: decontam.contamination(e, i), lambda e, _: quality_rules.judged(e), lambda e, _: pii.find(e),
])
def test_empty_tables(spark, table_of, run):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(table_of({1: "a"}).where("false"), items).collect() == []


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, ngram_join.similar_groups])
def test_rows_without_id_are_left_out(table_of, run):
    assert {r.doc_id for r in run(table_of({None: "some longer text", 2: "some longer text"})).collect()} == {2}
