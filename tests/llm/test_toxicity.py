"""Positive-unlabelled learning: its risk, its features, held-out accuracy, and edges."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelkite.llm import toxicity

LEARN = "doc_id % 4 <> 2"
DDL = "doc_id long, text string, score double, toxic string, found int, shard string"


def corpus(n=3000, seed=5):
    """Texts of made words; a tenth holds rude ones, half of the texts are labelled."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdegilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rude = [stem + end for stem in ("zzark", "qqolt", "vrizz") for end in ("", "en", "ig", "lich")]
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.1
        text = [rng.choice(words) for _ in range(rng.choice([5, 30, 200]))]
        for _ in range((2 + len(text) // 10) * toxic):
            text[rng.randrange(len(text))] = rng.choice(rude)
        docs.append((k, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((k, int(toxic)))
    return docs, labels


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", 1, "y") for r in rows], DDL).repartition(3)


def scored(spark, docs, labels):
    return toxicity.scores(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), LEARN)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    found = {r.doc_id: r.score for r in scored(spark, docs, labels).collect()}
    held = [(found[d] >= 0.3, bool(t)) for d, t in labels if d % 4 == 2]
    toxic = [p for p, t in held if t]
    clean = [p for p, t in held if not t]
    assert len(found) == len(docs) and all(0 <= s <= 1 for s in found.values())
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def test_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = corpus(600)
    other = [(d, 1 - t if d % 4 == 2 else t) for d, t in labels]
    a, b = (sorted(map(tuple, scored(spark, docs, which).collect())) for which in (labels, other))
    assert a == b


def test_zero_labels_are_unlabelled_text(spark):
    """With the same prior, the classifier does not see which texts were labelled clean."""
    docs, labels = corpus(600)
    ones = [(d, t) for d, t in labels if t]
    zeros = [d for d, t in labels if not t and d % 4 != 2]
    unused = sorted({d for d, _ in docs if d % 4 != 2} - {d for d, _ in labels})
    moved = ones + [(d, 0) for d in unused[: len(zeros)]] + [(d, 0) for d in zeros[len(unused) :]]
    a, b = (sorted(map(tuple, scored(spark, docs, which).collect())) for which in (labels, moved))
    assert a == b


def test_risk_slopes_are_those_of_the_corrected_risk():
    rng = np.random.default_rng(1)
    zp, zu, prior = rng.normal(1, 1, 7), rng.normal(-1, 1, 11), 0.2

    def risk(zp, zu):
        clean = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        return prior * np.mean(np.logaddexp(0, -zp)) + clean

    gp, gu = toxicity.risk_gradients(zp, zu, prior)
    for z, g, other in ((zp, gp, False), (zu, gu, True)):
        for k in range(len(z)):
            up, down = z.copy(), z.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            slope = (risk(zp, up) - risk(zp, down) if other else risk(up, zu) - risk(down, zu)) / 2e-5
            assert slope == pytest.approx(g[k], abs=1e-6)


def test_a_negative_risk_is_climbed_back():
    zp, zu = np.full(4, 5.0), np.full(6, -5.0)
    gp, gu = toxicity.risk_gradients(zp, zu, 0.5)
    assert (gu < 0).all() and (gp > 0).all()


def test_features_of_whole_texts():
    known = toxicity.WordFeatures()
    texts = [None, "", "Word word WORD", "x " * 50_000 + "Straße", "the\x00rest"]
    owner, found = toxicity.features(texts, known)
    expected = [
        {w if part is None else "^" + w[:part] for w in set(words) for part in (None, 4, 5) if part is None or len(w) > part}
        for words in ([], [], ["word"], ["x", "straße"], ["the", "rest"])
    ]
    sizes = [len(e) for e in expected]
    assert np.bincount(owner, minlength=5).tolist() == sizes
    assert all(len(np.unique(found[owner == k])) == sizes[k] for k in range(5))


def test_edges(spark):
    docs, labels = corpus(400)
    odd = [(None, "zzark"), (None, None), (9001, None), (9002, ""), (9003, "long " * 50_000), (0, docs[0][1]), (0, docs[0][1])]
    labels = labels + [(None, 1), (77_777, 1), (9001, None), (9002, 0), (labels[0][0], 1), (labels[0][0], 0)]
    rows = scored(spark, docs + odd, labels).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 0}) == 1
    assert len({r.score for r in rows if r.doc_id in (9001, 9002)}) == 1


def test_without_positives_or_rows(spark):
    docs, _ = corpus(50)
    assert {round(r.score, 6) for r in scored(spark, docs, [(0, 0), (1, 0), (3, 0)]).collect()} == {0.125}
    assert scored(spark, docs, []).count() == 50
    empty = frame(spark, docs).limit(0)
    assert toxicity.scores(empty, spark.createDataFrame([], "doc_id long, toxic int"), LEARN).count() == 0
