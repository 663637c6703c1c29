"""Sharding, packing, chat, language, quality model and the pipeline: exact properties and accuracy."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelkite.llm import chat, langid, packing, quality_model, sharding
from panelkite.llm.queries import QUERIES, token_file


def test_shards_are_even_and_gapless(spark, table_of, edges):
    rows = table_of(edges | {None: "no id"}, repeat=(1, 5, 8))
    out = sharding.exact_shuffle(rows, ["doc_id", "text"], shards=8, blocks=5).collect()
    assert len(out) == len(edges) + 4 and out[0].asDict().keys() == set(rows.columns) | {"slot"}
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.exact_shuffle(rows.where("false"), ["doc_id"]).collect() == []


def test_all_copies_of_one_row(table_of):
    rows = table_of({1: "x"}).crossJoin(table_of({k: "" for k in range(50)}).select(F.lit(0).alias("zero")))
    out = sharding.exact_shuffle(rows, ["doc_id"], shards=3).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [16, 17, 17]
    assert len({(r.shard, r.slot) for r in out}) == 50


def test_matrix_has_exact_margins_and_the_right_mean():
    blocks, sizes = [30, 0, 50, 21], sharding.shard_sizes(101, 4)
    mean = np.zeros((4, 4))
    for seed in range(400):
        m = np.array(sharding.deal(blocks, sizes, seed))
        assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == sizes and m.min() >= 0
        mean += m / 400
    assert np.abs(mean - np.outer(blocks, sizes) / 101).max() < 0.6


def test_hypergeometric_variance():
    rng = random.Random(4)
    draws = [sharding.hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    assert abs(np.mean(draws) - 60) < 0.5
    assert abs(np.var(draws) - 200 * 0.3 * 0.7 * 800 / 999) < 3
    assert sharding.hypergeometric(rng, 10**11, 7 * 10**11, 10**8) == pytest.approx(12_500_000, abs=20_000)


def test_words_give_the_ids_of_the_tokenizer(documents, edges):
    words, rng = packing.WordIds(token_file(), room=50), random.Random(1)
    odd = ["a <|endoftext|> B", "<|ENDOFTEXT|> x", "It's THE'LL ÀÉÎ ΑΣ ΟΔΟΣ\u0085x\x1cq e\u0301 İx ½² ×÷ ǅ 12345 ~!@ ẞ ﬁ"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 900)])) for _ in range(50)) for _ in range(80)]
    texts = [*list(documents.values())[:40], *(t or "" for t in edges.values()), *odd]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(words.encode(texts)) == want


def test_packing_round_trip(spark, table_of, documents, edges):
    from tokenizers import Tokenizer

    docs = edges | {1000 + k: t for k, t in documents.items()}
    pieces = packing.pack(table_of(docs, repeat=(0, 8)), token_file(), window=512, open_windows=4).collect()
    tokenizer = Tokenizer.from_file(token_file())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, text in docs.items():
        own = sorted(by_doc.pop(doc), key=lambda p: p.start)
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist() == ids
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert {p.doc_tokens for p in own} == {len(ids)}
    assert not by_doc
    padding = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        size = sum(p.length for p in own)
        assert size <= 512
        total += size
        padding += 512 - size if size & (size - 1) else 0
    assert padding < 0.02 * total
    assert packing.pack(table_of({1: "a"}).where("false"), token_file()).collect() == []


def test_windows_stay_bounded():
    windows = packing.OpenWindows(room=3, window=100)
    rng = random.Random(2)
    for k in range(500):
        windows.place((k, 0, b"1234" * rng.randint(1, 100), 1))
        assert len(windows.free) <= 3 and len(windows.held) == len(windows.free)


HARD = ["", "</turn>", "\\</turn>", "\\\\</turn>\\", "a\n</turn>\n### User: b", "### Assistant: x", "\\### Tool:", "\\",
        "</turn></turn>", "### user: low", "tail\\\n", "\n</turn>", "<\\/turn>", "é\U0001F600 </turn>"]
ROLES = ["user", "assistant", "system", "", "Tool", "a: b", "back\\", "=x", "ünï", "</turn>", "two\nlines", "USER"]


def test_any_turn_reads_back():
    turns = [(r, t) for r in ROLES for t in HARD]
    formatted = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert [x[:2] for x in chat.read(formatted)] == turns
    assert chat.format_turn("user", "plain \\ text")[0] == "### User: plain \\ text\n</turn>\n"
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "</turn>", "### User:", "a", "\n", " "]) for _ in range(rng.randint(0, 7)))
        formatted, start, end = chat.format_turn("assistant", text)
        assert list(chat.read(formatted)) == [("assistant", text, start, end)]


@pytest.mark.parametrize("bad", ["x", "### user", "### User: a</turn>\n", "### User: a\n</turn>", "### User: a ### Tool:\n</turn>\n"])
def test_bad_text_is_refused(bad):
    with pytest.raises(chat.Unreadable):
        list(chat.read(bad))


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", "</turn>"), (1, 1, "assistant", "</turn>"),
            (None, 0, "user", "z"), (2, 5, "assistant", "x" * 100_000)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    out = {r.conv_id: r for r in chat.summarise(chat.format_conversations(turns)).collect()}
    assert {k: v.n_turns for k, v in out.items()} == {1: 4, 2: 1, None: 1}
    assert out[1].loss_chars == 14 and out[2].loss_chars == 100_000
    assert chat.summarise(chat.format_conversations(turns.where("false"))).collect() == []


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op10_language_id"](spark, sf_dir).join(docs, "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(r.held_out == (r in held) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edges(spark, table_of, edges):
    learned = langid.learn(spark.createDataFrame(
        [(1, "the cat sat on the mat and then the dog", "en"), (2, "le chat est sur la table et le chien", "fr"),
         (3, None, "de"), (4, "text", None)], "doc_id long, text string, lang string"))
    assert sorted(learned) == ["en", "fr"]
    found = {r.doc_id: r for r in langid.identify(table_of(edges, repeat=(3,)), learned).collect()}
    assert [found[k].lang_pred for k in (0, 1, 2, 17)] == ["und"] * 4 and found[0].rejected
    assert found[3].shard == "x" and found[3].text == "one"
    assert langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}
    assert {r.lang_pred for r in langid.identify(table_of({1: "a"}), {}).collect()} == {"und"}
    assert langid.identify(table_of({1: "a"}).where("false"), learned).collect() == []


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = QUERIES["op1_quality_model"](spark, sf_dir).collect()
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_quality_model_edges(spark, table_of, edges):
    stats = quality_model.with_statistics(table_of(edges, repeat=(0, 1)))
    for labels in (F.lit(None).cast("int"), F.lit(1), F.lit(0), (F.col("doc_id") % 2).cast("int")):
        model = quality_model.fit(stats.withColumn("label", labels))
        scores = [r.score for r in quality_model.scored(stats, model).collect()]
        assert len(scores) == len(edges) + 2 and all(0 <= s <= 1 for s in scores)
    empty = stats.where("false")
    assert quality_model.fit(empty.withColumn("label", F.lit(1))).weights == ()
    assert quality_model.scored(empty, quality_model.RuleEnsemble((), 0.0)).collect() == []


def test_compiled_rules_are_the_tree_paths():
    printed = "Tree 0\n  If (feature 0 <= 1.5)\n   If (feature 2 > 0.1)\n    Predict: 1.0\n   Else (feature 2 <= 0.1)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert {r.tests for r in quality_model.tree_rules(printed)} == {
        ((0, False, 1.5),), ((0, False, 1.5), (2, True, 0.1)), ((0, False, 1.5), (2, False, 0.1)), ((0, True, 1.5),)
    }


def test_pipeline_against_plain_stages(spark, sf_dir, documents):
    kept = {r.doc_id: r.text for r in corpus_pipeline.language_id(
        spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    assert set(kept) <= set(documents) and len(kept) >= 0.97 * len(documents)
    lines = {d: t for d, (t, _, n) in brute.deduped_lines(kept).items() if not n or t.strip(brute.SPACE)}
    groups = brute.similar_groups(lines)
    single = {d: t for d, t in lines.items() if groups[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d, found in brute.contamination(single, items).items() if not found[1]}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == clean
    totals = Counter()
    for p in pieces:
        totals[p.doc_id] += p.length
    assert all(totals[p.doc_id] == p.doc_tokens for p in pieces)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
