from __future__ import annotations

import random

from panelkite.llm import langid


def test_letter_junk_is_rejected_and_learned_rows_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = langid.learn(docs)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    junk = [(k, " ".join(word() for _ in range(200))) for k in range(200)]
    found = langid.identify(spark.createDataFrame(junk, "doc_id long, text string"), learned)
    rejected = found.where("rejected").count()
    own = langid.identify(docs.select("doc_id", "text", "lang"), learned).where("lang_pred = lang")
    kept, total = own.where("NOT rejected").count(), own.count()
    print("margin", learned.min_margin, "junk rejected", rejected, "kept", kept, "of", total)
    assert kept >= 0.97 * total
    assert rejected >= 180, rejected
