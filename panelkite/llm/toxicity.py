"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts, labelled or not, stand for the whole corpus
and are unlabelled. With the share of toxic texts (the class prior) p, the risk of calling texts clean is

    R(clean) = R_unlabelled(clean) - p * R_positive(clean),

which is not negative for the true classes. Where a batch makes it negative, the classifier is fitting
noise, and the step goes back instead (Kiryo et al., 2017). The classifiers are linear over features of
words; each shard of the corpus trains one in numpy, and their weights are averaged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .words import alnum_words, chunks, slices

BUCKETS = 2**18  # of hashed features: words, and their beginnings
BEGINNINGS = (4, 5)  # characters
ROOM = 300_000  # words whose features a task remembers

MIN_DEVIATION = 6.0  # by which a feature is commoner in toxic texts than chance explains
MIN_LIFT = 2.0  # times as common there as in the corpus
MIN_TEXTS = 4  # toxic texts with the feature
MAX_FEATURES = 4096  # the most deviating ones are kept

SHARD_ROWS = 32_768
EPOCHS = 10
BATCH = 512
RATE = 0.02
DECAY = 1e-4
SCALE = 4.0


class WordFeatures(dict):
    """The place of each word in `table`, whose rows are features of a word; -1 where it has fewer."""

    def __init__(self):
        super().__init__()
        self.table = np.full((1024, 1 + len(BEGINNINGS)), -1, dtype=np.int64)

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        if place == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        text = word.decode("utf-8", "replace")
        keys = [word, *(b"^" + text[:k].encode() for k in BEGINNINGS if len(text) > k)]
        self.table[place] = -1
        self.table[place, : len(keys)] = [xxhash.xxh3_64_intdigest(key) % BUCKETS for key in keys]
        self[word] = place
        return place


def features(texts: list[str | None], known: WordFeatures, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, feature) of all distinct features of the texts, in order.

    `keep` gives each bucket's number among the kept features, or -1.
    """
    if len(known) > ROOM:
        known.clear()
    sets = [set(alnum_words(text)) for text in texts]
    places = np.fromiter((known[w] for words in sets for w in words), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(words) for words in sets])
    found = known.table[places].ravel()
    owner = np.repeat(owner, known.table.shape[1])
    if keep is not None:
        found = np.where(found >= 0, keep[found], -1)
    real = found >= 0
    pairs = np.unique(owner[real] * BUCKETS + found[real])
    return pairs // BUCKETS, pairs % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts, toxic texts with it) of the rows of a task."""
    known, counts = WordFeatures(), np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in slices(batches):
        texts, toxic = batch["text"].to_pylist(), np.array(batch["toxic"].to_pylist(), dtype=bool)
        for a, b in chunks(texts):
            owner, found = features(texts[a:b], known)
            counts[0] += np.bincount(found, minlength=BUCKETS)
            counts[1] += np.bincount(found[toxic[a:b][owner]], minlength=BUCKETS)
    seen = np.flatnonzero(counts[0])
    yield pa.record_batch([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], ["feature", "n", "p"])


def telling_features(learning: DataFrame, n: int, p: int) -> list[int]:
    """Features that toxic texts have more often than the corpus has; counted over all `n` texts, `p` toxic."""
    counted = learning.select("text", "toxic").mapInArrow(_count, "feature long, n long, p long")
    whole = counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where(F.col("p") >= MIN_TEXTS)
    share = F.col("n") / F.lit(float(n))
    chance = share * p
    deviation = (F.col("p") - chance) / F.sqrt(chance * (1 - share) + 1)
    best = whole.where((deviation > MIN_DEVIATION) & (F.col("p") > MIN_LIFT * chance))
    return [r.feature for r in best.orderBy(deviation.desc(), "feature").limit(MAX_FEATURES).collect()]


def _found(batches: Iterator[pa.RecordBatch], kept: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows with their kept features in the place of the text."""
    keep = np.full(BUCKETS, -1, dtype=np.int64)
    keep[kept] = np.arange(len(kept))
    known = WordFeatures()
    for batch in slices(batches):
        texts = batch["text"].to_pylist()
        for a, b in chunks(texts):
            owner, found = features(texts[a:b], known, keep)
            ends = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))
            yield pa.record_batch([batch["doc_id"].slice(a, b - a), lists], ["doc_id", "found"])


class Rows:
    """Rows of features as numpy arrays."""

    def __init__(self, lists: pa.ListArray):
        self.values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.norms = SCALE / np.sqrt(np.maximum(self.sizes, 1))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the chosen rows, the row's place among them for each, and norms."""
        sizes = self.sizes[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.values[self.begins[rows][owner] + inside], owner, self.norms[rows]


def logits(weights: np.ndarray, features: np.ndarray, owner: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The last of `weights` is the intercept."""
    return np.bincount(owner, weights[features], minlength=len(norms)) * norms + weights[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradients(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the corrected logistic risk along the logits of positive and unlabelled rows.

    Where the risk of calling texts clean is negative, the step climbs it back instead.
    """
    clean = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
    of_u, of_p = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
    if clean < 0:
        return -of_p, -of_u
    return of_p - prior * sigmoid(-zp) / len(zp), of_u


def train(rows: Rows, positive: np.ndarray, prior: float, width: int, seed: int) -> np.ndarray:
    """Weights of `width` features and the intercept, from positive rows and all rows as unlabelled ones."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(width + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second, step = np.zeros(width + 1), np.zeros(width + 1), 0
    decay = np.append(np.full(width, DECAY), 0.0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows.sizes))
        for u in np.array_split(order, max(1, len(order) // BATCH)):
            p = rng.choice(positive, min(len(positive), BATCH // 2), replace=False)
            fu, ou, nu = rows.take(u)
            fp, op, np_ = rows.take(p)
            gp, gu = risk_gradients(logits(weights, fp, op, np_), logits(weights, fu, ou, nu), prior)
            slope = np.bincount(fu, (gu * nu)[ou], minlength=width + 1) + np.bincount(fp, (gp * np_)[op], minlength=width + 1)
            slope[-1] = gp.sum() + gu.sum()
            slope += decay * weights
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def _member(shard: pa.Table, prior: float, width: int) -> pa.Table:
    """One classifier, with the number of its positive rows as its voice; none without such rows."""
    shard = shard.combine_chunks()
    positive = np.flatnonzero(np.array(shard["toxic"].to_pylist(), dtype=bool))
    if not len(positive) or not width:
        return pa.table({"place": pa.array([], pa.int32()), "weight": pa.array([], pa.float64()), "voice": pa.array([], pa.int64())})
    lists = shard["found"].combine_chunks()
    rows = Rows(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists)
    weights = train(rows, positive, prior, width, int(shard["shard"][0].as_py()))
    return pa.table(
        {
            "place": pa.array(np.arange(width + 1), pa.int32()), "weight": pa.array(weights),
            "voice": pa.array(np.full(width + 1, len(positive)), pa.int64()),
        }
    )


def fit(found: DataFrame, positives: DataFrame, prior: float, width: int, learning: int) -> np.ndarray:
    """The averaged weights over (doc_id, found) rows: every row trains the classifier of its shard."""
    shards = max(1, -(-learning // SHARD_ROWS))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    rows = found.withColumn("shard", number).join(positives.withColumn("toxic", F.lit(True)), "doc_id", "left")

    def member(shard: pa.Table) -> pa.Table:
        return _member(shard, prior, width)

    members = (
        rows.select("shard", "found", F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .groupBy("shard")
        .applyInArrow(member, "place int, weight double, voice long")
    )
    mean = members.groupBy("place").agg((F.sum(F.col("weight") * F.col("voice")) / F.sum("voice")).alias("weight"))
    weights = np.zeros(width + 1)
    weights[-1] = np.log(prior / (1 - prior))
    for row in mean.collect():  # at most MAX_FEATURES + 1 rows
        weights[row.place] = row.weight
    return weights


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = Rows(batch["found"])
        score = sigmoid(logits(weights, *rows.take(np.arange(batch.num_rows))))
        yield pa.record_batch([batch["doc_id"], pa.array(score)], ["doc_id", "score"])


def scores(docs: DataFrame, toxic: DataFrame, learn: str) -> DataFrame:
    """(doc_id, score) of each row of `docs` (doc_id, text): the probability that the text is toxic.

    `toxic` (doc_id, toxic) holds labels, 1 or 0, of some documents; `learn` is a condition on doc_id that
    a row must meet to be learned from, labelled or not. Labels give the positives and the class prior;
    a text labelled 0 is unlabelled text like others. A document with several labels is toxic if one is.
    Null and empty texts have no features and get the score of the intercept; long texts count whole;
    repeated rows each come back with the same score; null labels and labels without a text do not count; rows with a null doc_id are
    scored, not learned from. Without positives, all scores are the smoothed share of toxic labels. An
    empty table gives no rows. Columns other than doc_id, text and toxic are ignored.
    """
    docs = docs.select("doc_id", "text")
    labels = toxic.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learn)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = settled(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-labels")
    marked, total = labels.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    prior = float(np.clip((marked + 0.5) / (total + 1), 0.001, 0.999))
    positives = settled(labels.where("toxic = 1").select("doc_id"), "toxic-positives")
    learning = docs.where("doc_id IS NOT NULL").where(learn)
    n = learning.count()

    rows = learning.join(positives.withColumn("toxic", F.lit(True)), "doc_id", "left")
    rows = rows.withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    p = rows.where("toxic").count()
    kept = telling_features(rows, n, p) if p else []
    found = docs.mapInArrow(functools.partial(_found, kept=kept), "doc_id long, found array<int>")
    found = settled(found, "toxic-features")
    known = found.where("doc_id IS NOT NULL").where(learn)
    weights = fit(known, positives, prior, len(kept), n)
    return found.mapInArrow(functools.partial(_score, weights=weights), "doc_id long, score double")
