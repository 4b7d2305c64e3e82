"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's parts are its character n-grams, with ``<`` and ``>`` at its ends, and the word itself, hashed into BUCKETS rows of one embedding table. A text is the mean of the embeddings of
all parts of its words, where a word that occurs n times counts as the root of n; a linear softmax tells the two labels apart. Table and softmax are trained together, in numpy, on a bounded sample of labelled rows; a misspelt word shares
most n-grams, and so vectors, with the word that was seen. A fifth of the sample takes no part in that: on it the logits are shifted, so that a score of DECISION is where the labels part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.llm.common import written
from subledger.llm.words import WordTable, groups, split_all, sums_by

BUCKETS = 1 << 17
DIMENSIONS = 4
GRAMS = (3, 4, 5)
#: The sample to train on has about as many rows of each label at most, and as many bytes of text in all; one in CALIBRATE rows is calibrated on.
ROWS_PER_LABEL, SAMPLE_BYTES, CALIBRATE = 3000, 64 << 20, 5
#: The score at which a text is taken for toxic, and how much more recall counts than precision when the scores are shifted to that.
DECISION, BETA = 0.3, 2.0
#: Steps over the whole sample, how far speed carries on, step lengths of embeddings, softmax and bias, and how much a mean is scaled up.
STEPS, MOMENTUM, RATES, SCALE = 60, 0.9, (100.0, 0.02, 0.1), 30.0
#: Words in fewer of the sample's texts than this share, or than 3, are not trained on.
LEAST_SHARE = 0.002
#: Weight of a part with an embedding of zero that every text has besides its own, so that a few odd words don't decide.
BLANK = 100.0


def parts_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all parts of all words, where each word's begin; the last entry is their number)."""
    marked = ["<" + w.decode("utf-8", "replace").lower() + ">" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(begin + lengths, lengths) - np.arange(len(codes))
    found, owners, rolling = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([codes[n - 1 :], np.zeros(min(n - 1, len(codes)), np.uint64)])[: len(codes)] + np.uint64(1)
        if n in GRAMS:
            # A word as short as the n-gram is its own whole part, below.
            at = np.flatnonzero(left >= n)
            found.append(rolling[at] * np.uint64(2 * n + 1))
            owners.append(owner[at])
    whole = np.zeros(len(marked), np.uint64)
    if len(marked):
        power = np.cumprod(np.concatenate([[1], np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
        whole = np.add.reduceat(codes * power[left], begin)
    found.append(whole)
    owners.append(np.arange(len(marked)))
    flat, by = np.concatenate(found), np.concatenate(owners)
    mixed = ((flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    order = np.argsort(by, kind="stable")
    return mixed[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(marked)))])


def calibration(logits: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """What to add to the logits so that a score of DECISION parts the labels best: by the F-measure that counts recall BETA times as much as precision, where label 1 has the share ``prior``.

    Of cuts that part equally well the middle one counts. With one label only it is the share's own logit.
    """
    ones = labels == 1
    if not 0 < prior < 1 or not ones.any() or ones.all():
        return float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    order = np.argsort(-logits, kind="stable")
    found, wrong = np.cumsum(ones[order]) / ones.sum(), np.cumsum(~ones[order]) / (~ones).sum()
    precision = prior * found / np.maximum(prior * found + (1 - prior) * wrong, 1e-12)
    f = (1 + BETA**2) * precision * found / np.maximum(BETA**2 * precision + found, 1e-12)
    x = logits[order]
    below = np.append(x[1:], x[-1] - 1.0)
    f[x == below] = -1.0  # no cut between equals
    best = int(f.argmax())
    return float(np.log(DECISION / (1 - DECISION)) - (x[best] + below[best]) / 2)


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(score, weight) of each bucket and the bias: the embeddings and the softmax, multiplied out. ``prior``: the share of label 1 among all labelled rows.

    A part weighs the log of the inverse share of texts that hold it. Steps follow the slope itself, so that parts which tell labels apart in many texts lead.
    """
    shift = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    index: dict[bytes, int] = {}
    words, counts = [], []
    for text in texts:
        found = Counter(text.encode("utf-8", "surrogatepass").lower().split())
        words.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int32, len(found)))
        counts.append(np.fromiter(found.values(), np.float32, len(found)))
    names = list(index)
    if not names or len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), np.ones(BUCKETS, np.float32), shift
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(w) for w in words])
    word, root = np.concatenate(words), np.sqrt(np.concatenate(counts))
    held = np.bincount(word, minlength=len(names))
    # The parts of all words are taken a slice at a time, twice, rather than held.
    slices = [slice(at, at + 20_000) for at in range(0, len(names), 20_000)]
    absent = np.zeros(BUCKETS)
    for x in slices:
        buckets, begin = parts_of(names[x])
        absent += np.bincount(buckets, np.repeat(np.log1p(-held[x] / (len(texts) + 1)), np.diff(begin)), BUCKETS)
    weights = -np.log(np.maximum(-np.expm1(absent), 1 / (len(texts) + 1)))
    # Words in very few texts are not trained on: they would be learned by heart.
    used = held >= max(3, LEAST_SHARE * len(texts))
    word_weight, kept_parts, kept_lengths = np.zeros(len(names)), [], []
    for x in slices:
        buckets, begin = parts_of(names[x])
        word_weight[x] = sums_by(weights[buckets], begin)
        kept_parts.append(buckets[np.repeat(used[x], np.diff(begin))].astype(np.int32))
        kept_lengths.append(np.diff(begin)[used[x]])
    buckets, begin = np.concatenate(kept_parts), np.concatenate([[0], np.cumsum(np.concatenate(kept_lengths))])
    size = BLANK + np.bincount(doc, root * word_weight[word], len(texts))

    dense, kept = np.cumsum(used) - 1, used[word]
    doc, word, factor = doc[kept], dense[word[kept]], (SCALE * root / size[doc])[kept][:, None]
    doc_edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    by_word = np.argsort(word, kind="stable")
    word_edges = np.searchsorted(word[by_word], np.arange(len(begin)))
    own, local = np.unique(buckets, return_inverse=True)
    by_bucket = np.argsort(local, kind="stable")
    bucket_edges = np.searchsorted(local[by_bucket], np.arange(len(own) + 1))
    part_word = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[by_bucket]
    idf = weights[own][:, None]

    table = np.zeros((len(own), DIMENSIONS))
    softmax, bias = np.random.default_rng(seed).normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, 2)), np.zeros(2)
    truth = np.eye(2)[labels]
    aside = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % CALIBRATE == 0 for t in texts), bool, len(texts))
    learned = truth * ~aside[:, None]
    balance = (learned / np.maximum(1, learned.sum(0))).sum(1, keepdims=True) / 2
    params, speeds = [table, softmax, bias], [0.0, 0.0, 0.0]
    for _ in range(STEPS):
        vectors = sums_by((table * idf)[local], begin)
        means = sums_by(vectors[word] * factor, doc_edges)
        logits = means @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        wrong = (p / p.sum(1, keepdims=True) - truth) * balance
        per_word = sums_by(((wrong @ softmax.T)[doc] * factor)[by_word], word_edges)
        slopes = [sums_by(per_word[part_word], bucket_edges) * idf, means.T @ wrong, wrong.sum(0)]
        for k, (x, g) in enumerate(zip(params, slopes, strict=True)):
            speeds[k] = MOMENTUM * speeds[k] + g
            x -= RATES[k] * speeds[k]
    scores, all_weights = np.zeros(BUCKETS, np.float32), weights.astype(np.float32)
    means = sums_by(sums_by((table * idf)[local], begin)[word] * factor, doc_edges)
    logits = means @ (softmax[:, 1] - softmax[:, 0]) + float(bias[1] - bias[0])
    scores[own] = SCALE * (table * idf) @ (softmax[:, 1] - softmax[:, 0])
    return scores, all_weights, float(bias[1] - bias[0]) + calibration(logits[aside], labels[aside], prior)


class WordScores(WordTable):
    """(summed score, summed weight) of each word's parts."""

    def __init__(self, scores: np.ndarray, weights: np.ndarray):
        self.both = np.stack([scores, weights], 1)
        super().__init__()

    def compute(self, words: list[bytes]) -> np.ndarray:
        buckets, begin = parts_of(words)
        return sums_by(self.both[buckets], begin)


def _score(batches: Iterator[pa.RecordBatch], scores: np.ndarray, weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    table = WordScores(scores, weights)
    for batch in groups(batches):
        words, starts = split_all(batch.column("text").to_pylist(), lower=True)
        number, rows = table.look_up(words)
        n = len(rows) + 1
        pair, count = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(starts)) * n + number, return_counts=True)
        total, weight = sums_by(rows[pair % n] * np.sqrt(count)[:, None], np.searchsorted(pair, np.arange(batch.num_rows + 1) * n)).T
        logit = total / (BLANK + weight) + bias
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], ["doc_id", "score"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: int = ROWS_PER_LABEL) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on about ``rows_per_label`` rows of each label at most, those with the lowest hashes of their id, and on SAMPLE_BYTES of text; the labels' shares are counted over all of ``labels``.

    A null id or label is left out; of an id with two labels the larger counts. Of an id with several texts all are taken, within the bound. Labels of one kind only, or none, give every text the share of label 1.
    """
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    dice = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))
    chance = F.when(F.col("label") == 1, rows_per_label / max(1, counts.get(1, 0))).otherwise(rows_per_label / max(1, counts.get(0, 0)))
    chosen = known.where(dice < chance * (1 << 20)).withColumn("dice", dice).orderBy("dice", "id").limit(3 * rows_per_label)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(chosen), "id").select("label", "dice", "text")
    sized = written(sample)
    size, rows = sized.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    share = min(1.0, SAMPLE_BYTES / max(1, size or 0), 3 * rows_per_label / max(1, rows))
    # Fewer rows rather than parts of texts.
    table = sized.where(F.pmod(F.xxhash64("text", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20)).orderBy("dice", "text").select("label", "text").toArrow()
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    labels_of, texts = table.column("label").to_numpy().astype(np.int64), table.column("text").to_pylist()
    del table
    return train(texts, labels_of, prior)


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``, over its whole text. A null or empty text has the score of the bias alone; equal texts have equal scores; null and repeated ids stay as they are; other columns play no part, whatever
    their names; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 x BUCKETS floats, whatever the input
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _score(batches, *shared.value), "doc_id long, score double")
