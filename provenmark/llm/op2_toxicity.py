"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character 3- to 5-grams (with edge marks, hashed to buckets) and of its own bucket; a
passage of five words is the mean of its words; a linear softmax gives two logits. Embeddings and softmax are trained together by
Adam on passages, each with its text's label: passages without a telling word cancel out between the labels. A text is scored by
the same passages: the difference of the two logits of each is what the softmax sees, and the highest of a text, scaled and shifted
by two numbers fitted on the sample's texts, is its score; so one passage decides in a text of any length. A misspelt word shares
most n-grams with the word it stands for.

Training uses a bounded sample of labelled rows on the driver: at most `sample` rows of each label, with texts of at most
`sample_bytes` bytes, chosen by a hash of the doc_id, so reruns agree. Because everything after the embedding is linear, the
model that is broadcast is one float for each bucket. Words of fewer than RARE of the sample's texts are left out of training,
since they only name their text; in scoring each counts by its n-grams. Scoring covers every row and whole texts, without a shuffle.

Defined cases: null and empty texts, and texts of spaces, score 0; a null doc_id is not held out and never learned from; without
labels of both kinds every score is 0; a doc_id that is labelled both ways counts as toxic; repeated rows score alike; only doc_id
and text are read of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import LOWER, Words, blocks, buffers, hash_spans, mix, split

BUCKETS, WIDTH, PASSAGE = 1 << 17, 8, 5
SAMPLE, SAMPLE_BYTES = 1500, 20_000
ROUNDS, RARE, RATE, DECAY, FLOOR = 60, 3, 0.05, 1e-5, 1e-5
THRESHOLD = 0.7
_SALT = np.array([0x9E3779B97F4A7C15], np.uint64)


def features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, and where each word's begin."""
    marked = np.full(int((lengths + 2).sum()) + 8, 0, np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths + 2)])
    marked[at[:-1]], marked[at[1:] - 1] = ord("<"), ord(">")
    inner = np.repeat(at[:-1] + 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
    marked[inner] = data[np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))]
    view = np.ndarray((len(marked) - 7,), "<u8", marked, 0, (1,))
    owners, buckets = [np.arange(len(starts))], [hash_spans(data, starts, lengths) % np.uint64(BUCKETS)]
    for n in (3, 4, 5):
        count = np.maximum(lengths + 2 - n + 1, 0)
        owner = np.repeat(np.arange(len(starts)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[owner]
        owners.append(owner)
        buckets.append(mix((view[place] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n) * _SALT) % np.uint64(BUCKETS))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(starts) + 1))


def _frequent(words: Words, least: int) -> Words:
    """Words that occur in at least so many of the texts."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    _, code = np.unique(words.hashes, return_inverse=True)
    pairs = np.unique(code.astype(np.int64) * len(words.first) + text)
    kept = np.flatnonzero(np.bincount(pairs // len(words.first))[code] >= least) if len(code) else code
    return Words(np.searchsorted(kept, words.first), words.starts[kept], words.lengths[kept], words.hashes[kept])


class Bags:
    """Texts as passages of distinct words."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, least: int = 1):
        words = split(offsets, data, lower=True)
        if least > 1:
            words = _frequent(words, least)
        counts = np.diff(words.first)
        _, index, self.word = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.buckets, self.at = features(LOWER[data], words.starts[index], words.lengths[index])
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(text)) - words.first[:-1][text]
        opens = place % PASSAGE == 0
        self.passage = np.flatnonzero(opens)  # first word of each passage
        self.sizes = np.diff(np.append(self.passage, len(text)))
        self.text = text[self.passage]  # ascending
        self.n = len(counts)
        self.full = np.unique(self.text)  # texts with words

    def word_means(self, values: np.ndarray) -> np.ndarray:
        """Mean of the values of each distinct word's buckets."""
        count = np.diff(self.at)
        return np.add.reduceat(values[self.buckets], self.at[:-1], axis=0) / count[:, None]

    def passages(self, means: np.ndarray) -> np.ndarray:
        return np.add.reduceat(means[self.word], self.passage, axis=0) / self.sizes[:, None]

    def peaks(self, model: np.ndarray) -> np.ndarray:
        """The highest passage logit of each text with words."""
        logits = self.passages(self.word_means(model[:, None].astype(float)))[:, 0]
        return np.maximum.reduceat(logits, np.searchsorted(self.text, self.full))


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 7, rare: int = RARE) -> tuple[np.ndarray, float, float]:
    """One float a bucket and a bias, for pooled logits; zeros and -inf if a label is missing."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0, float("-inf")
    bags = Bags(*buffers(pa.array(texts, pa.large_string())), rare)
    y = labels[bags.text].astype(int)
    each = 0.5 / np.maximum(1, np.bincount(y, minlength=2))[y]
    drawn = np.random.default_rng(seed)
    embed, soft, bias = drawn.normal(0, 0.1, (BUCKETS, WIDTH)), drawn.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
    state = [(np.zeros(p.shape), np.zeros(p.shape)) for p in (embed, soft, bias)]
    count = np.diff(bags.at)
    in_passage = np.repeat(np.arange(len(bags.passage)), bags.sizes)
    owner = np.repeat(np.arange(len(count)), count)
    for step in range(1, rounds + 1):
        hidden = bags.passages(bags.word_means(embed))
        logits = hidden @ soft + bias
        d = np.exp(logits - logits.max(1, keepdims=True))
        d = d / d.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= each[:, None]
        d_hidden = (d @ soft.T) / bags.sizes[:, None]
        d_word = np.stack([np.bincount(bags.word, d_hidden[in_passage, k], len(count)) for k in range(WIDTH)], 1) / count[:, None]
        d_embed = np.stack([np.bincount(bags.buckets, d_word[owner, k], BUCKETS) for k in range(WIDTH)], 1)
        for p, g, (m, v) in zip((embed, soft, bias), (d_embed + DECAY * embed, hidden.T @ d + DECAY * soft, d.sum(0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + FLOOR)
    model = (embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    # scale and shift of the pooled logit, by Newton steps of a one-variable logistic regression on the sample's texts
    whole = Bags(*buffers(pa.array(texts, pa.large_string())))
    x = whole.peaks(model)
    scale, shift, t = 0.0, 0.0, labels[whole.full].astype(float)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        w, r = q * (1 - q) + 1e-3, q - t
        hess = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        scale, shift = np.array([scale, shift]) - np.linalg.solve(hess, [(r * x).sum() + 1e-3 * scale, r.sum()])
    return model, float(scale), float(shift)


def score_batch(model: tuple[np.ndarray, float, float], offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for a, b in blocks(offsets, 4_000_000):
        bags = Bags(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        if len(bags.full) and np.isfinite(model[2]):
            pooled = bags.peaks(model[0])
            out[a + bags.full] = 1 / (1 + np.exp(-np.clip(model[1] * pooled + model[2], -30, 30)))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float, float]:
    """A model from rows whose crc32(doc_id) mod 3 is not 1."""
    marked = labels.where("toxic IN (0, 1) AND crc32(cast(doc_id AS string)) % 3 != 1").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    fit = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= sample_bytes)
    marked = marked.join(fit.select("doc_id"), "doc_id", "left_semi")  # ids alone
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("__toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = fit.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * sample).collect()  # both sides bounded by the sample
    return train([r.text for r in rows], np.array([r["__toxic"] for r in rows]))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the data

    def scored(batches):
        for batch in batches:
            score = score_batch(sent.value, *buffers(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
