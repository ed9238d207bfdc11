"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of its
whole form, all hashed into one table; a text's vector is the mean of its words'
vectors; a linear softmax over two classes reads it. Table and softmax are trained
jointly in numpy. An unseen misspelling shares most n-grams with a known word and
so its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.samples import sample
from quillmesh.plans.lineage import broadcast_if, cut

#: Punctuation that may stand around a word.
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_"
LONGEST, SHORTEST = 5, 3
#: Words whose scores a worker remembers before it starts afresh.
CACHE_WORDS = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [t for t in (w.strip(EDGES) for w in (text or "").lower().split()) if t]


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word index, bucket)`` of every n-gram of ``<word>`` and of each whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(length)
    owner = np.repeat(np.arange(len(words)), length)
    room = np.repeat(end, length) - np.arange(len(code))
    whole = np.fromiter((hash_word(w) for w in words), np.uint64, len(words))
    at, what = [np.arange(len(words))], [whole]
    rolled = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        m = max(len(code) - n + 1, 0)
        rolled[:m] = rolled[:m] * _STEP + code[len(code) - m :] + np.uint64(1)
        if n >= SHORTEST:
            fits = np.flatnonzero(room >= n)
            at.append(owner[fits])
            what.append(rolled[fits] + np.uint64(n))
    mixed = np.concatenate(what) * _MIX
    return np.concatenate(at), ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def hash_word(word: str) -> int:
    out = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        out = ((out ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return out


def word_scores(words: list[str], weight: np.ndarray) -> np.ndarray:
    """Mean over each word's subwords of their projected weights."""
    at, bucket = subwords(words, len(weight))
    return np.bincount(at, weight[bucket], len(words)) / np.maximum(np.bincount(at, minlength=len(words)), 1)


@dataclass
class ToxicityModel:
    """The table and softmax, folded into one log-odds weight a bucket, and a bias.

    ``weight[b]`` is the bucket's vector times the difference of the two classes'
    softmax vectors: averaging commutes with that product, so scores are unchanged.
    """

    weight: np.ndarray
    bias: float
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias, "cache": {}}

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Probability of the toxic class; texts without words get that of an empty bag."""
        bags = [tokens(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list({w for bag in bags for w in bag if w not in self.cache})
        for low in range(0, len(new), 1 << 15):
            block = new[low : low + (1 << 15)]
            self.cache.update(zip(block, word_scores(block, self.weight).tolist()))
        get = self.cache.__getitem__
        logit = np.array([sum(map(get, bag)) / len(bag) if bag else 0.0 for bag in bags]) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(texts: list[str], labels: np.ndarray, buckets: int = 1 << 18, dim: int = 8, steps: int = 100, rate: float = 0.1, sharpness: float = 100.0, seed: int = 42) -> ToxicityModel:
    """Joint full-batch training of n-gram vectors and softmax by Adam on the log loss.

    ``sharpness`` multiplies the averages before the softmax: one toxic word among
    hundreds moves an average by a hundredth. A text's log-odds are linear in its
    words' and a word's in its n-grams', so the gradient of every vector is one
    number times the softmax difference and a step costs four sparse sums. Without
    both classes the model answers the labels' base rate, 0.01 to 0.99 (0.01 without labels, as nothing speaks against any text).
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        rate_of = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
        return ToxicityModel(np.zeros(buckets, np.float32), float(np.log(rate_of / (1 - rate_of))))
    index: dict[str, int] = {}
    docs, words, shares = [], [], []
    for i, text in enumerate(texts):
        bag = np.array([index.setdefault(w, len(index)) for w in tokens(text)], np.int32)
        kinds, count = np.unique(bag, return_counts=True)
        docs.append(np.full(len(kinds), i, np.int32))
        words.append(kinds)
        shares.append((sharpness * count / max(len(bag), 1)).astype(np.float32))
    doc, word, share = np.concatenate(docs), np.concatenate(words), np.concatenate(shares)
    del docs, words, shares
    owners, grams, names = [], [], list(index)
    for low in range(0, len(names), 1 << 14):
        at, bucket = subwords(names[low : low + (1 << 14)], buckets)
        owners.append((at + low).astype(np.int32))
        grams.append(bucket.astype(np.int32))
    owner, bucket = np.concatenate([*owners, np.zeros(0, np.int32)]), np.concatenate([*grams, np.zeros(0, np.int32)])
    del owners, grams, names
    part = (1 / np.maximum(np.bincount(owner, minlength=len(index)), 1)).astype(np.float32)
    seen = np.bincount(bucket, minlength=buckets) > 0
    used, bucket = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)[bucket]

    def total(where: np.ndarray, what: Callable[[slice], np.ndarray], size: int, block: int = 1 << 20) -> np.ndarray:
        """Sums of ``what(places)`` by ``where``, a block of places at a time."""
        out = np.zeros(size)
        for low in range(0, len(where), block):
            out += np.bincount(where[low : low + block], what(slice(low, low + block)), size)
        return out

    rng = np.random.default_rng(seed)
    table, out, bias = rng.normal(0, 0.1, (len(used), dim)), rng.normal(0, 0.1, dim), 0.0
    m, v = [np.zeros_like(table), np.zeros_like(out), 0.0], [np.zeros_like(table), np.zeros_like(out), 0.0]
    for t in range(1, steps + 1):
        u = table @ out
        s = part * total(owner, lambda k: u[bucket[k]], len(index))
        z = total(doc, lambda k: share[k] * s[word[k]], len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        r = part * total(word, lambda k: share[k] * g[doc[k]], len(index))
        q = total(bucket, lambda k: r[owner[k]], len(used))
        grads = [np.outer(q, out), q @ table, g.sum()]
        news = []
        for i, (x, dx) in enumerate(zip((table, out, bias), grads)):
            m[i] = 0.9 * m[i] + 0.1 * dx
            v[i] = 0.999 * v[i] + 0.001 * dx * dx
            news.append(x - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-4))
        table, out, bias = news
    weight = np.zeros(buckets, np.float32)
    weight[used] = sharpness * (table @ out)
    return ToxicityModel(weight, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 4500, max_chars: int = 20_000, seed: int = 42, max_broadcast_rows: int = 100_000) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled texts: up to ``max_toxic`` and ``max_clean`` of them.

    Ids are drawn by a hash, so reruns agree; texts over ``max_chars`` are scored but
    not learned from. Conflicting labels of an id count as toxic, repeated ones once;
    null labels and ids are ignored; of the texts of a repeated id the first by code
    point teaches. Empty tables give no rows.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    some = cut(sample(known, "toxic", F.when(F.col("toxic"), F.lit(max_toxic)).otherwise(F.lit(max_clean)), seed))
    few = broadcast_if(some.withColumnRenamed("doc_id", "__id"), max_toxic + max_clean, max_broadcast_rows)
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(few, F.col("doc_id") == F.col("__id"))
    got = sorted((r["doc_id"], r["text"], int(r["toxic"])) for r in rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    return [t for _, t, _ in got], np.array([y for _, _, y in got])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 4500, **options) -> ToxicityModel:
    """Train on the driver from ``training_rows``."""
    return train(*training_rows(docs, labels, max_toxic, max_clean), **options)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Toxicity of each whole text, 0 to 1. Null, empty and blank texts get the score of an empty bag."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for low in range(0, len(texts), 256):
            block = texts.slice(low, 256).to_pylist()
            out[low : low + len(block)] = model.scores(block)
        return pa.array(out)

    return of(text)
