"""Language identification by blended-spectrum presence kernels, Nyström landmarks and ridge regression.

``k(s, t) = |G(s) & G(t)| / sqrt(|G(s)| |G(t)|)``, where ``G`` is the set of a text's
character n-grams of all lengths up to ``LONGEST``, hashed into a fixed number of
buckets. Landmark texts span the feature space (Nyström); one-versus-rest kernel
ridge regression is solved in it. The kernel against all landmarks and the solved
weights fold into one matrix of buckets by languages, so a batch of texts is scored
by one product of its presence matrix with that matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.samples import sample

LONGEST = 3
#: Texts in one presence matrix, and characters whose n-grams are hashed at once.
BATCH, CHAR_BLOCK = 64, 1 << 20
UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str, buckets: int, out: np.ndarray | None = None) -> np.ndarray:
    """Presence vector of the text's n-grams over the buckets; case and runs of spaces are levelled."""
    row = np.zeros(buckets, np.float32) if out is None else out
    code = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for low in range(0, len(code), CHAR_BLOCK):
        block = code[low : low + CHAR_BLOCK + LONGEST - 1].astype(np.uint64)
        rolled = np.zeros(len(block), np.uint64)
        for n in range(1, LONGEST + 1):
            m = len(block) - n + 1
            if m > 0:
                rolled[:m] = (rolled[:m] << np.uint64(21)) + block[n - 1 :] + np.uint64(1)
                row[((rolled[:m] * _MIX) >> np.uint64(40)) % np.uint64(buckets)] = 1
    return row


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """``weights``: buckets by languages."""

    languages: list[str]
    weights: np.ndarray

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` and 0 where there is no letter or no language is known.

        The score is the winner's regression value, clipped: about 1 on texts like
        the landmarks, near 0 on texts that share few n-grams with any.
        """
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for low in range(0, len(rows), BATCH):
            some = rows[low : low + BATCH]
            seen = np.zeros((len(some), len(self.weights)), np.float32)
            for k, i in enumerate(some):
                presence(texts[i], len(self.weights), seen[k])
            value = (seen @ self.weights) / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))
            best = value.argmax(axis=1)
            scores[some] = np.clip(value[np.arange(len(some)), best], 0, 1)
            for i, b in zip(some, best):
                names[i] = self.languages[b]
        return names, scores


def train(texts: list[str], langs: list[str], buckets: int = 1 << 15, landmarks: int = 200, ridge: float = 1e-3, seed: int = 42) -> LanguageModel:
    """Nyström kernel ridge regression on the driver; landmarks are spread evenly over the languages."""
    rows = [(t, g) for t, g in zip(texts, langs) if has_letter(t) and g is not None]
    names = sorted({g for _, g in rows})
    if not names:
        return LanguageModel([], np.zeros((buckets, 0), np.float32))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    rank = {g: 0 for g in names}
    turn = []
    for i in order:
        turn.append((rank[rows[i][1]], i))
        rank[rows[i][1]] += 1
    chosen = [i for _, i in sorted(turn)][:landmarks]
    mark = np.stack([presence(rows[i][0], buckets) for i in chosen])
    mark /= np.sqrt(mark.sum(axis=1, keepdims=True))
    value, vector = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    gram, right = np.zeros((keep.sum(), keep.sum())), np.zeros((keep.sum(), len(names)))
    total = {g: sum(x == g for _, x in rows) for g in names}
    for low in range(0, len(rows), BATCH):
        some = rows[low : low + BATCH]
        seen = np.stack([presence(t, buckets) for t, _ in some])
        seen /= np.sqrt(seen.sum(axis=1, keepdims=True))
        feature = (seen @ mark.T).astype(np.float64) @ root
        weight = np.array([1 / total[g] for _, g in some])[:, None] / len(names)
        gram += feature.T @ (feature * weight)
        right += feature.T @ (weight * np.array([[g == n for n in names] for _, g in some]))
    solved = root @ np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), right)
    return LanguageModel(names, (mark.T @ solved).astype(np.float32))


def training_rows(docs: DataFrame, per_language: int = 600, max_chars: int = 20_000, seed: int = 42) -> tuple[list[str], list[str]]:
    """A bounded sample of up to ``per_language`` different labelled texts of each language, drawn by a hash of text and label.

    Rows without text or language, and texts over ``max_chars``, teach nothing. A text
    that repeats counts once, under whatever ids; an empty table gives no rows.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(F.length("text") <= max_chars).select("lang", "text")
    got = sorted((r["lang"], r["text"]) for r in sample(known, "lang", F.lit(per_language), seed).collect())
    return [t for _, t in got], [g for g, _ in got]


def fit(docs: DataFrame, per_language: int = 600, **options) -> LanguageModel:
    """Train on ``training_rows``; ``docs`` has ``text`` and ``lang``, other columns are not read. An empty table gives a model that says ``und``."""
    return train(*training_rows(docs, per_language), **options)


def language_column(model: LanguageModel, text: Column) -> Column:
    """Struct of ``lang`` and ``score`` for each whole text; ``und`` and 0 for null texts and those without letters."""

    @F.arrow_udf("lang string, score double")
    def of(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for low in range(0, len(texts), 256):
            n, s = model.decide(texts.slice(low, 256).to_pylist())
            names += n
            scores.append(s)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([*scores, []]))], names=["lang", "score"])

    return of(text)
