"""Language identification by nearest centroid.

A text's letters, lower-cased, with anything else as a space, give hashed
character 1- to 3-grams; their TF-IDF vector (logarithmic counts) is scaled to
length 1.  Each language has several centroids, found by k-means under cosine
among its own training vectors; the language of the nearest centroid is the
prediction and the cosine its score.  A text farther from that centroid than
nearly all training texts of it (its radius) is marked as rejected.

Centroids are fitted on at most `max_rows` labelled texts of at most
`max_chars` characters, in hash order; both bounds are parameters.  Every whole
text is classified.

Cases: text that is null or has no letter is "und" with score 0; rows without
language are not learned from; repeated rows get equal results; a null doc_id
counts as held in; without training rows all texts are "und"; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality_classifier import code_points, held_out
from tessera.llm.storage import small_batches
from tessera.llm.textops import chunks

BUCKETS = 4096
CENTROIDS = 3
MAX_ROWS = 3_000
MAX_CHARS = 20_000
HELD_OUT = (3, 1)
RADIUS_QUANTILE = 0.999
CHUNK_BYTES, CHUNK_TEXTS = 1_000_000, 512
_SPACE = 0x20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def vectors(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed grams by text as float32, whether the text has a letter)."""
    cp, at = code_points([t.decode().lower().encode() for t in texts])
    letter = _letters()[cp]
    cp = np.where(letter, cp, np.uint32(_SPACE))
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    n = len(text)
    # Each text owns the space before it; no gram reaches past the space after it.
    here, letter = cp[:n], letter[:n]
    out = np.zeros(len(texts) * buckets, dtype=np.float32)
    hashed = here * np.uint32(0x9E3779B1)
    use = letter
    for size in (1, 2, 3):
        if size > 1:
            nxt = np.append(here[size - 1 :], np.full(size - 1, _SPACE, dtype=np.uint32))
            hashed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(0x85EBCA6B) + nxt * np.uint32(0x9E3779B1)
            use = use | np.append(letter[size - 1 :], np.zeros(size - 1, dtype=bool)) if size == 2 else use & np.append(letter[1:], [False])
        x = hashed + np.uint32(size)
        x = ((x ^ (x >> np.uint32(16))) * np.uint32(0xC2B2AE35)) >> np.uint32(8)
        index = (text * buckets + (x % np.uint32(buckets)))[use]
        out += np.bincount(index, minlength=len(out)).astype(np.float32)
    any_letter = np.bincount(text[letter], minlength=len(texts)) > 0
    return out.reshape(len(texts), buckets), any_letter


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _k_means(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centre = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ centre.T).argmax(axis=1)
        new = np.stack([v[near == i].mean(axis=0) if (near == i).any() else centre[i] for i in range(len(centre))])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.allclose(new, centre, atol=1e-6):
            break
        centre = new
    return centre


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected)."""
        counts, letter = vectors(texts, len(self.idf))
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        scaled = _scaled(counts, self.idf)
        best = (scaled @ self.centroids.T).argmax(axis=1)
        # Summed row by row, so that equal texts score alike in any batch.
        top = np.clip((scaled * self.centroids[best]).sum(axis=1, dtype=np.float64), 0, 1)
        rejected = ~letter | (1 - top > self.radius[best])
        return [self.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist())], np.where(letter, top, 0.0), rejected


def train(texts: list[bytes], langs: list[str], buckets: int = BUCKETS, k: int = CENTROIDS, seed: int = 3) -> Model:
    parts = [vectors(texts[a:b], buckets) for a, b in chunks(texts, CHUNK_BYTES, CHUNK_TEXTS)]
    if not parts:
        return Model(np.ones(buckets, dtype=np.float32), np.zeros((0, buckets), dtype=np.float32), [], np.zeros(0))
    counts, letter = np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])
    counts, names = counts[letter], np.array(langs, dtype=object)[letter]
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    v = _scaled(counts, idf)
    rng = np.random.default_rng(seed)
    centres, owner = [], []
    for lang in sorted(set(names)):
        c = _k_means(v[names == lang], k, rng)
        centres.append(c)
        owner += [lang] * len(c)
    centroids = np.concatenate(centres) if centres else np.zeros((0, buckets), dtype=np.float32)
    radius = np.ones(len(centroids))
    cosine = v @ centroids.T
    near = cosine.argmax(axis=1) if len(centroids) else np.zeros(0, dtype=int)
    for i in range(len(centroids)):
        own = cosine[near == i, i]
        if len(own):
            radius[i] = 1 - np.quantile(own, 1 - RADIUS_QUANTILE)
    return Model(idf, centroids, owner, radius)


def training_rows(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, text, lang): the bounded sample, without held-out rows."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), *HELD_OUT) & (F.length("text") <= max_chars))
    # At most max_rows ids.
    few = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    rows = training_rows(docs, max_rows, max_chars).toArrow()
    return train([t.encode() for t in rows.column("text").to_pylist()], rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row a document.  docs: doc_id, text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b"" if t is None else t for t in batch.column("text").cast("binary").to_pylist()]
            for a, b in chunks(data, CHUNK_BYTES, CHUNK_TEXTS):
                lang, cosine, rejected = held.value.predict(data[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(lang, pa.string()), pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
