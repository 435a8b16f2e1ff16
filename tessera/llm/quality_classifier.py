"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its features: its words, word
pairs, a repeat mark for each word equal to the one before it, character 3- to
5-grams inside words (with their ends marked) and one end mark, each hashed
into a table of vectors.  A softmax layer turns the mean
into class probabilities; table and layer are trained together by stochastic
gradient descent in numpy on the driver.  With two classes a score only needs
one number per table entry, the entry's share of the logit, so scoring is a
look-up and a mean.

Training rows are a bounded sample of the labelled rows: at most `max_rows`, in
hash order, of texts of at most `max_chars` characters; both bounds are
parameters.  Scoring reads every whole text.

Cases: null text is empty text, which has the end mark as its one feature;
repeated rows get equal scores; a null doc_id counts as held in and keeps its
row; label rows without document, null labels and other columns are ignored; without
labelled rows of both classes every score is the share of label 1 (0.5 if
there are none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import give_back, quoted, small_batches
from tessera.llm.textops import chunks, encoded, mix, word_table

BUCKETS = 1 << 18
DIMENSIONS = 10
MAX_ROWS = 4_000
MAX_CHARS = 20_000
EPOCHS = 12
# Small samples are seen more often, until this many rows in all.
MIN_SEEN = 32_000
RATE = 0.5
THRESHOLD = 0.7
HELD_OUT = (4, 2)
GRAMS = (3, 4, 5)
_END, _REPEAT = 0, 1
_MUL = np.uint32(0x9E3779B1)
_G = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is the remainder; null is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with a space around each, and each text's first place, one more at the end."""
    parts = [t.decode() for t in texts]
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    joined = " " + " ".join(parts) + "  "
    return np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), at


def feature_blocks(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text of each feature, ascending; its bucket), one pair for each kind of feature."""
    mask = np.uint32(buckets - 1)
    yield np.arange(len(texts)), np.full(len(texts), _END, dtype=np.uint32)
    table = word_table(texts)
    h = table.hashes()
    owner = table.owner()
    yield owner, (h >> np.uint64(32)).astype(np.uint32) & mask
    if len(h) > 1:
        same = owner[1:] == owner[:-1]
        pair = mix(h[:-1] * _G + h[1:])
        yield owner[1:][same], (pair[same] >> np.uint64(32)).astype(np.uint32) & mask
        again = owner[1:][same & (h[1:] == h[:-1])]
        yield again, np.full(len(again), _REPEAT, dtype=np.uint32)
    cp, at = code_points(texts)
    white = (cp == 0x20) | ((cp >= 9) & (cp <= 13))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
    inner = ~white
    hashed = cp * _MUL + np.uint32(1)
    # A gram may begin or end with a white place, which marks a word's end, but has none inside.
    clear = np.ones(len(cp), dtype=bool)
    for n in range(2, GRAMS[-1] + 1):
        size = len(cp) - n + 1
        hashed = (hashed[:size] ^ (hashed[:size] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 : n - 1 + size] * _MUL
        if n > 2:
            clear = clear[:size] & inner[n - 2 : n - 2 + size]
        if n in GRAMS:
            where = np.flatnonzero(clear[: min(size, len(text))])
            x = hashed[where] + np.uint32(n)
            x ^= x >> np.uint32(16)
            x *= np.uint32(0xC2B2AE35)
            yield text[where], (x >> np.uint32(7)) & mask


@dataclass
class Model:
    """weight: each bucket's share of the logit of label 1; bias: the rest."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        total, number = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, bucket in feature_blocks(texts, len(self.weight)):
            total += np.bincount(owner, self.weight[bucket], len(texts))
            number += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / number + self.bias)))


def train(texts: list[bytes], labels: np.ndarray, buckets: int = BUCKETS, dims: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """Vectors and softmax layer by SGD over mini-batches, the rate falling to 0."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        edge = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(buckets, dtype=np.float32), float(np.log(edge / (1 - edge))))
    # Of each text its distinct buckets and how often it has them; nothing is joined into one array, which would be there twice.
    ids, times, whole = [], [], []
    for a, b in chunks(texts):
        blocks = list(feature_blocks(texts[a:b], buckets))
        one = np.concatenate([o.astype(np.int64) * buckets + f for o, f in blocks])
        del blocks
        one, n = np.unique(one, return_counts=True)
        doc = one // buckets
        cut = np.cumsum(np.bincount(doc, minlength=b - a))[:-1]
        whole += np.bincount(doc, n, b - a).tolist()
        ids += np.split((one % buckets).astype(np.int32), cut)
        times += np.split(n.astype(np.min_scalar_type(n.max())), cut)
    size, whole = np.array([len(x) for x in ids]), np.array(whole)
    epochs = max(epochs, -(-MIN_SEEN // len(texts)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
    layer, bias = np.zeros((dims, 2), dtype=np.float32), np.log(np.array([1 - share, share], dtype=np.float32))
    batch, steps, step = 16, epochs * -(-len(texts) // 16), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            docs = order[s : s + batch]
            owner = np.repeat(np.arange(len(docs)), size[docs])
            begin = np.concatenate([[0], np.cumsum(size[docs])[:-1]])
            f = np.concatenate([ids[d] for d in docs])
            w = (np.concatenate([times[d] for d in docs]) / whole[docs][owner]).astype(np.float32)[:, None]
            mean = np.add.reduceat(vectors[f] * w, begin, axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            back = p @ layer.T
            layer -= lr * mean.T @ p
            bias -= lr * 0.1 * p.sum(axis=0)
            # A frequency is small where a text is long, so vectors get a larger rate.
            np.subtract.at(vectors, f, (lr * 20) * w * back[owner])
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, text, quality): the bounded sample, without held-out rows."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), *HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    few = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows rows of two numbers.
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.length("text") <= max_chars).join(F.broadcast(few), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    rows = training_rows(docs, labels, max_rows, max_chars).toArrow()
    texts, marks = encoded(rows.column("text")), rows.column("quality").to_numpy().astype(np.int64)
    del rows
    model = train(texts, marks)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs with quality_score and quality_predicted added, or replaced where docs has them."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    new = {"quality_score": T.DoubleType(), "quality_predicted": T.IntegerType()}
    kept = [f for f in docs.schema if f.name.lower() not in new]
    # Own names inside, so that no column of docs can clash.
    inner = docs.select(*[quoted(f.name).alias(f"_c{i}") for i, f in enumerate(kept)])
    at = [f.name for f in kept].index("text")
    names = [*inner.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = encoded(batch.column(at))
            for a, b in chunks(data):
                s = held.value.score(data[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names)

    schema = T.StructType([*inner.schema.fields, *[T.StructField(n, t) for n, t in new.items()]])
    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(f.name) for i, f in enumerate(kept)], *new)
