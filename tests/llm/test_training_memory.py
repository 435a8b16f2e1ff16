"""Quality classifier: training holds its features once."""

import random
import tracemalloc

import numpy as np

from tessera.llm import quality_classifier as qc


def test_features_are_held_once(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=3000)).encode() for _ in range(1500)]
    buckets, features = 1 << 16, 0
    for a in range(0, len(texts), 100):
        part = list(qc.feature_blocks(texts[a : a + 100], buckets))
        features += len(np.unique(np.concatenate([o.astype(np.int64) * buckets + f for o, f in part])))
    monkeypatch.setattr(qc, "MIN_SEEN", 1)
    tracemalloc.start()
    try:
        qc.train(texts, np.arange(len(texts)) % 2, buckets, epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Five bytes a feature, and room for what one chunk of texts and the vectors need.
    assert peak < 5 * features + 70_000_000 < 12 * features
