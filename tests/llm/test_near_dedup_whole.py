"""Near-dedup finds all there is: across shards and across clusters."""

import numpy as np

from tessera.llm import near_dedup as N


def islands(groups=30, size=240, dim=256, noise=0.0125, seed=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    v = np.repeat(centre / np.linalg.norm(centre, axis=1, keepdims=True), size, axis=0) + rng.normal(size=(groups * size, dim)) * noise
    v = v[rng.permutation(len(v))]
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_vectors_of_another_shard_reach_every_island():
    v = islands()
    stored, away = v[:3600], v[3600:4000]
    graph = N._padded(N.build(stored))
    rng = np.random.default_rng(1)
    entries = N._entries(stored, graph, rng)
    label = N.parts(graph)
    assert set(label[entries]) == set(label) and len(set(label)) > 1
    truth = away @ stored.T >= 0.95
    at = np.full(len(away), -1)
    assert (N.search(away, at, stored, graph, entries, N.BEAM, 0.95) & truth).sum() < 0.5 * truth.sum()
    beam, links, found = N.choose_beam(stored, graph, entries, away[:64], 0.95, rng)
    assert found >= N.RECALL * links > 0
    got = N.search(away, at, stored, graph, entries, beam, 0.95) if beam else truth
    assert (got & truth).sum() >= 0.995 * truth.sum()


def test_shard_is_scanned_when_no_beam_is_wide_enough():
    v = islands()
    v, away = v[:3600], v[3600:4000]
    graph = N._padded(N.build(v))
    # One entry: vectors of other islands are not found.
    rng = np.random.default_rng(1)
    beam, links, found = N.choose_beam(v, graph, np.array([0]), away, 0.95, rng)
    assert beam == 0 and found == links > 0


def test_links_between_shards(spark, monkeypatch):
    monkeypatch.setattr(N, "CLUSTER", 10_000)
    monkeypatch.setattr(N, "SHARD", 2000)
    rows = [list(map(float, x)) for x in islands(size=120)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    out = N.near_links(df)[0].collect()
    m = np.array(rows)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (m @ m.T >= 0.95).sum(axis=1) - 1
    got = np.zeros(len(rows), dtype=np.int64)
    for r in out:
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.995 * want.sum() > 0


def spread(n=2400, dim=5, seed=6):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T
    return v, (sim >= 0.95).sum(axis=1) - 1


def found_of(spark, v):
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out, recall = N.near_links(df)
    got = np.zeros(len(v), dtype=np.int64)
    for r in out.collect():
        got[r.vec_id] = r.n_links
    return got, recall


def test_links_between_clusters(spark, monkeypatch):
    monkeypatch.setattr(N, "CLUSTER", 40)
    v, want = spread()
    got, recall = found_of(spark, v)
    assert (got <= want).all() and got.sum() >= 0.995 * want.sum() > 1000 and recall >= N.RECALL


def test_all_are_compared_when_recall_stays_low(spark, monkeypatch):
    monkeypatch.setattr(N, "CLUSTER", 40)
    monkeypatch.setattr(N, "SCAN", 700)
    # A search that loses its links must not be accepted.
    monkeypatch.setattr(N, "_searched", lambda placed, held, threshold: placed.select("cid", *[N.F.lit(0).cast("long").alias(c) for c in ("links", "root", "audited", "recalled")]))
    v, want = spread()
    got, recall = found_of(spark, v)
    assert (got == want).all() and recall == 1.0
