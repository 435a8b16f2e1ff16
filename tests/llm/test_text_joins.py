"""Jaccard join and substring dedup against brute force."""

import hashlib

import pytest

from tessera.llm import jaccard_join
from tessera.llm.jaccard_join import link_components
from tessera.llm.substring_dedup import dedup, window_keys
from tessera.llm.textops import word_table
from tests.llm.helpers import corpus, documents, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x.translate(LOW) for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets}
    changed = True
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return sorted((i, len(s), low[i]) for i, s in sets)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    texts = corpus(seed, 160)
    got = link_components(documents(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(list(enumerate(texts)))


def test_jaccard_small_sets_and_hot_group(spark):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for size in range(5, 24):
        w = [f"v{size}x{i}" for i in range(size)]
        texts += [" ".join(w), " ".join(w + ["end"]), " ".join(w[1:]), " ".join(w[:-2])]
    texts += [" ".join(base[:i] + [f"n{i}"] + base[i + 1 :]) for i in range(60)] + [" ".join(base)] * 40
    texts += [" ".join(base[20:60] + [f"q{i}x{j}" for j in range(60)]) for i in range(30)]
    got = link_components(documents(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(list(enumerate(texts)))


def test_jaccard_heavy_signatures(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", 8)
    monkeypatch.setattr(jaccard_join, "HEAVY_SAMPLE", 2)
    monkeypatch.setattr(jaccard_join, "SIGNATURES_PER_GROUP", 500)
    texts = corpus(7, 120)
    base = [f"w{i}" for i in range(120)]
    texts += [" ".join(base[:i] + [f"n{i}"] + base[i + 1 :]) for i in range(100)] + [" ".join(base)] * 40
    got = link_components(documents(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(list(enumerate(texts)))


def test_jaccard_edges(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", None], [4, 4, None])
    assert sorted(map(tuple, link_components(df).collect()), key=repr) == [(4, 2, 4), (4, 2, 4), (None, 0, None)]
    assert link_components(df.filter("n > 9")).collect() == []


def brute_dedup(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        gone = set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if seen.setdefault(key, (i, p)) != (i, p):
                gone.update(range(p, p + 20))
        out[i] = (i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed):
    texts = corpus(seed, 160, 60)
    df = documents(spark, texts)
    want = brute_dedup(list(enumerate(texts)))
    assert sorted(map(tuple, dedup(df).collect())) == want
    got = dedup(df, ["extra"], digest=True).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in want]


def test_substring_dedup_edges(spark):
    w = " ".join(f"w{i}" for i in range(30))
    df = documents(spark, [w, w, w, None], [5, 5, None, 2])
    got = sorted(map(tuple, dedup(df).collect()), key=repr)
    assert got == sorted([(5, 30, 0, w), (5, 30, 0, w), (None, 30, 30, ""), (2, 0, 0, "")], key=repr)
    assert dedup(df.filter("n > 9")).collect() == []


def test_equal_windows_have_equal_keys():
    for seed in range(4):
        data = [(t or "").encode() for t in corpus(seed, 60, 30)]
        table = word_table(data)
        starts, keys, _ = window_keys(table.hashes(), table.first)
        w = [table.buf[a:b].tobytes() for a, b in zip(table.start, table.end)]
        by: dict = {}
        for s, k in zip(starts.tolist(), keys.tolist()):
            assert by.setdefault(tuple(w[s : s + 20]), k) == k
