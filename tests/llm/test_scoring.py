"""Scores against plain computations: log-likelihood ratio, feature means, cosines; kept shares; article text of given pages."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import html_extract as H
from tessera.llm import language_id as L
from tessera.llm import quality_classifier as Q
from tessera.llm import quality_rules as R
from tests.llm.helpers import corpus, documents, words


def grams(text, buckets):
    w = [x.encode() for x in words(text)]
    one = [xxhash.xxh64_intdigest(x, 42) for x in w]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    pairs = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, w[1:])]
    return [signed(h) % buckets for h in one] + [signed(h) % buckets + buckets for h in pairs]


def brute_judge(docs, trusted, buckets, prior, quantile):
    fold = {i: zlib.crc32(str(i).encode()) % R.FOLDS for i, _ in docs}
    raw, good = Counter(), [Counter() for _ in range(R.FOLDS)]
    for i, t in docs:
        raw.update(grams(t, buckets))
        if i in trusted:
            good[fold[i]].update(grams(t, buckets))
    total, scores = sum(raw.values()), {}
    for i, t in docs:
        others = [g for f, g in enumerate(good) if f != fold[i]]
        held = sum(sum(g.values()) for g in others)
        logs = []
        for x in grams(t, buckets):
            share = raw[x] / total
            logs.append(math.log((sum(g[x] for g in others) + prior * held * share) / ((1 + prior) * held) / share) if held else 0.0)
        scores[i] = sum(logs) / len(logs) if logs else 0.0
    return scores


def test_log_likelihood_ratio(spark):
    texts = corpus(11, 150, 60)
    docs, trusted = list(enumerate(texts)), set(range(10, 90))
    got = R.judge(documents(spark, texts), spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets=256, prior=0.5, quantile=0.1).collect()
    want = brute_judge(docs, trusted, 256, 0.5, 0.1)
    assert all(abs(r.score - want[r.doc_id]) < 1e-8 for r in got)
    # The threshold is a thousandth that all but a tenth of the trusted reach.
    passed = sorted(math.floor(r.score * 1000) for r in got if r.doc_id in trusted and not r.base_failed)
    at = passed[int(0.1 * len(passed))] / 1000
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if not r.base_failed and r.score >= at}
    assert 0 < sum(r.kept for r in got) < len(got)


def test_threshold_ties_and_no_trusted(spark):
    df = documents(spark, [" ".join(f"w{j}" for j in range(30))] * 8)
    ids = df.select("doc_id").filter("doc_id < 6")
    assert all(r.kept for r in R.judge(df, ids).collect())
    assert all(r.kept and r.score == 0 for r in R.judge(df, ids.filter("doc_id > 99")).collect())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_texts_off_the_list_are_kept_as_those_on_it(spark, sf):
    base = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    good = labels.filter("quality = 1 and toxic = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("listed"))
    out = R.judge(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), good.filter("listed").select("doc_id"))
    share = {r.listed: r.kept for r in out.join(good, "doc_id").groupBy("listed").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert abs(share[True] - share[False]) < 0.05 and min(share.values()) > 0.9
    bad = out.join(labels.filter("quality = 0"), "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert bad < 0.2


def test_quality_score_is_the_mean_of_the_features(spark):
    rng = np.random.default_rng(0)
    model = Q.Model(rng.normal(size=1 << 12).astype(np.float32), 0.3)
    data = [(t or "").encode() for t in corpus(12, 60)]
    got = model.score(data)
    for t, s in zip(data, got):
        blocks = [b for _, b in Q.feature_blocks([t], 1 << 12)]
        w = words(t.decode())
        inner = [sum(max(0, len(x) + 2 - n + 1) for n in Q.GRAMS) for x in w]
        assert sum(map(len, blocks)) == 1 + len(w) + max(0, len(w) - 1) + sum(a == b for a, b in zip(w, w[1:])) + sum(inner)
        mean = np.mean(np.concatenate([model.weight[b].astype(np.float64) for b in blocks]))
        assert abs(s - 1 / (1 + math.exp(-(mean + 0.3)))) < 1e-6
    # Exactly at the threshold counts as label 1.
    flat = Q.Model(np.zeros(1 << 12, np.float32), math.log(0.7 / 0.3))
    exact = float(flat.score([b"a"])[0])
    df = documents(spark, ["a", "b c"])
    assert {r.quality_predicted for r in Q.score(df, flat, threshold=exact).collect()} == {1}
    assert {r.quality_predicted for r in Q.score(df, flat, threshold=math.nextafter(exact, 1)).collect()} == {0}


def test_language_is_that_of_the_nearest_centroid():
    rng = np.random.default_rng(1)
    idf = rng.uniform(1, 3, 512).astype(np.float32)
    centroids = np.abs(rng.normal(size=(4, 512))).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = L.Model(idf, centroids, ["a", "b", "b", "c"], np.full(4, 0.5))
    data = [(t or "").encode() for t in corpus(13, 60)]
    lang, score, rejected = model.predict(data)
    for t, got, s, out in zip(data, lang, score, rejected):
        if not any(c.isalpha() for c in t.decode()):
            assert (got, s, out) == ("und", 0, True)
            continue
        v = np.log1p(L.vectors([t], 512)[0][0].astype(np.float64)) * idf
        cosine = centroids @ (v / np.linalg.norm(v))
        assert got == model.langs[int(cosine.argmax())] and abs(s - cosine.max()) < 1e-5 and out == (1 - s > 0.5)
    # Of equal cosines the first centroid's language is taken.
    twin = L.Model(idf, centroids[[0, 0]], ["x", "y"], np.ones(2))
    assert twin.predict([b"some text"])[0] == ["x"]


def test_article_text_of_given_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    trees = H.train()
    got, right, some = H.extract_texts(pages, trees), 0, 0
    for source, text in zip(pages, got):
        page = H.Page(source)
        if "article" not in page.tag:
            continue
        inside = np.zeros(len(page.tag), dtype=bool)
        inside[page.tag.index("article")] = True
        for i in range(1, len(page.tag)):
            inside[i] |= inside[page.parent[i]]
        some += 1
        right += H.text_of(page, inside) == text
    assert some > 200 and right >= 0.99 * some


def test_html_keeps_inline_text_and_outlives_unclosed_tags():
    page = (
        "<html><body><article><h1>Title of it</h1><p>Some words with <math><mi>x</mi></math> in a long first paragraph, and more of them.</p><svg/>"
        "<p>Words after a drawing <button>that was never closed and go on, in a long second paragraph.</p></article></body></html>"
    )
    want = "Title of it\nSome words with x in a long first paragraph, and more of them.\nWords after a drawing that was never closed and go on, in a long second paragraph."
    assert H.extract_texts([page], H.train()) == [want]
