"""Quality classifier, language ID, HTML extraction, near-dedup."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract as H
from tessera.llm import language_id as L
from tessera.llm import near_dedup as N
from tessera.llm import queries
from tessera.llm import quality_classifier as Q
from tests.llm.helpers import documents

DATA = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    out = queries.QUERIES["op1_quality_classifier"](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)


def test_quality_is_a_function_of_the_text(spark):
    good, bad = ["the cat sat on the mat and looked"] * 30, ["### $$$ | | |"] * 30
    model = Q.train([t.encode() for t in good + bad], np.array([1] * 30 + [0] * 30))
    again = Q.train([t.encode() for t in good + bad], np.array([1] * 30 + [0] * 30))
    assert np.array_equal(model.weight, again.weight)
    df = documents(spark, ["the cat sat", "### | $$$", None, "", "the cat sat", "x " * 100_000], [1, 2, None, 4, 1, 6]).withColumn("score", F.lit(1))
    out = Q.score(df, model)
    assert out.columns == [*df.columns, "quality_score", "quality_predicted"]
    got = sorted((r.doc_id or 0, r.text or "", round(r.quality_score, 9)) for r in out.collect())
    assert len(got) == 6 and got[0][2] == got[4][2] and got[1][2] == got[2][2] > 0.7 > got[3][2]
    assert Q.score(df.filter("n > 9"), model).collect() == []
    one = model.score([("the cat sat on the mat and looked " * 1000).encode()])[0]
    assert one > 0.7


def test_quality_without_both_classes(spark):
    df = documents(spark, ["a", "b", "c", "d", "e", "f"])
    labels = spark.createDataFrame([(i, 1) for i in range(6)] + [(None, 0), (9, 0), (1, None)], "doc_id long, quality int")
    assert all(r.quality_score > 0.9 for r in Q.score(df, Q.fit(df, labels)).collect())
    assert [r.quality_score for r in Q.score(df, Q.fit(df, labels.filter("doc_id > 99"))).collect()] == [0.5] * 6


def test_language_held_out_accuracy(spark):
    langs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op8_language_id"](spark, DATA).join(langs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    model = L.train([b"the cat and the dog", b"el gato y el perro"] * 5, ["en", "es"] * 5)
    df = documents(spark, ["the dog", None, "", "12 34 $$", "el perro " * 50_000, "the dog", "ΩΩ ЖЖ"])
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(7)][:6] == ["en", "und", "und", "und", "es", "en"]
    assert got[1].score == 0 and got[0].score == got[5].score and got[6].lang_pred in ("en", "es") and got[6].rejected
    assert L.identify(df.filter("n > 9"), model).collect() == []
    empty = L.fit(df.filter("n > 9"))
    assert {r.lang_pred for r in L.identify(df, empty).collect()} == {"und"}


PAGES = {
    "plain": (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
        "<article><h1>Big &amp; news</h1><p>First <b>para</b>\n graph with words, and more words to read here.<p>Second para &#233; has a &lt;tag&gt; and goes on for a while too.</article>"
        '<div class="comments"><div class="comment"><p>I like it</p></div></div><footer>&copy; us</footer><script>var x="</p>";</script></body></html>',
        "Big & news\nFirst para graph with words, and more words to read here.\nSecond para é has a <tag> and goes on for a while too.",
    ),
    "advert": (
        '<body><div class="ad">Buy now, cheap things for all of you</div><article><p>' + "Long text of the article, again. " * 6 + '</p><div class="ad">Buy more of it</div><p>' + "The end of it is here, at last. " * 4 + "</p></article></body>",
        ("Long text of the article, again. " * 6).strip() + "\n" + ("The end of it is here, at last. " * 4).strip(),
    ),
}


@pytest.fixture(scope="module")
def trees():
    return H.train()


@pytest.mark.parametrize("name", PAGES)
def test_html_pages(trees, name):
    source, want = PAGES[name]
    assert H.extract_texts([source], trees) == [want]


def test_html_generated_pages(trees):
    rng, kept, lost, wrong = random.Random(4711), 0, 0, 0
    for _ in range(150):
        page = H.Page(H.generated_page(rng))
        x, _ = H.features(page)
        inside = H.decode(page, np.where(x[:, 0] > 0, trees.log_odds(x), 0.0))
        for e, _, _, s in page.pieces:
            size = len(s.split())
            kept += size * (inside[e] and H.MARK in s)
            lost += size * (not inside[e] and H.MARK in s)
            wrong += size * (inside[e] and H.MARK not in s)
    assert kept / (kept + lost) > 0.95 and kept / (kept + wrong) > 0.95


def test_html_decoding_is_consistent():
    rng = np.random.default_rng(0)
    for seed in range(30):
        page = H.Page(H.generated_page(random.Random(seed)))
        odds = rng.normal(0, 2, len(page.tag))
        inside = H.decode(page, odds)
        for i in range(1, len(page.tag)):
            up, path = page.parent[i], [inside[i]]
            while up >= 0:
                path.append(inside[up])
                up = page.parent[up]
            # From the root: outside, inside, pruned; so inside is one stretch.
            changes = sum(a != b for a, b in zip(path, path[1:]))
            assert changes <= 2 and (changes < 2 or not path[0])


def test_html_edges(spark, trees):
    broken = ["", None, "no markup at all", "<p", "<div><p>a<div></p></b>", "<a \"'" * 2000, "<script>x", "<!-- x", "&#0; &bogus; " * 10, "<ul>" * 3000 + "deep"]
    df = spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(broken)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    rows = H.extract(df, trees).collect()
    assert len(rows) == len(broken) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert H.extract(df.filter("page_id > 99"), trees).collect() == []


def brute_links(vectors):
    good = {}
    for i, v in vectors:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float64)
            good[i] = a / np.linalg.norm(a)
    link = {i: {j for j, b in good.items() if j != i and a @ b >= 0.95} for i, a in good.items()}
    out = {}
    for i, _ in vectors:
        todo, reach = [i], {i}
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        out[i] = (len(link.get(i, ())), min(reach), min(reach) == i)
    return out


def test_near_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [list(map(float, v)) for v in base]
    for k in range(300):
        rows.append(list(map(float, base[k % 7] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3]))))
    rows += [rows[3]] * 40 + [[2 * x for x in rows[3]], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, n_links int")
    out, recall = N.near_links(df)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert recall >= 0.99 and got == brute_links(list(enumerate(rows)))
    none, _ = N.near_links(df.filter("label > 0"))
    assert none.collect() == []


def test_near_dedup_many_shards(spark, monkeypatch):
    monkeypatch.setattr(N, "CLUSTER", 150)
    monkeypatch.setattr(N, "SHARD", 120)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 32))
    rows = [list(map(float, rng.normal(size=32))) for _ in range(700)]
    rows += [list(map(float, centre[k % 12] + rng.normal(size=32) * 0.08)) for k in range(500)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_links(df)[0].collect()}
    want = brute_links(list(enumerate(rows)))
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values()) > 1000
    assert all(got[i][0] <= want[i][0] for i in got)
    assert np.mean([got[i][1] == want[i][1] for i in got]) > 0.99


def test_robust_prune_keeps_nearest_and_drops_shadowed():
    v = np.array([[1, 0], [0.99, 0.141], [0.98, 0.199], [0, 1]], dtype=np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = N.prune(v, np.array([0]), np.array([[1, 2, 3, 0, 1]]), degree=3)
    assert out[0].tolist() == [1, 3, -1]
