"""Packing: exact round trip, mixture and edges; the pipeline against its parts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing as P
from tests.llm.helpers import corpus, documents
from tests.llm.test_text_joins import brute_components, brute_dedup


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


def test_ids_equal_the_tokenizer_library(reference_tokenizer):
    rng = np.random.default_rng(1)
    texts = corpus(9, 80) + ["<|endoftext|> x", "it's I'LL  \n\n a b　c", "\U0001f600‍", "١٢٣ ½ ²", "a" * 3000]
    texts += ["".join(chr(c) for c in rng.integers(1, 0x3000, 200)) for _ in range(40)]
    enc = P.encoder(P.default_tokenizer())
    for t in texts:
        assert enc.encode_to_numpy(t or "", allowed_special="all").tolist() == reference_tokenizer.encode(t or "", add_special_tokens=False).ids


def check(rows, docs, tokenizer, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.row_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    got = []
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert len(ids) == pieces[0].doc_tokens
        got.append((pieces[0].doc_id, ids))
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for s, pieces in by_sequence.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert sum(r.length for r in pieces) == window or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


@pytest.mark.parametrize("window", [16, 1024])
def test_packing_round_trip(spark, reference_tokenizer, window):
    texts = corpus(6, 150)
    rows = P.pack(documents(spark, texts), window=window).collect()
    check(rows, list(enumerate(texts)), reference_tokenizer, window)


def test_packing_mixture(spark, reference_tokenizer):
    rng = np.random.default_rng(2)
    rows = [(i, ["a", "a", "a", "b", "b", "c"][i % 6], " ".join(["tok"] * int(rng.integers(5, 120)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pieces = P.pack(df, window=256).collect()
    held = defaultdict(int)
    for r in pieces:
        held[r.source] += r.length
    total = sum(held.values())
    for upto in range(10, 150, 10):
        seen = defaultdict(int)
        for r in pieces:
            if r.sequence_id < upto:
                seen[r.source] += r.length
        for s in held:
            assert abs(seen[s] - upto * 256 * held[s] / total) < 500
    weighted = P.pack(df, window=256, weights={"a": 1, "b": 1, "c": 2}).collect()
    seen = defaultdict(int)
    for r in weighted:
        if r.sequence_id < 40:
            seen[r.source] += r.length
    assert abs(seen["c"] - 2 * seen["a"]) < 600 and abs(seen["a"] - seen["b"]) < 400
    assert sum(r.length for r in weighted) == total


def test_packing_edges(spark, reference_tokenizer):
    df = documents(spark, [None, "", "a b", "a b"], [None, 1, 2, 2])
    rows = P.pack(df).collect()
    check(rows, [(None, None), (1, ""), (2, "a b"), (2, "a b")], reference_tokenizer, 1024)
    assert P.pack(df.filter("n > 9")).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    texts = corpus(8, 120)
    df = documents(spark, texts)
    kept = C.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    want = {i for i, _, c in brute_components(list(enumerate(texts))) if i == c}
    assert {r.doc_id for r in kept.collect()} == want
    once = C.drop_near_copies(spark, df.unionByName(df), "")
    assert sorted(r.doc_id for r in once.collect()) == sorted(want)
    fewer = C.drop_repeats(spark, df, "")
    assert fewer.columns == df.columns
    expect = {i: t for i, n, gone, t in brute_dedup(list(enumerate(texts))) if n == 0 or gone < n}
    assert {r.doc_id: r.text for r in fewer.collect()} == expect
    mixed = C.mix_sources(spark, df, "")
    assert mixed.columns == df.columns
    assert [name for name, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "packing"]


def test_pipeline_runs_whole(spark):
    import corpus_pipeline as C

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    good = C.keep_quality(spark, docs, base)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    rows = C.run(spark, base)
    ids = {r.doc_id for r in good.collect()}
    pieces = rows.collect()
    assert pieces and {r.doc_id for r in pieces} <= ids
    per = defaultdict(int)
    for r in pieces:
        per[r.sequence_id] += r.length
    assert set(list(per.values())[:-1]) <= {1024, per[max(per)]}
    assert all(n == 1024 for s, n in per.items() if s != max(per))
