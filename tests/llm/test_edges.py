"""Every operator and stage with clashing and odd column names, nulls, empty and very long texts, ties, repeated rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tessera.llm import chat_format, html_extract, jaccard_join, language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup
from tessera.llm.storage import checkpoint_dir
from tests.llm.helpers import words

BASE = "/root/testdata/sf0.001"
# Private and output names of all operators, a dotted one, and one with a space.
NAMES = """_copy _c0 _c1 a.b size n ids kept row_id taken quality_score quality_predicted score component_id n_shingles cls slice lists bits rid n_words
n_removed shard place block target source_size source_key stop ids_crc32 sequence_id offset length start gram weight w fold text_ crc round queue node comp sig _word _t _row _n _total x
""".split() + ["two words"]
LONG = " ".join(f"w{i * 7919 % 150_001}" for i in range(150_000))
TEXTS = [(1, "the cat sat on the mat and looked at the dog that sat there"), (1, "the cat sat on the mat and looked at the dog that sat there"), (2, None), (None, "no name here at all"), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG + " end"), (7, "x" * 1_000_000)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, ["en", None][k % 2], ["s", None][k % 3 == 0], len(t or "")) for k, (i, t) in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES]).repartition(3)


def model():
    good, bad = ["the cat sat on the mat and looked"] * 30, ["### $$$ | | |"] * 30
    import numpy as np

    return quality_classifier.train([t.encode() for t in good + bad], np.array([1] * 30 + [0] * 30))


def run(name, df):
    if name == "quality_classifier":
        return quality_classifier.score(df, model())
    if name == "language_id":
        return language_id.identify(df, language_id.train([b"the cat and the dog", b"el gato y el perro"] * 5, ["en", "es"] * 5))
    if name == "quality_rules":
        return quality_rules.judge(df, df.filter("doc_id = 1").select("doc_id"))
    return {"jaccard_join": jaccard_join.link_components, "packing": packing.pack, "mixing": mixing.mix_plan, "mix": mixing.mix, "substring_dedup": substring_dedup.dedup}[name](df)


OPERATORS = ["quality_classifier", "language_id", "quality_rules", "jaccard_join", "packing", "mixing", "mix", "substring_dedup"]


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_odd_tables(spark, odd, name):
    rows = run(name, odd).collect()
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
    if name != "mix":
        assert set(per) == {i for i, _ in TEXTS}
    if name not in ("packing", "mix"):
        assert len(rows) == len(TEXTS) and len(per[1]) == 2
    assert run(name, odd.filter("n_chars < 0")).collect() == []
    if name == "jaccard_join":
        assert per[6][0].component_id == 5 and per[5][0].n_shingles > 100_000 and per[None][0].component_id is None
    if name == "substring_dedup":
        assert per[5][0].n_removed < 1000 and per[6][0].n_removed >= 149_000
    if name == "quality_rules":
        assert per[5][0].n_words == 150_000 and per[7][0].word_chars == 1_000_000
    if name == "packing":
        assert all(sum(r.length for r in v if r.start >= 0) % v[0].doc_tokens == 0 for v in per.values())
    if name == "mixing":
        assert {r["size"] for r in per[5]} == {150_000} and per[2][0].taken == 0
    if name == "mix":
        assert sum(len(words(r.text)) for r in rows) == sum(r.taken for r in mixing.mix_plan(odd).collect())


@pytest.mark.parametrize("stage", range(5))
def test_stage_takes_odd_tables(spark, odd, stage):
    name, fn = C.STAGES[stage]
    out = fn(spark, odd, BASE)
    rows = out.collect()
    if stage < 4:
        assert out.columns == odd.columns and rows
        assert {r["a.b"] for r in rows} == {"clash"} == {r["_copy"] for r in rows}
        assert fn(spark, odd.filter("n_chars < 0"), BASE).collect() == []
    if stage == 1:
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "None", "3", "4", "5", "7"])
    if stage == 2:
        assert {r.doc_id for r in rows} >= {1, 2, None, 3, 4, 5, 7}


def test_chat_and_html_take_odd_tables(spark):
    long = "word " * 200_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (None, None, None, None), (2, 0, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(n) for n in ("example", "n_turns", "loss_start", "t", "turns", "parts", "a.b")])
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_examples(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len(long) and got[None].n_turns == 1 and got[2].loss_chars == 0
    page = "<html><body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} of the article, with words to read.</p>" for i in range(8000)) + "</article></body></html>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "u", "")], "page_id long, url string, html string").select("*", *[F.lit(1).alias(n) for n in ("text", "n_chars", "a.b")])
    rows = html_extract.extract(df).collect()
    assert len(rows) == 4 and [r.text.count("\n") for r in rows if r.page_id == 1] == [7999, 7999]
    assert all(r.text == "" for r in rows if r.page_id != 1)


def test_vectors_take_odd_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (None, None), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(n) for n in ("n_links", "unit", "cid", "homes", "a.b", "kept")])
    got = near_dedup.near_links(df)[0].collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 3, 1, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2


def test_long_words_of_one_hash_family_stay_apart(spark):
    """Thue-Morse words collide under polynomial hashes modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    one, two = " ".join([a, *(f"w{i}" for i in range(24))]), " ".join([b, *(f"w{i}" for i in range(24))])
    df = spark.createDataFrame([(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, " ".join(f"{a}{i}" for i in range(5))), (4, " ".join(f"{b}{i}" for i in range(5))), (5, one), (6, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 24}
    assert {r.doc_id: r.component_id for r in jaccard_join.link_components(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}


def test_no_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint_dir(Session())
