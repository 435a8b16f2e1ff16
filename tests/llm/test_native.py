"""Quality rules, chat formatting and mixing against brute force."""

import hashlib
from collections import Counter

import pytest

from tessera.llm.chat_format import digest, format_examples, loss_text, read_turns
from tessera.llm.mixing import mix, mix_plan, source_targets
from tessera.llm.quality_rules import judge
from tests.llm.helpers import corpus, documents, words
from pyspark.sql import functions as F


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality_rules(spark):
    texts = corpus(4, 120, 30) + ["a | b\n\nx\nx \nx\n#$", "p q " * 300]
    df = documents(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(20, 60)], "doc_id long")
    out = judge(df, trusted)
    assert no_python(out)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        seen, gone = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7)), set()
        for p in range(len(w) - 7):
            if seen[tuple(w[p : p + 8])] > 1:
                gone.update(range(p, p + 8))
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(gone) > 30 * len(w))
        assert not (r.kept and r.base_failed) and (w or r.score == 0)


def test_quality_rules_edges(spark):
    df = documents(spark, ["a b", "a b", None], [1, 1, None])
    none = spark.createDataFrame([], "doc_id long")
    assert [r.score for r in judge(df, none).collect()] == [0.0] * 3
    assert judge(df.filter("n > 9"), none).collect() == []


CONVERSATIONS = [
    (1, 0, "system", "be [INST] good</s>%5B"), (1, 1, "user", None), (1, 2, "assistant", "a:\nb [OUT]"), (1, 3, "user", "é"), (1, 4, "assistant", ""),
    (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, None, None, None), (4, 0, "we:ird[", "%25<"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, 7) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, example int").repartition(3)
    examples = format_examples(df)
    out = digest(examples)
    assert no_python(out)
    got = {r.conv_id: r for r in out.collect()}
    for c in (1, 2, 3, 4, None):
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in CONVERSATIONS if r[0] == c))
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    one = examples.filter("conv_id = 1").orderBy("example").select("text", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"), read_turns(F.col("text")).alias("t")).collect()
    assert [r.loss for r in one] == ["a:\nb [OUT]", "", ""] and [len(r.t) for r in one] == [3, 5, 6]
    assert got[1].formatted_chars == sum(len(r.text) for r in one)
    assert digest(format_examples(df.filter("conv_id = 99"))).collect() == []


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 2 * sizes[s]]
        for s in full or list(left):
            out[s] = 2.0 * sizes[s] if full else share[s]
            left.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 0, None: 7}, {f"s{i:02}": 13**i % 1000 for i in range(20)}, {"é": 5, "Z": 900, "z": 40, None: 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"k{s}", s, n) for s, n in sizes.items()], "source_key string, source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mixing(spark):
    texts = corpus(5, 200)
    df = documents(spark, texts).drop("size")
    plan = mix_plan(df.select("doc_id", "source", "text"))
    assert no_python(plan)
    rows = plan.collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len(words(t)) for i, t in enumerate(texts)}
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    again = {(r.doc_id, r.taken) for r in mix_plan(df.repartition(7).select("doc_id", "source", "text")).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mix(df)
    assert mixed.columns == df.columns and no_python(mixed)
    count = Counter()
    for r in mixed.collect():
        count[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert count == Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_mixing_edges(spark):
    df = documents(spark, [None, "a b", "a b"], [1, 2, 2]).drop("size")
    assert sorted((r.doc_id, r.taken) for r in mix_plan(df.select("doc_id", "source", "text")).collect())[0] == (1, 0)
    assert mix(df.filter("n > 9")).collect() == [] and mix_plan(df.filter("n > 9").select("doc_id", "source", "text")).collect() == []
