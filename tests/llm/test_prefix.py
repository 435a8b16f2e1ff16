"""Running sums against a plain loop, and the tree's quotas."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import prefix
from tessera.llm.mixing import quotas


def test_running_total(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SPAN", 3)
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(20), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, b long, i long, v long").repartition(5)
    got = {r.i: r.s for r in prefix.running_total(df, ["k"], "b", [F.col("i")], "v", "s").collect()}
    sums, want = defaultdict(int), {}
    for k, b, i, v in sorted(rows):
        sums[k] += v
        want[i] = sums[k]
    assert got == want
    assert prefix.running_total(df.filter("i < 0"), ["k"], "b", [F.col("i")], "v", "s").collect() == []


def test_quotas_split_every_node_in_halves(spark):
    counts = {"sa": 37, "sb": 5, "": 1, "sc": 200}
    df = spark.createDataFrame(list(counts.items()), "source_key string, n long")
    for depth in (0, 1, 3):
        rows = quotas(df, depth, 7).collect()
        per, by = Counter(), Counter()
        for r in rows:
            per[r.source_key] += r.n
            by[r.node] += r.n
        assert per == counts and max(by.values()) - min(by[i] for i in range(2**depth)) <= 1
        assert sorted(map(tuple, rows)) == sorted(map(tuple, quotas(df.repartition(3), depth, 7).collect()))
    # A draw is hypergeometric: the first half's share of a source is near its mean.
    left = Counter({r.source_key: r.n for r in quotas(df, 1, 9).collect() if r.node == 0})
    assert abs(left["sc"] - 100) < 15 and sum(left.values()) == 122
