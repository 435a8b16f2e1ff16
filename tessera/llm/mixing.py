"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets.  Sources by code point, null last, get weights 3, 1, 2, repeating,
and share 150 % of all words; no target exceeds twice its source, the excess
goes to the others by weight.  With sources ordered by cap / weight this level
is found in one pass of running sums.

Blocks.  A source's documents lie in blocks by hash, and its blocks in an order
by hash.  Running sums of words give every document its place; a target below
the source's size takes the words before the target, one between one and two
sizes takes every document once and the words before the rest again.  At most
one document of a source is cut.

Tree.  The numbers of taken blocks by source are split among 2^depth output
shards: at each node the left half's quotas by source are one multivariate
hypergeometric draw, made by ranking hashes of the node's (source, number)
pairs, so quotas add up exactly.  The ranks come from a histogram of hashes and
one rank inside its bucket at the cut, so no task holds a level.  Then each
source's blocks, in an order by hash, are handed out by the shards' quotas, so
shards are disjoint.  Rows of a shard are ordered by hash.  Column functions
only; hashes are seeded, so reruns agree.

Cases: null text has size 0 and takes 0; sources without words have target 0;
repeated rows are one document's copies, each taken for itself; null doc_ids are
told apart by their texts; an empty table gives no rows; other columns, whatever
their names, are ignored by mix_plan and carried by mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.prefix import bucket_count, running_total
from tessera.llm.storage import drop_staged, quoted, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
ROWS_PER_SHARD = 50_000
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source_key, source, source_size, target) from (source_key, source, source_size), one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights)) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * cap)
    first_full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = first_full.rowsBetween(Window.unboundedPreceding, -1)
    onward = first_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * share)
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # Sources are full in this order up to the first whose level fits below its cap; that level holds for the rest.
    rows = rows.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(first_full.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return rows.select("source_key", "source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, depth: int | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 23) -> DataFrame:
    """One row per document row: row_id, doc_id, source, size, source_size, target, taken, block, shard, place.

    docs: doc_id, source, text.  depth: of the tree; by default such that a
    shard has about ROWS_PER_SHARD rows, and 4 at least.
    """
    return _plan(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", "text"), depth, weights, share, cap, seed)


def _plan(docs: DataFrame, depth: int | None, weights, share: float, cap: float, seed: int) -> DataFrame:
    """mix_plan of (row_id, doc_id, source, text)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    mixed = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = staged(docs.select("row_id", "doc_id", "source", key.alias("source_key"), word_count(F.col("text")).alias("size"), mixed.alias("mixed")), "sizes")
    sizes = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).drop("source")
    n = rows.count()
    blocks = bucket_count(n)
    depth = depth if depth is not None else max(4, (n // ROWS_PER_SHARD).bit_length())
    rows = rows.withColumn("block", F.pmod("mixed", F.lit(blocks)))
    placed = running_total(rows, ["source_key"], "block", [F.col("mixed"), F.col("doc_id"), F.col("size"), F.col("row_id")], "size", "stop")
    placed = placed.join(targets, "source_key")
    passes = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    rest = F.round(F.col("target") - passes * F.col("source_size")).cast("long")
    again = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("stop") - F.col("size"))))
    placed = staged(placed.withColumn("taken", (passes * F.col("size") + again).cast("long")).drop("stop", "mixed"), "placed")
    shards = _deal(placed.filter("taken > 0").select("source_key", "block").distinct(), depth, seed)
    placed = placed.join(shards, ["source_key", "block"], "left")
    return placed.select("row_id", "doc_id", "source", "size", "source_size", "target", "taken", "block", "shard",
                         F.xxhash64("row_id", "doc_id", F.lit(seed + 1)).alias("place"))


def quotas(counts: DataFrame, depth: int, seed: int) -> DataFrame:
    """(node, source_key, n): blocks of each source at each leaf of the tree, from (source_key, n)."""
    now = staged(counts.select(F.lit(0).cast("long").alias("node"), "source_key", F.col("n").cast("long").alias("n")), "quotas")
    for level in range(depth):
        each = now.select("node", "source_key", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("j"))
        each = each.withColumn("h", F.xxhash64("node", "source_key", "j", F.lit(seed + level))).withColumn("b", F.shiftrightunsigned("h", 52))
        node = Window.partitionBy("node")
        # At most 4096 buckets a node.
        held = each.groupBy("node", "b").agg(F.count(F.lit(1)).alias("held"))
        held = held.withColumns({"upto": F.sum("held").over(node.orderBy("b")), "half": F.ceil(F.sum("held").over(node) / 2)})
        cut = held.select("node", "b", (F.col("half") - (F.col("upto") - F.col("held"))).alias("spare"), "held").filter("spare > 0")
        first = each.join(cut, ["node", "b"])
        rank = F.row_number().over(Window.partitionBy("node", "b").orderBy("h", "source_key", "j"))
        left = first.filter("spare >= held").select("node", "source_key").unionByName(first.filter("spare < held").withColumn("rank", rank).filter("rank <= spare").select("node", "source_key"))
        left = left.groupBy("node", "source_key").agg(F.count(F.lit(1)).alias("x"))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.coalesce("x", F.lit(0)).alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.coalesce("x", F.lit(0))).alias("n")))
        split = now.join(left, ["node", "source_key"], "left").select("source_key", F.explode(halves).alias("half"))
        before, now = now, staged(split.select("half.node", "source_key", "half.n").filter("n > 0"), "quotas")
        drop_staged(before)
    return now


def _deal(blocks: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source_key, block, shard): each source's blocks in an order by hash, handed out by the leaves' quotas."""
    mixed = F.xxhash64("source_key", "block", F.lit(seed))
    ranked = blocks.withColumns({"h": mixed, "b": F.shiftrightunsigned(mixed, 52), "one": F.lit(1).cast("long")})
    ranked = running_total(ranked, ["source_key"], "b", [F.col("h"), F.col("block")], "one", "rank").select("source_key", "block", "rank")
    leaves = quotas(blocks.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")), depth, seed)
    upto = F.sum("n").over(Window.partitionBy("source_key").orderBy("node"))
    leaves = leaves.withColumn("upto", upto).select("source_key", F.col("node").alias("shard"), F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("rank"))
    return ranked.join(leaves, ["source_key", "rank"]).select("source_key", "block", "shard")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n), " ")


def mix(docs: DataFrame, depth: int | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 23) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as it is taken, ordered inside shards by hash.

    A row taken once and in part again comes back whole and as its first
    words.  Where docs has n_chars, it is the length of the new text.
    """
    names = docs.columns
    table = staged(docs.select(F.monotonically_increasing_id().alias("_row"), *[quoted(c).alias(f"_c{i}") for i, c in enumerate(names)]), "mix")
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    slim = table.select(F.col("_row").alias("row_id"), F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"))
    plan = _plan(slim, depth, weights, share, cap, seed).filter("taken > 0").select(F.col("row_id").alias("_row"), "size", "taken", "shard", "place")
    rows = plan.join(table, "_row")
    copies = F.filter(F.array(F.least("taken", "size"), F.greatest(F.lit(0).cast("long"), F.col("taken") - F.col("size"))), lambda n: n > 0)
    rows = rows.withColumn("_n", F.explode(copies))
    text = F.when(F.col("_n") < F.col("size"), first_words(F.col(at["text"]), F.col("_n").cast("int"))).otherwise(F.col(at["text"]))
    rows = rows.withColumn(at["text"], text).repartition("shard").sortWithinPartitions("shard", "place", "_n")
    out = rows.select(*[F.col(at[c]).alias(c) for c in names])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
