"""Quality rules: base rules on counts, then a hashed n-gram log-likelihood ratio.

A document's words and word pairs are hashed into buckets.  Two multinomials
over the buckets, of the trusted texts and of the whole corpus, give every
bucket the weight log(p_trusted / p_raw); a document's score is the mean weight
of its n-grams, so length does not matter.  Column functions only.

Folds.  Every document has a fold by its doc_id, and is scored by the trusted
texts of the other folds only, whether it is trusted itself or not; so being on
the list raises no score.

Smoothing.  The trusted multinomial is drawn towards the raw one by a Dirichlet
prior that weighs as much as `prior` times the trusted texts.

Threshold.  The score that all but the share `quantile` of the trusted documents
reach that pass the base rules, read from an exact count of scores rounded to
thousandths.  Each document that passes the base rules and reaches it is kept.

Raw counts cover all documents, trusted counts all trusted texts.  Their ids are
compared exactly, but texts seldom travel for it: a broadcast bit map of fixed
size says of each document whether it may be trusted, and the few ids that it
takes for trusted ones by mistake, found by a join of ids alone, make a second
map.  Only texts that both maps mark go through an exchange and an exact join.
The weight table has 2 * buckets rows of one weight a fold, whatever the corpus.

A window repeat inside a document is found by 64-bit hashes of its words.

Cases: null and empty texts have no words, so they fail the base rules and
score 0; repeated rows are judged each by itself; without trusted texts in other
folds a score is 0, and without trusted texts that pass the base rules these
alone decide; a score equal to the threshold is kept; an empty table gives no
rows; other columns are ignored; a null doc_id is kept as null, in fold 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import staged

BUCKETS = 1 << 16
FOLDS = 4
PRIOR = 1.0
QUANTILE = 0.02
# Rows of a bit map of ids, of MAP_WORDS words of 64 bits each; an id has a bit in every word of its row.
MAP_ROWS = 1 << 18
MAP_WORDS = 4
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def _covered(hashes: Column, width: int) -> Column:
    """Number of positions covered by windows whose hash occurs twice or more."""

    def count(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        h = lambda i: F.get(sorted_windows, i)["h"]
        same = F.filter(sorted_windows, lambda s, i: ((i > 0) & (h(i - 1) == s["h"])) | ((i < n - 1) & (h(i + 1) == s["h"])))
        starts = F.sort_array(F.transform(same, lambda s: s["i"]))
        step = F.aggregate(
            starts, F.struct(F.lit(0).alias("sum"), F.lit(-width).alias("last")),
            lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(width), i - acc["last"])).alias("sum"), i.alias("last")),
        )
        return step["sum"]

    tagged = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return let(F.sort_array(tagged), count)


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words found twice or more in the array."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h, width)))
    return F.when(n > width, found).otherwise(0).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def base_counts(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, w, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(
        "row_id", "doc_id",
        let(words(F.col("text")), lambda w: F.struct(
            w.alias("w"), F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
        )).alias("s"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
    ).select("row_id", "doc_id", F.col("s.w").alias("w"), F.col("s.n_words").alias("n_words"), F.col("s.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines",
             F.col("s.n_repeat_words").alias("n_repeat_words"))


def n_grams(rows: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """One row per word and per word pair: keep and `gram`, null for a row without words."""
    each = rows.select(*keep, "w", F.posexplode_outer("w").alias("at", "word"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    following = F.get("w", F.col("at") + 1)
    pair = F.when(following.isNotNull(), bucket("word", following) + buckets)
    grams = each.select(*keep, F.explode(F.array(F.when(F.col("word").isNotNull(), bucket("word")), pair)).alias("gram"))
    return grams


def _bits(key: Column) -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(MAP_WORDS)]


def in_map(rows: DataFrame, ids: DataFrame, name: str, seed: int, size: int) -> DataFrame:
    """rows with `name`: true wherever doc_id is one of ids (column _t), and seldom elsewhere."""
    place = lambda key: F.pmod(key, F.lit(size))
    key = F.xxhash64("_t", F.lit(seed))
    table = ids.select(place(key).alias("_row"), *[b.alias(f"_m{k}") for k, b in enumerate(_bits(key))])
    table = table.groupBy("_row").agg(*[F.bit_or(f"_m{k}").alias(f"_m{k}") for k in range(MAP_WORDS)])
    key = F.xxhash64("doc_id", F.lit(seed))
    found = F.col("doc_id").isNotNull()
    for k, b in enumerate(_bits(key)):
        found &= F.coalesce(F.col(f"_m{k}").bitwiseAND(b) != 0, F.lit(False))
    # At most `size` rows of MAP_WORDS + 1 numbers.
    return rows.join(F.broadcast(table), place(key) == F.col("_row"), "left").select(*rows.columns, found.alias(name))


def trusted_folds(docs: DataFrame, trusted: DataFrame, map_rows: int = MAP_ROWS) -> DataFrame:
    """(fold, text) of all documents; fold is null for those that are not trusted."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("_t")).filter("_t is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    may = in_map(rows.select("doc_id"), ids, "_may", 0, map_rows).filter("_may").select(F.col("doc_id").alias("_t")).distinct()
    wrong = staged(may.join(ids, "_t", "left_anti"), "wrong")
    rows = in_map(in_map(rows, ids, "_may", 0, map_rows), wrong, "_doubt", 1, map_rows)
    open_ = F.col("_may") & F.col("_doubt")
    # What may be trusted is either trusted or among the wrong ones, which are all in doubt.
    sure = rows.filter(~open_).select(F.when(F.col("_may"), fold(F.col("doc_id"))).alias("fold"), "text")
    doubt = rows.filter(open_).select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_t"), "left")
    return sure.unionByName(doubt.select(F.when(F.col("_t").isNotNull(), fold(F.col("doc_id"))).alias("fold"), "text"))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(gram, weight): a weight for each fold, by the trusted texts of the others; trusted: doc_id of trusted texts."""
    marked = trusted_folds(docs, trusted).select("fold", words(F.col("text")).alias("w"))
    good = [F.count_if(F.col("fold") == k).alias(f"good{k}") for k in range(FOLDS)]
    counts = n_grams(marked, ["fold"], buckets).filter("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("raw"), *good)
    counts = staged(counts, "grams")
    total = counts.agg(*[F.sum(c).alias(c) for c in counts.columns[1:]]).first()
    each = []
    for k in range(FOLDS):
        others = [f"good{j}" for j in range(FOLDS) if j != k]
        held = sum(total[c] or 0 for c in others)
        share = F.col("raw") / F.lit(float(total.raw or 1))
        seen = sum((F.col(c) for c in others), F.lit(0)) + share * (prior * held)
        each.append(F.log(seen / (share * ((1 + prior) * held))) if held else F.lit(0.0))
    return counts.select("gram", F.array(*each).alias("weight"))


def threshold_of(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> float:
    """The score that all but a share of the trusted documents that pass the base rules reach; -inf without any."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("_t")).distinct()
    good = scored.filter("not base_failed").join(ids, F.col("doc_id") == F.col("_t"), "left_semi")
    # A row for each thousandth a score can take, some 20,000 at most.
    table = good.groupBy(F.floor(F.col("score") * 1000).alias("at")).agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    below, spare = 0, int(quantile * sum(r.n for r in table))
    for r in table:
        below += r.n
        if below > spare:
            return r["at"] / 1000
    return float("-inf")


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the base counts, score, base_failed, kept; one row a document.  docs: doc_id, text."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = base_counts(docs).withColumn("fold", fold(F.col("doc_id")))
    keep = ["row_id", "doc_id", "fold", *counts]
    # At most 2 * buckets rows.
    table = F.broadcast(weights(docs, trusted, buckets, prior))
    scored = n_grams(base, keep, buckets).join(table, "gram", "left").withColumn("weight", F.get("weight", F.col("fold")))
    out = scored.groupBy("row_id").agg(F.sum("weight").alias("total"), F.count("weight").alias("grams"), *[F.max(c).alias(c) for c in keep[1:]])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # Sums in another order differ in their last digits only.
    score = F.when(F.col("grams") > 0, F.round(F.col("total") / F.col("grams"), 9)).otherwise(0.0)
    out = staged(out.select("doc_id", *counts, score.alias("score"), failed.alias("base_failed")), "scores")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold_of(out, trusted, quantile))))
