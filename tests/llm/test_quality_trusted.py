"""Quality rules: every trusted text is counted, however many there are."""

from pyspark.sql import functions as F

from tessera.llm.quality_rules import BUCKETS, n_grams, weights, words


def test_all_trusted_texts_count(spark):
    docs = spark.range(22_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word u"), F.col("id")).alias("text"))
    common = n_grams(spark.sql("select 'word' as text").select(words(F.col("text")).alias("w")), [], BUCKETS).first().gram
    # A rare word is known to the folds that do not hold its text; were some trusted texts left out, theirs would be to none.
    out = {r.gram: r.weight for r in weights(docs, docs.select("doc_id"), prior=0.0).collect()}
    assert all(abs(w) < 1e-2 for w in out[common])
    rare = [w for gram, w in out.items() if gram != common]
    assert all(max(x for x in w if x is not None) > 0 for w in rare) and len(rare) > 1000
