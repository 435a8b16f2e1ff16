"""A corpus pipeline of five operators: classify, drop near copies, drop repeated passages, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of docs.  As a stage begins, the tables that the stage
before it staged for itself are deleted, so its result must be written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, mixing, packing, quality_classifier, substring_dedup
from tessera.llm.storage import drop_staged, quoted, recorded, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[int, list[DataFrame]] = {}


def _numbered(k: int) -> Callable[[Stage], Stage]:
    """Stage k: deletes what stage k - 1 has left and remembers its own tables."""

    def wrap(fn: Stage) -> Stage:
        @wraps(fn)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            old = _left.pop(k - 1, [])
            drop_staged(*[t for t in old if t.sparkSession.sparkContext.applicationId == spark.sparkContext.applicationId])
            with recorded() as own:
                out = fn(spark, docs, sf_dir)
            _left.setdefault(k, []).extend(own)
            return out

        return run

    return wrap


@_numbered(0)
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    names = docs.columns
    # Own names are put aside, so that no column of docs can clash with a new one.
    slim = docs.select(*[quoted(c).alias(c if c in ("doc_id", "text") else f"_c{i}") for i, c in enumerate(names)])
    model = quality_classifier.fit(slim.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality_classifier.score(slim, model).filter("quality_predicted = 1")
    return good.select(*[F.col(c if c in ("doc_id", "text") else f"_c{i}").alias(c) for i, c in enumerate(names)])


@_numbered(1)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies; documents that repeat a doc_id stay once."""
    groups = staged(jaccard_join.link_components(docs.select("doc_id", "text")), "groups")
    extra = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    copies = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.alias("d").join(copies.alias("c"), F.col("d.doc_id") == F.col("c.doc_id"), "left_anti")
    if extra:
        null = F.col("doc_id").isNull()
        kept = kept.filter(~null).dropDuplicates(["doc_id"]).unionByName(kept.filter(null))
    return kept


@_numbered(2)
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that also start earlier; documents that lose all their words go."""
    names = docs.columns
    carried = {c: f"_c{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    slim = docs.select("doc_id", "text", *[quoted(c).alias(a) for c, a in carried.items()])
    out = substring_dedup.dedup(slim, list(carried.values())).filter("n_words = 0 or n_removed < n_words")
    columns = {"text": F.col("kept"), "doc_id": F.col("doc_id"), **{c: F.col(a) for c, a in carried.items()}}
    if "n_chars" in names:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in names])


@_numbered(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document can be there twice, or in part."""
    return mixing.mix(docs)


@_numbered(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack(docs.select("doc_id", "source", "text")).drop("row_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

# Trained models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
