"""A corpus from raw documents to packed token sequences.

Each stage takes all that its predecessor kept, as rows like ``documents``; the
last returns the packed pieces.  Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import mixing, ngram_join, packing, quality_classifier, suffix_dedup
from barlake.llm.common import forget, materialize, table
from barlake.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows that are still there.

    An empty table gives an empty one; null and empty texts are scored as such and
    go if the classifier rejects them; repeated rows stay or go together.
    """
    ranking = quality_classifier.fit(docs, quality_classifier.label_split(table(spark, sf_dir, "labels")))
    scored = quality_classifier.score_quality(docs, ranking, with_text=True)
    return scored.where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; rows without an id stay.

    A document whose rows are repeated whole keeps one of them.  Rows that share
    an id but differ in any column all stay or all go.
    """
    groups = ngram_join.join_components(docs)
    rows, ids = groups.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows > ids:
        docs = docs.where("doc_id is not null").dropDuplicates().union(docs.where("doc_id is null"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.limit(ngram_join.BROADCAST_IDS + 1).count() <= ngram_join.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that are found elsewhere too; cut characters are marked as such.

    Passages are of over 50 words, or of 400 bytes where these are fewer words.

    Every row stays, with what is left of its text; a null text becomes empty.  Rows
    repeated whole lose all but short texts in each of them; no row gives no row.
    """
    done = suffix_dedup.remove_repeats(docs, words=51)
    text = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("kept").cast("string"))
    done = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws it, in shuffled order.

    A null source is a source of its own, repeated rows are drawn alike, and no row
    gives no row.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their token ids.

    An empty or null text is one token, its end; repeated rows are packed each; no
    row gives no row.
    """
    return packing.pack_documents(docs, *tokenizer())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: SQL can't express the classifier and the tokenizer; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read goes once its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
