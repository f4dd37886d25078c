"""A corpus pipeline: quality, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
else these hold.  ``run`` writes what a stage returns to the shared checkpoint folder and reads it for the next.
All stages share the executors and their Python workers, so those that send whole texts to Python bound the batches
of the session.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import langid, near, packing, quality, substrings
from tablewarden.llm.common import bounded_batches, stored, table

TOKENIZER = "word_bpe_49k.json"


def _carried(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id and text beside whole rows, so that no column of ``docs`` meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in also)).alias("row"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labels of documents at hand, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(_carried(docs), model).where("predicted = 1").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages by a clear margin; all of them where no language was learned."""
    bounded_batches(spark)
    dictionaries = langid.train(docs)
    if not dictionaries:
        return docs
    return langid.identify(_carried(docs), dictionaries).where("accepted").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of similar texts; repeated rows once, null ids untouched."""
    bounded_batches(spark)
    classes = stored(near.similar(docs.select("doc_id", "text")), "pipeline-classes")
    per_id = classes.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    odd = per_id.where("class_id <> doc_id or n > 1").select(F.col("doc_id").alias("__odd_id"), (F.col("class_id") != F.col("doc_id")).alias("__gone"))
    odd = stored(odd, "pipeline-odd")
    # one join moves each row once; what goes grows with the documents, so it is a shuffle at every size
    kept = docs.hint("merge").join(odd, F.col("doc_id") == F.col("__odd_id"), "left").where("__gone is null or not __gone")
    if odd.where("not __gone").isEmpty():
        return kept.select(docs.columns)
    kept = stored(kept, "pipeline-kept")
    once = kept.where("__gone is not null").dropDuplicates(["doc_id"])
    return kept.where("__gone is null").unionByName(once).select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand in an earlier one; other texts stay as they are."""
    bounded_batches(spark)
    cut = substrings.remove_repeats(_carried(docs, "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = cut.select("row.*", text.alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", good_quality), ("language", known_language), ("near_copies", without_near_copies),
          ("repeated_passages", without_repeated_passages), ("packing", packed)]
ORACLE_SQL = None          # learned stages cannot be said in SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
