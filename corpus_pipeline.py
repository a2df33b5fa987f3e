"""A training corpus from raw documents in five stages: toxicity, quality, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``, whatever other columns it has. run() writes each stage's result to the shared
folder as Parquet and reads it back for the next, so a lost executor never costs more than the
stage at hand; tables that a finished stage made go.

In every stage a null text counts as empty, texts are read whole, rows that repeat a doc_id are rows
of their own unless the stage says otherwise, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, ngram_join, packing, quality, runtime, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op4's own threshold leaves; the classifier learns from sf_dir's labels of the documents at hand.

    Rows without an id are judged, too, but nothing is learned from them.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fixed rules and the fences of their language and source; null languages and sources are groups of their own."""
    return quality.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more share (they stay in the one of largest id; a null id is the smallest);
    a null text becomes empty, and n_chars follows the text."""
    found = line_dedup.dedup(docs, whole_rows=True)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in found.columns else found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group under links: that of smallest id, and of rows that repeat it the one whose text comes first.

    Documents without words are in no group, and documents without an id neither: all of them stay.
    """
    found = runtime.store(ngram_join.join(docs), "near-duplicates")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Only rows of repeated ids are sorted; there are few, and none of them when ids are keys.
    again = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    marked = left.join(again, F.col("doc_id") == F.col("_again"), "left")
    words = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    single = marked.where(F.col("_again").isNull() | ~words)
    first = Window.partitionBy("doc_id").orderBy("text", *[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"])
    one = marked.where(F.col("_again").isNotNull() & words).withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return single.select(*docs.columns).unionByName(one.select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The fitted classifier and the sketches can't be written in SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with runtime.scope() as stay:
            after = runtime.store(stage(spark, docs, sf_dir), f"stage-{name}")
            stay.append(after)
        runtime.discard(docs)
        docs = after
    return docs
