"""A pipeline over documents; each stage is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, mixing, packing, substrings, toxicity
from sparkloom.llm.common import shared_folder, written

#: Columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic. Learned from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("label")).filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, known)
    scored = toxicity.score(docs.select(*COLUMNS).withColumn("own", F.col("text")), model, text="own", keep=tuple(COLUMNS))
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least doc_id, one without doc_id last. Five words and a similarity of 0.8.

    Rows are numbered once, in a table that is written, so those that share or lack a doc_id are compared too, and a number
    is the same row's whatever executors read it. Texts without words have nothing to compare and stay.
    """
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard.jaccard_groups(rows.select("_row", "text"), doc_id="_row", rule=jaccard.Rule(n=5, percent=80)).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_row")
    kept = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(first).select("_row")
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier; those of which nothing is left go."""
    found = substrings.dedup_substrings(docs, keep=("doc_id", "text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = found.filter((F.col("n_removed") == 0) | (F.col("kept") != ""))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier and packing can't be expressed in SQL; tests compare near copies, repeats, mixing and packing with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/sparkloom/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
