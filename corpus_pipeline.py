"""The corpus pipeline: toxic documents out, near copies out, sources mixed, sequences packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import mixing, near_copies, packing, queries, toxicity
from tickloom.session import scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the rejecting score; all others go.

    Each row stands for itself: rows that repeat an id or a text are kept or dropped alike. Missing and empty texts score too, and
    stay where that score is low. Other columns come along whatever their names; an empty table stays empty.
    """
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, queries.REJECT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every class of near copies; rows without an id stay.

    Of rows that repeat an id and its text one stays, the first by their other columns in order; rows that repeat an id with another
    text are documents by themselves. Missing and empty texts are one class. Other columns come along whatever
    their names; an empty table stays empty.
    """
    classes = near_copies.classes_of_texts(docs)
    kept = classes.filter("kept AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    # a row is one value beside what it is found by, so its columns may have any names
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), near_copies.digest_of().alias("digest"), F.struct("*").alias("row"))
    ranks = [F.col("row")[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = F.struct(*ranks, F.lit(0))
    one_each = marked.join(kept, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", order).alias("row"))
    return one_each.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it whole.

    Missing and empty texts have no words and are taken with their source's complete passes. A null source is a source; rows
    without an id are told apart by their texts, equal rows are taken about equally often. Other columns come along whatever their
    names; an empty table stays empty.
    """
    return mixing.repeat_rows(docs, mixing.mix_sources(docs, queries.table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences.

    Rows are packed one by one, whether they repeat an id or have none; a missing text is an empty one and still has its end.
    Other columns are left out; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

# Models, signatures and tokens are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_dir(spark)}-{uuid.uuid4().hex[:8]}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
