"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    cap_filters, hard_negatives, id_coder, language_model, license_scan, mixing, near_copies, packing, periodic_runs, toxicity, warc, winnowing, word_bpe,
)
from tickloom.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The part of the ids that a model does not learn from.
HELD_OUT_TOXIC = (4, 2)
REJECT = 0.3


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled rows of ``docs`` whose id is not held out."""
    return toxicity.train(docs, labels.filter(~held_out(*HELD_OUT_TOXIC)))


@query
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_dir(spark))


@query
def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id", held_out(*HELD_OUT_TOXIC).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"))


@query
def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.cap_filter_classes(table(spark, sf_dir, "embeddings"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


@query
def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_id_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_coder.round_trip(table(spark, sf_dir, "documents"), vocabulary(), scratch_dir(spark))


HELD_OUT_WORDS = (7, 2)


@query
def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores, total = language_model.fit_and_score(docs, docs.filter(~held_out(*HELD_OUT_WORDS)))
    return scores.select(
        "doc_id", held_out(*HELD_OUT_WORDS).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score")


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = winnowing.edit_prints(table(spark, sf_dir, "documents"))
    return prints.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.printed(F.col("prints")).alias("fingerprint"), winnowing.printed(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited", "near_next")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("blocks", lambda b: b["label"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), "score")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    large = lambda x: 256 * x.cast("double")
    # a number that large is whole already, and may be none that a long holds
    whole = F.transform("embedding", lambda x: F.when(F.abs(large(x)) < 2**52, F.floor(large(x)).cast("double")).otherwise(large(x)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("vector"))
    return hard_negatives.mine_negatives(rows, "vec_id % 100 = 0")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), places=periodic_runs.repeated_tail)
    # the greatest length/period, compared exactly; runs come by start and period, so the first of equals stays
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"))


@query
def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    rows = word_bpe.decode_ids(word_bpe.encode_texts(table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
