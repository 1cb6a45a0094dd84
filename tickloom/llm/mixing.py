"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; within a source, documents
in the order of their keys are a weighted sample without replacement of any size. A source
whose target is over its size first takes complete epochs; the rest is the run of documents that
fills what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
# Documents of a source that are ordered in one window; a source of any size is many of them.
BUCKET = 4096


def word_count(text: str = "text"):
    """Number of words, split at ASCII white space; 0 for a missing text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def digest_of(text: str = "text"):
    """The digest of a text; a missing one counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size), one row per source.

    The sources, ordered by code point with null last, weigh ``weights``, repeated. They share
    ``share`` times all sizes; no target exceeds ``most`` times its source's size, and what is
    above goes to the others by weight until none is above. That is: a target is the smaller of the
    cap and the weight times a common level, and the level follows from sorting the sources by cap per weight.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    leveled = ranked.withColumns({
        "left": F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "heavy": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    leveled = leveled.withColumn("level", F.when(F.col("left") / F.col("heavy") * F.col("weight") <= F.col("cap"), F.col("left") / F.col("heavy")))
    leveled = leveled.withColumn("level", F.first("level", ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return leveled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken, whole, digest): what the mix takes of every row of ``docs``.

    ``size`` is the number of words (missing text: 0), ``epochs`` the complete passes over the document's source,
    ``taken`` the words taken with repeats: ``epochs`` times the size, plus the whole document where the sample reaches past it, plus the
    part of the one document per source in which the budget ends, so that a source's words meet its
    target to the word. ``whole`` counts full copies instead, with that last document in if at least half of it fits.
    ``digest`` is that of the text: it tells rows apart that share an id or have none.
    ``quality`` (doc_id, quality) sets the sampling weight: 2 for 1, 0.5 for 0, else 1. Keys depend on
    ``seed`` and the id only, or the text where there is no id, so reruns agree; rows that share an id are ordered by size and
    take part one by one. Equal rows are counted, ranked once and told apart at the end. A null source is a source. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"),
                       digest_of().alias("digest"))
    rows = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    weight = F.lit(1.0)
    if quality is not None:
        marks = quality.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"), F.min(F.lit(0).cast("long")).alias("zero"))
        # rows without an id have no mark; they are spread by their texts
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
        rows = rows.join(marks, (F.col("doc_id") == F.col("id")) & (spread == F.col("zero")), "left").drop("id", "zero")
        weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    # a uniform draw strictly between 0 and 1
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    draw = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) * F.lit(2.0**-53)
    rows = cut(rows.select("doc_id", "source", "size", "digest", "n", (-F.log(draw) / weight).alias("key")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    plan = cut(targets.join(sizes.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
        "buckets": F.ceil(F.col("docs") / BUCKET),
    }).withColumn("budget", F.greatest(F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0))))
    # keys fall into about equal buckets by the distribution of an exponential key; buckets are in key order
    keyed = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1).cast("long"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = cut(keyed.groupBy("source", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("words")).select(
        F.col("source").alias("s"), F.col("bucket").alias("k"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "digest").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("prior", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)))
    placed = placed.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    room = F.col("budget") - F.col("ahead") - F.col("prior") - F.col("nth") * F.col("size")
    part = F.greatest(F.least(room, F.col("size")), F.lit(0))
    full = ((room > 0) & (2 * room >= F.col("size"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs",
                         (F.col("epochs") * F.col("size") + part).alias("taken"), (F.col("epochs") + full).alias("whole"), "digest")


def repeat_rows(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """``docs`` with every row as often as ``mix``, made of it by ``mix_sources``, takes it whole.

    Rows meet by id, source and text, whether they have an id or not. Rows equal in all three are taken equally often,
    but for the few between which a source's budget ends: there some are taken once more than the others.
    """
    times = cut(mix.groupBy("doc_id", "source", "digest").agg(F.sum("whole").alias("all"), F.count("*").alias("n")).select(
        F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("digest").alias("mixed"),
        F.expr("all div n").alias("times"), F.expr("all % n").alias("more")))
    # a row is one value beside what it is found by, so its columns may have any names
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest_of().alias("digest"),
                         F.struct("*").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("digest") == F.col("mixed"))
    out = marked.join(times.filter("times > 0"), same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    out = out.select("row.*")
    some = times.filter("more > 0")
    if some.take(1):  # at most one group of equal rows per source
        rank = F.row_number().over(W.partitionBy("id", "from", "mixed").orderBy("more"))
        out = out.union(marked.join(some, same).withColumn("rank", rank).filter("rank <= more").select("row.*"))
    return out
