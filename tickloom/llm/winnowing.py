"""Document fingerprints by winnowing.

A text's words (lower case, split at ASCII white space) give rolling hashes of runs of K words; in every window
of W such hashes the smallest is selected, the rightmost of equal ones, and kept with its position. Two texts that
share a run of W + K - 1 words share a selected hash.

All of it is DataFrame expressions. Windows are minima over doubling widths of values that hold the hash above
the reversed position, so that the least value is the rightmost least hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.bind import let

GRAM, WINDOW = 5, 16
_LOW = (1 << 32) - 1


def _turn(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _ahead(values: Column, i: Column, n: int) -> Column:
    return F.coalesce(F.get(values, i + n), F.lit(0).cast("long"))


def _grams(hashes: Column, k: int, body) -> Column:
    """Cyclic polynomial hashes of k words each, from those of runs that double in length."""

    def widen(values: Column, width: int) -> Column:
        if width == k:
            return body(values)
        step = min(width, k - width)
        # a run of width + step words: the first ``width`` turned, and the last ``step``
        more = values if step == width else _runs(hashes, step)
        joined = F.transform(values, lambda x, i: _turn(x, step).bitwiseXOR(_ahead(more, i, width)))
        return let(joined, lambda v: widen(v, width + step))

    return widen(hashes, 1)


def _runs(hashes: Column, k: int) -> Column:
    return hashes if k == 1 else _grams(hashes, k, lambda v: v)


def _selected(values: Column, w: int) -> Column:
    """The distinct minima of all windows of w values; of all values if there are fewer."""

    def widen(least: Column, width: int) -> Column:
        if width == w:
            return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(least) - (w - 1), F.least(F.size(least), F.lit(1)))))
        step = min(width, w - width)
        return let(F.transform(least, lambda x, i: F.least(x, F.get(least, i + step))), lambda v: widen(v, width + step))

    return widen(values, 1)


def fingerprint(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """array<struct<hash long, position long>> by position; empty for a text without words.

    ``position`` is the word the hashed run starts at. Fewer than ``k`` words are one run; fewer than ``w`` runs one window.
    """
    words = F.array_remove(F.split(F.lower(text), r"[ \t-\r]+"), "")

    def pick(grams: Column) -> Column:
        real = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - (k - 1), F.least(F.size(grams), F.lit(1))))
        value = F.transform(real, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32).bitwiseOR(F.lit(_LOW) - i))
        places = F.transform(let(value, lambda v: _selected(v, w)), lambda x: F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW)))
        return F.transform(places, lambda p: F.struct(F.get(grams, p.cast("int")).alias("hash"), p.alias("position")))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: _grams(h, k, pick))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes, of two arrays of hashes; 1 if both are empty."""
    return let(F.array_union(a, b), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(u)))


def hashes_of(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def printed(prints: Column) -> Column:
    """A fingerprint as text: hexadecimal hash and position of every selected run."""
    return F.array_join(F.transform(prints, lambda p: F.concat(F.hex(p["hash"]), F.lit("@"), p["position"].cast("string"))), " ")


def ranges_of(rows: DataFrame, key: str):
    """The number of the range a key lies in, of about equal numbers of rows; null keys lie in the first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx(key, shares, 100 * parts)).first()[0] or []))
    if not cuts:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col(key)))
    return F.when(F.col(key).isNull(), 0).otherwise(below).cast("int")


def edit_prints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited, prints, edited_prints, near_edited, near_next) for every row of ``docs`` (doc_id, text).

    The edited text has its last half of code points replaced by the first as many of the next document's text. A missing text
    counts as empty; texts without words have empty fingerprints, which are alike by 1 among themselves and by 0 to others. Rows with
    equal ids follow each other in any order; null ids come first, but the last row is followed by the first that has an id (by an empty text if
    none has). An empty table gives no rows; other columns are ignored.

    Ids fall into ranges; a text is moved once, to its range, and a copy of each range's first text to the end of the range before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = rows.withColumn("part", ranges_of(rows, "doc_id"))
    # one row per range, whatever the texts
    firsts = held.groupBy("part").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    order = W.orderBy("part")
    firsts = firsts.withColumn("before", F.lag("part").over(order)).withColumn(
        "before", F.coalesce("before", F.max("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    copies = held.join(F.broadcast(firsts), ["part", "doc_id"]).dropDuplicates(["part"])
    copies = copies.select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("copy"))
    along = W.partitionBy("part").orderBy("copy", "doc_id")
    placed = held.withColumn("copy", F.lit(False)).unionByName(copies)
    placed = placed.withColumn("next_text", F.coalesce(F.lead("text").over(along), F.lit("")))
    placed = placed.withColumn("prints", fingerprint(F.col("text"), k, w)).withColumn("hashes", hashes_of(F.col("prints")))
    placed = placed.withColumn("next_hashes", F.coalesce(F.lead("hashes").over(along), F.array().cast("array<bigint>"))).filter(~F.col("copy"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    placed = placed.withColumn("edited", edited).withColumn("edited_prints", fingerprint(F.col("edited"), k, w))
    return placed.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "prints", "edited_prints",
        likeness(F.col("hashes"), hashes_of(F.col("edited_prints"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
