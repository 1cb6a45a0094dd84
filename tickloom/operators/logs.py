"""Text read by bytes: ranges, pages cut at line ends, page navigation.

Positions count bytes, so the work is done on binary columns: taking a slice costs
its own length, where the same slice of a string would walk the text from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bind import let

# Block size and line window of the log viewer.
LOG_CHUNK, LOG_WINDOW = 65_536, 128
# Bytes of pages that are cut off a text together, before they are cut into pages.
SEGMENT = 1 << 20


def as_bytes(df: DataFrame, col: str) -> Column:
    """The column as binary: text in UTF-8, binary as it is."""
    if df.schema[col].dataType.simpleString() == "binary":
        return F.col(col)
    return F.encode(F.col(col), "UTF-8")


def pages_of(size: Column, chunk: int) -> Column:
    """ceil(size / chunk), at least 1."""
    count = F.call_function("div", size.cast("bigint") + (chunk - 1), F.lit(chunk).cast("bigint"))
    return F.greatest(count, F.lit(1).cast("bigint"))


def page_count(df: DataFrame, col: str, chunk: int = 500) -> DataFrame:
    return df.withColumn("page_count", pages_of(F.octet_length(col), chunk))


def _int(value: int | Column) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def byte_range(data: Column, pos: int | Column, offset: int | Column) -> Column:
    """Bytes [pos, pos + offset), or the -offset bytes before pos; cut to the data."""
    pos, offset = _int(pos).cast("bigint"), _int(offset).cast("bigint")
    low = F.greatest(F.least(pos, pos + offset), F.lit(0))
    high = F.greatest(pos, pos + offset)
    far = F.lit(2**31 - 2)  # beyond any value
    return F.substring(
        data, (F.least(low, far) + 1).cast("int"), F.least(high - low, far).cast("int")
    )


def read_range(df: DataFrame, col: str, pos: int | Column, offset: int | Column = 500) -> DataFrame:
    """Adds ``block``: the byte range; empty where it lies outside the data."""
    return df.withColumn("block", byte_range(as_bytes(df, col), pos, offset))


def _newline_at(data: Column) -> Column:
    """Place of the first newline byte, from 1; 0 if none. One character is one byte here."""
    return F.instr(F.decode(data, "ISO-8859-1"), "\n")


def line_crop_before(data: Column) -> Column:
    """What follows the first newline; all of it without one."""
    return F.substring(data, _newline_at(data) + 1, F.octet_length(data))


def line_crop_after(data: Column) -> Column:
    """What precedes the first newline; all of it without one."""
    return let(
        _newline_at(data),
        lambda at: F.when(at > 0, F.substring(data, F.lit(1), at - 1)).otherwise(data),
    )


def page_block(data: Column, start: Column, chunk: int, window: int) -> Column:
    """Bytes [start, start + chunk), extended to whole lines by up to window bytes each way."""
    body = byte_range(data, start, chunk)
    if window <= 0:
        return body
    return F.concat(
        let(byte_range(data, start, -window), line_crop_before),
        body,
        let(byte_range(data, start + chunk, window), line_crop_after),
    )


def paginate(
    df: DataFrame, col: str, chunk: int = 500, offset: int = 0, origin: str = "start"
) -> DataFrame:
    """One row per page: ``page`` (from 1), ``page_count``, ``block`` (binary).

    Counted from the start, or from the end, where the last page may be short. A text is
    cut twice: into runs of pages of about :data:`SEGMENT` bytes, each with the window on
    both sides, and those into pages. So no row but the text's own holds more than a run,
    however long the text, and neither the text nor a run is copied per page.
    """
    if origin not in ("start", "end"):
        raise ValueError("origin is 'start' or 'end'")
    rest = [c for c in df.columns if c != col]
    size, at = F.octet_length(col).cast("bigint"), F.col("_at")
    run, window = max(SEGMENT // chunk, 1), max(offset, 0)

    def first_byte(page: Column, size: Column) -> Column:
        return (page - 1) * chunk if origin == "start" else size - page * chunk

    def segment(data: Column, size: Column, first: Column) -> Column:
        last = F.least(first + (run - 1), F.col("page_count"))
        left, right = (first, last) if origin == "start" else (last, first)
        low = F.greatest(first_byte(left, size) - window, F.lit(0))
        high = first_byte(right, size) + (chunk + window)
        return let(
            low,
            lambda low: F.struct(
                first.alias("first"), last.alias("last"), (first_byte(first, size) - low).alias("at"),
                byte_range(data, low, high - low).alias("data"),
            ),
        )

    firsts = F.sequence(F.lit(1).cast("bigint"), F.col("page_count"), F.lit(run).cast("bigint"))
    segments = let(
        as_bytes(df, col),
        lambda data: let(size, lambda n: F.transform(firsts, lambda first: segment(data, n, first))),
    )
    step = chunk if origin == "start" else -chunk
    pages = let(
        F.col("_data"),
        lambda data: F.transform(
            F.sequence("_first", "_last"),
            lambda page: F.struct(
                page.alias("page"),
                let(at + (page - F.col("_first")) * step, lambda low: page_block(data, low, chunk, offset)).alias("block"),
            ),
        ),
    )
    parts = [F.col(f"_run.{name}").alias(f"_{name}") for name in ("first", "last", "at", "data")]
    return (
        df.select(*rest, col, pages_of(size, chunk).alias("page_count"))
        .select(*rest, "page_count", F.explode(segments).alias("_run"))
        .select(*rest, "page_count", *parts)
        .select(*rest, "page_count", F.explode(pages).alias("_page"))
        .select(*rest, "_page.page", "page_count", "_page.block")
    )


def read_page(
    df: DataFrame, col: str, page: int | Column, chunk: int = 500, offset: int = 0,
    origin: str = "start",
) -> DataFrame:
    """Adds ``block``: one page of each text; NULL if it has no such page."""
    page = _int(page).cast("bigint")
    size = F.octet_length(col).cast("bigint")
    first = (page - 1) * chunk if origin == "start" else size - page * chunk
    exists = (page >= 1) & (page <= pages_of(size, chunk))
    block = let(as_bytes(df, col), lambda data: page_block(data, first, chunk, offset))
    return df.withColumn("block", F.when(exists, block))


def page_nav(pages: DataFrame) -> DataFrame:
    """Adds ``prev_page``, ``next_page`` and ``last_page``; NULL where there is none."""
    page, count = F.col("page"), F.col("page_count")
    return pages.withColumns(
        {
            "prev_page": F.when(page > 1, page - 1),
            "next_page": F.when(page < count, page + 1),
            "last_page": F.when(count > 1, count),
        }
    )


def replace_in_lines(df: DataFrame, col: str, orig: str, new: str) -> DataFrame:
    """Every occurrence of ``orig`` within a line, taken literally, becomes ``new``."""
    if not orig:
        raise ValueError("nothing to replace")
    if "\n" in orig[:-1]:  # no line holds such text
        return df
    return df.withColumn(col, F.replace(F.col(col), F.lit(orig), F.lit(new)))
