"""Dealing rows out to tasks before a step that costs far more than moving them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Pairs of one key that a join may make in one place.
TILE = 1 << 20
# Tiles a partition gets; where there would be more, tiles grow instead, up to so many pairs.
_TILES, _LARGEST = 64, 1 << 28


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows that are about to grow a lot, over all shuffle partitions."""
    return df.repartition(_partitions(df), *keys)


def deal(df: DataFrame) -> DataFrame:
    """Wide rows, each in turn to the next shuffle partition, before a step that costs far more than moving them.

    A count of partitions that is given keeps adaptive execution from putting them together by their compressed
    bytes, which say little about the work: markup packs to a tenth.
    """
    return df.repartition(_partitions(df))


def tiled_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, most: int = TILE) -> DataFrame:
    """Inner join on ``key`` whose work is dealt out by the pairs it makes, not by the rows it reads.

    ``sizes`` holds (key, lefts, rights), the rows of each key on either side. A key with more than ``most``
    pairs becomes a grid of tiles of about that many: rows of a side are dealt to its slices by their hash and
    repeated for each slice of the other side, so every pair meets in one tile. Tiles are as near to squares as
    the sides allow, which keeps the repeats few. Rows alike in all columns share a slice. The join is asked for
    as a merge, since the optimizer knows nothing of the repeats.

    Tiles of a fixed size would make repeats grow with the pairs, which grow with the square of the input. So the number of
    tiles is bounded and their size grows instead: what is shuffled then grows as the rows do.
    """
    lefts, rights = F.col("lefts").cast("double"), F.col("rights").cast("double")
    share = F.sum(lefts * rights) / (_TILES * _partitions(sizes))
    pairs = sizes.agg(F.greatest(F.lit(float(most)), F.least(share, F.lit(float(_LARGEST))))).scalar()
    cuts = sizes.filter(lefts * rights > pairs).select(
        key,
        F.ceil(lefts / F.greatest(F.sqrt(pairs), pairs / rights)).alias("_lefts"),
        F.ceil(rights / F.greatest(F.sqrt(pairs), pairs / lefts)).alias("_rights"),
    )

    def dealt(side: DataFrame, mine: str, other: str, slice_of: tuple[str, str]) -> DataFrame:
        hashed = [f.name for f in side.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        own: Column = F.pmod(F.xxhash64(*hashed), F.coalesce(mine, F.lit(1).cast("bigint")))
        every = F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1).cast("bigint")) - 1)
        tiles = side.join(cuts, key, "left").withColumns({slice_of[0]: own}).withColumn(slice_of[1], F.explode(every))
        return spread(tiles.drop("_lefts", "_rights"), key, "_i", "_j")

    a = dealt(left, "_lefts", "_rights", ("_i", "_j"))
    b = dealt(right, "_rights", "_lefts", ("_j", "_i"))
    return a.hint("merge").join(b, [key, "_i", "_j"]).drop("_i", "_j")


# Rows that a task packs at once, and rows of a part.
_PACKED, _PART = 1 << 20, 1 << 19


def _pack(rows: DataFrame, part: Column) -> DataFrame:
    """(part, packed): the rows in compressed columns, those of a part that a task has at hand together."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        parts = table.column("_part").to_numpy()
        order = np.argsort(parts, kind="stable")
        table, parts = table.drop_columns("_part").take(order).combine_chunks(), parts[order]
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(parts)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(start, end - start))
            yield pa.RecordBatch.from_pydict({"part": parts[start : start + 1], "packed": [sink.getvalue().to_pybytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _PACKED:
                yield from packed(held)
                held = []
        if sum(b.num_rows for b in held):
            yield from packed(held)

    return rows.withColumn("_part", part).mapInArrow(run, "part int, packed binary")


def packed_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """Inner join on ``keys`` of tables with about as many rows, which travel as compressed columns.

    Rows as Spark shuffles them take several times the bytes they have in Parquet, and sorting them takes as many again. ``by``
    are expressions of the keys; rows alike in them go to one part and lie side by side there, so they should be few enough for
    a task and alike enough to be packed well. Parts have about half a million rows of ``left``, whatever the
    number of partitions. Columns other than the keys are named differently; null keys match nothing.
    """
    parts = max(1, -(-left.count() // _PART), _partitions(left))
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    others = [f for f in right.schema if f.name not in keys]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in [*left.schema, *others])])

    def unpacked(side: pa.Table) -> pa.Table | None:
        tables = [pa.ipc.open_stream(value.as_buffer()).read_all() for value in side.column("packed")]
        return pa.concat_tables(tables) if tables else None

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = unpacked(a), unpacked(b)
        if a is None or b is None:
            return empty
        found = a.select(keys).append_column("_a", pa.array(np.arange(a.num_rows))).join(
            b.select(keys).append_column("_b", pa.array(np.arange(b.num_rows))), keys, join_type="inner", use_threads=False)
        a, b = a.take(found.column("_a")), b.drop_columns(keys).take(found.column("_b"))
        return pa.table([*a.columns, *b.columns], schema=empty.schema)

    empty = to_arrow_schema(schema).empty_table()
    sides = [_pack(rows, part).repartition(parts, "part").groupBy("part") for rows in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(join, schema)
