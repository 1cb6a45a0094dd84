"""Listings of whole path inventories: all directories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bind import let
from tickloom.functions.paths import extension, path_parts, within


def _named(path: Column) -> Column:
    """The path without a slash at its end."""
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "(?s)/$", ""))


def rejected_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows :func:`list_children` cannot place, with ``reason``: no path, relative, or an empty part."""
    path = F.col(path_col)
    reason = (
        F.when(path.isNull(), "no path")
        .when(~path.startswith("/"), "relative")
        .when((path != "/") & path_parts(_named(path)).isNull(), "empty part")
    )
    return paths.withColumn("reason", reason).filter("reason IS NOT NULL")


def list_children(
    paths: DataFrame,
    parent: str | None = None,
    extensions: tuple[str, ...] = (),
    path_col: str = "path",
    dir_col: str | None = None,
) -> DataFrame:
    """(parent, name, isdir, type, path) of every directory's children.

    Directories come first, then names in order. With ``extensions`` only files of
    those types are kept, and all directories. A path that ends in ``/``, or whose row says so
    in ``dir_col``, is a directory itself, listed even if nothing is below it. What cannot be placed
    is given by :func:`rejected_paths`. Each path gives one row per level,
    reduced to distinct children on the map side before anything is shuffled; for a
    single ``parent`` it gives one row.
    """
    path = F.col(path_col)
    isdir = path.endswith("/") if dir_col is None else path.endswith("/") | F.coalesce(F.col(dir_col), F.lit(False))
    rows = paths.select(_named(path).alias("path"), isdir.alias("own")).filter("path LIKE '/_%'")
    parts, level = F.col("parts"), F.col("level")
    levels = F.sequence(F.lit(1), F.size(parts))
    if parent is not None:
        parent = "/" + parent.strip("/")
        rows = rows.filter(within("path", parent) & (F.col("path") != parent))
        levels = F.array(F.lit(len([p for p in parent.split("/") if p]) + 1))
    above = F.slice(parts, F.lit(1), level - 1)
    children = (
        rows.select(path_parts("path").alias("parts"), "own")
        .filter("parts IS NOT NULL")
        .select("parts", "own", F.explode(levels).alias("level"))
        .select(
            F.concat(F.lit("/"), F.array_join(above, "/")).alias("parent"),
            F.get(parts, level - 1).alias("name"),
            ((level < F.size(parts)) | F.col("own")).alias("isdir"),
        )
        .groupBy("parent", "name")
        .agg(F.max("isdir").alias("isdir"))
    )
    kind = F.when(F.col("isdir"), "dir").otherwise(extension("name"))
    children = children.withColumn("type", kind)
    if extensions:
        children = children.filter(F.col("isdir") | F.col("type").isin(*extensions))
    below = F.when(F.col("parent") == "/", F.lit("/")).otherwise(F.concat("parent", F.lit("/")))
    return children.withColumn("path", F.concat(below, "name")).orderBy(
        "parent", F.desc("isdir"), "name"
    )


def breadcrumbs(paths: DataFrame, home: str = "/", path_col: str = "path") -> DataFrame:
    """Adds ``crumbs``: array of (name, path) from home down to the path.

    NULL for paths outside home or with an empty part.
    """
    home = "/" + home.strip("/")
    skip = 0 if home == "/" else len(home.strip("/").split("/"))
    top = F.struct(F.lit("home").alias("name"), F.lit(home).alias("path"))

    def below(parts: Column) -> Column:
        def crumb(i: Column) -> Column:
            prefix = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))
            return F.struct(F.get(parts, i - 1).alias("name"), prefix.alias("path"))

        crumbs = F.transform(F.sequence(F.lit(skip + 1), F.size(parts)), crumb)
        return F.when(F.size(parts) > skip, F.concat(F.array(top), crumbs))

    crumbs = F.when(F.col(path_col) == home, F.array(top)).when(
        within(path_col, home), let(path_parts(path_col), below)
    )
    return paths.withColumn("crumbs", crumbs)
