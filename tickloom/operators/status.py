"""Application status from JSON snapshots of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.clean import json_or_else

# What a cluster's status is called.
FREE, BUSY, DOWN = 0, -1, -2

APPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField(
                "attempts",
                T.ArrayType(T.StructType([T.StructField("completed", T.BooleanType())])),
            ),
        ]
    )
)


def apps_column(body: Column) -> Column:
    """Apps (id, name, completed) of one snapshot; NULL if it cannot be read.

    An app is completed when all its attempts are, so also when it has none.
    """
    parsed = json_or_else(body, APPS)
    whole = F.filter(
        parsed,
        lambda a: a["id"].isNotNull() & a["name"].isNotNull() & a["attempts"].isNotNull(),
    )
    return F.transform(
        whole,
        lambda a: F.struct(
            a["id"].alias("app_id"),
            a["name"].alias("app_name"),
            F.forall(a["attempts"], lambda t: t["completed"]).alias("completed"),
        ),
    )


def parse_apps(snapshots: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per app and snapshot; ``_corrupt`` keeps a body that cannot be read.

    A snapshot without a single app gives one row of NULLs, so it is not lost.
    """
    body = F.col(body_col)
    rest = [c for c in snapshots.columns if c != body_col]
    # settled before the rows are multiplied, so that no body is copied per app
    parsed = snapshots.withColumn("_apps", apps_column(body)).withColumn(
        "_corrupt", F.when(F.col("_apps").isNull(), body)
    )
    return parsed.select(*rest, "_corrupt", F.explode_outer("_apps").alias("_app")).select(
        *rest, "_app.*", "_corrupt"
    )


def running_apps(apps: DataFrame) -> DataFrame:
    """Rows of apps not completed yet."""
    return apps.filter(~F.col("completed"))


def running_apps_of(snapshots: DataFrame, body_col: str = "body") -> DataFrame:
    """The running apps of snapshots, a row each; completed ones are dropped before rows are made."""
    rest = [c for c in snapshots.columns if c != body_col]
    return snapshots.select(*rest, F.explode(running_column(F.col(body_col))).alias("_app")).select(*rest, "_app.*")


def running_column(body: Column) -> Column:
    """Running apps of one snapshot; NULL, not empty, without a snapshot."""
    return F.filter(apps_column(body), lambda a: ~a["completed"])


def cluster_status(snapshots: DataFrame, body_col: str = "body") -> DataFrame:
    """Adds ``cluster_status``: 0 free, -1 busy, -2 down. No shuffle; batch or stream."""
    count = F.size(running_column(F.col(body_col)))
    status = F.when(count.isNull() | (count < 0), DOWN).when(count == 0, FREE).otherwise(BUSY)
    return snapshots.withColumn("cluster_status", status)
