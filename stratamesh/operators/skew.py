"""Hot keys: find them by a pre-aggregated count, then salt only those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side table up to which it may be broadcast; beyond, Spark plans an ordinary join.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted, never guessed), and that count
    (``limit`` + 1 stands for more)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, limit + 1
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), len(rows)


def hot_groups(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame | None:
    """Keys with over ``max_rows`` rows and ``_parts``, the number of pieces each should be split into; None if
    there are none. The count combines on the map side, so a hot key costs no skewed shuffle."""
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > max_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(max_rows)).cast("int").alias("_parts"))
    )
    hot, n = small(hot)
    return hot if n else None


def salt(df: DataFrame, hot: DataFrame | None, keys: list[str], by: Column) -> DataFrame:
    """Adds ``_salt``: a hash of ``by`` within the pieces of a hot key, 0 for any other key."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    return (
        df.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int"))
        .drop("_parts")
    )


def replicate(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """Gives each row of a hot key once for every piece of that key."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    return (
        df.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )


def lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """Left join to ``right``, which has each ``key`` once. Rows of a key in ``hot`` (``key``, ``_parts``) are spread by a
    hash of ``by``; rows without a key need no partner and are not shuffled to one place."""
    none = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key])
    some = left.where(F.col(key).isNotNull())
    if hot is None:
        met = some.join(right, key, "left")
    else:
        met = salt(some, hot, [key], F.col(by)).join(replicate(right, hot, [key]), [key, "_salt"], "left").drop("_salt")
    return met.select(none.columns).unionByName(none)
