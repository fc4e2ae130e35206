"""References to records that are not there, are deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.operators.skew import hot_groups, replicate, salt


def orphan_references(refs: DataFrame, parents: DataFrame, *, max_group_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``refs`` (``domain``, ``ref`` text, ``at`` timestamp, any payload columns) that point to no row of
    ``parents`` (``domain``, ``ref``, ``loaded_at``, ``deleted_at``) valid at ``at``, with their ``reason``:
    missing (no such parent), late (every row of it is loaded after the reference) or deleted (else).

    Method: references and parent keys are co-partitioned by key, sorted by time and merged in one pass; a running
    maximum of the parents' ends says whether any of them is valid at a reference. A marker at the head of each key
    says that the key exists at all, so no frame looks beyond the current row and nothing is buffered. References
    never meet each other: a key with over ``max_group_rows`` of them is salted and its parents are given to every
    piece.

    Defined results: null ``ref`` is no reference; a parent without ``loaded_at`` exists but is never valid; a
    reference without ``at`` finds no valid parent (reason deleted if the key exists); deleted at or before loading
    is never valid; repeated parents change nothing; repeated references stay repeated; an empty parent table makes
    every reference missing. ``refs`` must not have columns named like those of the merge (leading underscore).
    """
    key = ["domain", "ref"]
    load = [c for c in refs.columns if c not in {*key, "at"}]
    r = refs.where("domain IS NOT NULL AND ref IS NOT NULL")
    p = parents.select("domain", "ref", "loaded_at", "deleted_at").where("domain IS NOT NULL AND ref IS NOT NULL")
    end = F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz"))
    ends = p.where("loaded_at IS NOT NULL").select(*key, F.lit(1).alias("_kind"), F.col("loaded_at").cast("timestamp_ntz").alias("at"), end.alias("_end"), F.lit(None).cast("boolean").alias("_late"))
    head = p.groupBy(*key).agg(F.min("loaded_at").cast("timestamp_ntz").alias("at"), F.bool_and(F.col("loaded_at").isNotNull()).alias("_late"))
    head = head.select(*key, F.lit(0).alias("_kind"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("timestamp_ntz").alias("_end"), "_late")
    hot = hot_groups(r.select(*key), key, max_group_rows)
    mine = salt(r, hot, key, F.xxhash64(*load)).select(*key, "_salt", F.lit(2).alias("_kind"), F.col("at").cast("timestamp_ntz").alias("at"), *load)
    rows = replicate(head.unionByName(ends), hot, key).unionByName(mine, allowMissingColumns=True)
    w = Window.partitionBy(*key, "_salt").orderBy(F.col("_kind") != 0, F.col("at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        rows.withColumn("_until", F.max("_end").over(w))
        .withColumn("_head", F.max(F.when(F.col("_kind") == 0, F.struct(F.lit(1).alias("one"), F.col("_late").alias("late")))).over(w))
        .where((F.col("_kind") == 2) & ~F.coalesce(F.col("_until") > F.col("at"), F.lit(False)))
    )
    return merged.select(
        *key, "at", *load,
        F.when(F.col("_head").isNull(), "missing")
        .when(F.col("_until").isNull() & F.col("_head.late") & F.col("at").isNotNull(), "late")
        .otherwise("deleted").alias("reason"),
    )
