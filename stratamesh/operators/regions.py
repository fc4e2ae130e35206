"""Aggregates per region and over the set of regions. Amounts are whole numbers, shares come last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.functions.scalar import half_up, ratio
from stratamesh.operators.mesh import both_ways, with_ends


def region_sums(cells: DataFrame, assignment: DataFrame, amounts: list[str], cell: str = "cell") -> DataFrame:
    """Cells and sums of ``amounts`` per region; regions below 0 are outside."""
    return cells.join(assignment.where("region >= 0"), cell).groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"), *[F.sum(a).alias(a) for a in amounts])


def label_shares(df: DataFrame, group: str, label: str, weight: Column, n: int | None = None) -> DataFrame:
    """group, label, w, share (0 where a group weighs nothing), place by weight then label; the first ``n`` places."""
    g = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.sum(weight).alias("w"))
    r = g.withColumn("share", half_up(ratio(F.col("w"), F.sum("w").over(Window.partitionBy(group))), 6)).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col("w").desc(), label)))
    return r if n is None else r.where(F.col("place") <= n)


def dominant(df: DataFrame, group: str, label: str, weight: Column) -> DataFrame:
    """The label with most weight of each group, ties to the smaller label: the first place without a window sort."""
    g = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.sum(weight).alias("w"))
    first = g.groupBy(group).agg(F.max("w").alias("w"))
    return g.join(first, [group, "w"]).groupBy(group).agg(F.min(label).alias(label), F.max("w").alias("w"))


def unpivot_amounts(df: DataFrame, keys: list[str], amounts: dict[str, str], label: str = "label", value: str = "amount") -> DataFrame:
    """One row per amount column, with its label."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias(label), F.col(c).alias(value)) for c, k in amounts.items()])).alias("_x")).select(*keys, f"_x.{label}", f"_x.{value}")


def region_neighbours(edges: DataFrame, assignment: DataFrame, cell: str = "cell") -> DataFrame:
    """a, b and the number of cell edges between them, both ways."""
    e = with_ends(edges, assignment, cell, ["region"]).where("region_u >= 0 AND region_v >= 0 AND region_u <> region_v")
    g = e.groupBy(F.least("region_u", "region_v").alias("u"), F.greatest("region_u", "region_v").alias("v")).agg(F.count(F.lit(1)).alias("n_edges"))
    return both_ways(g).join(g.select(F.col("u").alias("_a"), F.col("v").alias("_b"), "n_edges"), (F.least("u", "v") == F.col("_a")) & (F.greatest("u", "v") == F.col("_b"))).select(F.col("u").alias("a"), F.col("v").alias("b"), "n_edges")


def apportion(df: DataFrame, group: str, key: str, weight: str, total: str, out: str) -> DataFrame:
    """Largest remainders: ``total`` (a whole number, the same in a group) shared by weight so that it sums exactly;
    equal shares where all weights are 0; ties by key. Weights are whole numbers, so the remainders are exact."""
    w = Window.partitionBy(group)
    d = df.withColumn("_w", F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("decimal(18,0)")).withColumn("_sum", F.sum("_w").over(w))
    d = d.withColumn("_w", F.when(F.col("_sum") == 0, F.lit(1).cast("decimal(18,0)")).otherwise(F.col("_w"))).withColumn("_sum", F.sum("_w").over(w))
    d = d.withColumn("_part", (F.col("_w") * F.col(total).cast("decimal(18,0)")).cast("decimal(38,0)"))
    d = d.withColumn("_floor", F.expr("_part div _sum")).withColumn("_rest", F.expr("_part % _sum").cast("decimal(38,0)"))
    short = F.col(total) - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy(F.col("_rest").desc(), key))
    return d.withColumn(out, (F.col("_floor") + F.when(rank <= short, 1).otherwise(0)).cast("bigint")).drop("_w", "_sum", "_part", "_floor", "_rest")


def spread(totals: DataFrame, cells: DataFrame, key: str, value: str, weight: str, fallback: str, cell: str = "cell") -> DataFrame:
    """A key's total given to its cells by ``weight``, by ``fallback`` where the key's weights are all 0."""
    w = Window.partitionBy(key)
    c = cells.select(cell, key, F.col(weight).alias("_w"), F.col(fallback).alias("_f"))
    share = F.when(F.sum("_w").over(w) > 0, ratio(F.col("_w"), F.sum("_w").over(w))).otherwise(ratio(F.col("_f"), F.sum("_f").over(w)))
    return c.withColumn("_share", share).join(totals, key).select(cell, key, (F.col(value) * F.col("_share")).alias(value))


def compare_overlap(a: DataFrame, b: DataFrame, weight: DataFrame | None = None, cell: str = "cell") -> DataFrame:
    """Region pairs of two splits with the cells (and people) they share."""
    j = a.select(cell, F.col("region").alias("ra")).join(b.select(cell, F.col("region").alias("rb")), cell).where("ra >= 0 AND rb >= 0")
    j = j.join(weight, cell, "left") if weight is not None else j.withColumn("people", F.lit(0))
    return j.groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.coalesce("people", F.lit(0))).alias("people"))


def greedy_match(pairs: DataFrame, a: str, b: str, score: str, limit: int = 100_000) -> DataFrame:
    """One-to-one matching: pairs by score (ties by a, b), each taken if neither side is taken. Regions are few, so
    the pairs (at most ``limit``, else an error) are walked on the driver."""
    rows = pairs.orderBy(F.col(score).desc(), a, b).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} pairs")
    left, right, kept = set(), set(), []
    for r in rows:
        if r[a] not in left and r[b] not in right:
            left.add(r[a]), right.add(r[b]), kept.append(r)
    return pairs.sparkSession.createDataFrame(kept, pairs.schema)


def perimeter_sides(edges: DataFrame, assignment: DataFrame, cell: str = "cell") -> DataFrame:
    """region, sides: hexagon sides that are not shared with a cell of the same region."""
    same = with_ends(edges, assignment, cell, ["region"]).where("region_u = region_v").groupBy(F.col("region_u").alias("region")).agg((2 * F.count(F.lit(1))).alias("inner"))
    n = assignment.where("region >= 0").groupBy("region").agg((6 * F.count(F.lit(1))).alias("all"))
    return n.join(same, "region", "left").select("region", F.greatest(F.lit(0), F.col("all") - F.coalesce("inner", F.lit(0))).alias("sides"))
