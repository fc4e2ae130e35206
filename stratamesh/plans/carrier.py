"""The mesh, its attributes and layers, bound to the test tables: as DataFrames and as the same SQL for DuckDB.

Amounts are whole numbers (people, cents, thousandths of km2) so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamesh.operators import mesh as M
from stratamesh.session import table

SECTORS = ["AF", "NF", "NO", "RF"]


def newest_cells(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cell").orderBy(F.col("loaded_at").desc(), F.coalesce("area", F.lit(-1.0)).desc(), "id")
    return table(spark, d, "cells").withColumn("_rn", F.row_number().over(w)).where("_rn = 1 AND deleted_at IS NULL").drop("_rn", "loaded_at", "deleted_at")


def mesh(spark: SparkSession, d: str) -> DataFrame:
    """cell, id, lon, lat, milli (area), province, cd, csd, neighbours, people, cents, returned, s_AF..s_RF."""
    cells = newest_cells(spark, d)
    span = table(spark, d, "cells").agg(F.max("cell") + 1).first()[0]
    line = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % F.lit(span)).alias("cell"), F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
        F.concat("l_returnflag", "l_linestatus").alias("s"), "l_returnflag",
    )
    attrs = line.groupBy("cell").agg(
        F.sum("q").alias("people"), F.sum("c").alias("cents"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("q")).otherwise(0)).alias("returned"),
        *[F.sum(F.when(F.col("s") == s, F.col("c")).otherwise(0)).alias(f"s_{s}") for s in SECTORS],
    )
    amounts = ["people", "cents", "returned", *[f"s_{s}" for s in SECTORS]]
    return cells.join(attrs, "cell", "left").select(
        "cell", "id", "lon", "lat", F.coalesce(F.round(F.col("area") * 1000), F.lit(0)).cast("bigint").alias("milli"), "province", "cd", "csd", "neighbours",
        *[F.coalesce(a, F.lit(0)).cast("bigint").alias(a) for a in amounts],
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    return M.undirected_edges(newest_cells(spark, d), "cell", "neighbours")


def assignment(spark: SparkSession, d: str) -> DataFrame:
    """cell, region: provinces as dense numbers (a split that follows them)."""
    return M.actual_baseline(newest_cells(spark, d), "cell", "province")


def other_region(k: int = 7) -> Column:
    """The region of a cell in ``other_split``, from its lon and lat."""
    return F.pmod(F.floor((F.col("lon") + 180) / 9) + 3 * F.floor((F.col("lat") + 90) / 12), F.lit(k)).cast("int")


def other_split(spark: SparkSession, d: str, k: int = 7) -> DataFrame:
    """cell, region: another split of the same cells."""
    return newest_cells(spark, d).select("cell", other_region(k).alias("region"))


def places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "places").where("cell >= 0").select("place_key", "csd", "name", "province", F.coalesce("population", F.lit(0)).cast("bigint").alias("population"), "lng", "lat", "cell").distinct()


def cma_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cmas").select("cma_key", "name", F.explode("cells").alias("cell")).where("cell >= 0").distinct()


def boxes(spark: SparkSession, d: str, size: int = 5) -> DataFrame:
    """key, x0, x1, y0, y1: rectangles of part rows over the map, in degrees (exact in eighths)."""
    p = table(spark, d, "part")
    x0, y0 = -140 + F.col("p_partkey") % 83, 45 + F.col("p_partkey") % 29
    return p.select(F.col("p_partkey").alias("key"), x0.cast("double").alias("x0"), (x0 + F.col("p_size") / 8.0).alias("x1"), y0.cast("double").alias("y0"), (y0 + F.col("p_size") / 16.0).alias("y1"))


#: An outline that is not convex, and a hole in it, in eighths of a box's sides.
OUTLINE = [(0, 0), (4, 2), (8, 0), (6, 4), (8, 8), (3, 6), (0, 8), (1, 4)]
HOLE = [(3, 3), (5, 3), (5, 5), (3, 5)]


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """key, rings: the boxes as polygons with a hole (coordinates exact in 128ths)."""
    at = lambda a, b: F.struct((F.col("x0") + (F.col("x1") - F.col("x0")) * F.lit(a / 8)).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * F.lit(b / 8)).alias("y"))
    return boxes(spark, d).select("key", F.array(*[F.array(*[at(a, b) for a, b in r]) for r in (OUTLINE, HOLE)]).alias("rings"))


def unit_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unit_rows").select("unit_row_key", "unit_id", "name", "status", "sovereign", "capital", "valid_from", "valid_to", "truth", "geometry_ref").distinct()


def event_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unit_events").where("event_kind <> 'check' AND event_date IS NOT NULL").select(F.col("event_date").alias("day"), "unit_id", "event_kind").distinct()


def _crossed(x: str, y: str, box: str) -> str:
    at = lambda c, k, v: f"({box}.{c}0 + ({box}.{c}1 - {box}.{c}0) * CAST({v / 8} AS DOUBLE))"
    out = []
    for r in (OUTLINE, HOLE):
        for (a, b), (c, e) in zip(r, r[1:] + r[:1]):
            if b != e:
                ax, ay, bx, by = at("x", 0, a), at("y", 0, b), at("x", 0, c), at("y", 0, e)
                out.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END")
    return " + ".join(out)


def inside(x: str, y: str, box: str = "b") -> str:
    """SQL: the point is in the polygon of a row of ``boxes``."""
    return f"({box}.x0 <= {x} AND {x} <= {box}.x1 AND {box}.y0 <= {y} AND {y} <= {box}.y1 AND ({_crossed(x, y, box)}) % 2 = 1)"


_SUMS = ", ".join(f"CAST(sum(CASE WHEN s = '{s}' THEN c ELSE 0 END) AS BIGINT) AS s_{s}" for s in SECTORS)
MESH_SQL = f"""
newest AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY cell ORDER BY loaded_at DESC, coalesce(area, -1) DESC, id) = 1),
attrs AS (
  SELECT cell, CAST(sum(q) AS BIGINT) AS people, CAST(sum(c) AS BIGINT) AS cents, CAST(sum(CASE WHEN l_returnflag = 'R' THEN q ELSE 0 END) AS BIGINT) AS returned, {_SUMS}
  FROM (SELECT l_orderkey % (SELECT max(cell) + 1 FROM cells) AS cell, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_returnflag || l_linestatus AS s, l_returnflag FROM lineitem)
  GROUP BY cell),
mesh AS (
  SELECT n.cell, id, lon, lat, CAST(coalesce(round(area * 1000), 0) AS BIGINT) AS milli, province, cd, csd, neighbours, coalesce(people, 0) AS people, coalesce(cents, 0) AS cents, coalesce(returned, 0) AS returned,
    {", ".join(f"coalesce(s_{s}, 0) AS s_{s}" for s in SECTORS)}
  FROM newest n LEFT JOIN attrs a ON a.cell = n.cell WHERE deleted_at IS NULL),
edges AS (SELECT DISTINCT least(cell, n) AS u, greatest(cell, n) AS v FROM (SELECT cell, unnest(neighbours) AS n FROM mesh) WHERE n <> cell AND n IN (SELECT cell FROM mesh)),
assigned AS (SELECT cell, CAST(dense_rank() OVER (ORDER BY province) - 1 AS INTEGER) AS region FROM mesh),
other AS (SELECT cell, CAST(((CAST(floor((lon + 180) / 9) + 3 * floor((lat + 90) / 12) AS BIGINT) % 7) + 7) % 7 AS INTEGER) AS region FROM mesh),
spots AS (SELECT DISTINCT place_key, csd, name, province, coalesce(population, 0) AS population, lng, lat, cell FROM places WHERE cell >= 0),
metro AS (SELECT DISTINCT cma_key, name, cell FROM (SELECT cma_key, name, unnest(cells) AS cell FROM cmas) WHERE cell >= 0),
boxes AS (SELECT p_partkey AS key, CAST(-140 + p_partkey % 83 AS DOUBLE) AS x0, -140 + p_partkey % 83 + p_size / CAST(8 AS DOUBLE) AS x1, CAST(45 + p_partkey % 29 AS DOUBLE) AS y0, 45 + p_partkey % 29 + p_size / CAST(16 AS DOUBLE) AS y1 FROM part),
urows AS (SELECT DISTINCT unit_row_key, unit_id, name, status, sovereign, capital, valid_from, valid_to, truth, geometry_ref FROM unit_rows),
days AS (SELECT DISTINCT event_date AS day, unit_id, event_kind FROM unit_events WHERE event_kind <> 'check' AND event_date IS NOT NULL)"""


def sql(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{MESH_SQL}{',' + extra if extra else ''}\n{body}"
