"""Operators on a mesh of cells: scopes, edges, borders, derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.functions.scalar import half_up, in_polygon, ratio


def undirected_edges(cells: DataFrame, cell: str, neighbours: str) -> DataFrame:
    """u < v of each pair of cells of which either lists the other; unknown, null and own indices are left out."""
    told = cells.select(F.col(cell).alias("a"), F.explode(neighbours).alias("b")).where("b IS NOT NULL AND a <> b")
    known = told.join(cells.select(F.col(cell).alias("b")), "b", "left_semi")
    return known.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def with_ends(edges: DataFrame, cells: DataFrame, cell: str, columns: list[str]) -> DataFrame:
    """Edges with ``columns`` of both ends as <column>_u and <column>_v."""
    for end in ("u", "v"):
        side = cells.select(F.col(cell).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        edges = edges.join(side, end)
    return edges


def scope_graph(edges: DataFrame, scope: DataFrame, cell: str) -> DataFrame:
    """The induced subgraph: edges with both ends in ``scope``."""
    s = scope.select(F.col(cell).alias("u")).distinct()
    return edges.join(s, "u", "left_semi").join(s.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v")


def polygon_scope(cells: DataFrame, rings: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Cells whose centre lies in a polygon (rings of structs x, y), by even-odd ray cast after a box filter."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = (F.col(lon) >= F.array_min(xs)) & (F.col(lon) <= F.array_max(xs)) & (F.col(lat) >= F.array_min(ys)) & (F.col(lat) <= F.array_max(ys))
    return cells.where(box & in_polygon(rings, F.col(lon), F.col(lat)))


def actual_baseline(cells: DataFrame, cell: str, group: str) -> DataFrame:
    """The groups (say provinces) as dense region numbers in order of their names."""
    codes = cells.select(group).distinct().withColumn("region", F.dense_rank().over(Window.orderBy(group)) - 1)
    return cells.select(cell, group).join(codes, group).select(cell, F.col("region").cast("int").alias("region"))


def snap_edges(edges: DataFrame, cells: DataFrame, cell: str, *, layers: list[str], graticule: float | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """u, v, snap: whether a selected layer runs between the ends, i.e. a column of ``layers`` differs, or a line of
    the graticule (every ``graticule`` degrees) passes."""
    e = with_ends(edges, cells, cell, [*layers, lon, lat])
    tests = [~F.col(f"{c}_u").eqNullSafe(F.col(f"{c}_v")) for c in layers]
    if graticule:
        tests += [F.floor(F.col(f"{c}_u") / graticule) != F.floor(F.col(f"{c}_v") / graticule) for c in (lon, lat)]
    any_ = F.lit(False)
    for t in tests:
        any_ = any_ | t
    return e.select("u", "v", any_.alias("snap"))


def classify_border(edges: DataFrame, cells: DataFrame, assignment: DataFrame, cell: str, kinds: list[tuple[str, str]]) -> DataFrame:
    """u, v, kind, label of the edges between different regions: the first of ``kinds`` (kind, column) whose column
    differs between the ends, else open; the label joins the two values in order."""
    e = with_ends(edges.join(assignment.select(F.col(cell).alias("u"), F.col("region").alias("ru")), "u").join(assignment.select(F.col(cell).alias("v"), F.col("region").alias("rv")), "v").where("ru <> rv"), cells, cell, [c for _, c in kinds])
    kind, label = F.lit("open"), F.lit(None).cast("string")
    for name, c in reversed(kinds):
        differ = ~F.col(f"{c}_u").eqNullSafe(F.col(f"{c}_v"))
        kind = F.when(differ, name).otherwise(kind)
        label = F.when(differ, F.concat_ws(" / ", F.least(F.col(f"{c}_u"), F.col(f"{c}_v")), F.greatest(F.col(f"{c}_u"), F.col(f"{c}_v")))).otherwise(label)
    return e.select("u", "v", kind.alias("kind"), label.alias("label"))


def rank_unit(df: DataFrame, value: str, key: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """Rank in [0, 1] by value, ties by key, within groups: (place - 1) / max(1, n - 1).

    Without groups the order is over all rows: places are counted by a range sort in two levels (per value bucket,
    then within it), so no single task holds the table.
    """
    if groups:
        w = Window.partitionBy(*groups).orderBy(value, key)
        n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
        return df.withColumn(out, (F.row_number().over(w) - 1) / F.greatest(F.lit(1), n - 1))
    return global_position(df, [value, key], "_pos", "_n").withColumn(out, F.col("_pos") / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_pos", "_n")


def global_position(df: DataFrame, order: list[str], out: str, total: str | None = None) -> DataFrame:
    """0-based position in a total order over all rows. Rows are put in buckets of the first column by sampled
    quantiles; positions inside a bucket are added to the sizes of the buckets before it. A value that is very
    frequent is one bucket."""
    first = order[0]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set((df.agg(F.percentile_approx(F.col(first).cast("double"), [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0]) or []))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(first).cast("double"))) if cuts else F.lit(0)
    b = df.withColumn("_b", F.coalesce(bucket, F.lit(-1)))
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    starts = sizes.select("_b", F.coalesce(F.sum("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_m").over(Window.partitionBy(F.lit(1))).alias("_all"))
    w = Window.partitionBy("_b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    r = b.withColumn(out, F.row_number().over(w) - 1).join(F.broadcast(starts), "_b").withColumn(out, (F.col(out) + F.col("_start")).cast("bigint"))
    return (r.withColumn(total, F.col("_all")) if total else r).drop("_b", "_start", "_all")


def lens_columns(cells: DataFrame, *, people: str, cents: str, milli: str, primary: list[str], code: str, most_codes: int = 1_000) -> DataFrame:
    """Derived columns: product per head (thousands), density, share of the primary sectors, 0/1 indicators of a code.
    Over ``most_codes`` codes are an error, none is left out."""
    codes = [r[0] for r in cells.select(code).where(F.col(code).isNotNull()).distinct().orderBy(code).limit(most_codes + 1).collect()]
    if len(codes) > most_codes:
        raise ValueError(f"over {most_codes} codes in {code}")
    return cells.select(
        "*",
        half_up(ratio(F.col(cents), F.col(people) * 100), 3).alias("product_per_head"),
        half_up(ratio(F.col(people) * 1000, F.col(milli)), 4).alias("density"),
        half_up(ratio(sum(F.col(c) for c in primary), F.col(cents)), 4).alias("primary_share"),
        *[F.when(F.col(code) == c, 1).otherwise(0).alias(f"{code}_{c}") for c in codes],
    )


def pin_cells(groups: DataFrame, cells: DataFrame, *, csd: str, place_cell: str, cell: str = "cell") -> DataFrame:
    """group, cell: all cells of the group's csd, else the place's own cell."""
    of_csd = cells.select(F.col("csd").alias(csd), F.col(cell).alias("_c"))
    g = groups.join(of_csd, csd, "left")
    return g.select("grp", F.coalesce("_c", place_cell).alias("cell")).where("cell IS NOT NULL").distinct()


def carve_metros(metro: DataFrame, scope: DataFrame, population: DataFrame, least: int) -> DataFrame:
    """Metros of at least ``least`` people whose cells lie wholly in scope: (cma_key, cells)."""
    inside = metro.join(scope.select("cell").withColumn("_in", F.lit(1)), "cell", "left").join(population, "cell", "left")
    g = inside.groupBy("cma_key").agg(F.count(F.lit(1)).alias("n_cells"), F.count("_in").alias("n_in"), F.sum(F.coalesce("people", F.lit(0))).alias("people"))
    return g.where((F.col("n_cells") == F.col("n_in")) & (F.col("people") >= least)).select("cma_key", "n_cells", "people")
