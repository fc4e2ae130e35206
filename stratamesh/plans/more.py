"""Smaller queries: cell-set expressions, names, colours, edits, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamesh.functions.scalar import half_up
from stratamesh.operators import cellsets as X
from stratamesh.operators import regions as R
from stratamesh.operators import spatial as P
from stratamesh.operators.temporal import valid_on
from stratamesh.plans import carrier as C
from stratamesh.plans import problems
from stratamesh.plans.carrier import sql
from stratamesh.plans.registry import Registry
from stratamesh.session import cut, table
from stratamesh.sources.nested import shred

query = Registry()


def _sets(spark: SparkSession, d: str) -> X.CellSets:
    return X.CellSets(C.newest_cells(spark, d), C.places(spark, d))


@query(sql("""SELECT cell FROM mesh WHERE (province IN ('AB', 'SK') OR (lon >= -100 AND lon < -80 AND lat >= 50 AND lat < 70)) AND NOT lat >= 65
EXCEPT SELECT cell FROM mesh m WHERE EXISTS (SELECT 1 FROM spots s WHERE s.population >= 20000 AND (m.lon - s.lng) * (m.lon - s.lng) + (m.lat - s.lat) * (m.lat - s.lat) <= 1)"""))
def geometry_expr(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d)({"minus": [{"union": [{"province": ["AB", "SK"]}, {"box": [-100, 50, -80, 70]}]}, {"north_of": 65}, {"buffer": {"people": 20000, "degrees": 1.0}}]})


@query(sql("SELECT m.cell, coalesce((SELECT min(key) FROM boxes b WHERE b.x0 <= lon AND lon < b.x1 AND b.y0 <= lat AND lat < b.y1), n) AS key FROM mesh m JOIN (SELECT cell AS c, key AS n FROM mesh, boxes QUALIFY row_number() OVER (PARTITION BY cell ORDER BY (lon - x0) * (lon - x0) + (lat - y0) * (lat - y0), key) = 1) x ON x.c = m.cell"))
def partition_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Cells to the box that holds them (smallest key), the rest to the box whose corner is nearest."""
    cells, b = C.newest_cells(spark, d).select("cell", "lon", "lat"), C.boxes(spark, d)
    held = P.in_boxes(cells, b).groupBy("cell").agg(F.min("key").alias("key"))
    rest = cells.join(held, "cell", "left_anti")
    return held.unionByName(P.nearest(rest, b.select("key", F.col("x0").alias("tlon"), F.col("y0").alias("tlat")), point="cell", target="key").select("cell", "key"))


@query(sql("SELECT m.cell, coalesce(e.region, o.region) AS region FROM mesh m JOIN other o ON o.cell = m.cell LEFT JOIN (SELECT cell, CAST(place_key % 7 AS INTEGER) AS region FROM spots QUALIFY row_number() OVER (PARTITION BY cell ORDER BY place_key DESC) = 1) e ON e.cell = m.cell"))
def paint_edit(spark: SparkSession, d: str) -> DataFrame:
    """Point edits over a split: the last edit of a cell wins."""
    e = C.places(spark, d).groupBy("cell").agg(F.max("place_key").alias("k")).select("cell", (F.col("k") % 7).cast("int").alias("edit"))
    return C.other_split(spark, d).join(e, "cell", "left").select("cell", F.coalesce("edit", "region").alias("region"))


@query(sql("SELECT place_key FROM spots s WHERE NOT EXISTS (SELECT 1 FROM mesh m WHERE m.cell = s.cell AND m.csd = s.csd)"))
def control_points(spark: SparkSession, d: str) -> DataFrame:
    """Places whose stated csd is not that of their cell."""
    m = C.newest_cells(spark, d).select("cell", "csd")
    return C.places(spark, d).join(m, ["cell", "csd"], "left_anti").select("place_key")


@query(sql("""SELECT region, place_key FROM (SELECT o.region, s.place_key, row_number() OVER (PARTITION BY o.region ORDER BY CASE WHEN p.region = o.region THEN 0 ELSE 1 END, s.place_key) AS rn
  FROM (SELECT DISTINCT region FROM other) o JOIN spots s ON s.name LIKE 'Port %' LEFT JOIN other p ON p.cell = s.cell) WHERE rn = 1"""))
def capital_pin(spark: SparkSession, d: str) -> DataFrame:
    """A named place inside the region, else the first anywhere."""
    split = C.other_split(spark, d)
    s = C.places(spark, d).where(F.col("name").startswith("Port "))
    inside = s.join(split, "cell").groupBy("region").agg(F.min("place_key").alias("own"))
    any_ = s.agg(F.min("place_key").alias("any"))
    return split.select("region").distinct().join(inside, "region", "left").crossJoin(F.broadcast(any_)).select("region", F.coalesce("own", "any").alias("place_key")).where("place_key IS NOT NULL")


@query(sql("SELECT s.place_key, coalesce(m.cd, p.cd, x.cd) AS cd FROM spots s LEFT JOIN mesh m ON m.cell = s.cell LEFT JOIN (SELECT csd, min(cd) AS cd FROM mesh GROUP BY csd) p ON p.csd = s.csd JOIN (SELECT place_key AS k, m2.cd FROM spots, mesh m2 QUALIFY row_number() OVER (PARTITION BY place_key ORDER BY (lng - m2.lon) * (lng - m2.lon) + (spots.lat - m2.lat) * (spots.lat - m2.lat), m2.cell) = 1) x ON x.k = s.place_key"))
def place_to_hex(spark: SparkSession, d: str) -> DataFrame:
    """Parent of a place: by its cell, else by its csd, else by the nearest cell."""
    m, p = C.newest_cells(spark, d), C.places(spark, d)
    a = p.join(m.select("cell", F.col("cd").alias("a")), "cell", "left").join(m.groupBy("csd").agg(F.min("cd").alias("b")), "csd", "left").select("place_key", "lng", "lat", F.coalesce("a", "b").alias("cd"))
    rest = a.where("cd IS NULL")
    near = P.nearest(rest, m.select(F.col("cell").alias("t"), F.col("lon").alias("tlon"), F.col("lat").alias("tlat")), point="place_key", target="t", lon="lng")
    return a.where("cd IS NOT NULL").select("place_key", "cd").unionByName(near.join(m.select(F.col("cell").alias("t"), "cd"), "t").select("place_key", "cd"))


@query("""SELECT p_size, p_brand, count(*) AS n, CAST(row_number() OVER (ORDER BY p_size, p_brand) - 1 AS INTEGER) AS key FROM part WHERE p_size >= 7 GROUP BY p_size, p_brand""")
def river_network(spark: SparkSession, d: str) -> DataFrame:
    """Lines of at least an order, grouped by order and name, with a running key (the groups are few)."""
    g = table(spark, d, "part").where("p_size >= 7").groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("key", F.row_number().over(Window.orderBy("p_size", "p_brand")) - 1)


@query("""SELECT s_suppkey, n_name AS licence, regexp_extract(s_name || ' https://x.test/' || s_suppkey, 'https?://\\S+') AS url FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def attribution_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    text = F.concat("s_name", F.lit(" https://x.test/"), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", F.col("n_name").alias("licence"), F.regexp_extract(text, r"https?://\S+", 0).alias("url"))


@query("""WITH s AS (SELECT n AS id FROM range(0, (SELECT max(cell) + 1 FROM cells)) t(n)), c AS (SELECT cell, count(*) AS k FROM cells GROUP BY cell)
SELECT id, CASE WHEN k IS NULL THEN 'missing' ELSE 'repeated' END AS state FROM s LEFT JOIN c ON c.cell = s.id WHERE k IS NULL OR k > 1""")
def set_cover(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the expected range that are missing or repeated."""
    c = table(spark, d, "cells").groupBy(F.col("cell").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    top = table(spark, d, "cells").agg(F.max("cell") + 1).first()[0] or 0
    return spark.range(0, top).join(c, "id", "left").where("k IS NULL OR k > 1").select("id", F.when(F.col("k").isNull(), "missing").otherwise("repeated").alias("state"))


@query("SELECT DISTINCT unit_id FROM unit_events WHERE unit_id IS NOT NULL EXCEPT SELECT unit_id FROM unit_rows")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "unit_events").select("unit_id").where("unit_id IS NOT NULL").distinct()
    return e.join(table(spark, d, "unit_rows").select("unit_id"), "unit_id", "left_anti")


@query(sql("SELECT a.key, count(b.key) AS ring_depth, count(b.key) % 2 = 0 AS is_outer FROM boxes a LEFT JOIN boxes b ON b.key <> a.key AND b.x0 <= a.x0 AND a.x1 <= b.x1 AND b.y0 <= a.y0 AND a.y1 <= b.y1 AND (b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) GROUP BY a.key"))
def nest_holes(spark: SparkSession, d: str) -> DataFrame:
    """How many larger boxes hold each box, and the parity that makes it an outline or a hole."""
    b = C.boxes(spark, d)
    sides = {"x0": "a0", "x1": "a1", "y0": "c0", "y1": "c1"}
    kinds = cut(b.groupBy(*sides).agg(F.count(F.lit(1)).alias("many")))  # equal boxes hold, and are held by, the same
    inner = kinds.select(*[F.col(k).alias(v) for k, v in sides.items()])
    size = lambda a, b_, c, e: (F.col(b_) - F.col(a)) * (F.col(e) - F.col(c))
    held = P.in_boxes(inner, kinds, lon="a0", lat="c0", size=1.0).where("a1 <= x1 AND c1 <= y1").where(size("x0", "x1", "y0", "y1") > size("a0", "a1", "c0", "c1"))
    n = held.groupBy(*sides.values()).agg(F.sum("many").alias("n"))
    depth = F.coalesce("n", F.lit(0)).cast("bigint")
    return b.join(n, [F.col(k) == F.col(v) for k, v in sides.items()], "left").select("key", depth.alias("ring_depth"), (depth % 2 == 0).alias("is_outer"))


@query(sql("SELECT key FROM boxes WHERE (x1 - x0) * (y1 - y0) >= 10 AND (SELECT count(*) FROM mesh WHERE x0 <= lon AND lon < x1 AND y0 <= lat AND lat < y1) >= 5"))
def lakes_split(spark: SparkSession, d: str) -> DataFrame:
    """Large boxes that enough of the mesh covers."""
    b = C.boxes(spark, d).where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 10)
    return P.in_boxes(C.newest_cells(spark, d).select("cell", "lon", "lat"), b).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("key")


@query(sql("SELECT place_key, name FROM (SELECT place_key, name, row_number() OVER (PARTITION BY province ORDER BY population DESC, name, place_key) AS rn FROM spots) WHERE rn = 1 OR rn BETWEEN 3 AND 4"))
def slice_limit(spark: SparkSession, d: str) -> DataFrame:
    """First, third and fourth place of each province."""
    w = Window.partitionBy("province").orderBy(F.col("population").desc(), "name", "place_key")
    return C.places(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1 OR rn BETWEEN 3 AND 4").select("place_key", "name")


@query(sql("SELECT o.region, coalesce(max(CASE WHEN s.population >= 20000 THEN s.name END), max(q.name), 'Region ' || o.region) AS name FROM (SELECT DISTINCT region FROM other) o LEFT JOIN other p ON p.region = o.region LEFT JOIN spots s ON s.cell = p.cell LEFT JOIN metro q ON q.cell = p.cell GROUP BY o.region"))
def manual_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by priority: a large place, a metro, a number."""
    split = C.other_split(spark, d)
    big = C.places(spark, d).where("population >= 20000").join(split, "cell").groupBy("region").agg(F.max("name").alias("a"))
    metro = C.cma_cells(spark, d).join(split, "cell").groupBy("region").agg(F.max("name").alias("b"))
    r = split.select("region").distinct().join(big, "region", "left").join(metro, "region", "left")
    return r.select("region", F.coalesce("a", "b", F.concat(F.lit("Region "), F.col("region").cast("string"))).alias("name"))


@query(sql("SELECT province, CASE WHEN count(*) > 200 THEN 'large scope ' ELSE 'scope ' END || province AS label FROM mesh GROUP BY province"))
def scope_label(spark: SparkSession, d: str) -> DataFrame:
    g = C.newest_cells(spark, d).groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    return g.select("province", F.concat(F.when(F.col("n") > 200, "large scope ").otherwise("scope "), F.col("province")).alias("label"))


@query(sql("SELECT unit_id, bool_or(truth = 'disputed') AND NOT bool_and(truth = 'disputed') AS is_shown, CASE WHEN count(DISTINCT truth) > 1 THEN 'several truths' WHEN bool_or(valid_to IS NULL) THEN 'open' ELSE '' END AS reason FROM urows GROUP BY unit_id"))
def shareability(spark: SparkSession, d: str) -> DataFrame:
    """Ordered reasons and a layer rule per unit."""
    g = C.unit_rows(spark, d).groupBy("unit_id").agg(F.bool_or(F.col("truth") == "disputed").alias("any"), F.bool_and(F.col("truth") == "disputed").alias("all"), F.count_distinct("truth").alias("n"), F.bool_or(F.col("valid_to").isNull()).alias("open"))
    return g.select("unit_id", (F.col("any") & ~F.col("all")).alias("is_shown"), F.when(F.col("n") > 1, "several truths").when(F.col("open"), "open").otherwise("").alias("reason"))


@query(sql(f"SELECT a.cell, b.key, floor(greatest(0, least(lon + 0.5, x1) - greatest(lon - 0.5, x0)) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6 AS width FROM mesh a JOIN boxes b ON lon - 0.5 < x1 AND x0 < lon + 0.5 AND lat - 0.25 < y1 AND y0 < lat + 0.25"))
def intersect_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves, here by their width."""
    x, y = F.col("lon"), F.col("lat")
    c = C.newest_cells(spark, d).select("cell", (x - 0.5).alias("a0"), (x + 0.5).alias("a1"), (y - 0.25).alias("c0"), (y + 0.25).alias("c1"))
    return P.box_overlaps(c, C.boxes(spark, d)).select("cell", "key", half_up(F.greatest(F.lit(0.0), F.least("a1", "x1") - F.greatest("a0", "x0")), 6).alias("width"))


@query()
def graph_colour(spark: SparkSession, d: str) -> DataFrame:
    return X.greedy_colours(R.region_neighbours(C.edges(spark, d), C.other_split(spark, d)).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))


@query()
def generated_names(spark: SparkSession, d: str) -> DataFrame:
    """Greedy unique names of regions from their largest places. A region may need as many different names as there are
    regions, one more than others can take from it; further ones cannot matter."""
    split = C.other_split(spark, d)
    n = split.agg(F.count_distinct("region")).first()[0]
    s = C.places(spark, d).join(split, "cell")
    s = s.withColumn("_rn", F.row_number().over(Window.partitionBy("region", "name").orderBy(F.col("population").desc(), "place_key"))).where("_rn = 1").drop("_rn")
    w = Window.partitionBy("region").orderBy(F.col("population").desc(), "place_key")
    c = s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("weight", F.max("population").over(Window.partitionBy("region")))
    return X.unique_names(c)


@query()
def merge_short(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("kind"), (F.col("o_totalprice") / 1000).alias("km"))
    return X.merge_short(o, ["o_custkey"], 45.0)


@query(problems._RECORDS + """SELECT raw_id, list_sort(list(DISTINCT v)) AS units FROM (SELECT raw_id, t.atom ->> '$' AS v, t.fullkey AS k, t.type AS kind FROM good, json_tree(good.j) t)
WHERE regexp_matches(k, '\\.geometry.*\\.unit$') AND kind NOT IN ('ARRAY', 'OBJECT', 'NULL') GROUP BY raw_id""")
def json_walk(spark: SparkSession, d: str) -> DataFrame:
    """Every unit that a geometry in the raw records names, however deep."""
    t = shred(table(spark, d, "raw_records"), key="raw_id", payload="payload", keep=[], repeated=["children", "regions", "events", "changes"], paths=r".*\.geometry.*\.unit")
    return t.groupBy("raw_id").agg(F.sort_array(F.collect_set("value")).alias("units"))


@query(problems.SQL["p3_packs"])
def tree_load(spark: SparkSession, d: str) -> DataFrame:
    """Packs of the raw records as flat rows with their parents, methods and scopes."""
    return problems.p3_packs(spark, d)


QUERIES, SQL = query.queries, query.sql
