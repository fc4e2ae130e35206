"""Queries on scopes, outlines, samples, trees of packs and stored files."""

from __future__ import annotations

import gzip
import heapq
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamesh.functions.scalar import half_up
from stratamesh.operators import graph as G
from stratamesh.operators import spatial as P
from stratamesh.operators.hierarchy import descendants, listed_parents, nested_sets
from stratamesh.plans import carrier as C
from stratamesh.plans import problems
from stratamesh.plans.carrier import sql
from stratamesh.plans.registry import Registry
from stratamesh.plans.space import _BOTH, _LABELS, _SAME
from stratamesh.session import shared_folder, table
from stratamesh.sources.nested import instances, shred

query = Registry()


# --- scopes -----------------------------------------------------------------------------------------------------


def in_scope(spark: SparkSession, d: str, scope: dict) -> DataFrame:
    """The cells of a scope: ``{"kind": k, ...}`` with k one of all; province, cd, csd (``of``: a list); cells (``of``: a frame
    with ``cell``); polygon (``of``: rings); region (``of``: numbers of another split)."""
    m = C.newest_cells(spark, d)
    kind, of = scope["kind"], scope.get("of")
    if kind == "all":
        return m.select("cell")
    if kind in ("province", "cd", "csd"):
        return m.where(F.col(kind).isin(list(of))).select("cell")
    if kind == "cells":
        return m.join(of.select("cell").distinct(), "cell", "left_semi").select("cell")
    if kind == "polygon":
        rings = spark.createDataFrame([(0, [[(float(x), float(y)) for x, y in r] for r in of])], "key int, rings array<array<struct<x:double,y:double>>>")
        return P.points_in_polygons(m.select("cell", "lon", "lat"), rings).select("cell")
    if kind == "region":
        return C.other_split(spark, d).where(F.col("region").isin(list(of))).select("cell")
    raise ValueError(f"no scope of kind {kind}")


_TRIANGLE = [(-125, 42), (-70, 45), (-100, 72)]
_IN_TRIANGLE = " + ".join(f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < CAST({bx - ax} AS DOUBLE) * (lat - {ay}) / CAST({by - ay} AS DOUBLE) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_TRIANGLE, _TRIANGLE[1:] + _TRIANGLE[:1]))


@query(sql(f"""SELECT 'all' AS kind, cell FROM mesh UNION ALL SELECT 'province', cell FROM mesh WHERE province IN ('AB', 'SK', 'MB') UNION ALL SELECT 'cd', cell FROM mesh WHERE cd IN (SELECT min(cd) FROM mesh GROUP BY province)
UNION ALL SELECT 'csd', cell FROM mesh WHERE csd IN (SELECT max(csd) FROM mesh GROUP BY cd) UNION ALL SELECT DISTINCT 'cells', cell FROM metro WHERE cell IN (SELECT cell FROM mesh)
UNION ALL SELECT 'polygon', cell FROM mesh WHERE ({_IN_TRIANGLE}) % 2 = 1 UNION ALL SELECT 'region', cell FROM other WHERE region IN (1, 4)"""))
def scope_mask(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a scope of each of the seven kinds."""
    m = C.newest_cells(spark, d)
    firsts = [r[0] for r in m.groupBy("province").agg(F.min("cd")).select("min(cd)").collect()]  # one a province: few
    lasts = m.groupBy("cd").agg(F.max("csd").alias("csd"))
    scopes = [
        {"kind": "all"}, {"kind": "province", "of": ["AB", "SK", "MB"]}, {"kind": "cd", "of": [x for x in firsts if x is not None]}, {"kind": "cells", "of": C.cma_cells(spark, d)},
        {"kind": "polygon", "of": [_TRIANGLE]}, {"kind": "region", "of": [1, 4]},
    ]
    out = m.join(lasts.select("csd").distinct(), "csd", "left_semi").select(F.lit("csd").alias("kind"), "cell")
    for s in scopes:
        out = out.unionByName(in_scope(spark, d, s).select(F.lit(s["kind"]).alias("kind"), "cell"))
    return out


# --- outlines ---------------------------------------------------------------------------------------------------

_SQUARES = "sq AS (SELECT DISTINCT region, CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y FROM mesh JOIN other USING (cell)), sides AS (SELECT region, x, y, x + 1 AS x2, y AS y2 FROM sq UNION ALL SELECT region, x, y + 1, x + 1, y + 1 FROM sq UNION ALL SELECT region, x, y, x, y + 1 FROM sq UNION ALL SELECT region, x + 1, y, x + 1, y + 1 FROM sq), outline AS (SELECT region, x, y, x2, y2 FROM sides GROUP BY ALL HAVING count(*) = 1)"


def dissolved(squares: DataFrame, key: str) -> DataFrame:
    """``key``, x, y, x2, y2: the outline of the union of a key's unit squares (x, y), each once: sides inside are used twice
    and cancel."""
    at = lambda a, b, c, e: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"), (F.col("x") + c).alias("x2"), (F.col("y") + e).alias("y2"))
    s = squares.select(key, F.explode(F.array(at(0, 0, 1, 0), at(0, 1, 1, 1), at(0, 0, 0, 1), at(1, 0, 1, 1))).alias("s")).select(key, "s.*")
    return s.groupBy(key, "x", "y", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def _squares(spark: SparkSession, d: str) -> DataFrame:
    return C.newest_cells(spark, d).join(C.other_split(spark, d), "cell").select("region", F.floor("lon").alias("x"), F.floor("lat").alias("y")).distinct()


@query(sql("SELECT region, x, y, x2, y2 FROM outline", _SQUARES))
def dissolve(spark: SparkSession, d: str) -> DataFrame:
    """Sides of the outlines of regions on a grid of whole degrees."""
    return dissolved(_squares(spark, d), "region")


@query(sql("SELECT region, n_pieces, n_squares, n_sides, floor(4 * pi() * n_squares / (n_sides * n_sides) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6 AS roundness FROM (SELECT region, count(DISTINCT c) AS n_pieces FROM lab JOIN other USING (cell) GROUP BY region) JOIN (SELECT region, count(*) AS n_squares FROM sq GROUP BY region) USING (region) JOIN (SELECT region, count(*) AS n_sides FROM outline GROUP BY region) USING (region)", f"{_SAME}, {_LABELS}, {_SQUARES}", recursive=True))
def region_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of each region, and how round it is: 4 pi area / perimeter^2 of its outline."""
    split, s = C.other_split(spark, d), _squares(spark, d)
    e = C.edges(spark, d).join(split.select(F.col("cell").alias("u"), F.col("region").alias("ru")), "u").join(split.select(F.col("cell").alias("v"), F.col("region").alias("rv")), "v").where("ru = rv")
    pieces = G.connected_components(split, e).join(split, "cell").groupBy("region").agg(F.count_distinct("component").alias("n_pieces"))
    r = pieces.join(s.groupBy("region").agg(F.count(F.lit(1)).alias("n_squares")), "region").join(dissolved(s, "region").groupBy("region").agg(F.count(F.lit(1)).alias("n_sides")), "region")
    return r.select("region", "n_pieces", "n_squares", "n_sides", half_up(4 * math.pi * F.col("n_squares") / (F.col("n_sides") * F.col("n_sides")), 6).alias("roundness"))


def encode_rings(rings: Column) -> Column:
    """Rings as flat arrays: sizes, xs, ys."""
    every = F.flatten(rings)
    return F.struct(F.transform(rings, F.size).alias("sizes"), F.transform(every, lambda p: p["x"]).alias("xs"), F.transform(every, lambda p: p["y"]).alias("ys"))


def decode_rings(flat: Column) -> Column:
    """The inverse of ``encode_rings``: each ring is a slice that starts where the sizes before it end."""
    points = F.arrays_zip(flat["xs"].alias("x"), flat["ys"].alias("y"))
    starts = F.aggregate(flat["sizes"], F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return F.transform(flat["sizes"], lambda n, i: F.slice(points, F.get(starts, i) + 1, n))


_POINTS = " UNION ALL ".join(f"SELECT key, {r} AS ring_no, {i} AS point_no, x0 + (x1 - x0) * CAST({a / 8} AS DOUBLE) AS x, y0 + (y1 - y0) * CAST({b / 8} AS DOUBLE) AS y FROM boxes" for r, ring in enumerate((C.OUTLINE, C.HOLE)) for i, (a, b) in enumerate(ring))


@query(sql(_POINTS))
def ring_codec(spark: SparkSession, d: str) -> DataFrame:
    """Points of polygons after a round trip through flat arrays."""
    p = C.polygons(spark, d).select("key", encode_rings(F.col("rings")).alias("flat")).select("key", F.posexplode(decode_rings(F.col("flat"))).alias("ring_no", "ring"))
    return p.select("key", "ring_no", F.posexplode("ring").alias("point_no", "p")).select("key", "ring_no", "point_no", "p.x", "p.y")


# --- samples and joins ------------------------------------------------------------------------------------------


@query(sql("""SELECT idx, cell, coalesce(ns, []) AS neighbours FROM kept LEFT JOIN (SELECT a.cell AS c, list_sort(list(b.idx)) AS ns FROM kept a JOIN both_ e ON e.u = a.cell JOIN kept b ON b.cell = e.v GROUP BY a.cell) n ON n.c = kept.cell""",
 f"""{_BOTH}, walk(cell, m) USING KEY (cell) AS (SELECT min(cell), 0 FROM mesh UNION SELECT e.v, min(w.m + 1) FROM both_ e JOIN walk w ON w.cell = e.u LEFT JOIN recurring.walk r ON r.cell = e.v WHERE r.cell IS NULL OR w.m + 1 < r.m GROUP BY e.v),
 kept AS MATERIALIZED (SELECT cell, idx FROM (SELECT cell, CAST(row_number() OVER (ORDER BY m, cell) - 1 AS INTEGER) AS idx FROM walk) WHERE idx < 50)""", recursive=True))
def ring_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 50 cells nearest to the first by rings of neighbours, in order within a ring, renumbered with their neighbours."""
    e = C.edges(spark, d)
    seed = C.newest_cells(spark, d).agg(F.min("cell").alias("node")).where("node IS NOT NULL").select("node", F.lit(0).alias("seed"), F.lit(0).alias("dist"))
    kept = [r[0] for r in G.hop_distances(seed, e, 50).orderBy("dist", "node").limit(50).collect()]
    k = spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "idx int, cell bigint")
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    n = both.join(F.broadcast(k.select(F.col("cell").alias("v"), F.col("idx").alias("n"))), "v").join(F.broadcast(k.select(F.col("cell").alias("u"))), "u").groupBy(F.col("u").alias("cell")).agg(F.sort_array(F.collect_list("n")).alias("neighbours"))
    return k.join(n, "cell", "left").select("idx", "cell", F.coalesce("neighbours", F.array().cast("array<int>")).alias("neighbours"))


@query(sql("SELECT m.csd, family, CAST(greatest(0, sum(n)) AS BIGINT) AS speakers FROM per JOIN mesh m ON m.cell = per.cell GROUP BY m.csd, family", "per AS MATERIALIZED (SELECT l_orderkey % (SELECT max(cell) + 1 FROM cells) AS cell, CAST(s_nationkey AS INTEGER) AS family, sum(CAST(l_quantity AS BIGINT) - 20) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"))
def family_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of each family in each csd: counts of its languages added, never below zero."""
    span = table(spark, d, "cells").agg(F.max("cell") + 1).first()[0]
    line = table(spark, d, "lineitem").select((F.col("l_orderkey") % F.lit(span)).alias("cell"), F.col("l_suppkey").alias("language"), (F.col("l_quantity").cast("bigint") - 20).alias("n"))
    per = line.groupBy("cell", "language").agg(F.sum("n").alias("n"))
    of = table(spark, d, "supplier").select(F.col("s_suppkey").alias("language"), F.col("s_nationkey").cast("int").alias("family"))
    g = per.join(of, "language").join(C.newest_cells(spark, d).select("cell", "csd"), "cell").groupBy("csd", "family").agg(F.sum("n").alias("n"))
    return g.select("csd", "family", F.greatest(F.lit(0), F.col("n")).cast("bigint").alias("speakers"))


@query()
def nearest_capital_cells(spark: SparkSession, d: str) -> DataFrame:
    """The 14 largest places in order, each with the nearest cell that none before it took. A place needs as many nearest
    cells as there are places, so each partition keeps that many of each and few rows reach the driver."""
    caps = C.places(spark, d).orderBy(F.col("population").desc(), "place_key").select("place_key", "lng", "lat").limit(14).collect()
    k = len(caps)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in caps]
        for b in batches:
            for cell, x, y in zip(*(c.to_pylist() for c in b.columns)):
                for i, p in enumerate(caps):
                    item = (-((x - p[1]) ** 2 + (y - p[2]) ** 2), -cell)
                    heapq.heappush(best[i], item) if len(best[i]) < k else heapq.heappushpop(best[i], item)
        rows = [(i, -a, -c) for i, h in enumerate(best) for a, c in h]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in ((0, pa.int32()), (1, pa.float64()), (2, pa.int64()))], ["i", "deg2", "cell"])

    some = C.newest_cells(spark, d).where("lon IS NOT NULL AND lat IS NOT NULL").select("cell", "lon", "lat").mapInArrow(nearest, "i int, deg2 double, cell bigint")
    rank = Window.partitionBy("i").orderBy("deg2", "cell")
    used, out = set(), []
    for r in some.withColumn("_rn", F.row_number().over(rank)).where(F.col("_rn") <= k).orderBy("i", "deg2", "cell").collect():
        if r["cell"] not in used and (not out or out[-1][2] != r["i"]):
            used.add(r["cell"])
            out.append((caps[r["i"]][0], r["cell"], r["i"]))
    return spark.createDataFrame([(a, b) for a, b, _ in out], "place_key bigint, cell bigint")


# --- trees of packs ---------------------------------------------------------------------------------------------

_OLD = """, places AS (SELECT node_id, row_number() OVER (PARTITION BY parent, parent_region ORDER BY updated_at DESC, node_id) AS rn FROM (SELECT l.node_id, l.parent, n.parent_region, n.updated_at FROM links l JOIN newest n USING (node_id)) WHERE parent IS NOT NULL AND parent_region IS NOT NULL)
SELECT node_id FROM walk WHERE NOT list_has_any(path, (SELECT coalesce(list(node_id), []) FROM places WHERE rn > 1))"""


@query(problems._TREE.rstrip() + _OLD)
def tree_replace(spark: SparkSession, d: str) -> DataFrame:
    """Splits that stay when of several children of one region only the newest counts: older ones go with all below them."""
    rows = table(spark, d, "tree_nodes")
    links = listed_parents(rows, node="node_id", parent="parent_id", children="children", updated_at="updated_at")
    sets = nested_sets(links)
    newest = rows.where("node_id IS NOT NULL").groupBy(F.col("node_id").alias("node")).agg(F.max(F.struct("updated_at", "parent_region")).alias("x")).select("node", "x.*")
    there = links.select(F.col("node").alias("parent"))
    placed = links.where("parent IS NOT NULL").join(there, "parent", "left_semi").join(newest, "node").where("parent_region IS NOT NULL")
    # the newest of a family by a grouped maximum, so that a wide one is not one task
    best = placed.groupBy("parent", "parent_region").agg(F.max("updated_at").alias("updated_at")).join(placed, ["parent", "parent_region", "updated_at"]).groupBy("parent", "parent_region").agg(F.min("node").alias("keep"))
    old = placed.join(best, ["parent", "parent_region"]).where("node <> keep").select("node")
    gone = old.unionByName(descendants(sets, old).select(F.col("below").alias("node"))).distinct()
    return sets.where("root IS NOT NULL").select("node").join(gone, "node", "left_anti").select(F.col("node").alias("node_id"))


def assemble(packs: DataFrame) -> DataFrame:
    """raw_id, tree: the rows of ``p3_packs`` put together again as one JSON text a record, level by level from below. Places
    that null elements leave empty in a list are nulls again."""
    p = packs.withColumn("level", F.length("pack") - F.length(F.replace("pack", F.lit("."), F.lit("")))).withColumn("no", F.element_at(F.split("pack", r"\."), -1).cast("int"))
    top = p.agg(F.max("level")).first()[0]
    below = None
    for level in range(top if top is not None else -1, -1, -1):
        here = p.where(F.col("level") == level)
        here = here.withColumn("kids", F.lit("")) if below is None else here.join(below, ["raw_id", "pack"], "left")
        own = F.to_json(F.struct(F.struct("method", F.col("pack_name").alias("id")).alias("meta")))
        j = here.select("raw_id", F.col("parent").alias("pack"), "no", F.concat(F.regexp_replace(own, r"\}$", ""), F.when(own == "{}", "").otherwise(","), F.lit('"children":['), F.coalesce("kids", F.lit("")), F.lit("]}")).alias("json"))
        # nulls before a child for each place that is missing before it
        g = j.groupBy("raw_id", "pack").agg(F.sort_array(F.collect_list(F.struct("no", "json"))).alias("a"))
        gap = lambda x, i: F.concat(F.repeat(F.lit("null,"), x["no"] - F.when(i == 0, 0).otherwise(F.get(F.col("a"), i - 1)["no"] + 1)), x["json"])
        below = g.select("raw_id", "pack", F.array_join(F.transform("a", gap), ",").alias("kids"))
    return packs.select("raw_id", F.lit("").alias("tree")).limit(0) if below is None else below.select("raw_id", F.col("kids").alias("tree"))


@query(problems._RECORDS + "SELECT raw_id, pos AS pack, " + problems._scalar("j", "meta.method", "method") + " FROM packs")
def sink_tree(spark: SparkSession, d: str) -> DataFrame:
    """Packs after a round trip through one nested JSON text for each record."""
    t = shred(assemble(problems.p3_packs(spark, d)), key="raw_id", payload="tree", keep=[], repeated=["children"], paths=r"(?:\.children\[\])*(?:\.meta\.method)?")
    g = instances(t, ["raw_id"], F.regexp_extract("path", r"^(.*\[\])?", 0), {"method": "meta.method"})
    return g.select("raw_id", problems._position(F.col("ords")).alias("pack"), "method")


# --- files ------------------------------------------------------------------------------------------------------


def write_json_gz(df: DataFrame, path: str) -> None:
    """JSON lines in gzipped parts, written by the tasks."""
    df.write.option("compression", "gzip").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of files that may be gzipped or not, whatever they are called: told by the first two bytes. A file is read
    by one task."""
    lines = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                yield pa.RecordBatch.from_arrays([pa.array([x for x in raw.decode("utf-8-sig").split("\n") if x.strip()], pa.string())], ["line"])

    return lines.mapInArrow(run, "line string").select(F.from_json("line", schema).alias("r")).select("r.*")


@query("SELECT DISTINCT place_key, name, population, lng, lat FROM places")
def scan_json_gz(spark: SparkSession, d: str) -> DataFrame:
    """The places written as gzipped JSON and read again."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    write_json_gz(table(spark, d, "places").select("place_key", "name", "population", "lng", "lat").distinct(), path)
    return read_json(spark, path, "place_key bigint, name string, population bigint, lng double, lat double")


QUERIES, SQL = query.queries, query.sql
