"""Queries on codecs, packs, checks of artefacts, and the partitioner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamesh.functions import scalar as S
from stratamesh.operators import mesh as M
from stratamesh.operators.partition import solve_runs as run_all
from stratamesh.plans import carrier as C
from stratamesh.plans.carrier import sql
from stratamesh.plans.registry import Registry
from stratamesh.session import table
from stratamesh.sources import codec as K
from stratamesh.sources import sinks as W

query = Registry()


@query(sql("SELECT cd, list(CAST(people AS INTEGER) ORDER BY cell) AS people FROM mesh GROUP BY cd"))
def decode_column(spark: SparkSession, d: str) -> DataFrame:
    """People of each division's cells through the encoded column and back."""
    g = C.mesh(spark, d).groupBy("cd").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "people"))), lambda x: x["people"].cast("int")).alias("v"))
    return g.select("cd", K.encode_int32(F.col("v")).alias("data")).select("cd", K.decode_int32(F.col("data")).alias("people"))


@query("""SELECT s_suppkey, to_base64(encode('{"n":' || s_suppkey || ',"name":"' || s_name || '"}')) AS padded FROM supplier""")
def share_link(spark: SparkSession, d: str) -> DataFrame:
    """Links round trip; what is compared is their padded form."""
    t = table(spark, d, "supplier").select("s_suppkey", F.format_string('{"n":%d,"name":"%s"}', "s_suppkey", "s_name").alias("spec"))
    return t.select("s_suppkey", F.base64(F.encode(K.open_link(K.share_link(F.col("spec"))), "utf-8")).alias("padded"))


@query("SELECT o_custkey AS arc, o_orderkey AS pos, CAST(sum(o_orderkey % 7 - 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) * 0.5 - 100 AS x, CAST(sum(o_orderkey % 5 - 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) * 0.25 + 40 AS y FROM orders".replace("o_orderkey AS pos", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos"))
def scan_topojson(spark: SparkSession, d: str) -> DataFrame:
    """Delta-encoded arcs (one per customer, a step per order) to points."""
    k = F.col("o_orderkey")
    arcs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("arc")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.array(k % 7 - 3, k % 5 - 2)).alias("points"))
    return K.decode_arcs(arcs, (0.5, 0.25), (-100.0, 40.0))


@query("SELECT n_nationkey AS geo, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS c1, CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS DOUBLE) AS c5 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def scan_census_profile(spark: SparkSession, d: str) -> DataFrame:
    """Long counts by place and characteristic to wide rows."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    long = o.groupBy(F.col("c_nationkey").alias("geo"), F.substring("o_orderpriority", 1, 1).cast("int").alias("ch")).agg(F.count(F.lit(1)).cast("string").alias("v"))
    return K.census_profile(long, "geo", "ch", "v", [1, 5]).select("geo", F.coalesce(F.col("1"), F.lit(0.0)).alias("c1"), F.coalesce(F.col("5"), F.lit(0.0)).alias("c5"))


@query("SELECT year, CAST(sum(v) AS BIGINT) AS total FROM (SELECT year(o_orderdate) AS year, o_orderpriority AS p, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders) WHERE year = (SELECT max(year) FROM (SELECT year(o_orderdate) AS year FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5)) GROUP BY year")
def scan_gdp_table(spark: SparkSession, d: str) -> DataFrame:
    """The latest year in which every category is present."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), "o_orderpriority", F.round("o_totalprice").cast("bigint").alias("v"))
    year = o.groupBy("year").agg(F.count_distinct("o_orderpriority").alias("n")).where("n = 5").agg(F.max("year").alias("year"))
    return o.join(F.broadcast(year), "year", "left_semi").groupBy("year").agg(F.sum("v").alias("total"))


#: Endings of a candidate's text and the codes they stand for.
_PARTIES = {"BUILDING": 1, "AUTOMOBILE": 2, "MACHINERY": 3, "HOUSEHOLD": 4}


@query(f"""SELECT c_nationkey AS district, CASE {' '.join(f"WHEN t LIKE '%{e}' THEN {k}" for e, k in _PARTIES.items())} ELSE -1 END AS party, count(*) AS n
FROM (SELECT c_nationkey, c_name || ' ' || c_mktsegment AS t FROM customer) GROUP BY ALL""")
def scan_election(spark: SparkSession, d: str) -> DataFrame:
    """Party of each elected candidate by the ending of the candidate's text, by district; -1 for an unknown party."""
    t = F.concat_ws(" ", "c_name", "c_mktsegment")
    party = F.coalesce(*[F.when(t.endswith(e), k) for e, k in _PARTIES.items()], F.lit(-1))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("district"), party.alias("party")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT unit_id, name FROM unit_rows WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY recorded_at, unit_row_key) = 1")
def scan_glottolog(spark: SparkSession, d: str) -> DataFrame:
    """First row per id, unnamed rows skipped."""
    g = table(spark, d, "unit_rows").where("name IS NOT NULL").groupBy("unit_id").agg(F.min(F.struct("recorded_at", "unit_row_key", "name")).alias("x"))
    return g.select("unit_id", "x.name")


@query("SELECT draw, (SELECT 0) + n AS n FROM (VALUES (1, 1144304738), (2, 1416247), (3, 958946056), (4, 627933444), (5, 2007157716), (6, 2340967985), (7, 2642484575), (8, 2787370982)) v(draw, n)".replace("(SELECT 0) + n AS n", "CAST(n AS BIGINT) AS n").replace("SELECT draw", "SELECT CAST(draw AS BIGINT) AS draw"))
def mulberry32(spark: SparkSession, d: str) -> DataFrame:
    """The generator's first numbers for seed 0, from column expressions."""
    return spark.range(1, 9).select(F.col("id").alias("draw"), S.mulberry32(F.lit(0), F.col("id")).alias("n"))


@query(C.sql("""SELECT place_key, CASE WHEN name IS NOT NULL THEN CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(range(octet_length(encode(name))), lambda i: CAST('0x' || substr(hex(encode(name)), CAST(2 * i + 1 AS INTEGER), 2) AS UBIGINT))),
  lambda h, b: (xor(h, b) * CAST(16777619 AS UBIGINT)) % CAST(4294967296 AS UBIGINT)) AS BIGINT) END AS hash FROM spots"""))
def fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return C.places(spark, d).select("place_key", S.fnv1a(F.col("name")).alias("hash"))


@query("SELECT s_suppkey, floor(s_acctbal * 10 + 0.5) / 10 AS up, round_even(s_acctbal, 1) AS even, coalesce(s_acctbal / nullif(CAST(s_nationkey AS DOUBLE), 0), 0) AS safe FROM supplier")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", S.half_up(b, 1).alias("up"), S.half_even(b, 1).alias("even"), S.ratio(b, F.col("s_nationkey")).alias("safe"))


@query("""WITH o AS (SELECT unit_id AS name, min(sha256(coalesce(status, ''))) AS sha FROM unit_rows WHERE truth = 'dejure' GROUP BY unit_id), n AS (SELECT unit_id AS name, min(sha256(coalesce(status, ''))) AS sha FROM unit_rows WHERE truth <> 'dejure' GROUP BY unit_id)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'gone' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.name = n.name WHERE o.sha IS DISTINCT FROM n.sha""")
def verify_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric difference of two sets of hashed artefacts."""
    h = lambda df: df.groupBy(F.col("unit_id").alias("name")).agg(F.min(F.sha2(F.coalesce("status", F.lit("")), 256)).alias("sha"))
    u = table(spark, d, "unit_rows")
    return W.verify_rebuild(h(u.where("truth = 'dejure'")), h(u.where("truth <> 'dejure'")))


@query("SELECT geometry_ref, CAST(max(CAST(valid_from[:4] AS INT)) AS INTEGER) AS latest, count(DISTINCT valid_from[:4]) AS n_versions FROM unit_rows GROUP BY geometry_ref")
def version_pick(spark: SparkSession, d: str) -> DataFrame:
    """The latest numbered version of each artefact."""
    y = S.date_to_year(F.col("valid_from"))
    return table(spark, d, "unit_rows").groupBy("geometry_ref").agg(F.max(y).alias("latest"), F.count_distinct(y).alias("n_versions"))


@query("""SELECT unit_row_key, 'validity' AS error FROM unit_rows WHERE valid_to <= valid_from UNION SELECT unit_row_key, 'truth' FROM unit_rows WHERE truth NOT IN ('dejure', 'defacto', 'disputed') UNION SELECT unit_row_key, 'capital' FROM unit_rows WHERE capital IS NULL UNION SELECT unit_row_key, 'confidence' FROM unit_rows WHERE confidence < 0 OR confidence > 1""")
def schema_validate(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a rule, one row per rule, in one pass over the table."""
    rules = {"validity": "valid_to <= valid_from", "truth": "truth NOT IN ('dejure', 'defacto', 'disputed')", "capital": "capital IS NULL", "confidence": "confidence < 0 OR confidence > 1"}
    found = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in rules.items()]))
    return table(spark, d, "unit_rows").select("unit_row_key", F.explode(found).alias("error")).distinct()


@query("SELECT geometry_ref, count(*) AS n FROM (SELECT DISTINCT unit_row_key, geometry_ref FROM unit_rows) GROUP BY geometry_ref HAVING count(*) > 1")
def plan_validate(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that more than one row claims."""
    return C.unit_rows(spark, d).select("unit_row_key", "geometry_ref").distinct().groupBy("geometry_ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT e.unit_id, count(*) AS n FROM (SELECT DISTINCT event_key, unit_id FROM unit_events) e WHERE e.unit_id NOT IN (SELECT unit_id FROM unit_rows) GROUP BY e.unit_id")
def census_mapping_check(spark: SparkSession, d: str) -> DataFrame:
    """Codes that the dimension does not know."""
    e = table(spark, d, "unit_events").select("event_key", "unit_id").distinct()
    return e.join(table(spark, d, "unit_rows").select("unit_id").distinct(), "unit_id", "left_anti").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT s.place_key, CASE WHEN p.cell IN (SELECT cell FROM cells) THEN 'exact' WHEN p.cell IS NULL THEN 'unfittable' ELSE 'regenerate' END AS fit FROM (SELECT DISTINCT place_key FROM places) s JOIN places p USING (place_key)")
def scan_pack(spark: SparkSession, d: str) -> DataFrame:
    """How a stored reference fits the present mesh."""
    p = table(spark, d, "places").select("place_key", "cell").distinct()
    c = table(spark, d, "cells").select("cell").distinct().withColumn("_there", F.lit(True))
    return p.join(c, "cell", "left").select("place_key", F.when(F.col("_there"), "exact").when(F.col("cell").isNull(), "unfittable").otherwise("regenerate").alias("fit")).distinct()


@query()
def solve_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of every method and two seeds over the cells of each province: runs in parallel, each in one task. Methods
    that refine take 200,000 moves (fewer where the cost stays); the others are moved 2,000 times."""
    m = C.mesh(spark, d).select(F.col("province").alias("scope"), "cell", "lon", "lat", F.col("people").cast("double").alias("load"), F.col("returned").cast("double").alias("lens"), "neighbours")
    scopes = m.select("scope").distinct()
    methods = F.explode(F.array(*[F.lit(x) for x in ("random", "seeded", "balanced", "quota", "lens")]))
    runs = scopes.withColumn("method", methods).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("n", F.lit(4)).withColumn("moves", F.when(F.col("method").isin("seeded", "balanced", "lens"), 200_000).otherwise(2000))
    return run_all(m, runs.withColumn("run_id", F.concat_ws(":", "scope", "method", "seed")))


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """The box of each region as its ring."""
    b = C.mesh(spark, d).join(C.other_split(spark, d), "cell").groupBy("region").agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("e"), F.sum("people").alias("people"))
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return b.select("region", "people", F.concat(F.lit("Region & "), F.col("region").cast("string")).alias("name"), F.lit("#1f77b4").alias("colour"), F.array(pt("a", "c"), pt("a", "e"), pt("b", "e"), pt("b", "c")).alias("ring"))


@query()
def sink_geojson(spark: SparkSession, d: str) -> DataFrame:
    return W.geojson_features(_shapes(spark, d), ["name", "people"])


@query()
def sink_kml(spark: SparkSession, d: str) -> DataFrame:
    return W.kml_placemarks(_shapes(spark, d), "name", "colour")


@query()
def sink_pack(spark: SparkSession, d: str) -> DataFrame:
    regions = C.mesh(spark, d).join(C.other_split(spark, d), "cell").groupBy("region").agg(F.sum("people").alias("people"))
    return W.pack_json(C.other_split(spark, d), regions, {"method": "template", "seed": "1"})


@query(sql("SELECT region, CASE WHEN least(x1 - x0, y1 - y0) > 0 THEN (x1 - x0) * (y1 - y0) ELSE 0 END AS area FROM (SELECT region, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM mesh JOIN other USING (cell) GROUP BY region)").replace("CASE WHEN least(x1 - x0, y1 - y0) > 0 THEN (x1 - x0) * (y1 - y0) ELSE 0 END", "floor((x1 - x0) * (y1 - y0) * 1e4 + CAST(0.5 AS DOUBLE)) / 1e4"))
def ring_area(spark: SparkSession, d: str) -> DataFrame:
    """Shoelace area of each ring, wound outward."""
    return _shapes(spark, d).select("region", S.half_up(S.signed_area(W.wound(F.col("ring"), True)), 4).alias("area"))


@query(sql("SELECT cell, attribute, amount FROM (SELECT cell, 'people' AS attribute, people AS amount FROM mesh UNION ALL SELECT cell, 'cents', cents FROM mesh UNION ALL SELECT cell, 'milli', milli FROM mesh) WHERE cell IN (SELECT cell FROM spots)"))
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All attributes of the cells that hold a place, one per row."""
    m = C.mesh(spark, d).join(C.places(spark, d).select("cell").distinct(), "cell", "left_semi")
    return m.select("cell", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("amount")) for a in ("people", "cents", "milli")])).alias("x")).select("cell", "x.attribute", "x.amount")


@query(sql("SELECT province, CASE WHEN people > 0 THEN 'census' ELSE 'fill' END AS source, count(*) AS n_cells FROM mesh GROUP BY ALL"))
def family_areas(spark: SparkSession, d: str) -> DataFrame:
    return C.mesh(spark, d).groupBy("province", F.when(F.col("people") > 0, "census").otherwise("fill").alias("source")).agg(F.count(F.lit(1)).alias("n_cells"))


@query(sql("SELECT province, cd, n FROM (SELECT province, cd, count(*) AS n, row_number() OVER (PARTITION BY province ORDER BY count(*) DESC, cd) AS rn FROM mesh GROUP BY province, cd) WHERE n >= 25 OR rn = 1"))
def labelled_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas of at least 25 cells and each group's largest."""
    g = C.newest_cells(spark, d).groupBy("province", "cd").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rn", F.row_number().over(Window.partitionBy("province").orderBy(F.col("n").desc(), "cd"))).where("n >= 25 OR rn = 1").select("province", "cd", "n")


@query(sql("SELECT cell, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS pos FROM mesh"))
def load_mesh_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their dense position in the order of their ids."""
    m = C.newest_cells(spark, d).withColumn("_k", F.conv(F.substring("id", 1, 13), 16, 10).cast("double"))
    return M.global_position(m, ["_k", "id"], "pos").select("cell", "pos")


QUERIES, SQL = query.queries, query.sql
