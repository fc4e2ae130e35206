"""Queries that describe regions, scopes and the set of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamesh.functions.scalar import half_up, ratio, slug, xml_escape
from stratamesh.operators import mesh as M
from stratamesh.operators import regions as R
from stratamesh.operators import spatial as P
from stratamesh.plans import carrier as C
from stratamesh.plans.carrier import SECTORS, sql
from stratamesh.plans.registry import Registry
from stratamesh.session import table

query = Registry()
_INDUSTRY = {f"s_{s}": s for s in SECTORS}
_LONG = "sectors AS (" + " UNION ALL ".join(f"SELECT cell, cd, province, '{s}' AS label, s_{s} AS amount FROM mesh" for s in SECTORS) + ")"


def _r(x: str, k: int = 6) -> str:
    return f"floor(({x}) * 1e{k} + CAST(0.5 AS DOUBLE)) / 1e{k}"


def _q(a: str, b: str, k: int = 6) -> str:
    """Rounded ratio, 0 on zero, in SQL."""
    return _r(f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)", k)


def _sectors(spark: SparkSession, d: str) -> DataFrame:
    return R.unpivot_amounts(C.mesh(spark, d), ["cell", "cd", "province"], _INDUSTRY)


# --- scopes and cells -------------------------------------------------------------------------------------------


_POLY = [(-130.0, 50.0), (-100.0, 46.0), (-80.0, 60.0), (-105.0, 75.0), (-128.0, 66.0)]
_HOLE = [(-115.0, 58.0), (-105.0, 58.0), (-105.0, 64.0), (-115.0, 64.0)]


def _rings() -> Column:
    ring = lambda ps: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ps])
    return F.array(ring(_POLY), ring(_HOLE))


def _crossings(ps: list[tuple[float, float]]) -> str:
    """Number of edges that a ray from (lon, lat) crosses, edge by edge, in SQL."""
    return " + ".join(f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < CAST({bx - ax} AS DOUBLE) * (lat - {ay}) / CAST({by - ay} AS DOUBLE) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(ps, ps[1:] + ps[:1]) if ay != by)


@query(sql(f"SELECT cell FROM mesh WHERE (({_crossings(_POLY)}) % 2 + ({_crossings(_HOLE)}) % 2) % 2 = 1"))
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return M.polygon_scope(C.mesh(spark, d), _rings()).select("cell")


@query(sql(f"SELECT place_key, coalesce(min(b.key), -1) AS region FROM spots s LEFT JOIN boxes b ON {C.inside('s.lng', 's.lat')} GROUP BY place_key"))
def region_at(spark: SparkSession, d: str) -> DataFrame:
    """The first region whose polygon holds a place, -1 if none."""
    p = C.places(spark, d).select("place_key", "lng", "lat")
    g = P.first_polygons(p, C.polygons(spark, d), point="place_key", lon="lng").groupBy("place_key").agg(F.min("key").alias("key"))
    return p.select("place_key").distinct().join(g, "place_key", "left").select("place_key", F.coalesce("key", F.lit(-1)).alias("region"))


@query(sql(f"""SELECT cell, {_q('cents', 'people * 100', 3)} AS product_per_head, {_q('people * 1000', 'milli', 4)} AS density, {_q('s_AF + s_RF', 'cents', 4)} AS primary_share,
  CASE WHEN province = 'AB' THEN 1 ELSE 0 END AS province_ab FROM mesh"""))
def lens_columns(spark: SparkSession, d: str) -> DataFrame:
    c = M.lens_columns(C.mesh(spark, d), people="people", cents="cents", milli="milli", primary=["s_AF", "s_RF"], code="province")
    ab = F.col("province_AB") if "province_AB" in c.columns else F.lit(0)
    return c.select("cell", "product_per_head", "density", "primary_share", ab.alias("province_ab"))


@query(sql("SELECT cell, (row_number() OVER (ORDER BY people, cell) - 1) / CAST(greatest(1, count(*) OVER () - 1) AS DOUBLE) AS rank FROM mesh"))
def rank_unit(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_unit(C.mesh(spark, d).select("cell", "people"), "people", "cell", "rank").select("cell", "rank")


@query(sql(f"""SELECT cell, {_r('''((row_number() OVER (PARTITION BY province ORDER BY lat, cell) - 1) / CAST(greatest(1, count(*) OVER (PARTITION BY province) - 1) AS DOUBLE)
 + (row_number() OVER (PARTITION BY province ORDER BY s_AF, cell) - 1) / CAST(greatest(1, count(*) OVER (PARTITION BY province) - 1) AS DOUBLE)
 + (1 - (row_number() OVER (PARTITION BY province ORDER BY people, cell) - 1) / CAST(greatest(1, count(*) OVER (PARTITION BY province) - 1) AS DOUBLE))) / 3''')} AS colony FROM mesh"""))
def internal_colony(spark: SparkSession, d: str) -> DataFrame:
    c = C.mesh(spark, d).select("cell", "province", "lat", "s_AF", "people")
    for value, out in (("lat", "a"), ("s_AF", "b"), ("people", "c")):
        c = M.rank_unit(c, value, "cell", out, ["province"])
    return c.select("cell", half_up((F.col("a") + F.col("b") + (1 - F.col("c"))) / 3, 6).alias("colony"))


@query(sql("SELECT u, v, (a.cd <> b.cd OR a.csd <> b.csd OR floor(a.lon / 5.0) <> floor(b.lon / 5.0) OR floor(a.lat / 5.0) <> floor(b.lat / 5.0)) AS snap FROM edges JOIN mesh a ON a.cell = u JOIN mesh b ON b.cell = v"))
def snap_edges(spark: SparkSession, d: str) -> DataFrame:
    return M.snap_edges(C.edges(spark, d), C.newest_cells(spark, d), "cell", layers=["cd", "csd"], graticule=5.0)


_KINDS = [("province", "province"), ("division", "cd")]
_BORDER = """borders AS (SELECT u, v, CASE WHEN a.province <> b.province THEN 'province' WHEN a.cd <> b.cd THEN 'division' ELSE 'open' END AS kind,
  CASE WHEN a.province <> b.province THEN least(a.province, b.province) || ' / ' || greatest(a.province, b.province) WHEN a.cd <> b.cd THEN least(a.cd, b.cd) || ' / ' || greatest(a.cd, b.cd) END AS label, ra.region AS ra, rb.region AS rb,
  a.lon AS lon_u, a.lat AS lat_u, b.lon AS lon_v, b.lat AS lat_v
  FROM edges JOIN mesh a ON a.cell = u JOIN mesh b ON b.cell = v JOIN other ra ON ra.cell = u JOIN other rb ON rb.cell = v WHERE ra.region <> rb.region)"""


@query(sql("SELECT u, v, kind, label FROM borders", _BORDER))
def classify_border(spark: SparkSession, d: str) -> DataFrame:
    return M.classify_border(C.edges(spark, d), C.newest_cells(spark, d), C.other_split(spark, d), "cell", _KINDS)


_RUNS = f"""{_BORDER}, walked AS (
  SELECT *, least(ra, rb) AS a, greatest(ra, rb) AS b FROM borders), flagged AS (
  SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(label) OVER w IS NOT DISTINCT FROM label AND lag(u) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM walked WINDOW w AS (PARTITION BY a, b ORDER BY u, v)), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY a, b ORDER BY u, v ROWS UNBOUNDED PRECEDING) AS run FROM flagged), runs AS (
  SELECT a, b, CAST(run AS BIGINT) AS run, kind, label, count(*) AS n_edges, max(greatest(lat_u, lat_v)) - min(least(lat_u, lat_v)) AS dlat, max(greatest(lon_u, lon_v)) - min(least(lon_u, lon_v)) AS dlon FROM numbered GROUP BY a, b, run, kind, label)"""


def _border_runs(spark: SparkSession, d: str) -> DataFrame:
    """Edges between two regions in walking order (here by their cells), run-length encoded by kind and label."""
    cells, split = C.newest_cells(spark, d), C.other_split(spark, d)
    e = M.with_ends(M.classify_border(C.edges(spark, d), cells, split, "cell", _KINDS), cells, "cell", ["lon", "lat"])
    e = M.with_ends(e, split, "cell", ["region"]).withColumn("a", F.least("region_u", "region_v")).withColumn("b", F.greatest("region_u", "region_v"))
    w = Window.partitionBy("a", "b").orderBy("u", "v")
    same = F.lag("kind").over(w).eqNullSafe(F.col("kind")) & F.lag("label").over(w).eqNullSafe(F.col("label"))
    e = e.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("a", "b", "run", "kind", "label").agg(F.count(F.lit(1)).alias("n_edges"), (F.max(F.greatest("lat_u", "lat_v")) - F.min(F.least("lat_u", "lat_v"))).alias("dlat"), (F.max(F.greatest("lon_u", "lon_v")) - F.min(F.least("lon_u", "lon_v"))).alias("dlon"))


@query(sql("SELECT a, b, run, kind, label, n_edges FROM runs", _RUNS))
def border_runs(spark: SparkSession, d: str) -> DataFrame:
    return _border_runs(spark, d).select("a", "b", "run", "kind", "label", "n_edges")


@query(sql("SELECT a, b, run, CASE WHEN dlat < 0.25 AND dlon > 0.6 THEN 'parallel' WHEN dlon < 0.25 AND dlat > 0.6 THEN 'longitude' ELSE 'bent' END AS straight FROM runs", _RUNS))
def straight_run(spark: SparkSession, d: str) -> DataFrame:
    r = _border_runs(spark, d)
    return r.select("a", "b", "run", F.when((F.col("dlat") < 0.25) & (F.col("dlon") > 0.6), "parallel").when((F.col("dlon") < 0.25) & (F.col("dlat") > 0.6), "longitude").otherwise("bent").alias("straight"))


@query(sql("SELECT region, count(*) AS n_chokepoints FROM (SELECT a AS region, kind FROM runs UNION ALL SELECT b, kind FROM runs) WHERE kind = 'province' GROUP BY region", _RUNS))
def chokepoints(spark: SparkSession, d: str) -> DataFrame:
    r = _border_runs(spark, d).where("kind = 'province'").select(F.explode(F.array("a", "b")).alias("region"))
    return r.groupBy("region").agg(F.count(F.lit(1)).alias("n_chokepoints"))


@query(sql("SELECT cell FROM mesh m WHERE milli >= 250000 OR EXISTS (SELECT 1 FROM spots s WHERE s.cell = m.cell AND s.population > 0)"))
def keep_rule(spark: SparkSession, d: str) -> DataFrame:
    """Cells that are mostly land or hold a populated place."""
    there = C.places(spark, d).where("population > 0").select("cell").distinct().withColumn("_p", F.lit(True))
    return C.mesh(spark, d).join(there, "cell", "left").where("milli >= 250000 OR _p").select("cell")


@query(sql("""SELECT cma_key, count(*) AS n_cells, CAST(sum(coalesce(people, 0)) AS BIGINT) AS people FROM metro LEFT JOIN mesh USING (cell) GROUP BY cma_key
HAVING bool_and(cell IN (SELECT cell FROM mesh WHERE province IN ('AB', 'SK', 'MB'))) AND sum(coalesce(people, 0)) >= 100"""))
def carve_cmas(spark: SparkSession, d: str) -> DataFrame:
    m = C.mesh(spark, d).select("cell", "province", "people")
    return M.carve_metros(C.cma_cells(spark, d).select("cma_key", "cell"), m.where(F.col("province").isin("AB", "SK", "MB")), m.select("cell", "people"), 100)


@query(sql("SELECT DISTINCT place_key AS grp, coalesce(m.cell, s.cell) AS cell FROM spots s LEFT JOIN mesh m ON m.csd = s.csd"))
def pin_cells(spark: SparkSession, d: str) -> DataFrame:
    g = C.places(spark, d).select(F.col("place_key").alias("grp"), F.col("csd").alias("place_csd"), F.col("cell").alias("own"))
    return M.pin_cells(g, C.newest_cells(spark, d), csd="place_csd", place_cell="own")


# --- aggregates -------------------------------------------------------------------------------------------------

_SUMS = "sums AS (SELECT region, count(*) AS n_cells, CAST(sum(people) AS BIGINT) AS people, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(milli) AS BIGINT) AS milli, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(s_AF) AS BIGINT) AS s_AF, CAST(sum(s_RF) AS BIGINT) AS s_RF FROM mesh JOIN assigned USING (cell) GROUP BY region)"


def _sums(spark: SparkSession, d: str) -> DataFrame:
    return R.region_sums(C.mesh(spark, d), C.assignment(spark, d), ["people", "cents", "milli", "returned", "s_AF", "s_RF"])


@query(sql(f"SELECT region, n_cells, people, cents, milli, {_q('returned', 'people')} AS returned_share FROM sums", _SUMS))
def region_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return _sums(spark, d).select("region", "n_cells", "people", "cents", "milli", half_up(ratio(F.col("returned"), F.col("people")), 6).alias("returned_share"))


_STATS = f"""{_SUMS}, weighted AS (SELECT region, CAST(sum(CAST(people AS HUGEINT) * returned) AS DOUBLE) AS wx, CAST(sum(CAST(people AS HUGEINT) * returned * returned) AS DOUBLE) AS wxx, CAST(sum(people) AS DOUBLE) AS w FROM mesh JOIN assigned USING (cell) GROUP BY region),
inner_sides AS (SELECT a.region, 2 * count(*) AS n FROM edges JOIN assigned a ON a.cell = u JOIN assigned b ON b.cell = v WHERE a.region = b.region GROUP BY a.region)"""


@query(sql(f"SELECT region, {_r('coalesce(wx / nullif(w, 0), 0)', 4)} AS mean, {_r('greatest(0, coalesce(wxx / nullif(w, 0) - (wx / nullif(w, 0)) * (wx / nullif(w, 0)), 0))', 2)} AS variance, CAST(greatest(0, 6 * n_cells - coalesce(n, 0)) AS BIGINT) AS sides FROM weighted JOIN sums USING (region) LEFT JOIN inner_sides USING (region)", _STATS))
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean and variance (E[x2] - E[x]2, not below 0) of a column, and outer hexagon sides."""
    x = C.mesh(spark, d).join(C.assignment(spark, d), "cell").select("region", F.col("people").cast("decimal(20,0)").alias("w"), F.col("returned").cast("decimal(10,0)").alias("x"))
    g = x.groupBy("region").agg(F.sum("w").cast("double").alias("w"), F.sum(F.col("w") * F.col("x")).cast("double").alias("wx"), F.sum((F.col("w") * F.col("x")).cast("decimal(28,0)") * F.col("x")).cast("double").alias("wxx"))
    mean = F.try_divide("wx", "w")
    v = F.greatest(F.lit(0.0), F.coalesce(F.try_divide("wxx", "w") - mean * mean, F.lit(0.0)))
    return g.join(R.perimeter_sides(C.edges(spark, d), C.assignment(spark, d)), "region").select("region", half_up(F.coalesce(mean, F.lit(0.0)), 4).alias("mean"), half_up(v, 2).alias("variance"), F.col("sides").cast("bigint").alias("sides"))


@query(sql(f"SELECT cd, {_q('sum(CAST(people AS HUGEINT) * returned)', 'sum(people)')} AS mean FROM mesh GROUP BY cd"))
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return C.mesh(spark, d).groupBy("cd").agg(half_up(ratio(F.sum(F.col("people").cast("decimal(20,0)") * F.col("returned")), F.sum("people")), 6).alias("mean"))


@query(sql("SELECT province, cd, grouping_id(province, cd) AS level, count(*) AS n_cells, CAST(sum(people) AS BIGINT) AS people, CAST(sum(milli) AS BIGINT) AS milli FROM mesh GROUP BY ROLLUP (province, cd)").replace("grouping_id(province, cd) AS level", "CAST(grouping_id(province, cd) AS BIGINT) AS level"))
def hex_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Cells rolled up to divisions and provinces in one pass."""
    return C.mesh(spark, d).rollup("province", "cd").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_cells"), F.sum("people").alias("people"), F.sum("milli").alias("milli"))


@query(sql("""SELECT cell, csd, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY csd ORDER BY rest DESC, cell) <= 1000 - sum(fl) OVER (PARTITION BY csd) THEN 1 ELSE 0 END AS BIGINT) AS seats FROM (
  SELECT cell, csd, (w * 1000) // s AS fl, (w * 1000) % s AS rest FROM (SELECT cell, csd, CASE WHEN t = 0 THEN 1 ELSE people END AS w, CASE WHEN t = 0 THEN n ELSE t END AS s FROM (
    SELECT cell, csd, CAST(people AS HUGEINT) AS people, sum(people) OVER (PARTITION BY csd) AS t, count(*) OVER (PARTITION BY csd) AS n FROM mesh)))"""))
def apportion(spark: SparkSession, d: str) -> DataFrame:
    """1,000 seats of each csd to its cells by people."""
    return R.apportion(C.mesh(spark, d).select("cell", "csd", "people").withColumn("total", F.lit(1000).cast("bigint")), "csd", "cell", "people", "total", "seats").select("cell", "csd", "seats")


@query(sql("""WITH t AS (SELECT csd, CAST(sum(population) AS HUGEINT) AS total FROM spots GROUP BY csd), c AS (SELECT m.cell, m.csd, CAST(milli AS HUGEINT) AS w0, total, sum(milli) OVER (PARTITION BY m.csd) AS s0, count(*) OVER (PARTITION BY m.csd) AS n FROM mesh m JOIN t USING (csd)),
e AS (SELECT cell, csd, total, CASE WHEN s0 = 0 THEN 1 ELSE w0 END AS w, CASE WHEN s0 = 0 THEN n ELSE s0 END AS s FROM c), f AS (SELECT cell, csd, total, (w * total) // s AS fl, (w * total) % s AS rest FROM e)
SELECT cell, csd, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY csd ORDER BY rest DESC, cell) <= total - sum(fl) OVER (PARTITION BY csd) THEN 1 ELSE 0 END AS BIGINT) AS population FROM f""".replace("WITH t AS", "__")).replace("\n__", ", t AS", 1))
def population_columns(spark: SparkSession, d: str) -> DataFrame:
    """Each csd's people, from its places, as whole people in its cells by area."""
    t = C.places(spark, d).groupBy("csd").agg(F.sum("population").alias("total"))
    return R.apportion(C.mesh(spark, d).select("cell", "csd", "milli").join(t, "csd"), "csd", "cell", "milli", "total", "population").select("cell", "csd", "population")


@query(sql(f"SELECT cell, {_q('s_AF', 'cents')} AS share_af, {_q('s_RF', 'cents')} AS share_rf, {_r('greatest(0, least(1, 1 - coalesce(CAST(s_AF AS DOUBLE) / nullif(CAST(cents AS DOUBLE), 0), 0) - coalesce(CAST(s_RF AS DOUBLE) / nullif(CAST(cents AS DOUBLE), 0), 0)))')} AS share_other FROM mesh"))
def language_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of two parts and the rest, held within 0 and 1."""
    a, b = ratio(F.col("s_AF"), F.col("cents")), ratio(F.col("s_RF"), F.col("cents"))
    return C.mesh(spark, d).select("cell", half_up(a, 6).alias("share_af"), half_up(b, 6).alias("share_rf"), half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - a - b)), 6).alias("share_other"))


@query(sql("""SELECT m.cell, CASE WHEN best.cls IS NOT NULL THEN best.cls WHEN milli > 0 AND people * 1000 / CAST(milli AS DOUBLE) >= 0.4 THEN 1 ELSE 0 END AS urban FROM mesh m LEFT JOIN (
  SELECT cell, max(cls) AS cls FROM (SELECT cell, cls, w, max(w) OVER (PARTITION BY cell) AS top FROM (SELECT cell, CASE WHEN population >= 5000 THEN 3 ELSE 2 END AS cls, sum(population) AS w FROM spots WHERE population > 0 GROUP BY ALL)) WHERE w = top GROUP BY cell) best ON best.cell = m.cell"""))
def urban_class(spark: SparkSession, d: str) -> DataFrame:
    """The class with most people (ties to the higher class), else by density."""
    p = C.places(spark, d).where("population > 0").groupBy("cell", F.when(F.col("population") >= 5000, 3).otherwise(2).alias("cls")).agg(F.sum("population").alias("w"))
    best = p.groupBy("cell").agg(F.max(F.struct("w", "cls"))["cls"].alias("cls"))
    return C.mesh(spark, d).join(best, "cell", "left").select("cell", F.when(F.col("cls").isNotNull(), F.col("cls")).when(ratio(F.col("people") * 1000, F.col("milli")) >= 0.4, 1).otherwise(0).alias("urban"))


@query(sql(f"""SELECT cell, label AS industry FROM (SELECT cell, label, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN own > 0 THEN amount ELSE of_cd END DESC, label) AS rn FROM (
  SELECT cell, label, amount, sum(amount) OVER (PARTITION BY cell) AS own, sum(amount) OVER (PARTITION BY cd, label) AS of_cd FROM sectors)) WHERE rn = 1""", _LONG))
def industry_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest sector of each cell; an empty cell takes its division's mix. The division's sums are made first and
    joined, so no window holds a division."""
    s = _sectors(spark, d)
    of_cd = s.groupBy("cd", "label").agg(F.sum("amount").alias("of_cd"))
    own = s.groupBy("cell").agg(F.sum("amount").alias("own"))
    x = s.join(own, "cell").join(of_cd, ["cd", "label"]).withColumn("w", F.when(F.col("own") > 0, F.col("amount")).otherwise(F.col("of_cd")))
    return R.dominant(x, "cell", "label", F.col("w")).select("cell", F.col("label").alias("industry"))


@query(sql(f"""SELECT cell, {_r('sum(given)', 2)} AS gdp FROM (SELECT cell, province, label, CASE WHEN s > 0 THEN CAST(v AS DOUBLE) * CAST(amount AS DOUBLE) / CAST(s AS DOUBLE) WHEN p > 0 THEN CAST(v AS DOUBLE) * CAST(people AS DOUBLE) / CAST(p AS DOUBLE) ELSE 0 END AS given FROM (
  SELECT s.cell, s.province, label, amount, people, sum(amount) OVER (PARTITION BY s.province, label) AS s, sum(people) OVER (PARTITION BY s.province, label) AS p, 1000 * count(*) OVER (PARTITION BY s.province, label) AS v FROM sectors s JOIN mesh USING (cell))) GROUP BY cell""", _LONG))
def gdp_allocation(spark: SparkSession, d: str) -> DataFrame:
    """A total of each province and sector (here 1,000 a cell) shared by labour, or by people where there is none."""
    s = _sectors(spark, d).join(C.mesh(spark, d).select("cell", "people"), "cell")
    t = s.groupBy("province", "label").agg(F.sum("amount").alias("s"), F.sum("people").alias("p"), (1000 * F.count(F.lit(1))).alias("v"))
    dbl = lambda c: F.col(c).cast("double")
    given = F.when(F.col("s") > 0, F.try_divide(dbl("v") * dbl("amount"), dbl("s"))).when(F.col("p") > 0, F.try_divide(dbl("v") * dbl("people"), dbl("p"))).otherwise(F.lit(0.0))
    return s.join(t, ["province", "label"]).groupBy("cell").agg(half_up(F.sum(given), 2).alias("gdp"))


@query(sql(f"SELECT cell, CASE WHEN greatest(s_AF, s_RF, s_NF + s_NO) = 0 THEN 'none' WHEN s_AF >= s_RF AND s_AF >= s_NF + s_NO THEN 'af' WHEN s_RF >= s_NF + s_NO THEN 'rf' ELSE 'n' END AS mix FROM mesh"))
def treaty_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest part, the first of equals."""
    n = F.col("s_NF") + F.col("s_NO")
    return C.mesh(spark, d).select("cell", F.when(F.greatest(F.col("s_AF"), F.col("s_RF"), n) == 0, "none").when((F.col("s_AF") >= F.col("s_RF")) & (F.col("s_AF") >= n), "af").when(F.col("s_RF") >= n, "rf").otherwise("n").alias("mix"))


@query(sql("SELECT region, label FROM (SELECT region, label, row_number() OVER (PARTITION BY region ORDER BY sum(amount) DESC, label) AS rn FROM sectors JOIN assigned USING (cell) GROUP BY region, label) WHERE rn = 1", _LONG))
def dominant_label(spark: SparkSession, d: str) -> DataFrame:
    return R.dominant(_sectors(spark, d).join(C.assignment(spark, d), "cell"), "region", "label", F.col("amount")).select("region", "label")


@query(sql(f"SELECT region, label, place, w, {_q('w', 't')} AS share FROM (SELECT region, label, CAST(sum(amount) AS BIGINT) AS w, sum(sum(amount)) OVER (PARTITION BY region) AS t, CAST(row_number() OVER (PARTITION BY region ORDER BY sum(amount) DESC, label) AS INTEGER) AS place FROM sectors JOIN other USING (cell) GROUP BY region, label) WHERE place <= 3", _LONG))
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return R.label_shares(_sectors(spark, d).join(C.other_split(spark, d), "cell"), "region", "label", F.col("amount"), 3).select("region", "label", "place", "w", "share")


@query(sql(f"""SELECT region, {_r('coalesce(CAST(s_AF + s_RF AS DOUBLE) / nullif(CAST(cents AS DOUBLE), 0), 0)', 3)} AS resource_index, {_r('CASE WHEN hi > lo THEN (CAST(people AS DOUBLE) - lo) / (hi - lo) ELSE 0 END', 3)} AS population_score
FROM sums, (SELECT CAST(min(people) AS DOUBLE) AS lo, CAST(max(people) AS DOUBLE) AS hi FROM sums)""", _SUMS))
def region_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _sums(spark, d)
    ends = s.agg(F.min("people").cast("double").alias("lo"), F.max("people").cast("double").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.try_divide(F.col("people").cast("double") - F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(0.0)
    return s.crossJoin(F.broadcast(ends)).select("region", half_up(ratio(F.col("s_AF") + F.col("s_RF"), F.col("cents")), 3).alias("resource_index"), half_up(scaled, 3).alias("population_score"))


_POWER = f"""{_SUMS}, power AS (SELECT region, {_r('''0.5 * CAST(cents AS DOUBLE) / (SELECT sum(cents) FROM sums) + 0.3 * CAST(s_AF + s_RF AS DOUBLE) / (SELECT sum(s_AF + s_RF) FROM sums) + 0.2 * CAST(n_cells AS DOUBLE) / (SELECT max(n_cells) FROM sums)''')} AS score FROM sums)"""


@query(sql("SELECT region, score, CAST(row_number() OVER (ORDER BY score DESC, region) AS INTEGER) AS place FROM power", _POWER))
def power_ranking(spark: SparkSession, d: str) -> DataFrame:
    s = _sums(spark, d)
    t = s.agg(F.sum("cents").cast("double").alias("c"), F.sum(F.col("s_AF") + F.col("s_RF")).cast("double").alias("x"), F.max("n_cells").cast("double").alias("n"))
    score = 0.5 * F.col("cents").cast("double") / F.col("c") + 0.3 * (F.col("s_AF") + F.col("s_RF")).cast("double") / F.col("x") + 0.2 * F.col("n_cells").cast("double") / F.col("n")
    return s.crossJoin(F.broadcast(t)).select("region", half_up(score, 6).alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "region")))


@query(sql(f"SELECT {_r('CASE WHEN count(*) FILTER (people > 0) >= 2 THEN CAST(max(people) AS DOUBLE) / CAST(min(people) FILTER (people > 0) AS DOUBLE) END')} AS people_ratio FROM sums", _SUMS))
def set_ratios(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("people") > 0, F.col("people").cast("double"))
    return _sums(spark, d).agg(half_up(F.when(F.count(p) >= 2, F.max(p) / F.min(p)), 6).alias("people_ratio"))


@query(sql("SELECT cma_key, list_sort(list(DISTINCT region)) AS regions FROM metro JOIN other USING (cell) GROUP BY cma_key HAVING count(DISTINCT region) > 1"))
def metros_split(spark: SparkSession, d: str) -> DataFrame:
    g = C.cma_cells(spark, d).join(C.other_split(spark, d), "cell").groupBy("cma_key").agg(F.sort_array(F.collect_set("region")).alias("regions"))
    return g.where(F.size("regions") > 1)


@query(sql("SELECT (SELECT CAST(sum(people) AS BIGINT) FROM sums) AS of_regions, (SELECT CAST(sum(people) AS BIGINT) FROM mesh) AS of_scope, (SELECT sum(people) FROM sums) = (SELECT sum(people) FROM mesh) AS is_ok", _SUMS))
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    a = _sums(spark, d).agg(F.sum("people").alias("of_regions"))
    b = C.mesh(spark, d).agg(F.sum("people").alias("of_scope"))
    return a.crossJoin(b).withColumn("is_ok", F.col("of_regions") == F.col("of_scope"))


_NB = "nb AS (SELECT a.region AS a, b.region AS b, count(*) AS n_edges FROM (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) e JOIN other a ON a.cell = u JOIN other b ON b.cell = v WHERE a.region <> b.region GROUP BY ALL)"


@query(sql("SELECT a, b, n_edges FROM nb", _NB))
def edge_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return R.region_neighbours(C.edges(spark, d), C.other_split(spark, d))


_OSUM = "osum AS (SELECT region, CAST(sum(people) AS BIGINT) AS people, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(s_AF) AS BIGINT) AS s_AF, CAST(sum(s_RF) AS BIGINT) AS s_RF FROM mesh JOIN other USING (cell) GROUP BY region)"
_FEATURES = "CAST(s_AF AS DOUBLE) / CAST(cents AS DOUBLE) AS f1, CAST(s_RF AS DOUBLE) / CAST(cents AS DOUBLE) AS f2, least(1, CAST(people AS DOUBLE) / 100000) AS f3"


@query(sql(f"""SELECT a AS region, b AS rival, {_r('s')} AS similarity FROM (SELECT a, b, 1 / (1 + sqrt((x.f1 - y.f1) * (x.f1 - y.f1) + (x.f2 - y.f2) * (x.f2 - y.f2) + (x.f3 - y.f3) * (x.f3 - y.f3))) AS s FROM nb
 JOIN (SELECT region, {_FEATURES} FROM osum) x ON x.region = a JOIN (SELECT region, {_FEATURES} FROM osum) y ON y.region = b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1""", f"{_NB}, {_OSUM}"))
def rival_region(spark: SparkSession, d: str) -> DataFrame:
    """The most similar neighbour over three features, ties to the smaller region."""
    dbl = lambda c: F.col(c).cast("double")
    f = R.region_sums(C.mesh(spark, d), C.other_split(spark, d), ["people", "cents", "s_AF", "s_RF"]).select("region", F.struct((dbl("s_AF") / dbl("cents")).alias("a"), (dbl("s_RF") / dbl("cents")).alias("b"), F.least(F.lit(1.0), dbl("people") / 100000).alias("c")).alias("f"))
    n = R.region_neighbours(C.edges(spark, d), C.other_split(spark, d)).join(f.select(F.col("region").alias("a"), F.col("f").alias("x")), "a").join(f.select(F.col("region").alias("b"), F.col("f").alias("y")), "b")
    sq = sum((F.col(f"x.{k}") - F.col(f"y.{k}")) * (F.col(f"x.{k}") - F.col(f"y.{k}")) for k in "abc")
    g = n.withColumn("s", 1 / (1 + F.sqrt(sq))).groupBy("a").agg(F.max(F.struct("s", (-F.col("b")).alias("b"))).alias("m"))
    return g.select(F.col("a").alias("region"), (-F.col("m.b")).alias("rival"), half_up(F.col("m.s"), 6).alias("similarity"))


@query(sql("SELECT a.region AS ra, b.region AS rb, count(*) AS n_cells, CAST(sum(people) AS BIGINT) AS people FROM assigned a JOIN other b USING (cell) JOIN mesh USING (cell) GROUP BY ALL"))
def overlap_matrix(spark: SparkSession, d: str) -> DataFrame:
    return R.compare_overlap(C.assignment(spark, d), C.other_split(spark, d), C.mesh(spark, d).select("cell", "people"))


@query()
def match_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one matching of two splits' regions by shared cells."""
    return R.greedy_match(overlap_matrix(spark, d), "ra", "rb", "n_cells")


@query(sql("SELECT cell, region FROM assigned"))
def actual_baseline(spark: SparkSession, d: str) -> DataFrame:
    return C.assignment(spark, d)


@query(sql(f"""SELECT sum(t) AS balance_k, {_r('sum(t) / count(*)')} AS balance FROM (SELECT (CAST(people AS DOUBLE) - m) / m * ((CAST(people AS DOUBLE) - m) / m) AS t FROM sums, (SELECT CAST(sum(people) AS DOUBLE) / count(*) AS m FROM sums))""", _SUMS).replace("sum(t) AS balance_k, ", f"{_r('sum(t)')} AS balance_k, (SELECT count(*) FROM edges JOIN assigned a ON a.cell = u JOIN assigned b ON b.cell = v WHERE a.region <> b.region) AS cut_edges, (SELECT count(*) FROM edges) AS all_edges, "))
def cost_terms(spark: SparkSession, d: str) -> DataFrame:
    """Balance (mean squared miss of the mean load) and compactness (edges cut of all edges) of a split."""
    s = _sums(spark, d).select(F.col("people").cast("double").alias("p"))
    m = s.agg((F.sum("p") / F.count(F.lit(1))).alias("m"))
    t = (F.col("p") - F.col("m")) / F.col("m")
    b = s.crossJoin(F.broadcast(m)).agg(half_up(F.sum(t * t), 6).alias("balance_k"), half_up(F.sum(t * t) / F.count(F.lit(1)), 6).alias("balance"))
    e = M.with_ends(C.edges(spark, d), C.assignment(spark, d), "cell", ["region"]).agg(F.count(F.when(F.col("region_u") != F.col("region_v"), 1)).alias("cut_edges"), F.count(F.lit(1)).alias("all_edges"))
    return b.crossJoin(e)


@query(sql(f"SELECT region, {_q('people * 1000', 'milli', 2)} AS density, {_q('cents', 'people * 100', 3)} AS per_head, CASE WHEN people > 0 THEN 'peopled' ELSE 'empty' END AS kind FROM sums", _SUMS))
def dossier_record(spark: SparkSession, d: str) -> DataFrame:
    return _sums(spark, d).select("region", half_up(ratio(F.col("people") * 1000, F.col("milli")), 2).alias("density"), half_up(ratio(F.col("cents"), F.col("people") * 100), 3).alias("per_head"), F.when(F.col("people") > 0, "peopled").otherwise("empty").alias("kind"))


@query(sql(f"""SELECT cma_key, people, {_r('lon')} AS lon, {_r('lat')} AS lat, {_r('sqrt(CAST(people AS DOUBLE) / max(people) OVER ())')} AS size FROM (SELECT cma_key, CAST(sum(people) AS BIGINT) AS people, sum(people * lon) / nullif(sum(people), 0) AS lon, sum(people * lat) / nullif(sum(people), 0) AS lat FROM metro JOIN mesh USING (cell) GROUP BY cma_key)"""))
def immigrant_halos(spark: SparkSession, d: str) -> DataFrame:
    g = C.cma_cells(spark, d).join(C.mesh(spark, d), "cell").groupBy("cma_key").agg(F.sum("people").alias("people"), F.try_divide(F.sum(F.col("people") * F.col("lon")), F.sum("people")).alias("lon"), F.try_divide(F.sum(F.col("people") * F.col("lat")), F.sum("people")).alias("lat"))
    top = g.agg(F.max("people").alias("top"))
    return g.crossJoin(F.broadcast(top)).select("cma_key", "people", half_up(F.col("lon"), 6).alias("lon"), half_up(F.col("lat"), 6).alias("lat"), half_up(F.sqrt(F.col("people").cast("double") / F.col("top")), 6).alias("size"))


@query(sql("SELECT csd, province FROM (SELECT csd, province, row_number() OVER (PARTITION BY csd ORDER BY sum(milli) DESC, province) AS rn FROM mesh GROUP BY csd, province) WHERE rn = 1"))
def province_by_land(spark: SparkSession, d: str) -> DataFrame:
    return R.dominant(C.mesh(spark, d), "csd", "province", F.col("milli")).select("csd", "province")


@query(sql("SELECT region, 'Region ' || CAST(row_number() OVER (ORDER BY coalesce(CAST(cents AS DOUBLE) / nullif(people, 0), 0) DESC, region) AS VARCHAR) AS name FROM sums", _SUMS))
def rule_names(spark: SparkSession, d: str) -> DataFrame:
    s = _sums(spark, d).withColumn("m", ratio(F.col("cents"), F.col("people")))
    return s.select("region", F.concat(F.lit("Region "), F.row_number().over(Window.orderBy(F.col("m").desc(), "region")).cast("string")).alias("name"))


# --- rule findings ----------------------------------------------------------------------------------------------


@query(sql("""SELECT region, CAST(count(DISTINCT province) AS BIGINT) AS n_divisions, CASE WHEN count(DISTINCT province) > 3 THEN 'breaks' WHEN count(DISTINCT province) > 1 THEN 'strained' ELSE 'holds' END AS finding FROM mesh JOIN other USING (cell) GROUP BY region"""))
def federalism_senate_divisions(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("province")
    return C.newest_cells(spark, d).join(C.other_split(spark, d), "cell").groupBy("region").agg(n.alias("n_divisions")).withColumn("finding", F.when(F.col("n_divisions") > 3, "breaks").when(F.col("n_divisions") > 1, "strained").otherwise("holds"))


_SHARE = "shared AS (SELECT region, people, row_number() OVER (ORDER BY people, region) AS up, row_number() OVER (ORDER BY people DESC, region) AS down, count(*) OVER () AS n, sum(people) OVER () AS t FROM osum)"


@query(sql("""SELECT CAST(max(n) AS BIGINT) AS n, CASE WHEN CAST(sum(CASE WHEN up <= ceil(2 * n / 3.0) THEN people ELSE 0 END) AS DOUBLE) >= 0.5 * max(t) THEN 'breaks' WHEN CAST(sum(CASE WHEN down <= ceil(2 * n / 3.0) THEN people ELSE 0 END) AS DOUBLE) < 0.5 * max(t) THEN 'breaks' ELSE 'strained' END AS finding FROM shared""", f"{_OSUM}, {_SHARE}"))
def federalism_seven_fifty(spark: SparkSession, d: str) -> DataFrame:
    """Whether two thirds of the regions, smallest or largest, hold half of the people."""
    s = R.region_sums(C.mesh(spark, d), C.other_split(spark, d), ["people"])
    s = s.withColumn("up", F.row_number().over(Window.orderBy("people", "region"))).withColumn("down", F.row_number().over(Window.orderBy(F.col("people").desc(), "region")))
    t = s.agg(F.count(F.lit(1)).alias("n"), F.sum("people").alias("t"))
    need = F.ceil(2 * F.col("n") / 3.0)
    g = s.crossJoin(F.broadcast(t)).groupBy("n", "t").agg(F.sum(F.when(F.col("up") <= need, F.col("people")).otherwise(0)).alias("small"), F.sum(F.when(F.col("down") <= need, F.col("people")).otherwise(0)).alias("large"))
    half = 0.5 * F.col("t").cast("double")
    return g.select("n", F.when((F.col("small") >= half) | (F.col("large") < half), "breaks").otherwise("strained").alias("finding"))


@query(sql("""SELECT CAST(count(*) FILTER (p < m) AS BIGINT) AS n_below, CASE WHEN 2 * count(*) FILTER (p < m) > count(*) THEN 'strained' ELSE 'holds' END AS finding FROM (SELECT CAST(cents AS DOUBLE) / people AS p, (SELECT CAST(sum(cents) AS DOUBLE) / sum(people) FROM osum) AS m FROM osum)""", _OSUM))
def federalism_fiscal_capacity(spark: SparkSession, d: str) -> DataFrame:
    s = R.region_sums(C.mesh(spark, d), C.other_split(spark, d), ["people", "cents"])
    t = s.agg((F.sum("cents").cast("double") / F.sum("people")).alias("m"))
    g = s.crossJoin(F.broadcast(t)).agg(F.count(F.when(F.col("cents").cast("double") / F.col("people") < F.col("m"), 1)).alias("n_below"), F.count(F.lit(1)).alias("n"))
    return g.select("n_below", F.when(2 * F.col("n_below") > F.col("n"), "strained").otherwise("holds").alias("finding"))


def _intact(spark: SparkSession, d: str, provinces: list[str]) -> DataFrame:
    g = C.newest_cells(spark, d).where(F.col("province").isin(provinces)).join(C.other_split(spark, d), "cell").agg(F.count_distinct("region").alias("n_regions"))
    return g.withColumn("finding", F.when(F.col("n_regions") > 1, "breaks").otherwise("holds"))


def _intact_sql(provinces: str) -> str:
    return sql(f"SELECT CAST(count(DISTINCT region) AS BIGINT) AS n_regions, CASE WHEN count(DISTINCT region) > 1 THEN 'breaks' ELSE 'holds' END AS finding FROM mesh JOIN other USING (cell) WHERE province IN ({provinces})")


@query(_intact_sql("'QC'"))
def federalism_quebec_intact(spark: SparkSession, d: str) -> DataFrame:
    return _intact(spark, d, ["QC"])


@query(_intact_sql("'YT', 'NT', 'NU'"))
def federalism_territories_intact(spark: SparkSession, d: str) -> DataFrame:
    return _intact(spark, d, ["YT", "NT", "NU"])


@query(sql(f"SELECT {_r('CAST(min(people) AS DOUBLE) / sum(people)')} AS least_share, CASE WHEN CAST(min(people) AS DOUBLE) / sum(people) < 1 / 338.0 THEN 'strained' ELSE 'holds' END AS finding FROM osum", _OSUM))
def federalism_senate_floor(spark: SparkSession, d: str) -> DataFrame:
    g = R.region_sums(C.mesh(spark, d), C.other_split(spark, d), ["people"]).agg((F.min("people").cast("double") / F.sum("people")).alias("s"))
    return g.select(half_up(F.col("s"), 6).alias("least_share"), F.when(F.col("s") < 1 / 338.0, "strained").otherwise("holds").alias("finding"))


# --- text and small operators -----------------------------------------------------------------------------------


@query(sql("SELECT place_key, trim(regexp_replace(translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM spots"))
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return C.places(spark, d).select("place_key", slug(F.col("name")).alias("slug"), xml_escape(F.col("name")).alias("xml"))


@query(sql("SELECT place_key, name, population FROM spots WHERE lower(name) LIKE 'port%' ORDER BY population DESC, name, place_key LIMIT 8"))
def place_search(spark: SparkSession, d: str) -> DataFrame:
    """Top 8 places by population whose name begins as typed."""
    return C.places(spark, d).where(F.lower("name").startswith("port")).orderBy(F.col("population").desc(), "name", "place_key").limit(8).select("place_key", "name", "population")


@query(sql("SELECT region, place_key FROM (SELECT region, place_key, row_number() OVER (PARTITION BY region ORDER BY population DESC, place_key) AS rn FROM spots JOIN other USING (cell)) WHERE rn = 1"))
def region_top_place(spark: SparkSession, d: str) -> DataFrame:
    g = C.places(spark, d).join(C.other_split(spark, d), "cell").groupBy("region").agg(F.max(F.struct("population", (-F.col("place_key")).alias("k"))).alias("m"))
    return g.select("region", (-F.col("m.k")).alias("place_key"))


@query(sql("SELECT m.cell, CASE WHEN s.place_key IS NULL THEN false ELSE true END AS is_capital FROM mesh m LEFT JOIN (SELECT cell, min(place_key) AS place_key FROM spots WHERE population >= 5000 GROUP BY cell) s ON s.cell = m.cell"))
def left_join_null_layer(spark: SparkSession, d: str) -> DataFrame:
    s = C.places(spark, d).where("population >= 5000").groupBy("cell").agg(F.min("place_key").alias("place_key"))
    return C.mesh(spark, d).join(s, "cell", "left").select("cell", F.col("place_key").isNotNull().alias("is_capital"))


@query(sql("""SELECT region, cell FROM (SELECT region, m.cell, row_number() OVER (PARTITION BY region ORDER BY floor(((lon - mx) * (lon - mx) + (lat - my) * (lat - my)) * 1e6), m.cell) AS rn
  FROM mesh m JOIN assigned a ON a.cell = m.cell JOIN (SELECT region AS r, avg(lon) AS mx, avg(lat) AS my FROM mesh JOIN assigned USING (cell) GROUP BY region) c ON c.r = a.region) WHERE rn = 1"""))
def label_point(spark: SparkSession, d: str) -> DataFrame:
    """The region's cell nearest its mean centre (to a millionth of a square degree), ties to the smaller cell."""
    m = C.mesh(spark, d).select("cell", "lon", "lat").join(C.assignment(spark, d), "cell")
    c = m.groupBy("region").agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my"))
    dx, dy = F.col("lon") - F.col("mx"), F.col("lat") - F.col("my")
    g = m.join(c, "region").groupBy("region").agg(F.min(F.struct(F.floor((dx * dx + dy * dy) * 1e6).alias("q"), F.col("cell"))).alias("x"))
    return g.select("region", "x.cell")


@query(sql("SELECT cell, count(*) AS n_metros FROM metro GROUP BY cell"))
def side_table_csr(spark: SparkSession, d: str) -> DataFrame:
    """Metros per cell, the sizes behind the offsets of a ragged list."""
    return C.cma_cells(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n_metros"))


@query(sql("""SELECT cma_key, CAST(sum(people) AS BIGINT) AS people, list_sort(list(cell)) AS cells FROM metro JOIN mesh USING (cell) GROUP BY cma_key"""))
def cma_membership(spark: SparkSession, d: str) -> DataFrame:
    return C.cma_cells(spark, d).join(C.mesh(spark, d).select("cell", "people"), "cell").groupBy("cma_key").agg(F.sum("people").alias("people"), F.sort_array(F.collect_list("cell")).alias("cells"))


@query(sql("SELECT cell, n FROM (SELECT cell, unnest(neighbours) AS n FROM mesh) WHERE n IN (SELECT cell FROM mesh) AND NOT EXISTS (SELECT 1 FROM (SELECT cell AS c, unnest(neighbours) AS k FROM mesh) b WHERE b.c = n AND b.k = cell) GROUP BY cell, n"))
def order_checks(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour links that only one side tells."""
    m = C.newest_cells(spark, d)
    told = m.select("cell", F.explode("neighbours").alias("n")).join(m.select(F.col("cell").alias("n")), "n", "left_semi").distinct()
    return told.join(told.select(F.col("n").alias("cell"), F.col("cell").alias("n")), ["cell", "n"], "left_anti").select("cell", "n")


@query(sql("SELECT s.csd FROM spots s WHERE s.csd IS NOT NULL AND s.csd NOT IN (SELECT csd FROM mesh WHERE csd IS NOT NULL) GROUP BY s.csd"))
def anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return C.places(spark, d).where("csd IS NOT NULL").select("csd").join(C.newest_cells(spark, d).select("csd"), "csd", "left_anti").distinct()


@query(sql(f"SELECT m.cell, {_r('greatest(0, least(1, coalesce(CAST(returned AS DOUBLE) / nullif(people, 0), CAST(cr AS DOUBLE) / nullif(cp, 0), 0)))')} AS share FROM mesh m LEFT JOIN (SELECT csd, sum(returned) AS cr, sum(people) AS cp FROM mesh GROUP BY csd) c ON c.csd = m.csd"))
def fallback_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = C.mesh(spark, d)
    c = m.groupBy("csd").agg(F.sum("returned").alias("cr"), F.sum("people").alias("cp"))
    r = F.coalesce(F.try_divide(F.col("returned").cast("double"), F.col("people")), F.try_divide(F.col("cr").cast("double"), F.col("cp")), F.lit(0.0))
    return m.join(c, "csd", "left").select("cell", half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)), 6).alias("share"))


@query(sql(f"""SELECT m.cell, {_r('''CAST(total AS DOUBLE) * CASE WHEN sum(people) OVER (PARTITION BY m.csd) > 0 THEN CAST(people AS DOUBLE) / CAST(sum(people) OVER (PARTITION BY m.csd) AS DOUBLE) ELSE coalesce(CAST(milli AS DOUBLE) / nullif(CAST(sum(milli) OVER (PARTITION BY m.csd) AS DOUBLE), 0), 0) END''', 4)} AS total FROM mesh m JOIN (SELECT csd, sum(population) AS total FROM spots GROUP BY csd) t ON t.csd = m.csd"""))
def csd_spread(spark: SparkSession, d: str) -> DataFrame:
    t = C.places(spark, d).groupBy("csd").agg(F.sum("population").cast("double").alias("total"))
    return R.spread(t, C.mesh(spark, d), "csd", "total", "people", "milli").select("cell", half_up(F.col("total"), 4).alias("total"))


@query(sql("SELECT cell, n.n_name AS label FROM mesh JOIN nation n ON n.n_nationkey = cell % 30"))
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Codes to labels; codes without a label are dropped."""
    return C.mesh(spark, d).select("cell", (F.col("cell") % 30).cast("int").alias("n_nationkey")).join(table(spark, d, "nation"), "n_nationkey").select("cell", F.col("n_name").alias("label"))


_PARENT = "(x - (CAST(1 AS BIGINT) << 52)) | (CAST(7 AS BIGINT) << CAST(3 * (15 - ((x >> 52) & 15)) AS INTEGER))"


@query(sql(f"SELECT cell, lpad(lower(to_hex({_PARENT})), 15, '0') AS parent FROM (SELECT cell, CAST('0x' || id AS BIGINT) AS x FROM mesh) WHERE (x >> 52) & 15 > 0"))
def parent_join(spark: SparkSession, d: str) -> DataFrame:
    """The index of the next coarser cell: the resolution one less and the digit of the old resolution unused."""
    m = C.mesh(spark, d).select("cell", F.conv("id", 16, 10).cast("bigint").alias("x"))
    level = F.shiftright("x", 52).bitwiseAND(F.lit(15))
    parent = F.expr("(x - shiftleft(1L, 52)) | shiftleft(7L, cast(3 * (15 - (shiftright(x, 52) & 15)) as int))")
    return m.where(level > 0).select("cell", F.lpad(F.lower(F.hex(parent)), 15, "0").alias("parent"))


@query(sql("SELECT cell, list_sort(list(DISTINCT n)) AS ring FROM (SELECT u AS cell, v AS n FROM edges UNION ALL SELECT v, u FROM edges) GROUP BY cell"))
def kring_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return M.both_ways(C.edges(spark, d)).groupBy(F.col("u").alias("cell")).agg(F.sort_array(F.collect_set("v")).alias("ring"))


@query(sql("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) AS n_either FROM (SELECT a.cell AS a, b.cell AS b FROM (SELECT cell FROM assigned WHERE region = 0) a FULL JOIN (SELECT cell FROM other WHERE region = 0) b ON a.cell = b.cell)"))
def iou_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = C.assignment(spark, d).where("region = 0").select("cell", F.lit(1).alias("a"))
    b = C.other_split(spark, d).where("region = 0").select("cell", F.lit(1).alias("b"))
    return a.join(b, "cell", "full_outer").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_both"), F.count(F.lit(1)).alias("n_either"))


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return C.assignment(spark, d).where("region IN (0, 1, 2)").select("cell"), C.other_split(spark, d).where("region IN (0, 2, 4)").select("cell")


for _name, _op in (("geom_union", "UNION"), ("geom_intersect", "INTERSECT"), ("geom_minus", "EXCEPT")):
    def _set(spark: SparkSession, d: str, op: str = _op) -> DataFrame:
        a, b = _sets(spark, d)
        return {"UNION": a.union(b).distinct(), "INTERSECT": a.intersect(b), "EXCEPT": a.subtract(b)}[op]

    query(sql(f"SELECT cell FROM assigned WHERE region IN (0, 1, 2) {_op} SELECT cell FROM other WHERE region IN (0, 2, 4)"), name=_name)(_set)


@query(sql("SELECT region, '## Region ' || region || chr(10) || '- cells: ' || n_cells || chr(10) || '- people: ' || people AS markdown FROM sums", _SUMS))
def sink_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _sums(spark, d).select("region", F.format_string("## Region %d\n- cells: %d\n- people: %d", "region", "n_cells", "people").alias("markdown"))


@query(sql("SELECT region, CASE WHEN people = 0 THEN 'Region ' || region || ' is empty.' WHEN 2 * s_AF > cents THEN 'Region ' || region || ' lives by AF.' ELSE 'Region ' || region || ' lives by many trades.' END AS line FROM sums", _SUMS))
def character_line(spark: SparkSession, d: str) -> DataFrame:
    r = F.concat(F.lit("Region "), F.col("region").cast("string"))
    return _sums(spark, d).select("region", F.when(F.col("people") == 0, F.concat(r, F.lit(" is empty."))).when(2 * F.col("s_AF") > F.col("cents"), F.concat(r, F.lit(" lives by AF."))).otherwise(F.concat(r, F.lit(" lives by many trades."))).alias("line"))


QUERIES, SQL = query.queries, query.sql
