"""Points near other points, and the region that holds a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.operators.skew import hot_groups, replicate, salt

EARTH_KM = 6371.0088


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance on a sphere of radius 6371.0088 km; coordinates in degrees."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _grid(radius_km: float):
    """Bands of latitude as high as the radius; in each, buckets of longitude at least as wide as the radius is there
    and in the next bands. Functions of the band: buckets, width, and the longitude difference a pair can have."""
    step = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9)
    ratio = math.sin(radius_km / (2 * EARTH_KM)) * (1 + 1e-9)
    top = int(180 / step)

    def reach(b: Column) -> Column:
        edge = F.least(F.lit(90.0), F.greatest(F.abs((b - 1) * step - 90), F.abs((b + 2) * step - 90)))
        return F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12)))))

    def buckets(b: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / reach(b))).cast("bigint")

    return step, top, reach, buckets


def pairs_within(points: DataFrame, *, key: str, lat: str, lng: str, radius_km: float, max_cell_rows: int = 2_000) -> DataFrame:
    """All pairs ``a`` < ``b`` of different keys at most ``radius_km`` apart.

    Method: points are hashed to grid cells sized by the radius. Each point joins its own cell, the next one to the
    east and those of the band to the north that the radius can reach (half of the neighbourhood, so a pair is met
    once), then the exact great-circle distance decides. Longitude wraps round; near the poles a band has few, wide
    buckets. A cell with over ``max_cell_rows`` points is salted on one side and replicated on the other.

    Defined results: no position, hence no pair, for a null or NaN coordinate, |lat| > 90, |lng| > 180 or exactly
    (0, 0); null keys are left out; repeated rows count once; a key at several positions pairs by any of them; several
    keys on one position pair with each other; an empty table gives none; other columns are not read.
    """
    step, top, reach, buckets = _grid(radius_km)
    p = (
        points.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("y"), F.col(lng).cast("double").alias("x"))
        .where("k IS NOT NULL AND NOT isnan(y) AND NOT isnan(x) AND abs(y) <= 90 AND abs(x) <= 180 AND NOT (y = 0 AND x = 0)")
        .distinct()
        .withColumn("band", F.floor((F.col("y") + 90) / step).cast("bigint"))
        .withColumn("nb", buckets(F.col("band")))
        .withColumn("cell", F.least(F.floor((F.col("x") + 180) / (F.lit(360.0) / F.col("nb"))), F.col("nb")) % F.col("nb"))
    )
    home = p.select("band", "cell", "k", "y", "x")
    up = F.col("band") + 1
    nu = buckets(up)
    first = F.floor((F.col("x") + 180 - reach(F.col("band"))) / (360.0 / nu))
    last = F.floor((F.col("x") + 180 + reach(F.col("band"))) / (360.0 / nu))
    east = F.array(F.struct(F.col("band"), F.col("cell"), F.lit(True).alias("own")), F.struct(F.col("band"), ((F.col("cell") + 1) % F.col("nb")).alias("cell"), F.lit(False).alias("own")))
    north = F.transform(F.sequence(first, F.least(last, first + nu - 1)), lambda c: F.struct(up.alias("band"), F.pmod(c, nu).alias("cell"), F.lit(False).alias("own")))
    probe = p.select("k", "y", "x", F.explode(F.when(F.col("band") < top, F.concat(east, north)).otherwise(east)).alias("c")).select(
        "c.band", "c.cell", "c.own", F.col("k").alias("k2"), F.col("y").alias("y2"), F.col("x").alias("x2")
    )
    hot = hot_groups(home, ["band", "cell"], max_cell_rows)
    met = salt(probe, hot, ["band", "cell"], F.col("k2")).join(replicate(home, hot, ["band", "cell"]), ["band", "cell", "_salt"])
    near = met.where((F.when(F.col("own"), F.col("k") < F.col("k2")).otherwise(F.col("k") != F.col("k2"))) & (great_circle_km(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")) <= radius_km))
    return near.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()
