"""Spatial joins by bucket: points in boxes and polygons, nearest neighbours, overlaps."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from stratamesh.operators.proximity import great_circle_km
from stratamesh.operators.skew import hot_groups, replicate, salt, small
from stratamesh.session import cut, drop, gather


def _bucket(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _span(a: Column, b: Column, size: float) -> Column:
    return F.explode(F.sequence(_bucket(a, size), _bucket(b, size)))


def in_boxes(points: DataFrame, boxes: DataFrame, *, lon: str = "lon", lat: str = "lat", size: float = 4.0) -> DataFrame:
    """Points with every box (x0, x1, y0, y1) that holds them (lower edges in, upper out). Boxes are given to the
    buckets they touch, points to the one they are in, so the range condition has an equi-key."""
    b = boxes.where("x0 < x1 AND y0 < y1").withColumn("_i", _span(F.col("x0"), F.col("x1"), size)).withColumn("_j", _span(F.col("y0"), F.col("y1"), size))
    p = points.withColumn("_i", _bucket(F.col(lon), size)).withColumn("_j", _bucket(F.col(lat), size))
    return p.join(b, ["_i", "_j"]).where((F.col("x0") <= F.col(lon)) & (F.col(lon) < F.col("x1")) & (F.col("y0") <= F.col(lat)) & (F.col(lat) < F.col("y1"))).drop("_i", "_j")


def box_overlaps(a: DataFrame, b: DataFrame, *, size: float = 4.0) -> DataFrame:
    """Pairs of boxes (a0, a1, c0, c1 and x0, x1, y0, y1) that overlap, with the common ``area``. A pair is met in each
    bucket both touch and kept in the one that holds its lower left corner."""
    l = a.withColumn("_i", _span(F.col("a0"), F.col("a1"), size)).withColumn("_j", _span(F.col("c0"), F.col("c1"), size))
    r = b.withColumn("_i", _span(F.col("x0"), F.col("x1"), size)).withColumn("_j", _span(F.col("y0"), F.col("y1"), size))
    w = F.least("a1", "x1") - F.greatest("a0", "x0")
    h = F.least("c1", "y1") - F.greatest("c0", "y0")
    j = l.join(r, ["_i", "_j"]).where((w > 0) & (h > 0) & (F.col("_i") == _bucket(F.greatest("a0", "x0"), size)) & (F.col("_j") == _bucket(F.greatest("c0", "y0"), size)))
    return j.withColumn("area", w * h).drop("_i", "_j")


def _fitting(points: DataFrame, targets: DataFrame, size: float, on: list[str], a: tuple[str, str], b: tuple[str, str], most: int = 4) -> float:
    """``size`` halved until a point's bucket holds ``most`` targets on average (over the points whose bucket has any)."""
    count = lambda df, x, y, n: df.groupBy(_bucket(F.col(x), size).alias("_i"), _bucket(F.col(y), size).alias("_j"), *on).agg(F.count(F.lit(1)).alias(n))
    while size > 1e-6:
        met = count(points, *a, "_p").join(count(targets, *b, "_t"), ["_i", "_j", *on])
        mean = met.agg(F.sum(F.col("_p").cast("double") * F.col("_t")) / F.sum("_p")).first()[0] or 0
        if mean <= most:
            break
        size /= 2 ** math.ceil(math.log2(mean / most) / 2)
    return size


def _nearest_of(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, reach: float, limit: float, pairs: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For each point the first of the targets nearest to it and their squared distance, if that is at most ``limit``, else
    -1: buckets fitted to the targets, 3 x 3 of them around a point, their side doubled up to ``reach`` for points that
    find nothing within a side. About ``pairs`` distances are held at a time."""
    at, best = np.full(len(x), -1), np.full(len(x), np.inf)
    left = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
    if not len(left) or not len(tx):
        return at, best
    x0, y0 = tx.min(), ty.min()
    slack = 8 * np.spacing(max(np.abs(c).max() for c in (x[left], y[left], tx, ty)))

    def met(side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # a side a little over the distance, as differences and quotients are rounded
        side = side * (1 + 1e-9) + slack
        i, j = np.floor((tx - x0) / side).astype(np.int64), np.floor((ty - y0) / side).astype(np.int64)
        wide = j.max() + 1
        order = np.argsort(i * wide + j, kind="stable")
        code = (i * wide + j)[order]
        i, j = np.floor((x[left] - x0) / side).astype(np.int64), np.floor((y[left] - y0) / side).astype(np.int64)
        row = (i[:, None] + np.array([-1, 0, 1])) * wide
        begin = np.searchsorted(code, row + np.maximum(j - 1, 0)[:, None])
        end = np.searchsorted(code, row + np.minimum(j + 1, wide - 1)[:, None], "right")
        return order, begin, np.maximum(end - begin, 0)

    side = reach
    found = met(side)
    while (mean := found[2].sum() / len(left)) > 40 and side > reach * 1e-7:
        side /= 2 ** max(1, int(math.log2(mean / 40) / 2))
        found = met(side)
    while True:
        order, begin, n = found
        ends = np.cumsum(n.sum(1))
        k = 0
        while k < len(left):
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + pairs, "right")))
            m, b = n[k:to].ravel(), begin[k:to].ravel()
            each = n[k:to].sum(1)
            some = np.flatnonzero(each)
            if len(some):
                first = np.cumsum(m) - m
                t = order[np.arange(m.sum()) + np.repeat(b - first, m)]
                p = np.repeat(left[k:to], each)
                dx, dy = x[p] - tx[t], y[p] - ty[t]
                d = dx * dx + dy * dy
                starts = (np.cumsum(each) - each)[some]
                least = np.minimum.reduceat(d, starts)
                best[left[k:to][some]] = least
                at[left[k:to][some]] = np.minimum.reduceat(np.where(d == np.repeat(least, each[some]), t, len(tx)), starts)
            k = to
        left = left[best[left] > side * side]
        if side >= reach or not len(left):
            at[best > limit] = -1
            return at, best
        at[left], best[left] = -1, np.inf
        side = min(2 * side, reach)
        found = met(side)


def nearest(points: DataFrame, targets: DataFrame, *, point: str, target: str, lon: str = "lon", lat: str = "lat", tlon: str = "tlon", tlat: str = "tlat", start: float | None = None, within: float | None = None, parts: list[str] | None = None, carry: tuple[str, ...] = (), once: bool = False, outer: bool = False, a_tile: int = 16_384, sides: int = 4, max_rows: int = 20_000, max_targets: int = 500_000) -> DataFrame:
    """point, target, deg2 and the target's columns ``carry``: the target nearest in degrees, ties to the smaller key.
    ``within`` leaves out points without a target at most so many degrees away; with ``outer`` they stay, as do points
    without coordinates, and have nulls. A point at several positions counts at the one nearest to a target;
    ``once`` says that each has one row.

    Method: points and targets meet in tiles that hold about ``a_tile`` targets, a target also in the tiles at most a
    part of a side away, one of ``sides`` (with 4 a target is in 2.25 tiles on average, with 16 in 1.27). What a point
    finds within that distance is nearest of all; other points go on with tiles of twice the side (``start`` sets the
    first distance). No pair is shuffled. Tiles with over ``max_rows`` points or ``max_targets`` targets are salted.
    """
    on = parts or []
    keys, most = [point, *on], within or 720.0
    p = points.select(*keys, lon, lat)
    p = cut(p if outer else p.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()))
    t = cut(targets.where(F.col(tlon).isNotNull() & F.col(tlat).isNotNull() & ~F.isnan(tlon) & ~F.isnan(tlat)).groupBy(*on, tlon, tlat, *carry).agg(F.min(target).alias(target)))
    tile = _fitting(p, t, sides * min(most, start or most), on, (lon, lat), (tlon, tlat), a_tile)
    own_columns, gained = p.columns, [target, *carry]
    schema = StructType([*p.schema, *(StructField(c, t.schema[c].dataType) for c in gained), StructField("deg2", DoubleType())])
    names = schema.names

    def meet(p: DataFrame, reach: float, tile: float) -> DataFrame:
        """The rows of ``p`` with the nearest target within ``reach``, or nulls."""
        limit = reach * reach if within or reach < most else math.inf
        span = lambda c: F.explode(F.sequence(_bucket(F.col(c) - (reach * (1 + 1e-9) + 1e-9), tile), _bucket(F.col(c) + (reach * (1 + 1e-9) + 1e-9), tile)))
        own = p.withColumn("_i", _bucket(F.col(lon), tile)).withColumn("_j", _bucket(F.col(lat), tile))
        at = t.withColumn("_i", span(tlon)).withColumn("_j", span(tlat))
        group = [*on, "_i", "_j"]
        crowd, hot = hot_groups(at, group, max_targets), hot_groups(own, group, max_rows)
        own, at = (df.withColumnRenamed("_salt", "_part") for df in (replicate(own, crowd, group), salt(at, crowd, group, F.struct(tlon, tlat))))
        own, at = salt(own, hot, group, F.struct(point, lon, lat)), replicate(at, hot, group)

        def scan(rows: pa.Table, near: pa.Table) -> pa.Table:
            near = near.take(pc.sort_indices(near[target]))
            x, y, tx, ty = (np.asarray(df[c].to_numpy(), np.float64) for df, c in ((rows, lon), (rows, lat), (near, tlon), (near, tlat)))
            k, d = _nearest_of(x, y, tx, ty, reach, limit)
            k = pa.array(k, mask=k < 0)
            out = [rows[c] for c in own_columns] + [near[c].take(k) for c in gained] + [pa.array(d, mask=k.is_null().to_numpy(False))]
            return pa.table(out, names=names)

        group += ["_part", "_salt"]
        out = own.groupBy(*group).cogroup(at.groupBy(*group)).applyInArrow(scan, schema)
        return out if crowd is None else least(out, own_columns)

    def least(df: DataFrame, by: list[str]) -> DataFrame:
        """For each value of ``by`` the nearest row, with nulls where there is none."""
        best = F.min(F.when(F.col(target).isNotNull(), F.struct("deg2", *gained))).alias("_best")
        return df.groupBy(*by).agg(best).select(*by, *[f"_best.{c}" for c in (*gained, "deg2")])

    done: list[DataFrame] = []
    while True:
        reach = min(most, tile / sides)
        met = meet(p, reach, tile)
        if reach >= most and not done:
            break
        done.append(cut(met))
        drop(p)
        rest = done[-1].where(F.col(target).isNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull())
        if reach >= most or rest.isEmpty():
            drop(t)
            met = gather(done)
            break
        p, tile = cut(rest.select(own_columns)), 2 * tile
    met = met.select(*keys, *gained, "deg2")
    met = met if once and not done else least(met, keys)
    return met if outer else met.where(F.col(target).isNotNull())


def near_pairs(points: DataFrame, *, key: str, lon: str, lat: str, degrees: float) -> DataFrame:
    """u < v and km of points less than a bucket (``degrees``) apart in both axes."""
    a = points.select(F.col(key).alias("u"), F.col(lon).alias("x"), F.col(lat).alias("y"), _bucket(F.col(lon), degrees).alias("_i"), _bucket(F.col(lat), degrees).alias("_j"))
    step = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    b = points.select(F.col(key).alias("v"), F.col(lon).alias("x2"), F.col(lat).alias("y2"), _bucket(F.col(lon), degrees).alias("_i"), _bucket(F.col(lat), degrees).alias("_j")).withColumn("_di", step).withColumn("_dj", step)
    b = b.withColumn("_i", F.col("_i") + F.col("_di")).withColumn("_j", F.col("_j") + F.col("_dj"))
    j = a.join(b, ["_i", "_j"]).where((F.col("u") < F.col("v")) & (F.abs(F.col("x") - F.col("x2")) < degrees) & (F.abs(F.col("y") - F.col("y2")) < degrees))
    return j.select("u", "v", great_circle_km(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")).alias("km"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, key: str = "key", lon: str = "lon", lat: str = "lat", edges_a_band: int = 32, max_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``points`` with the ``key`` of every polygon that holds them. ``polygons`` has unique keys and ``rings``,
    array<array<struct<x,y>>>, closed or not; holes are rings like others.

    Method: a polygon's box goes to the grid cells it touches, of the least power of two over its sides (four at most),
    a point to its cell of every size in use; cells with over ``max_rows`` points are salted. A point then meets only
    the edges of its band of latitude, into which a polygon of many edges is cut, and an exact even-odd test on them
    decides: an edge counts where exactly one of its ends lies above the point and the point is left of it.

    Defined results: null coordinates, null or empty rings and null keys hold nothing; points on an edge follow the
    half-open rule above; repeated points stay; an empty side gives no row; other columns of ``points`` pass through.
    """
    e = polygons.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.explode("rings").alias("r"))
    e = e.select("_key", "r", F.posexplode("r").alias("i", "a")).select("_key", "a", F.coalesce(F.get("r", F.col("i") + 1), F.get("r", F.lit(0))).alias("b"))
    e = e.select("_key", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")).where("ay <> by")
    box = cut(e.groupBy("_key").agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"), F.count(F.lit(1)).alias("m")))
    box = box.withColumn("h", (F.col("y1") - F.col("y0")) / F.greatest(F.lit(1), F.ceil(F.col("m") / edges_a_band)))
    band = lambda y: F.floor((y - F.col("y0")) / F.col("h")).cast("int")
    bands = e.join(box.select("_key", "y0", "h"), "_key").withColumn("_band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by"))))).groupBy("_key", "_band").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_edges"))
    level = F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)))).cast("int")
    size = F.pow(F.lit(2.0), F.col("_k"))
    cells = box.withColumn("_k", level).withColumn("_i", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("_j", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    # the levels are powers of two of degrees: a few dozen at most
    levels = sorted(r[0] for r in box.select(level.alias("k")).distinct().collect())
    p = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_k", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_i", F.floor(F.col(lon) / size)).withColumn("_j", F.floor(F.col(lat) / size))
    on = ["_k", "_i", "_j"]
    hot = hot_groups(p, on, max_rows)
    met = salt(p, hot, on, F.struct(lon, lat)).join(replicate(cells.select("_key", "x0", "x1", "y0", "y1", "h", *on), hot, on), [*on, "_salt"])
    met = met.where((F.col("x0") <= F.col(lon)) & (F.col(lon) <= F.col("x1")) & (F.col("y0") <= F.col(lat)) & (F.col(lat) <= F.col("y1"))).withColumn("_band", band(F.col(lat)))

    def cross(n: Column, x: Column) -> Column:
        y = F.col(lat)
        above = (x["ay"] > y) != (x["by"] > y)
        return n + F.when(above & (F.col(lon) < (x["bx"] - x["ax"]) * (y - x["ay"]) / (x["by"] - x["ay"]) + x["ax"]), 1).otherwise(0)

    inside = met.join(bands, ["_key", "_band"]).where(F.aggregate("_edges", F.lit(0), cross) % 2 == 1)
    return inside.select(*points.columns, F.col("_key").alias(key))


def _edges(g: DataFrame) -> DataFrame:
    """``rings`` as arrays ax, ay, bx, by of the edges that are not level, and their box x0, x1, y0, y1; polygons without
    such an edge hold nothing and are left out."""
    e = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda a, i: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0))).alias("b")))))
    e = F.filter(e, lambda x: x["ay"] != x["b"]["y"])
    others = [c for c in g.columns if c != "rings"]
    # written once, as each of the columns below would build the edges again
    g = cut(g.select(*others, e.alias("e"))).where(F.size("e") > 0)
    g = g.select(*others, F.col("e.ax").alias("ax"), F.col("e.ay").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    ends = {"x0": F.least(F.array_min("ax"), F.array_min("bx")), "x1": F.greatest(F.array_max("ax"), F.array_max("bx")), "y0": F.least(F.array_min("ay"), F.array_min("by")), "y1": F.greatest(F.array_max("ay"), F.array_max("by"))}
    return g.withColumns(ends)


def first_polygons(points: DataFrame, polygons: DataFrame, *, point: str, key: str = "key", lon: str = "lon", lat: str = "lat", samples: tuple[tuple[float, float], ...] = ((0.0, 0.0),), tile: float = 1.0, max_rows: int = 20_000) -> DataFrame:
    """point, key, n of every row of ``points``: the polygon that holds most of its ``samples`` (offsets in degrees), with
    ties to the smallest ``key``, and how many it holds; rows that no polygon meets are left out. With one sample this
    is the smallest key over a point. The test and its defined results are those of ``points_in_polygons``; keys need
    not be unique.

    Method: equal polygons hold the same points, so only the smallest key of each outline is kept. Points and polygons meet in tiles,
    where polygons are taken by key and a point leaves as soon as all its samples are held, as no later polygon can do
    better. No pair of point and polygon is shuffled. Tiles with over ``max_rows`` points are salted.
    """
    g = polygons.where(F.col(key).isNotNull()).groupBy("rings").agg(F.min(key).alias("_key"))
    g = _edges(g)
    dx, dy = zip(*samples)
    reach = lambda a, b, d: F.explode(F.sequence(F.floor((F.col(a) - max(d) - 1e-9) / tile), F.floor((F.col(b) - min(d) + 1e-9) / tile)))
    g = g.withColumn("_i", reach("x0", "x1", dx)).withColumn("_j", reach("y0", "y1", dy))
    p = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(point).alias("_point"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    p = p.withColumn("_i", _bucket(F.col("x"), tile)).withColumn("_j", _bucket(F.col("y"), tile))
    on = ["_i", "_j"]
    hot = hot_groups(p, on, max_rows)
    p, g = salt(p, hot, on, F.struct("_point", "x", "y")), replicate(g, hot, on)
    schema = StructType([StructField(point, points.schema[point].dataType), StructField(key, polygons.schema[key].dataType), StructField("n", LongType())])

    def scan(rows: pa.Table, shapes: pa.Table) -> pa.Table:
        x, y = (rows[c].to_numpy()[:, None] + np.array(d) for c, d in (("x", dx), ("y", dy)))
        best, at = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        left = np.arange(len(x))
        shapes = shapes.combine_chunks()
        lists = [shapes[c].combine_chunks() for c in ("ax", "ay", "bx", "by")] if len(shapes) and len(x) else []
        lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
        flat = [np.asarray(c.values) for c in lists]
        begin = np.asarray(lists[0].offsets) if lists else []
        x0, x1, y0, y1 = (shapes[c].to_numpy() for c in ("x0", "x1", "y0", "y1"))
        for k in pc.sort_indices(shapes["_key"]).to_numpy() if lists else []:
            u, v = x[left], y[left]
            held = (x0[k] <= u) & (u <= x1[k]) & (y0[k] <= v) & (v <= y1[k])
            if held.any():
                a, b = u[held], v[held]
                odd = np.zeros(len(a), bool)
                for ax, ay, bx, by in zip(*(f[begin[k] : begin[k + 1]] for f in flat)):
                    odd ^= ((ay > b) != (by > b)) & (a < (bx - ax) * (b - ay) / (by - ay) + ax)
                held[held] = odd
                n = held.sum(1)
                more = n > best[left]
                if more.any():
                    best[left[more]], at[left[more]] = n[more], k
                    left = left[best[left] < len(dx)]
                    if not len(left):
                        break
        there = np.flatnonzero(best)
        out = [rows["_point"].take(there), shapes["_key"].take(at[there]), pa.array(best[there], pa.int64())]
        return pa.table(out, names=[point, key, "n"])

    return p.groupBy(*on, "_salt").cogroup(g.groupBy(*on, "_salt")).applyInArrow(scan, schema)


def polygon_pairs(points: DataFrame, polygons: DataFrame, *, point: str, key: str = "key", lon: str = "lon", lat: str = "lat", tile: float = 4.0, max_rows: int = 8_192, max_polygons: int = 2_048, max_keys: int = 64, a_row: int = 8_192) -> DataFrame:
    """Distinct point, key of every polygon that holds a position of the point. The test and its defined results are those
    of ``points_in_polygons``; a point may have several positions, and keys need not be unique.

    Method: polygons of equal rings hold the same points, so they are one outline with a list of keys (of ``max_keys`` at
    most, else it is cut). Points and outlines meet in tiles; of each outline come the points in it and its keys as two
    lists, of about ``a_row`` pairs at most, whose product is the result. No pair is shuffled, but for points of several
    positions and repeated keys, which alone can give a pair twice. Tiles with over ``max_rows`` points or
    ``max_polygons`` outlines are salted.
    """
    p = cut(points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(point).alias("_point"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).distinct())
    g = polygons.where(F.col(key).isNotNull() & F.col("rings").isNotNull()).select(F.col(key).alias("_key"), F.filter("rings", lambda r: r.isNotNull()).alias("rings"))
    schema = StructType([StructField("_points", ArrayType(p.schema["_point"].dataType)), StructField("_keys", ArrayType(g.schema["_key"].dataType))])

    def outlines(g: DataFrame) -> DataFrame:
        g = g.withColumn("_hash", F.xxhash64("rings"))
        g = salt(g, hot_groups(g, ["_hash"], 64 * max_keys), ["_hash"], F.col("_key"))
        g = g.groupBy("_hash", "_salt", "rings").agg(F.collect_list("_key").alias("_keys"))
        pieces = F.transform(F.sequence(F.lit(1), F.size("_keys"), F.lit(max_keys)), lambda i: F.slice("_keys", i, max_keys))
        return _edges(g.select("rings", F.explode(pieces).alias("_keys")))

    def scan(rows: pa.Table, shapes: pa.Table) -> pa.Table:
        rows, shapes = rows.take(pc.sort_indices(rows["y"])), shapes.combine_chunks()
        own, keys = rows["_point"].combine_chunks(), shapes["_keys"]
        x, y, x0, x1, y0, y1 = (df[c].to_numpy() for df, c in ((rows, "x"), (rows, "y"), *((shapes, c) for c in ("x0", "x1", "y0", "y1"))))
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(shapes["ax"]).to_numpy())]) if len(shapes) else []
        ax, ay, bx, by = (pc.list_flatten(shapes[c]).to_numpy() for c in ("ax", "ay", "bx", "by"))
        low, high = np.minimum(ay, by), np.maximum(ay, by)
        edges = list(zip(ax.tolist(), ay.tolist(), (bx - ax).tolist(), (by - ay).tolist()))
        many = pc.list_value_length(keys).to_numpy()
        first, last = np.searchsorted(y, y0), np.searchsorted(y, y1, "right")
        out: list[pa.Table] = []
        held: list[np.ndarray] = []
        of: list[int] = []
        starts: list[int] = []
        n = 0

        def flush() -> None:
            values = own.take(pa.array(np.concatenate([np.zeros(0, np.int64), *held])))
            lists = pa.ListArray.from_arrays(pa.array([*starts, n], pa.int32()), values)
            out.append(pa.table([lists, keys.take(pa.array(of, pa.int64()))], names=schema.names))

        for k in np.flatnonzero(first < last).tolist() if len(x) else []:
            c = x[first[k] : last[k]]
            c = first[k] + np.flatnonzero((x0[k] <= c) & (c <= x1[k]))
            if not len(c):
                continue
            # an edge counts for points from its lower end to below its upper one: a run, as points are sorted
            u, v, odd = x[c], y[c], np.zeros(len(c), bool)
            s = slice(begin[k], begin[k + 1])
            for i, j, (ex, ey, dx, dy) in zip(v.searchsorted(low[s]).tolist(), v.searchsorted(high[s]).tolist(), edges[s]):
                if i < j:
                    odd[i:j] ^= u[i:j] < dx * (v[i:j] - ey) / dy + ex
            c = c[odd]
            if len(c):
                runs = range(n, n + len(c), max(1, a_row // int(many[k])))
                held.append(c)
                starts.extend(runs)
                of.extend([k] * len(runs))
                n += len(c)
                if n > 1_000_000:
                    flush()
                    held, of, starts, n = [], [], [], 0
        flush()
        return pa.concat_tables(out)

    def pairs(p: DataFrame, g: DataFrame) -> DataFrame:
        on = ["_i", "_j"]
        p = p.withColumn("_i", _bucket(F.col("x"), tile)).withColumn("_j", _bucket(F.col("y"), tile))
        reach = lambda a, b: F.explode(F.sequence(_bucket(F.col(a) - 1e-9, tile), _bucket(F.col(b) + 1e-9, tile)))
        g = g.withColumn("_i", reach("x0", "x1")).withColumn("_j", reach("y0", "y1"))
        crowd, hot = hot_groups(g, on, max_polygons), hot_groups(p, on, max_rows)
        p, g = (df.withColumnRenamed("_salt", "_part") for df in (replicate(p, crowd, on), salt(g, crowd, on, F.struct("ax", "ay", "_keys"))))
        p, g = salt(p, hot, on, F.struct("_point", "x", "y")), replicate(g, hot, on)
        # a salt of one value is left out, else groups are shuffled again after the repartition
        on += ["_part"] * (crowd is not None) + ["_salt"] * (hot is not None)
        # more tasks than the size of the two sides asks for, as a task's work is the pairs that come out
        tasks = 4 * int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = p.repartition(tasks, *on).groupBy(*on).cogroup(g.repartition(tasks, *on).groupBy(*on)).applyInArrow(scan, schema)
        return met.select("_points", F.explode("_keys").alias(key)).select(F.explode("_points").alias(point), key)

    def repeated(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame | None]:
        """The rows whose ``c`` is there once, and the others or None."""
        again, n = small(df.groupBy(F.col(c).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again"))
        if not n:
            return df, None
        same = F.col(c).eqNullSafe(F.col("_again"))
        return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")

    p, moved = repeated(p, "_point")
    g, twice = repeated(g, "_key")
    g, twice = outlines(g), twice if twice is None else outlines(twice)
    met = pairs(p, g)
    twofold = [pairs(*x) for x in ((p, twice), (moved, g), (moved, twice)) if x[0] is not None and x[1] is not None]
    return met.unionByName(reduce(DataFrame.unionByName, twofold).distinct()) if twofold else met
