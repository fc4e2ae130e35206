"""Pairs of points and the polygons that hold them, against all pairs."""

import random

import pytest

from stratamesh.operators import spatial as P

POLYGONS = "key bigint, rings array<array<struct<x:double,y:double>>>"
POINTS = "point_key bigint, lng double, lat double"


def holds(rings, x, y):
    edges = [(a, b) for r in rings or [] for a, b in zip(r or [], (r or [])[1:] + (r or [])[:1]) if a[1] != b[1]]
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges) % 2 == 1


@pytest.mark.parametrize("sizes", [{}, {"tile": 0.7, "max_rows": 5, "max_polygons": 3, "max_keys": 2, "a_row": 4}])
def test_pairs_of_odd_inputs(spark, sizes):
    rng = random.Random(7)
    spots = [(rng.uniform(-3, 3), rng.uniform(-2, 2), rng.choice((0.5, 1.5, 5.0))) for _ in range(25)]
    rings = [[[(x, y), (x + w, y + 0.5), (x + w / 2, y + 0.6), (x + w, y + 2), (x, y + 2)], [(x + 0.1, y + 0.7), (x + 0.3, y + 0.7), (x + 0.2, y + 1)]] for x, y, w in spots]
    # outlines of several keys, keys of several outlines, equal rows, a null ring among others, no ring, no key
    polygons = [(k, rings[k % 25]) for k in range(60)] + [(k, rings[k + 9]) for k in range(6)] + [(3, rings[3])] * 2 + [(70, [None, rings[0][0]]), (71, None), (72, []), (None, rings[0]), (73, [[(0.0, 1.0), (1.0, 1.0)]])]
    # points of several positions, equal rows, positions on corners, no key, no position
    points = [(i % 150, rng.uniform(-4, 6), rng.uniform(-3, 4)) for i in range(220)] + [(200 + i, x, y) for i, (x, y, _) in enumerate(spots)]
    points += points[:9] + [(None, *p[1:]) for p in points[:20]] + [(300, None, 1.0), (301, 1.0, None), (302, float("nan"), 1.0), (303, 1.0, float("nan"))]
    want = {(i, k) for i, x, y in points if x is not None and y is not None for k, r in polygons if k is not None and holds(r, x, y)}
    got = P.polygon_pairs(spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS), point="point_key", lon="lng", **sizes).collect()
    assert {(r.point_key, r.key) for r in got} == want and len(got) == len(want) > 500


def test_an_empty_side_gives_no_pair(spark):
    points, polygons = spark.createDataFrame([(1, 0.5, 0.5)], POINTS), spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])], POLYGONS)
    n = lambda p, g: P.polygon_pairs(p, g, point="point_key", lon="lng").count()
    assert n(points, polygons) == 1 and n(points.limit(0), polygons) == n(points, polygons.limit(0)) == 0


def test_point_regions_shuffles_no_pairs(spark, sf):
    from stratamesh.plans import space

    plan = space.QUERIES["point_regions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("CoGroupsInArrow")
    assert len(above) == 2 and "Join" not in above[0] and "Aggregate" not in above[0]
