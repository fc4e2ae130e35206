"""The first or most frequent polygon over points, against all pairs."""

import random
from collections import Counter

from stratamesh.operators import spatial as P


def case(spark, seed=4):
    rng = random.Random(seed)
    rings = [[[(x, y), (x + w, y + 0.3), (x + w / 2, y + 0.4), (x + 0.2, y + w)]] for x, y, w in ((rng.uniform(-3, 3), rng.uniform(-2, 2), rng.choice((0.5, 1.5, 4.0))) for _ in range(40))]
    polygons = spark.createDataFrame([(100 - k, rings[k % 40]) for k in range(80)] + [(0, None), (None, rings[0])], "key bigint, rings array<array<struct<x:double,y:double>>>")
    points = [(i, rng.uniform(-4, 4), rng.uniform(-3, 3)) for i in range(200)] + [(200, None, 1.0)]
    return spark.createDataFrame(points, "cell bigint, lon double, lat double"), polygons


def test_smallest_key_without_pairs(spark):
    points, polygons = case(spark)
    want = {}
    for r in P.points_in_polygons(points, polygons).collect():
        want[r.cell] = min(r.key, want.get(r.cell, r.key))
    for rows in (20_000, 3):
        got = P.first_polygons(points, polygons, point="cell", max_rows=rows).collect()
        assert {r.cell: r.key for r in got} == want and len(got) == len(want) and {r.n for r in got} == {1}


def test_every_row_of_a_point_has_its_answer(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 5.5, 0.5), (1, 9.0, 9.0)], "place_key bigint, lng double, lat double")
    square = lambda x: [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]]
    polygons = spark.createDataFrame([(3, square(0.0)), (2, square(5.0))], "key bigint, rings array<array<struct<x:double,y:double>>>")
    assert sorted(r.key for r in P.first_polygons(points, polygons, point="place_key", lon="lng").collect()) == [2, 3]


def test_keys_need_not_be_unique(spark):
    points, polygons = case(spark, 6)
    want = {}
    for r in P.points_in_polygons(points, polygons).collect():
        want[r.cell] = min(1600 + r.key % 7, want.get(r.cell, 9999))
    years = polygons.selectExpr("1600 + key % 7 AS year", "rings")
    assert {r.cell: r.year for r in P.first_polygons(points, years, point="cell", key="year").collect()} == want


def test_bands_shuffle_no_pairs(spark, sf):
    from stratamesh.plans import space

    assert "CoGroupsInArrow" in space.QUERIES["bands"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_most_samples_then_the_smallest_key(spark):
    points, polygons = case(spark, 5)
    samples = ((0.0, 0.0), (0.3, 0.0), (-0.3, 0.1), (0.0, -0.2))
    rows = [(r.cell, r.lon + a, r.lat + b) for r in points.where("lon IS NOT NULL").collect() for a, b in samples]
    n = Counter((r.cell, r.key) for r in P.points_in_polygons(spark.createDataFrame(rows, "cell bigint, lon double, lat double"), polygons).collect())
    want = {}
    for (cell, key), k in n.items():
        want[cell] = max(want.get(cell, (0, 0)), (k, -key))
    assert {r.cell: (r.n, -r.key) for r in P.first_polygons(points, polygons, point="cell", samples=samples).collect()} == want
