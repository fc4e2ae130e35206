"""Nearest targets where points and targets crowd."""

import random

from stratamesh.operators import spatial as P

POINTS, TARGETS = "p int, lon double, lat double", "t int, tlon double, tlat double"


def crowd(spark, n, seed):
    rng = random.Random(seed)
    pts = [(i, rng.random(), rng.random()) for i in range(n)]
    tgt = [(i, rng.random(), rng.random()) for i in range(n)]
    brute = {i: min(((x - a) * (x - a) + (y - b) * (y - b), t) for t, a, b in tgt) for i, x, y in pts}
    return spark.createDataFrame(pts, POINTS), spark.createDataFrame(tgt, TARGETS), brute


def test_no_step_sorts_the_pairs(spark, monkeypatch):
    plans, write = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    p, t, brute = crowd(spark, 400, 1)
    got = P.nearest(p, t, point="p", target="t").collect()
    assert {r.p: r.t for r in got} == {i: v[1] for i, v in brute.items()}
    assert plans and not any("SortAggregate" in x for x in plans)


def test_buckets_shrink_to_what_they_hold(spark):
    p, t, brute = crowd(spark, 2000, 2)
    assert P._fitting(p, t, 2.0, [], ("lon", "lat"), ("tlon", "tlat")) < 0.1
    got = P.nearest(p, t, point="p", target="t", within=2.0).collect()
    assert {r.p: (r.deg2, r.t) for r in got} == brute


def test_a_distance_of_just_within_counts(spark):
    p = spark.createDataFrame([(1, -1e-17, 0.0), (2, -0.3, 0.0)], POINTS)
    t = spark.createDataFrame([(7, 0.3, 0.0)], TARGETS)
    assert [(r.p, r.t) for r in P.nearest(p, t, point="p", target="t", within=0.3).collect()] == [(1, 7)]


def test_targets_of_one_position_count_once(spark, monkeypatch):
    p = spark.createDataFrame([(1, 0.1, 0.1), (2, 3.0, 3.0)], POINTS)
    t = spark.createDataFrame([(i, 0.2, 0.2) for i in range(900, 0, -1)], TARGETS)
    seen = []
    fit = P._fitting
    monkeypatch.setattr(P, "_fitting", lambda a, b, *rest: (seen.append(b.count()), fit(a, b, *rest))[1])
    assert [(r.p, r.t) for r in P.nearest(p, t, point="p", target="t", within=0.5).collect()] == [(1, 1)]
    assert seen == [1]


def test_carried_columns_and_salted_tiles(spark):
    p, t, brute = crowd(spark, 600, 3)
    named = t.selectExpr("*", "concat('n', t) AS name")
    for more in ({}, {"once": True}, {"max_rows": 50}, {"max_targets": 60}, {"start": 0.01, "a_tile": 8, "max_rows": 7, "max_targets": 5}):
        got = P.nearest(p, named, point="p", target="t", carry=("name",), **more).collect()
        assert len(got) == 600 and {r.p: (r.deg2, r.t) for r in got} == brute and all(r.name == f"n{r.t}" for r in got)


def test_nearest_place_shuffles_no_pairs(spark, sf):
    from stratamesh.plans import space

    plan = space.QUERIES["nearest_place"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_points_without_a_target_stay(spark):
    p = spark.createDataFrame([(1, 0.1, 0.1), (2, 9.0, 9.0), (3, None, 1.0), (4, float("nan"), 1.0)], POINTS)
    t = spark.createDataFrame([(7, 0.2, 0.1), (6, 0.2, 0.1), (5, None, 1.0), (4, float("nan"), 1.0)], TARGETS)
    for once in (True, False):
        got = P.nearest(p, t, point="p", target="t", within=0.3, once=once, outer=True).collect()
        assert sorted((r.p, r.t) for r in got) == [(1, 6), (2, None), (3, None), (4, None)]
    none = P.nearest(p, t.where("t < 0"), point="p", target="t", outer=True).collect()
    assert sorted((r.p, r.t) for r in none) == [(k, None) for k in (1, 2, 3, 4)]


def test_refit_assignment_shuffles_no_pairs(spark, sf):
    from stratamesh.plans import space

    plan = space.QUERIES["refit_assignment"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_a_point_at_several_positions(spark):
    p = spark.createDataFrame([(1, 0.1, 0.1), (1, 5.0, 5.0), (2, 5.3, 5.0), (2, 5.3, 5.0)], POINTS)
    t = spark.createDataFrame([(7, 0.4, 0.1), (8, 5.1, 5.0)], TARGETS)
    for more in ({}, {"start": 0.15}, {"within": 0.5}):
        assert sorted((r.p, r.t) for r in P.nearest(p, t, point="p", target="t", **more).collect()) == [(1, 8), (2, 8)]


def test_cell_locator_shuffles_no_pairs(spark, sf):
    from stratamesh.plans import space

    plan = space.QUERIES["cell_locator"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in plan and "Join" not in plan


def test_cell_locator_moves_few_cells_twice(spark, sf, monkeypatch):
    from stratamesh.plans import carrier, space

    tiles, written, count, write = [], [], P.hot_groups, P.cut
    monkeypatch.setattr(P, "hot_groups", lambda df, *rest: tiles.append(df.count()) or count(df, *rest))
    monkeypatch.setattr(P, "cut", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    space.QUERIES["cell_locator"](spark, sf).collect()
    assert tiles[0] < 1.5 * carrier.newest_cells(spark, sf).count()
    assert "Aggregate" not in written[0]


def test_tiles_of_any_sides_find_the_same(spark):
    p, t, brute = crowd(spark, 500, 4)
    inside = {i: v for i, v in brute.items() if v[0] <= 0.02 * 0.02}
    assert 0 < len(inside) < 500
    for more in ({"sides": 16}, {"sides": 16, "a_tile": 8}, {"sides": 3, "a_tile": 1, "max_rows": 9, "max_targets": 7}):
        got = P.nearest(p, t, point="p", target="t", within=0.02, **more).collect()
        assert len(got) == len(inside) and {r.p: (r.deg2, r.t) for r in got} == inside


def test_repeated_places_count_once(spark, tmp_path):
    import datetime

    from stratamesh.plans import space

    at = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(1, "a", 5.0, 5.0, 1.0, at, None), (2, "b", 5.0, 5.0, 1.0, at, None), (3, "c", 5.4, 5.0, 1.0, at, None)], "cell long, id string, lon double, lat double, area double, loaded_at timestamp, deleted_at timestamp").write.parquet(f"{tmp_path}/cells.parquet")
    places = [(7, 5.1, 5.0, 1), (7, 5.1, 5.0, 1), (7, 5.1, 5.0, 2), (8, 5.3, 5.0, -1), (9, 5.3, 5.0, None), (10, 6.0, 5.0, 1), (11, 5.8, 5.0, 1)]
    spark.createDataFrame(places, "place_key long, lng double, lat double, cell long").write.parquet(f"{tmp_path}/places.parquet")
    assert sorted(map(tuple, space.QUERIES["cell_locator"](spark, str(tmp_path)).collect())) == [(7, 1), (11, 3)]
