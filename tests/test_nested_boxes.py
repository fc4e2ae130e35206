def test_flat_and_equal_boxes(spark, monkeypatch):
    from stratamesh.plans import more

    rows = [(1, 0.0, 9.0, 0.0, 9.0), (2, 0.0, 9.0, 0.0, 9.0), (3, 1.0, 2.0, 1.0, 2.0), (4, 1.0, 1.0, 1.0, 2.0), (5, None, 1.0, 1.0, 2.0)]
    monkeypatch.setattr(more.C, "boxes", lambda *_: spark.createDataFrame(rows, "key bigint, x0 double, x1 double, y0 double, y1 double"))
    got = {r.key: (r.ring_depth, r.is_outer) for r in more.QUERIES["nest_holes"](spark, "").collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (2, True), 4: (3, False), 5: (0, True)}
