"""Operators of the timeline, regions, graphs and codecs on small cases with known answers."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stratamesh.functions import scalar as S
from stratamesh.operators import cellsets as X
from stratamesh.operators import graph as G
from stratamesh.operators import regions as R
from stratamesh.operators import replay as RP
from stratamesh.operators import spatial as P
from stratamesh.operators import temporal as T
from stratamesh.sources import codec as K
from stratamesh.sources import sinks as W


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    r = one(spark, S.half_up(F.lit(-2.5)), S.half_even(F.lit(2.5)), S.ratio(F.lit(1), F.lit(0)), S.slug(F.lit("  Sainte-Émilie & Co. ")), S.xml_escape(F.lit('<a & "b">')), S.long_date(F.lit("1870-07-15")), S.kml_colour(F.lit("#1f77B4")))
    assert list(r) == [-2.0, 2.0, 0.0, "sainte-emilie-co", "&lt;a &amp; &quot;b&quot;&gt;", "15 Jul 1870", "ffb4771f"]
    fnv = lambda s: __import__("functools").reduce(lambda h, b: ((h ^ b) * 16777619) % 2**32, s.encode(), 2166136261)
    for text in ("", "a", "foobar", "é人"):
        assert one(spark, S.fnv1a(F.lit(text)))[0] == fnv(text)
    got = [r.n for r in spark.range(1, 9).select(S.mulberry32(F.lit(0), F.col("id")).alias("n")).collect()]
    assert got == [1144304738, 1416247, 958946056, 627933444, 2007157716, 2340967985, 2642484575, 2787370982]


def test_rings(spark):
    sq = lambda a, b: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b))])
    assert one(spark, S.signed_area(sq(0, 4)), S.signed_area(F.reverse(sq(0, 4))))[:] == (16.0, -16.0)
    rings = F.array(sq(0, 10), sq(4, 6))
    assert list(one(spark, *[S.in_polygon(rings, F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 1), (5, 5), (11, 5), (3.9, 5))])) == [True, False, False, True]


def test_apportion(spark):
    df = spark.createDataFrame([("a", 2, 1, 10), ("a", 0, 1, 10), ("a", 1, 1, 10), ("z", 0, 0, 3), ("z", 1, 0, 3), ("n", 0, None, 5), ("n", 1, 5, 5), ("0", 0, 5, 0)], "g string, k int, w bigint, t bigint")
    got = {(r.g, r.k): r.o for r in R.apportion(df, "g", "k", "w", "t", "o").collect()}
    assert (got["a", 2], got["a", 0], got["a", 1]) == (3, 4, 3)
    assert got["z", 0] + got["z", 1] == 3 and got["n", 0] == 0 and got["n", 1] == 5 and got["0", 0] == 0


def test_spans_and_intervals(spark):
    rows = [("r", "ruperts", "1867-07-01", "1870-07-15", 0.9), ("r", "ontario", "1870-07-15", "1889-01-01", 0.6), ("r", "ontario", "1889-01-01", "1912-01-01", 1.0), ("r", "ontario", "1912-01-01", None, 0.99), ("s", "a", "1900-01-01", "1901-01-01", 0.5), ("s", "a", "1902-01-01", None, 0.4)]
    df = spark.createDataFrame(rows, "k string, unit string, f string, t string, share double")
    got = sorted(tuple(r) for r in T.merge_spans(df, ["k"], "f", "t", ["unit"], "share").collect())
    assert got == [("r", "ontario", "1870-07-15", None, 0.6), ("r", "ruperts", "1867-07-01", "1870-07-15", 0.9), ("s", "a", "1900-01-01", "1901-01-01", 0.5), ("s", "a", "1902-01-01", None, 0.4)]
    days = spark.createDataFrame([("1870-07-15",), ("1867-07-01",), ("1999-04-01",), ("1867-07-01",), (None,)], "day string")
    assert [tuple(r) for r in T.intervals(days, "day").orderBy("since").collect()] == [("1867-07-01", "1870-07-15"), ("1870-07-15", "1999-04-01"), ("1999-04-01", None)]


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
def test_carried_against_brute_force(spark, inclusive, forward, keyed):
    r = random.Random(7)
    day = lambda: f"{r.choice(['180', '181', '185'])}{r.randrange(10)}-01-0{r.randrange(1, 4)}"
    facts = sorted({(r.choice("ab"), day()) for _ in range(25)})
    probes = [(r.choice("abc"), day(), i) for i in range(80)]
    fd = spark.createDataFrame([(k, d, d) for k, d in facts], "k string, at string, v string")
    pd_ = spark.createDataFrame(probes, "k string, at string, i int")
    got = {x.i: x.v for x in T.carried(fd if keyed else fd.select("at", "v").distinct(), pd_, at="at", value="v", keys=["k"] if keyed else [], bucket=F.expr("substring(at, 1, 3)"), inclusive=inclusive, forward=forward).collect()}
    for k, d, i in probes:
        fit = [f for kk, f in facts if (kk == k or not keyed) and ((f > d) if forward else (f < d) or False or (inclusive and f == d))] + ([f for kk, f in facts if forward and inclusive and f == d and (kk == k or not keyed)])
        assert got[i] == ((min if forward else max)(fit) if fit else None)


def test_diff_and_fold(spark):
    a = spark.createDataFrame([("x", "1", None), ("y", "1", "p"), ("z", "1", "p")], "u string, n string, c string")
    b = spark.createDataFrame([("x", "1", None), ("y", "2", None), ("w", "1", "p")], "u string, n string, c string")
    assert sorted(tuple(r) for r in T.diff_full_outer(a, b, "u", ["n", "c"]).collect()) == [("w", "added", ""), ("y", "changed", "n,c"), ("z", "removed", "")]
    ch = spark.createDataFrame([("u", "1900-01-01", 1, "alter"), ("u", "1900-01-02", 2, "create"), ("u", "1900-01-03", 3, "create"), ("u", "1900-01-04", 4, "dissolve"), ("u", "1900-01-05", 5, "rename")], "u string, d string, s int, k string")
    assert [r.verdict for r in RP.event_fold(ch, unit="u", date="d", seq="s", kind="k").orderBy("s").collect()] == ["does not exist", "ok", "exists already", "ok", "does not exist"]


BASE = "run string, unit string, valid_from string, valid_to string, name string, status string, sovereign string"
EVENTS = "run string, date string, event string, seq bigint, kind string, unit string, name string, status string, sovereign string"


def test_scenario_replay(spark):
    rows = [("r", "a", "1870-01-01", "1880-01-01", "A", "t", "s"), ("r", "a", "1880-01-01", None, "A2", "t", "s"), ("r", "b", "1880-01-01", "1900-01-01", "B", "t", "s")]
    base = spark.createDataFrame(rows, BASE)
    same = RP.scenario_replay(base, spark.createDataFrame([], EVENTS), runs=["run"])
    assert sorted(map(tuple, same.collect()), key=repr) == sorted(rows, key=repr)  # no events: the base, row for row
    ev = spark.createDataFrame([("r", "1885-01-01", "e1", 1, "rename", "a", "A3", None, None), ("r", "1885-01-01", "e1", 2, "dissolve", "b", None, None, None), ("r", "1890-01-01", "e2", 1, "create", "a", "X", None, None), ("r", "1890-01-01", "e2", 2, "rename", "b", "X", None, None)], EVENTS)
    got = sorted((r.unit, r.valid_from, r.valid_to, r.name) for r in RP.scenario_replay(base, ev, runs=["run"]).collect())
    assert got == [("a", "1870-01-01", "1880-01-01", "A"), ("a", "1880-01-01", "1885-01-01", "A2"), ("a", "1885-01-01", None, "A3"), ("b", "1880-01-01", "1885-01-01", "B")]
    skipped = RP.scenario_replay(base, ev, runs=["run"], report=True).collect()
    assert [(r.event, r.reason) for r in skipped] == [("e2", "a exists already")]


def test_components_and_fills(spark):
    nodes = spark.createDataFrame([(i, i * 0.1, 0.0) for i in range(6)], "cell bigint, lon double, lat double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5)], "u bigint, v bigint")
    assert {r.cell: r.component for r in G.connected_components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    cross = G.join_components(nodes, edges, node="cell", candidates=P.near_pairs(nodes, key="cell", lon="lon", lat="lat", degrees=1.0)).collect()
    assert [(r.u, r.v) for r in cross] == [(2, 3)]
    line = spark.createDataFrame([(i, i + 1) for i in range(5)], "u bigint, v bigint")
    fill = lambda seeds: {r.node: r.seed for r in G.hop_distances(spark.createDataFrame(seeds, "node bigint, seed string, dist int"), line).collect()}
    assert fill([(0, "1", 0), (5, "2", 0)]) == {0: "1", 1: "1", 2: "1", 3: "2", 4: "2", 5: "2"}
    assert set(fill([(3, "zzzz", 0), (3, "bbbb", 0)]).values()) == {"bbbb"}
    assert G.connected_components(nodes.limit(0), edges).count() == 0


def test_long_chain_and_star(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(1000, 1000 + i) for i in range(1, 50)], "u bigint, v bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(n), *range(1000, 1050), 5000]], "cell bigint")
    got = {r.cell: r.component for r in G.connected_components(nodes, chain).collect()}
    assert all(got[i] == 0 for i in range(n)) and all(got[1000 + i] == 1000 for i in range(50)) and got[5000] == 5000


def test_tree_walk(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("a", None)], "n string, p string")
    start = spark.createDataFrame([("c",), ("x",)], "n string")
    assert {tuple(r) for r in G.tree_walk(links, "n", "p", start, True).collect()} == {("c", "c", 0), ("c", "b", 1), ("c", "a", 2), ("x", "x", 0), ("x", "y", 1)}
    assert {r.node for r in G.tree_walk(links, "n", "p", spark.createDataFrame([("a",)], "n string"), False).collect()} == {"a", "b", "c", "d"}


@pytest.mark.parametrize("within", [None, 3.0])
def test_nearest_against_brute_force(spark, within):
    r = random.Random(3)
    pts = [(i, r.uniform(-140, -50), r.uniform(40, 80)) for i in range(60)] + [(99, None, 1.0)]
    tgt = [(i, r.uniform(-140, -120), r.uniform(40, 60)) for i in range(40)] + [(100, -130.0, 50.0), (90, -130.0, 50.0)]
    got = {x.p: x.t for x in P.nearest(spark.createDataFrame(pts, "p int, lon double, lat double"), spark.createDataFrame(tgt, "t int, tlon double, tlat double"), point="p", target="t", start=0.5, within=within).collect()}
    for i, x, y in pts:
        best = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in tgt) if x is not None else None
        assert got.get(i) == (best[1] if best and (within is None or best[0] <= within**2) else None)


def test_box_joins(spark):
    r = random.Random(4)
    bx = [(k, *sorted((r.uniform(-9, 9), r.uniform(-9, 9))), *sorted((r.uniform(-9, 9), r.uniform(-9, 9)))) for k in range(25)]
    b = spark.createDataFrame(bx, "key int, x0 double, x1 double, y0 double, y1 double")
    pts = [(i, r.uniform(-10, 10), r.uniform(-10, 10)) for i in range(80)]
    got = {(x.p, x.key) for x in P.in_boxes(spark.createDataFrame(pts, "p int, lon double, lat double"), b, size=1.5).collect()}
    assert got == {(i, k) for i, x, y in pts for k, x0, x1, y0, y1 in bx if x0 <= x < x1 and y0 <= y < y1}
    a = b.select(F.col("key").alias("k2"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("y0").alias("c0"), F.col("y1").alias("c1"))
    pairs = [(x.k2, x.key, round(x.area, 9)) for x in P.box_overlaps(a, b, size=1.5).collect()]
    want = {(i[0], j[0], round((min(i[2], j[2]) - max(i[1], j[1])) * (min(i[4], j[4]) - max(i[3], j[3])), 9)) for i in bx for j in bx if min(i[2], j[2]) > max(i[1], j[1]) and min(i[4], j[4]) > max(i[3], j[3])}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_codec(spark):
    df = spark.createDataFrame([("BAMCAf7///////9/AAAAgA==",), ("",), (None,)], "d string")
    got = [r.v for r in df.select(K.decode_int32(F.col("d")).alias("v")).collect()]
    assert got == [[16909060, -2, 2147483647, -2147483648], [], None]
    assert one(spark, K.encode_int32(F.array(*[F.lit(x) for x in got[0]])))[0] == "BAMCAf7///////9/AAAAgA=="
    f = spark.createDataFrame([([0.5, -1.25, 3e8],), ([],)], "v array<float>")
    assert [r.w for r in f.select(K.decode_float32(K.encode_float32("v")).alias("w")).collect()] == [[0.5, -1.25, 3e8], []]
    bad = spark.createDataFrame([("a", "count", None, "float32", 1, "AAAAAA=="), ("b", "money", "eur", "float32", 2, "AAAAAA=="), ("c", "measure", "km", "float32", 1, "AAAAAA==")], "name string, kind string, unit string, dtype string, length int, data string")
    assert {tuple(r) for r in K.envelope_errors(bad).collect()} == {("a", "dtype"), ("b", "unit of money"), ("b", "length")}


def test_arcs_round_trip(spark):
    arcs = spark.createDataFrame([(0, [[5, 5], [1, -2], [0, 3]]), (1, [[0, 0]])], "arc int, points array<array<bigint>>")
    pts = K.decode_arcs(arcs, (0.5, 0.25), (-10.0, 40.0))
    assert [(r.x, r.y) for r in pts.where("arc = 0").orderBy("pos").collect()] == [(-7.5, 41.25), (-7.0, 40.75), (-7.0, 41.5)]
    assert {r.arc: r.points for r in K.encode_arcs(pts, (0.5, 0.25), (-10.0, 40.0)).collect()} == {0: [[5, 5], [1, -2], [0, 3]], 1: [[0, 0]]}


def test_links_markdown_and_files(spark, tmp_path):
    for text in ('{"n":1}', "é?>~ü", "x"):
        link = one(spark, K.share_link(F.lit(text)))[0]
        assert not set(link) & set("+/=") and one(spark, K.open_link(F.lit(link)))[0] == text
    md = spark.createDataFrame([("| id | url |",), ("|---|:--|",), ("| a | http://x |",), ("text",)], "value string")
    assert [r.cells for r in K.markdown_rows(md).collect()] == [["id", "url"], ["a", "http://x"]]
    a = W.write_json_gz({"b": 1, "a": [1]}, str(tmp_path / "x.json.gz"))
    assert a == W.write_json_gz({"a": [1], "b": 1}, str(tmp_path / "y.json.gz"))
    assert spark.read.json(str(tmp_path / "x.json.gz")).first().b == 1


def test_geojson_and_kml_round_trip(spark, tmp_path):
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(1, "A & B", "#102030", [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0)]), (2, "C", "#102030", [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)])], f"region int, name string, colour string, ring {ring}")
    feats = [json.loads(r.feature) for r in W.geojson_features(df, ["name"]).orderBy("region").collect()]
    assert feats[0]["geometry"]["coordinates"] == [[[2.0, 2.0], [0.0, 2.0], [0.0, 0.0], [2.0, 2.0]]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    back = K.read_geojson(spark, str(tmp_path / "a.geojson")).orderBy("feature").collect()
    assert [r.properties["name"] for r in back] == ["A & B", "C"] and [(p.x, p.y) for p in back[1].points][:2] == [(5.0, 5.0), (6.0, 5.0)]
    marks = "".join(r.placemark for r in W.kml_placemarks(df, "name", "colour").collect())
    (tmp_path / "a.kml").write_text(f"<kml><Document>{marks}</Document></kml>")
    kml = {r.name: [(p.x, p.y) for p in r.ring] for r in K.read_kml(spark, str(tmp_path / "a.kml")).collect()}
    assert kml["A & B"] == [(2.0, 2.0), (0.0, 2.0), (0.0, 0.0), (2.0, 2.0)]


def test_pack_and_greedy_steps(spark):
    a = spark.createDataFrame([(7, 1), (3, 0), (5, -1)], "cell bigint, region int")
    pack = json.loads(W.pack_json(a, a.groupBy("region").count(), {"seed": "1"}).first().pack)
    assert pack["assignment"]["length"] == 3 and pack["meta"] == {"seed": "1"} and [r["region"] for r in pack["regions"]] == [-1, 0, 1]
    assert one(spark, K.decode_int32(F.lit(pack["assignment"]["data"])))[0] == [0, -1, 1]
    same = R.compare_overlap(a, a).collect()
    assert all(r.ra == r.rb for r in same)  # a split against itself moves nothing
    pairs = spark.createDataFrame([(0, 0, 5), (0, 1, 9), (1, 1, 8), (1, 0, 1)], "ra int, rb int, n int")
    assert {(r.ra, r.rb) for r in R.greedy_match(pairs, "ra", "rb", "n").collect()} == {(0, 1), (1, 0)}
    nb = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if i < j], "a int, b int")
    assert len({r.colour for r in X.greedy_colours(nb).collect()}) == 6
    names = spark.createDataFrame([(1, 5, 1, "P"), (2, 9, 1, "P"), (2, 9, 2, "Q"), (3, 1, 1, "P")], "region int, weight int, place int, name string")
    assert {r.region: r.name for r in X.unique_names(names).collect()} == {2: "P", 1: "P 2", 3: "P 3"}
    runs = spark.createDataFrame([(1, 0, "a", 50.0), (1, 1, "b", 10.0), (1, 2, "a", 60.0), (1, 3, "c", 70.0)], "k int, pos int, kind string, km double")
    assert [(r.kind, r.km) for r in X.merge_short(runs, ["k"], 45.0).orderBy("pos").collect()] == [("a", 120.0), ("c", 70.0)]


def test_stream_of_events(spark, tmp_path):
    from stratamesh.streaming.events import counts_by_day, event_stream, once

    t = dt.datetime(2024, 1, 1, 5)
    rows = [(1, "create", t), (1, "create", t + dt.timedelta(hours=1)), (2, "alter", t), (3, "alter", t + dt.timedelta(days=40))]
    df = spark.createDataFrame(rows, "event_key bigint, event_kind string, ingested_at timestamp")
    for i in range(4):
        df.where(f"event_key = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = counts_by_day(once(event_stream(spark, str(tmp_path / "in"), df.schema))).writeStream.outputMode("complete").format("memory").queryName("by_day").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.event_kind, r.n) for r in spark.sql("SELECT * FROM by_day").collect()) == [("alter", 1), ("alter", 1), ("create", 1)]


@pytest.mark.parametrize(("seed", "wide"), [(0, 1_000_000), (1, 3), (2, 10)])
def test_components_against_brute_force(spark, seed, wide):
    r = random.Random(seed)
    n = 150
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(90)] + [(5, k) for k in range(60, 90)] + [(k, k + 1) for k in range(100, 130)] + [(3, None), (7, 7), (7, 9999)]
    root = {k: k for k in range(n)}
    for _ in range(n):
        for a, b in pairs:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(k,) for k in range(n)] + [(4,), (None,)], "cell bigint")
    got = G.connected_components(nodes, spark.createDataFrame(pairs, "u bigint, v bigint"), wide=wide).collect()
    assert {x.cell: x.component for x in got} == root and len(got) == n


@pytest.mark.parametrize(("seed", "band", "rows"), [(0, 32, 1_000_000), (1, 2, 5), (2, 1, 40)])
def test_points_in_polygons_against_brute_force(spark, seed, band, rows):
    r = random.Random(seed)

    def star(x, y, size, corners):
        at = sorted(r.random() * 2 * math.pi for _ in range(corners))
        return [(x + size * q * math.cos(t), y + size * q * math.sin(t)) for t in at for q in (r.uniform(0.3, 1),)]

    shapes = {k: [star(r.uniform(-20, 20), r.uniform(-20, 20), r.choice((0.01, 1, 3, 30)), r.choice((3, 8, 60)))] for k in range(25)}
    for k in (1, 2, 3):
        x, y = shapes[k][0][0]
        shapes[k].append([(x - 0.5, y - 0.5), (x + 0.5, y - 0.5), (x + 0.5, y + 0.5), (x - 0.5, y + 0.5), (x - 0.5, y - 0.5)])
    shapes[98], shapes[99] = [], None
    points = [(i, r.gauss(0, 8), r.gauss(0, 8)) for i in range(300)] + [(900 + i, 0.5, 0.25) for i in range(60)] + [(1, None, 2.0), (2, 3.0, None)] + [(i, *p) for i, p in enumerate(shapes[4][0])]

    def inside(x, y, rings):
        n = 0
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return n % 2 == 1

    want = sorted((i, k) for i, x, y in points if x is not None and y is not None for k, rings in shapes.items() if rings and inside(x, y, rings))
    p = spark.createDataFrame([(*x, "s") for x in points], "id int, lon double, lat double, _s string")
    g = spark.createDataFrame([(k, v, 0) for k, v in shapes.items()] + [(None, shapes[0], 0)], "key int, rings array<array<struct<x:double,y:double>>>, lon int")
    got = P.points_in_polygons(p, g, edges_a_band=band, max_rows=rows)
    assert got.columns == ["id", "lon", "lat", "_s", "key"]
    assert sorted((x.id, x.key) for x in got.collect()) == want and len(want) > 300
    assert P.points_in_polygons(p.limit(0), g).count() == P.points_in_polygons(p, g.limit(0)).count() == 0
