"""Queries without SQL against brute force, on tables where a bound would show."""

import datetime as dt
import json
import math
import os
import random
import sys
from collections import deque

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connection  # noqa: E402

from stratamesh.operators import graph as G  # noqa: E402
from stratamesh.operators.proximity import EARTH_KM  # noqa: E402
from stratamesh.operators.hierarchy import _bucketed, ancestors, descendants, nested_sets  # noqa: E402
from stratamesh.plans import further, problems, space, timeline  # noqa: E402

T0 = dt.datetime(2024, 1, 1)
CELLS = "cell bigint, id string, lon double, lat double, area double, province string, cd string, csd string, neighbours array<bigint>, mesh_version string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
PLACES = "place_key bigint, csd string, name string, province string, population bigint, lng double, lat double, cell bigint, loaded_at timestamp_ntz"


def write_cells(spark, d, near, at=lambda c: (c * 0.1 - 100, 50.0)):
    rows = [(c, f"{c:015x}", *at(c), 1.0, "AB", "1", "1", near[c], "v1", T0, None) for c in near]
    spark.createDataFrame(rows, CELLS).write.parquet(f"{d}/cells.parquet")


def test_shortest_path_fill_reaches_every_cell(spark, tmp_path):
    r = random.Random(3)
    near = {c: [n for n in (c - 1, c + 1) if 0 <= n < 60] for c in range(60)} | {c: [] for c in (60, 61)}
    near[60].append(61)
    for _ in range(6):
        near[r.randrange(40, 60)].append(r.randrange(40, 60))
    write_cells(spark, tmp_path, near)
    seeds = {0: 5, 50: 2, 52: 1}
    spark.createDataFrame([(k, "1", "x", "AB", 20_000, 0.0, 0.0, c, T0) for c, k in seeds.items()] + [(9, "1", "y", "AB", 10, 0.0, 0.0, 25, T0)], PLACES).write.parquet(f"{tmp_path}/places.parquet")
    both = {c: set(ns) | {m for m in near if c in near[m]} for c, ns in near.items()}
    want = {}
    for s, key in seeds.items():
        dist, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in both[u] - dist.keys():
                dist[v] = dist[u] + 1
                todo.append(v)
        for c, n in dist.items():
            want[c] = min(want.get(c, (n, key)), (n, key))
    got = {x.cell: (x.dist, x.seed) for x in space.QUERIES["shortest_path_fill"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 60 and max(n for n, _ in want.values()) > 12


def km(p, q):
    (x1, y1), (x2, y2) = (tuple(map(math.radians, a)) for a in (p, q))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("seed", [0, 1])
def test_cross_components_against_brute_force(spark, seed):
    r = random.Random(seed)
    # crowds far apart, two of them on both sides of the date line, one at a pole
    at = {100 * k + i: (x + r.uniform(-w, w), y + r.uniform(-w, w)) for k, (x, y, w) in enumerate([(-100, 50, 2), (-60, 52, 2), (179, -10, 0.9), (-179, -10, 0.9), (10, 89, 0.9), (-99, 51, 0.5)]) for i in range(12)}
    names = list(at)
    r.shuffle(names)
    edges = [(min(a, b), max(a, b)) for a, b in zip(names, names[1:]) if a // 100 == b // 100]
    edges += [(100, 101), (102, 101)]
    root = {n: n for n in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = set()
    for d, a, b in sorted((km(at[a], at[b]), a, b) for a in at for b in at if a < b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b))
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()] + [(9999, None, None)], "cell bigint, lon double, lat double")
    got = G.cross_components(nodes, spark.createDataFrame(edges, "u bigint, v bigint"), node="cell").collect()
    assert {(x.u, x.v) for x in got} == want and len(got) == len(want) > 12
    assert all(abs(x.km - km(at[x.u], at[x.v])) < 1e-6 for x in got)
    assert G.cross_components(nodes.limit(0), spark.createDataFrame([], "u bigint, v bigint"), node="cell").count() == 0


def test_sea_crossings_leave_one_piece(spark, sf):
    cells, e = space._half(spark, sf)
    far = space.QUERIES["sea_crossings"](spark, sf).select("u", "v")
    assert far.count() == G.connected_components(cells, e).select("component").distinct().count() - 1
    assert G.connected_components(cells, e.unionByName(far)).select("component").distinct().count() == 1


def test_everything_below_every_split(spark, sf):
    assert compare(spark, connection(sf), problems.QUERIES["p5_below"], problems.SQL["p5_below"], sf) == ""
    sets = problems.QUERIES["p5_sets"](spark, sf).collect()
    found = {x.node_id: x for x in problems.QUERIES["p5_found"](spark, sf).collect()}
    assert len(sets) == len(found) and {x.node_id: x.root_id for x in sets} == {n: x.root_id for n, x in found.items()}
    assert all(x.hi - x.lo == found[x.node_id].n_below if x.root_id else (x.lo, x.hi) == (-1, -1) for x in sets)
    below = {(x.node_id, x.below) for x in problems.QUERIES["p5_below"](spark, sf).collect()}
    assert below == {(a.node_id, b.node_id) for a in sets for b in sets if a.root_id and a.root_id == b.root_id and a.lo < b.lo <= a.hi}


def test_range_join_does_not_meet_the_whole_tree(spark):
    """One wide tree: 40 families of 50 under one root. On the root alone 2,041 x 2,041 pairs would meet."""
    rows = [("r", None)] + [(f"f{i}", "r") for i in range(40)] + [(f"f{i}.{j}", f"f{i}") for i in range(40) for j in range(50)]
    sets = nested_sets(spark.createDataFrame(rows, "node string, parent string")).cache()
    want = {("r", n) for n, p in rows if p} | {(p, n) for n, p in rows if p and p != "r"}
    assert {(x.node, x.below) for x in descendants(sets).collect()} == want
    assert {(x.above, x.node) for x in ancestors(sets).collect()} == want
    r, p = _bucketed(sets, sets.select("node", "root", "lo", "hi"))
    assert r.join(p, ["root", "_k", "_b"]).agg(F.count(F.lit(1))).first()[0] <= 4 * len(want)


def test_scenario_replay_keeps_every_create(spark, tmp_path):
    rows = [
        (3, "s", "a", "1900-01-01", T0, "create", "A again", "t", "x"), (2, "s", "a", "1880-01-01", T0, "dissolve", None, None, None), (1, "s", "a", "1850-01-01", T0, "create", "A", "t", "x"),
        (4, "s", "b", "1860-01-01", T0, "create", "B", "t", "x"), (5, "s", "b", "1870-01-01", T0, "create", "B twice", "t", "x"), (6, "s", "b", "1875-01-01", T0, "rename", "B2", None, None),
        (8, "s", "c", "1860-01-01", T0, "create", "C late", "t", "x"), (7, "s", "c", "1860-01-01", T0, "create", "C first", "t", "x"), (9, "s", "c", None, T0, "create", "no date", "t", "x"),
    ]
    schema = "change_id bigint, scenario_id string, unit_id string, event_date string, recorded_at timestamp_ntz, kind string, name string, status string, sovereign string, capital string, fields_set array<string>"
    spark.createDataFrame([(*r, None, []) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/unit_changes.parquet")
    got = {(x.unit, x.valid_from, x.valid_to, x.name) for x in timeline.QUERIES["scenario_replay"](spark, str(tmp_path)).collect()}
    assert got == {("a", "1850-01-01", "1880-01-01", "A"), ("a", "1900-01-01", None, "A again"), ("b", "1860-01-01", "1875-01-01", "B"), ("b", "1875-01-01", None, "B2"), ("c", "1860-01-01", None, "C first")}


def test_every_cell_of_the_mesh_has_a_component(spark, tmp_path):
    r = random.Random(5)
    near = {c: [r.randrange(80)] if r.random() < 0.7 else [] for c in range(80)}
    write_cells(spark, tmp_path, near)
    root = {c: c for c in near}
    for _ in near:
        for c, ns in near.items():
            for n in ns:
                root[c] = root[n] = min(root[c], root[n])
    assert {x.cell: x.component for x in space.QUERIES["mesh_components"](spark, str(tmp_path)).collect()} == root
    sizes = {x.component: x.n_cells for x in space.QUERIES["mesh_component_sizes"](spark, str(tmp_path)).collect()}
    assert sizes == {c: list(root.values()).count(c) for c in set(root.values())} and len(sizes) > 5


def test_nearest_cells_without_replacement(spark, sf):
    got = [(x.place_key, x.cell) for x in further.QUERIES["nearest_capital_cells"](spark, sf).collect()]
    cells = further.C.newest_cells(spark, sf).select("cell", "lon", "lat").collect()
    used, want = set(), []
    for p in further.C.places(spark, sf).orderBy(F.col("population").desc(), "place_key").limit(14).collect():
        c = min((c for c in cells if c.cell not in used), key=lambda c: ((c.lon - p.lng) ** 2 + (c.lat - p.lat) ** 2, c.cell)).cell
        used.add(c)
        want.append((p.place_key, c))
    assert got == want


def test_trees_keep_null_children(spark):
    rows = [(1, "0", "", "m", None), (1, "0.1", "0", "a", "x"), (1, "0.3", "0", None, None), (1, "0.3.0", "0.3", "b", "y\"}")]
    packs = spark.createDataFrame(rows, "raw_id int, pack string, parent string, method string, pack_name string")
    tree = json.loads(further.assemble(packs).first()["tree"])
    assert tree["children"][0] is None and tree["children"][2] is None and len(tree["children"]) == 4
    assert tree["children"][3]["children"][0]["meta"] == {"method": "b", "id": "y\"}"} and tree["meta"] == {"method": "m"}
    assert further.assemble(packs.limit(0)).count() == 0


def test_json_is_told_by_its_first_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n"), (2, None), (3, "é")], "k int, v string")
    further.write_json_gz(df, f"{tmp_path}/j")
    for i, f in enumerate(p for p in os.listdir(f"{tmp_path}/j") if p.endswith(".gz")):
        os.rename(f"{tmp_path}/j/{f}", f"{tmp_path}/j/part{i}")  # no extension tells
    with open(f"{tmp_path}/j/plain.gz", "w", encoding="utf-8") as out:
        out.write('\ufeff{"k": 4}\n\n')
    got = sorted((x.k, x.v) for x in further.read_json(spark, f"{tmp_path}/j", "k int, v string").collect() if x.k)
    assert got == [(1, "a\n"), (2, None), (3, "é"), (4, None)]
