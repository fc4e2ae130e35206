"""The operators of the data-processing problems against brute force on small, dirty fixtures."""

import datetime as dt
import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from stratamesh.operators.asof import as_known
from stratamesh.operators.hierarchy import ancestors, descendants, nested_sets, resolve_parents
from stratamesh.operators.history import build_history
from stratamesh.operators.orphans import orphan_references
from stratamesh.operators.proximity import EARTH_KM, pairs_within
from stratamesh.sources.nested import Broken, instances, shred, triples

T0 = dt.datetime(2024, 1, 1)
FIELDS = ["name", "capital"]
CHANGES = "change_id bigint, unit_id string, event_date string, recorded_at timestamp_ntz, kind string, name string, capital string, fields_set array<string>, e string, d string, st string"


def history_of(df, **kw):
    h = build_history(df, entity="unit_id", date="event_date", change="change_id", known_at="recorded_at", kind="kind", fields=FIELDS, fields_set="fields_set", **kw)
    return sorted(((r.unit_id, str(r.valid_from), str(r.valid_to) if r.valid_to else None, r.name, r.capital) for r in h.collect()), key=repr)


def norm(s):
    return None if s is None else " ".join(unicodedata.normalize("NFC", s).split())


def brute_history(rows):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or (r[3], r) > (last[r[0]][3], last[r[0]])):
            last[r[0]] = r
    by_unit = {}
    for r in last.values():
        if r[1] is not None and r[2] is not None and r[4] is not None:
            by_unit.setdefault(r[1], []).append(r)
    out = []
    for unit, rs in by_unit.items():
        state, days = None, {}
        for r in sorted(rs, key=lambda r: (r[2], r[0])):
            given = {f: norm(v) for f, v in zip(FIELDS, r[5:7]) if r[7] and f in r[7]}
            if r[4] == "create":
                state = {**(state or dict.fromkeys(FIELDS)), **given}
            elif state is not None and r[4] in ("alter", "rename"):
                state = {**state, **given}
            elif r[4] == "dissolve":
                state = None
            days[r[2]] = state and tuple(state.values())
        was, since = None, None
        for day in sorted(days):
            if days[day] != was:
                if was is not None:
                    out.append((unit, since, day, *was))
                was, since = days[day], day
        if was is not None:
            out.append((unit, since, None, *was))
    return sorted(out, key=repr)


def random_changes(seed, n):
    r = random.Random(seed)
    values = ["A", " A\t", "B", "é", "é", "", None, "x\xa0y", "x  y"]
    rows = []
    for i in range(n):
        unit = r.choice(["hot"] * 6 + ["u1", "u2", "u3", None])
        day = r.choice([None, *[f"19{r.randrange(10, 30)}-0{r.randrange(1, 4)}-0{r.randrange(1, 4)}"] * 20])
        rows.append((r.choice([None, *range(max(1, i - 3), i + 30)] if r.random() < 0.2 else [1000 + i]), unit, day, T0 + dt.timedelta(seconds=i), r.choice(["create", "alter", "alter", "rename", "dissolve", "noise", None]), r.choice(values), r.choice(values), r.choice([None, [], ["name"], ["capital"], FIELDS])))
    return rows


@pytest.mark.parametrize(("seed", "limit", "block"), [(1, 10_000, 256), (2, 10_000, 2), (3, 40, 3), (4, 15, 256), (5, 60, 1)])
def test_history_against_brute_force(spark, seed, limit, block):
    rows = random_changes(seed, 300)
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in rows + rows[:40]], CHANGES)
    assert history_of(df, max_group_rows=limit, block=block) == brute_history(rows)


def test_history_empty_long_and_ties(spark):
    empty = spark.createDataFrame([], CHANGES)
    assert history_of(empty) == []
    long = "ab " * 200_000
    rows = [(1, "u", "1900-01-01", T0, "create", long, None, ["name"]), (1, "u", "1900-01-01", T0, "create", long, None, ["name"]), (2, "u", "1900-01-01", T0, "dissolve", None, None, []), (3, "u", "not a date", T0, "create", "x", None, ["name"]), (4, "v", "1900-01-02", T0, "create", long, "c", FIELDS)]
    got = history_of(spark.createDataFrame([(*r, None, None, None) for r in rows], CHANGES))
    assert [(g[0], g[1], g[2]) for g in got] == [("v", "1900-01-02", None)] and got[0][3] == long.strip()


# --- as known ---------------------------------------------------------------------------------------------------

EVENTS = "event_key bigint, unit_id string, truth string, event_date string, observed_at timestamp_ntz, ingested_at timestamp_ntz, at string, seg string"
VERSIONS = "unit_row_key bigint, unit_id string, truth string, valid_from string, valid_to string, recorded_at timestamp_ntz, d string"


def known(spark, ev, ve, **kw):
    r = as_known(spark.createDataFrame(ev, EVENTS), spark.createDataFrame(ve, VERSIONS), keys=["unit_id", "truth"], event_id="event_key", event_date="event_date", observed_at="observed_at", version_id="unit_row_key", valid_from="valid_from", valid_to="valid_to", recorded_at="recorded_at", **kw)
    return sorted(tuple(x) for x in r.collect())


@pytest.mark.parametrize(("seed", "limit"), [(1, 10_000), (2, 30), (3, 7)])
def test_as_known_against_brute_force(spark, seed, limit):
    r = random.Random(seed)
    day = lambda: r.choice([None] + [f"18{r.randrange(10, 60)}-01-01" for _ in range(12)])
    at = lambda: r.choice([None] + [T0 + dt.timedelta(hours=r.randrange(40)) for _ in range(12)])
    unit = lambda: r.choice(["hot", "hot", "hot", "u1", "u2", None])
    ve = [(k, unit(), r.choice(["a", "b"]), day(), day(), at(), "x") for k in range(60)]
    ev = [(k, unit(), r.choice(["a", "b", "c"]), day(), at(), T0, "x", "y") for k in range(400)]
    want = []
    for e in ev:
        if None in e[1:5]:
            continue
        fit = [v for v in ve if v[1:3] == e[1:3] and v[3] and v[5] and v[3] <= e[3] and (v[4] is None or e[3] < v[4]) and v[5] <= e[4]]
        if fit:
            want.append((e[0], max(fit, key=lambda v: (v[5], v[0]))[0]))
    again = [(*e[:5], T0 + dt.timedelta(days=1), "x", "y") for e in ev[:50]]
    assert known(spark, ev + again, ve + ve[:9], max_group_rows=limit) == sorted(want)


def test_as_known_empty_sides(spark):
    ev, ve = [(1, "u", "a", "1900-01-01", T0, T0, "", "")], [(1, "u", "a", "1800-01-01", None, T0, "")]
    assert known(spark, ev, ve) == [(1, 1)] and known(spark, [], ve) == [] and known(spark, ev, []) == []


# --- nested records ---------------------------------------------------------------------------------------------

REPEATED = frozenset(["children", "regions"])


def flatten(v, path="", ords=(), repeated=REPEATED):
    """The same triples from a parsed tree."""
    out = []
    if isinstance(v, dict):
        out.append((path, list(ords), "object", None))
        for k, x in v.items():
            p = f"{path}.{k}"
            if k in repeated and isinstance(x, dict):
                out += flatten(x, p + "[]", (*ords, 0), repeated)
            else:
                out += flatten(x, p, ords, repeated)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out += flatten(x, path + "[]", (*ords, i), repeated)
    elif v is not None:
        kind = "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
        out.append((path, list(ords), kind, v if kind == "string" else json.dumps(v)))
    return out


def random_tree(r, depth=0):
    k = r.random()
    if depth > 5 or k < 0.3:
        return r.choice([None, True, False, 0, -12, 3.5, "x", 'q"\\\n', "é人", ""])
    if k < 0.6:
        return [random_tree(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["children", "regions", "id", "a"]) + ("" if r.random() < 0.8 else str(i)): random_tree(r, depth + 1) for i in range(r.randrange(5))}


@pytest.mark.parametrize("seed", range(40))
def test_triples_against_a_parser(seed):
    r = random.Random(seed)
    v = {"top": random_tree(r), "children": random_tree(r)}
    for text in (json.dumps(v), json.dumps(v, indent=2, ensure_ascii=False), "﻿ \n" + json.dumps(v) + " \n", json.dumps(json.dumps(v)), json.dumps("﻿" + json.dumps(v))):
        assert triples(text, REPEATED) == flatten(v)


@pytest.mark.parametrize("bad", ["", " ", "null", "[]", "[{}]", '"x"', "{", '{"a":1', '{"a":1}}', '{"a":1}{"b":2}', '{"a":}', '{"a":1,}', '{"a" 1}', "{a:1}", '{"a":[1,]}', '{"a":[1}', '{"a":01}', '{"a":"x\ny"}', "upstream timeout", '"{}', '{"a":tru}', "{,}", '{"a":1 "b":2}', '{"a":[1 2]}'])
def test_broken_records_yield_nothing(bad):
    with pytest.raises(Broken):
        triples(bad, REPEATED)


def test_shred_deep_nulls_and_clashes(spark):
    deep = '{"children":[' * 3000 + '{"id":7}' + "]}" * 3000
    rows = [(1, deep, "p"), (2, None, "p"), (3, "", "p"), (4, '{"id":1,"id":2,"x.id":3}', "p"), (5, '{"children":null,"regions":[null,{"id":"9"}]}', "p")]
    df = spark.createDataFrame(rows, "k bigint, body string, path string")
    t = shred(df.withColumnRenamed("path", "kind"), key="k", payload="body", keep=["kind"], repeated=["children", "regions"])
    got = instances(t, ["k"], F.regexp_extract("path", r"^(.*\[\])?", 0), {"id": "id"}).collect()
    assert {(r.k, len(r.ords), r.id) for r in got if r.id} == {(1, 3000, "7"), (4, 0, "2"), (5, 1, "9")}
    assert shred(df.limit(0).drop("path"), key="k", payload="body", keep=[], repeated=[]).count() == 0


# --- orphans ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "limit"), [(1, 10_000), (2, 20), (3, 5)])
def test_orphans_against_brute_force(spark, seed, limit):
    r = random.Random(seed)
    at = lambda: r.choice([None] + [T0 + dt.timedelta(hours=r.randrange(30)) for _ in range(15)])
    refs = [(r.choice(["c", "c", "i", None]), r.choice(["hot", "hot", "1", "2", "3", "4", "", None]), at(), k, "x") for k in range(300)]
    parents = [(r.choice(["c", "i"]), r.choice(["hot", "1", "2", "3", ""]), at(), at()) for _ in range(14)]
    want = []
    for dom, ref, t, k, _ in refs:
        if dom is None or ref is None:
            continue
        mine = [p for p in parents if p[:2] == (dom, ref)]
        if t and any(p[2] and p[2] <= t and (p[3] is None or t < p[3]) for p in mine):
            continue
        want.append((k, "missing" if not mine else "late" if t and all(p[2] and p[2] > t for p in mine) else "deleted"))
    rd = spark.createDataFrame(refs, "domain string, ref string, at timestamp_ntz, k bigint, reason_ string")
    pd_ = spark.createDataFrame(parents + parents[:5], "domain string, ref string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    got = orphan_references(rd, pd_, max_group_rows=limit).select("k", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert orphan_references(rd.limit(0), pd_).count() == 0
    assert {x.reason for x in orphan_references(rd, pd_.limit(0)).collect()} == {"missing"}


# --- hierarchy --------------------------------------------------------------------------------------------------


def brute_tree(parent):
    out = {}
    for v in parent:
        path, x = [v], v
        while parent[x] is not None and parent[x] not in path:
            x = parent[x]
            path.append(x)
        out[v] = None if parent[x] is not None else path[::-1]
    return out


@pytest.mark.parametrize(("seed", "sizes"), [(0, {}), (1, {}), (2, {"wide": 5, "piece": 7}), (3, {"wide": 20, "piece": 3})])
def test_nested_sets_against_brute_force(spark, seed, sizes):
    r = random.Random(seed)
    n = 120
    parent = {f"n{i}": (f"n{r.randrange(i)}" if i and r.random() < 0.93 else None) for i in range(n)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(90)}  # a chain
    parent |= {f"w{i}": "n3" for i in range(80)}  # a wide family
    if seed:
        parent |= {"a": "b", "b": "d", "d": "a", "s": "s", "below": "a", "below2": "below", **{f"y{i}": "s" for i in range(5)}}
    links = spark.createDataFrame(list(parent.items()), "node string, parent string")
    sets = nested_sets(links, with_path=True, **sizes).cache()
    want = brute_tree(parent)
    got = {x.node: x for x in sets.collect()}
    assert got.keys() == parent.keys()
    for v, path in want.items():
        x = got[v]
        if path is None:
            assert (x.root, x.depth, x.n_below, x.path) == (None, -1, -1, None)
        else:
            assert (x.root, x.depth, x.path) == (path[0], len(path) - 1, path)
            assert x.n_below == sum(1 for p in want.values() if p and v in p) - 1
    # ranges nest as the tree does
    for p in {p for p in parent.values() if want.get(p)}:
        kids = sorted((got[v].lo, got[v].hi) for v, q in parent.items() if q == p)
        assert [a for a, _ in kids] == [got[p].lo + 1, *(b + 1 for _, b in kids[:-1])] and kids[-1][1] == got[p].hi
    some = spark.createDataFrame([("n3",), ("c40",), ("n7",)], "node string")
    up = {(a.node, a.above) for a in ancestors(sets, some).collect()}
    down = {(a.node, a.below) for a in descendants(sets, some).collect()}
    assert up == {(v, u) for v in ("n3", "c40", "n7") for u in want[v][:-1]}
    assert down == {(v, u) for v in ("n3", "c40", "n7") for u, p in want.items() if p and v in p and u != v}


def test_only_loops_and_empty(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "node string, parent string")
    assert {(x.node, x.depth) for x in nested_sets(links).collect()} == {("a", -1), ("b", -1), ("c", -1)}
    assert nested_sets(links.limit(0)).count() == 0
    gone = spark.createDataFrame([("a", "gone"), ("b", "gone"), ("c", "b"), ("d", "x")], "node string, parent string")
    assert {(x.node, x.root, x.depth, x.lo, x.hi) for x in nested_sets(gone).collect()} == {("a", "a", 0, 0, 0), ("b", "b", 0, 0, 1), ("c", "b", 1, 1, 1), ("d", "d", 0, 0, 0)}


def test_star_and_chain(spark):
    """A root with a million children, and a chain of 100,000 under one of them: salted joins, 17 rounds, no wide task."""
    star = spark.range(1_000_000).select((F.col("id") + 1).alias("node"), F.lit(0).cast("bigint").alias("parent"))
    chain = spark.range(100_000).select((F.col("id") + 2_000_000).alias("node"), F.when(F.col("id") == 0, 7).otherwise(F.col("id") + 1_999_999).alias("parent"))
    top = spark.createDataFrame([(0, None)], "node bigint, parent bigint")
    sets = nested_sets(top.unionByName(star).unionByName(chain), wide=100_000, piece=50_000).where("node in (0, 7, 2000000, 2099999)")
    got = {x.node: (x.root, x.depth, x.n_below, x.hi - x.lo) for x in sets.collect()}
    assert got == {0: (0, 0, 1_100_000, 1_100_000), 7: (0, 1, 100_000, 100_000), 2_000_000: (0, 2, 99_999, 99_999), 2_099_999: (0, 100_001, 0, 0)}


def test_resolve_parents(spark):
    rows = [("a", None, ["b", None, "x"], T0), ("b", None, None, T0), ("c", "gone", [], T0), ("d", "a", ["b"], T0), ("d", "b", None, T0 + dt.timedelta(1)), ("d", "b", None, T0 + dt.timedelta(1)), (None, "a", ["c"], T0), ("e", None, ["e"], T0)]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, children array<string>, updated_at timestamp_ntz").withColumn("node", F.lit(1)).withColumn("p", F.lit(2))
    got = {x.node: x.parent for x in resolve_parents(df, node="node_id", parent="parent_id", children="children", updated_at="updated_at").collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": "b", "e": "e"}


# --- proximity --------------------------------------------------------------------------------------------------


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("radius", "limit"), [(0.25, 2000), (0.25, 3), (40.0, 10), (900.0, 2000)])
def test_pairs_against_brute_force(spark, radius, limit):
    r = random.Random(int(radius))
    near = lambda y, x: (y + r.uniform(-1, 1) * radius / 80, x + r.uniform(-1, 1) * radius / 80 / max(0.02, math.cos(math.radians(y))))
    pts = []
    for y, x in ((60.0, -135.0), (0.01, 179.9999), (0.0, -179.9999), (89.999, 10.0), (-89.99, -170.0), (89.9999, -120.0), (45.0, 0.0)):
        pts += [near(y, x) for _ in range(25)] + [(y, x)] * 3
    pts = [(max(-90.0, min(90.0, y)), (x + 180) % 360 - 180) for y, x in pts]
    pts += [(None, 1.0), (1.0, None), (91.0, 0.0), (0.0, 181.0), (0.0, 0.0), (0.0, 0.0), (float("nan"), 5.0), (90.0, 0.0), (-90.0, 33.0), (90.0, 77.0)]
    rows = [(i, *p, "c") for i, p in enumerate(pts)]
    ok = [(i, p) for i, p in enumerate(pts) if None not in p and p[0] == p[0] and abs(p[0]) <= 90 and abs(p[1]) <= 180 and p != (0.0, 0.0)]
    want = {(i, j) for i, p in ok for j, q in ok if i < j and km(p, q) <= radius}
    df = spark.createDataFrame(rows + rows[:20] + [(None, 60.0, -135.0, "c")], "k bigint, y double, x double, band string")
    got = [tuple(t) for t in pairs_within(df, key="k", lat="y", lng="x", radius_km=radius, max_cell_rows=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs_within(df.limit(0), key="k", lat="y", lng="x", radius_km=radius).count() == 0


# --- whole queries ----------------------------------------------------------------------------------------------


def names():
    from stratamesh.plans import problems

    return sorted(problems.SQL)


@pytest.mark.parametrize("name", names())
def test_problem_queries_against_sql(spark, sf, name):
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from oracle import compare, connection

    from stratamesh.plans import problems

    assert compare(spark, connection(sf), problems.QUERIES[name], problems.SQL[name], sf) == ""
