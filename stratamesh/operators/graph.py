"""Iterative graph operators: components, shortest-path fills, joins of components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.operators.mesh import both_ways
from stratamesh.operators.proximity import EARTH_KM, great_circle_km
from stratamesh.operators.hierarchy import WIDE
from stratamesh.operators.skew import hot_groups, lookup
from stratamesh.session import cut, drop


def _hot(df: DataFrame, key: str, wide: int) -> DataFrame | None:
    return hot_groups(df, [key], wide) if df.count() > wide else None


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "cell", wide: int = WIDE) -> DataFrame:
    """node, component (the least node of it). Contraction: each vertex hooks to its least neighbour if that is smaller,
    hooks are followed to their end by pointer jumping, and the edges between what is left go on; every round at least
    halves the vertices that still have edges. Labels and vertices with over ``wide`` rows are salted, so neither a giant
    component nor a vertex of very many edges is one task. Edges of nodes that are not there, null ends and loops of one
    node count for nothing."""
    own = nodes.select(F.col(node).alias("n")).where("n IS NOT NULL").distinct()
    e = edges.select("u", "v").where("u <> v").join(own.withColumnRenamed("n", "u"), "u", "left_semi").join(own.withColumnRenamed("n", "v"), "v", "left_semi")
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    while e.limit(1).count():
        hook = cut(both_ways(e).groupBy(F.col("u").alias("n")).agg(F.least("n", F.min("v")).alias("to")))
        while True:
            met = lookup(hook, hook.select(F.col("n").alias("to"), F.col("to").alias("end")), "to", _hot(hook, "to", wide), "n")
            far = cut(met.select("n", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("went")))
            drop(hook)
            hook = far.select("n", "to")
            hook._cut = far._cut
            if not far.where("went").limit(1).count():
                break
        maps.append(hook)
        up = lookup(e, hook.select(F.col("n").alias("u"), F.col("to").alias("a")), "u", _hot(e, "u", wide), "v")
        up = lookup(up, hook.select(F.col("n").alias("v"), F.col("to").alias("b")), "v", _hot(e, "v", wide), "u")
        left = cut(up.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        drop(e)
        e = left
    if not maps:
        return own.select(F.col("n").alias(node), F.col("n").alias("component"))
    labels = maps[-1]
    for m in reversed(maps[:-1]):
        found = lookup(m, labels.select(F.col("n").alias("to"), F.col("to").alias("c")), "to", _hot(m, "to", wide), "n")
        labels = found.select("n", F.coalesce("c", "to").alias("to"))
    return own.join(labels, "n", "left").select(F.col("n").alias(node), F.coalesce("to", "n").alias("component"))


def hop_distances(seeds: DataFrame, edges: DataFrame, enough: int | None = None) -> DataFrame:
    """node, seed, dist: nearest seed by edge weights (column ``w``, else 1), ties to the smaller seed. Frontier
    relaxation until no node changes, or until ``enough`` nodes are reached (for edges without weights, whose rings come one
    by one): each round only the nodes improved in the last one send."""
    e = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1))
    e = cut(e.select("u", "v", "w").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    best = cut(seeds.groupBy("node").agg(F.min(F.struct(F.col("dist").alias("dist"), F.col("seed").alias("seed"))).alias("b")))
    front = best
    while True:
        sent = front.join(e, front["node"] == e["u"]).groupBy(F.col("v").alias("node")).agg(F.min(F.struct((F.col("b.dist") + F.col("w")).alias("dist"), F.col("b.seed").alias("seed"))).alias("s"))
        merged = cut(best.join(sent, "node", "full_outer").select("node", F.least("b", "s").alias("b"), (F.col("s").isNotNull() & (F.col("b").isNull() | (F.col("s") < F.col("b")))).alias("new")))
        front, best = merged.where("new").select("node", "b"), merged.select("node", "b")
        if not front.limit(1).count() or (enough is not None and best.count() >= enough):
            break
    return best.select("node", "b.seed", "b.dist")


def tree_walk(links: DataFrame, node: str, parent: str, start: DataFrame, up: bool) -> DataFrame:
    """start, node, steps: from each start node to its ancestors (``up``) or descendants, itself included. One join
    per level over the frontier only; a pair is never sent twice, so loops end."""
    link = links.select(F.col(node if up else parent).alias("_a"), F.col(parent if up else node).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    seen = cut(start.select(F.col(node).alias("start"), F.col(node).alias("node"), F.lit(0).alias("steps")).distinct())
    front = seen
    while True:
        nxt = front.join(link, front["node"] == link["_a"]).select("start", F.col("_b").alias("node"), (F.col("steps") + 1).alias("steps")).join(seen.select("start", "node"), ["start", "node"], "left_anti").distinct()
        nxt = cut(nxt)
        if not nxt.limit(1).count():
            return seen
        seen, front = cut(seen.unionByName(nxt)), nxt


def join_components(nodes: DataFrame, edges: DataFrame, *, node: str, candidates: DataFrame, limit: int = 500_000) -> DataFrame:
    """Edges (u, v, km) that join the components of a graph by their closest pairs, ties by (km, u, v): the least
    spanning forest over the pairs of components. ``candidates`` holds the possible pairs u < v with ``km`` (see
    ``spatial.near_pairs``). The least candidate of each pair of components is found by a grouped minimum; those, at
    most ``limit`` of them (else an error), are linked on the driver."""
    c = connected_components(nodes, edges, node).select(F.col(node).alias("u"), F.col("component").alias("cu"))
    p = candidates.join(c, "u").join(c.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v").where("cu <> cv")
    least = p.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min(F.struct("km", "u", "v")).alias("m"))
    rows = least.select("a", "b", "m.*").orderBy("km", "u", "v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} pairs of components")
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for r in rows:
        x, y = find(r["a"]), find(r["b"])
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((r["u"], r["v"], r["km"]))
    return nodes.sparkSession.createDataFrame(kept, candidates.select("u", "v", "km").schema)


def cross_components(nodes: DataFrame, edges: DataFrame, *, node: str, lon: str = "lon", lat: str = "lat", limit: int = 500_000) -> DataFrame:
    """Edges (u, v, km), u < v, that join all components of a graph into one by their closest pairs, however far apart,
    ties by (km, u, v): the least spanning tree of the components. Nodes without a place are not joined.

    Points are put in buckets of side ``s`` on the unit sphere (chords, so no seam and no pole). The closest pairs of
    components at most ``s`` apart are met in neighbouring buckets and linked on the driver in order (at most ``limit``
    of them, else an error); then the merged components go on with twice the side, until one is left or the side spans
    the sphere. After a round components are over ``s`` apart, so few pairs are near at any side; to find the closest
    points of a pair, boxes of an eighth of the side are compared first and only points of boxes that can hold the
    closest pair are joined."""
    c = connected_components(nodes, edges, node).select(F.col(node).alias("n"), F.col("component").alias("g"))
    a, o = F.radians(lat), F.radians(lon)
    p = nodes.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(node).alias("n"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), (F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z")).join(c, "n")
    p = cut(p)
    spread = p.agg(F.count("n").alias("n"), F.count_distinct("g").alias("g"), *[(F.max(k) - F.min(k)).alias(k) for k in "xyz"]).first()
    left, kept = spread["g"], []
    schema = nodes.select(F.col(node).alias("u"), F.col(node).alias("v"), F.lit(0.0).alias("km")).schema
    if left < 2:
        return nodes.sparkSession.createDataFrame([], schema)
    s = max(1e-7, 2 * max(spread[k] for k in "xyz") / math.sqrt(spread["n"]))
    step = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    box = [f"_{k}" for k in "xyz"]
    sub = [f"_s{k}" for k in "xyz"]
    while left > 1:
        at = p.select("*", *[F.floor(F.col(k) / (s / 8)).alias(f"_s{k}") for k in "xyz"])
        small = at.groupBy("g", *sub).agg(*[f(k).alias(f"{k}{i}") for k in "xyz" for i, f in ((0, F.min), (1, F.max))])
        small = cut(small.select("*", *[F.floor(F.col(k) / 8).alias(b) for k, b in zip(sub, box)]))
        other = small.select([F.col(k).alias(f"{k}_b") if k not in box else F.col(k) for k in small.columns])
        for b in box:
            other = other.withColumn("_d", step).withColumn(b, F.col(b) + F.col("_d")).drop("_d")
        gap = lambda k: F.greatest(F.lit(0.0), F.col(f"{k}0_b") - F.col(f"{k}1"), F.col(f"{k}0") - F.col(f"{k}1_b"))
        far = lambda k: F.greatest(F.col(f"{k}1_b") - F.col(f"{k}0"), F.col(f"{k}1") - F.col(f"{k}0_b"))
        met = small.join(other, box).where("g < g_b").withColumn("low", sum(gap(k) * gap(k) for k in "xyz")).withColumn("high", sum(far(k) * far(k) for k in "xyz"))
        met = cut(met.where(F.col("low") <= s * s * (1 + 1e-9)).select("g", "g_b", *sub, *[f"{k}_b" for k in sub], "low", "high"))
        best = met.groupBy("g", "g_b").agg(F.min("high").alias("least"))
        can = met.join(best, ["g", "g_b"]).where(F.col("low") <= F.col("least") * (1 + 1e-9) + 1e-18).select("g", "g_b", *sub, *[f"{k}_b" for k in sub])
        q = at.select(F.col("g").alias("g_b"), *[F.col(k).alias(f"{k}_b") for k in sub], F.col("n").alias("n2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
        pair = can.join(at.select("g", *sub, "n", "lon", "lat"), ["g", *sub]).join(q, ["g_b", *[f"{k}_b" for k in sub]])
        # the smaller node first, so that a distance does not depend on which component it was met from
        less = F.col("n") < F.col("n2")
        one, two = [[F.when(less, F.col(i)).otherwise(F.col(j)) for i, j in order] for order in ([("lat", "lat2"), ("lon", "lon2")], [("lat2", "lat"), ("lon2", "lon")])]
        pair = pair.select("g", "g_b", great_circle_km(*one, *two).alias("km"), F.least("n", "n2").alias("u"), F.greatest("n", "n2").alias("v"))
        if s < 2:
            pair = pair.where(F.col("km") <= 2 * EARTH_KM * math.asin(min(1.0, s / 2 * (1 - 1e-9))))
        rows = pair.groupBy("g", "g_b").agg(F.min(F.struct("km", "u", "v")).alias("m")).select("g", "g_b", "m.*").orderBy("km", "u", "v").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"over {limit} pairs of components")
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for r in rows:
            x, y = find(r["g"]), find(r["g_b"])
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((r["u"], r["v"], r["km"]))
                left -= 1
        if s >= 2:
            break
        if root:
            into = nodes.sparkSession.createDataFrame([(x, find(x)) for x in root], p.select("g", F.col("g").alias("to")).schema)
            p = cut(p.join(into, "g", "left").select("n", "lon", "lat", "x", "y", "z", F.coalesce("to", "g").alias("g")))
        s *= 2
    return nodes.sparkSession.createDataFrame(kept, schema)
