"""Geometry expressions evaluated on sets of cells, and greedy finishing steps on few regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.operators.spatial import nearest
from stratamesh.operators.temporal import valid_on

Expr = dict | str | list


class CellSets:
    """Evaluates expressions to DataFrames of one column ``cell``. Each operator is a plan over the mesh; equal parts of
    an expression are planned once. ``units`` maps unit ids to (valid_from, valid_to, key) rows with ``cell_key``."""

    def __init__(self, cells: DataFrame, places: DataFrame, units: DataFrame | None = None) -> None:
        self.cells, self.places, self.units = cells, places, units
        self.seen: dict[str, DataFrame] = {}
        self.operators: dict[str, Callable[[Expr], DataFrame]] = {
            "all": lambda _: cells, "box": self._box, "province": lambda p: cells.where(F.col("province").isin(p if isinstance(p, list) else [p])), "buffer": self._buffer,
            "north_of": lambda y: cells.where(F.col("lat") >= y), "near_posts": self._buffer, "union": self._union, "intersect": self._intersect, "minus": self._minus, "unit": self._unit, "zone": self._zone,
        }

    def __call__(self, expr: Expr) -> DataFrame:
        key = repr(expr)
        if key not in self.seen:
            if isinstance(expr, str):
                expr = {expr: None}
            (name, arg), = expr.items()
            if name not in self.operators:
                raise ValueError(f"unknown operator {name}")
            self.seen[key] = self.operators[name](arg).select("cell").distinct()
        return self.seen[key]

    def _box(self, b) -> DataFrame:
        x0, y0, x1, y1 = b
        return self.cells.where((F.col("lon") >= x0) & (F.col("lon") < x1) & (F.col("lat") >= y0) & (F.col("lat") < y1))

    def _buffer(self, a) -> DataFrame:
        p = self.places.where(F.col("population") >= a["people"]).select("place_key", F.col("lng").alias("tlon"), F.col("lat").alias("tlat"))
        return nearest(self.cells.select("cell", "lon", "lat"), p, point="cell", target="place_key", within=float(a["degrees"]))

    def _zone(self, a) -> DataFrame:
        return self.cells.where(F.col(a["layer"]) == a["value"])

    def _union(self, parts) -> DataFrame:
        sets = [self(p) for p in parts]
        for s in sets[1:]:
            sets[0] = sets[0].unionByName(s)
        return sets[0]

    def _intersect(self, parts) -> DataFrame:
        first, *rest = [self(p) for p in parts]
        for s in rest:
            first = first.join(s, "cell", "left_semi")
        return first

    def _minus(self, parts) -> DataFrame:
        first, *rest = [self(p) for p in parts]
        for s in rest:
            first = first.join(s, "cell", "left_anti")
        return first

    def _unit(self, a) -> DataFrame:
        u = self.units.where((F.col("unit_id") == a["id"]) & valid_on(a["at"]))
        return self.cells.join(u.select("cell_key").distinct(), self.cells["cd"] == F.col("cell_key"), "left_semi")


def greedy_colours(neighbours: DataFrame, colours: int = 8, limit: int = 100_000) -> DataFrame:
    """region, colour: in order of region, the least used colour that no coloured neighbour has. ``neighbours``: a, b.
    Regions are few; at most ``limit`` pairs (else an error) are walked on the driver."""
    rows = neighbours.select("a", "b").distinct().orderBy("a", "b").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} pairs")
    near: dict[int, set[int]] = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    used, colour = [0] * colours, {}
    for r in sorted(near):
        taken = {colour[n] for n in near[r] if n in colour}
        free = [c for c in range(colours) if c not in taken] or list(range(colours))
        colour[r] = min(free, key=lambda c: (used[c], c))
        used[colour[r]] += 1
    return neighbours.sparkSession.createDataFrame(sorted(colour.items()), "region int, colour int")


def unique_names(candidates: DataFrame, limit: int = 100_000) -> DataFrame:
    """region, name: regions in order of ``weight`` (largest first) take the first of their candidate names (by
    ``place``) that is not taken, else their first with a number."""
    rows = candidates.select("region", "weight", "place", "name").orderBy(F.col("weight").desc(), "region", "place").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} candidates")
    by: dict[int, list[str]] = {}
    for r in rows:
        by.setdefault(r["region"], []).append(r["name"])
    taken: set[str] = set()
    out = []
    for region, names in by.items():
        name = next((n for n in names if n not in taken), None)
        k = 2
        while name is None or name in taken:
            name, k = f"{names[0]} {k}", k + 1
        taken.add(name)
        out.append((region, name))
    return candidates.sparkSession.createDataFrame(out, "region int, name string")


def merge_short(runs: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Runs (``pos``, ``kind``, ``km``) of each key in order: a run shorter than ``least`` joins the one before it, equal
    neighbours become one. A fold over the sorted array of a key's runs."""
    one = lambda kind, km: F.struct(kind.alias("kind"), km.alias("km"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one(last["kind"], last["km"] + x["km"])))
        fold = (F.size(acc) > 0) & ((x["km"] < least) | F.coalesce(F.try_element_at(acc, F.lit(-1))["kind"] == x["kind"], F.lit(False)))
        return F.when(fold, joined).otherwise(F.concat(acc, F.array(one(x["kind"], x["km"]))))

    g = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "km"))).alias("a"))
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,km:double>>")
    return g.select(*keys, F.posexplode(F.aggregate("a", none, step)).alias("pos", "r")).select(*keys, "pos", "r.kind", "r.km")
