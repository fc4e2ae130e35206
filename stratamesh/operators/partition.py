"""Contiguous regions of a mesh: seeded growth, bisection and annealing, many runs in parallel.

One run is sequential by nature, so a run is one Arrow group (its scope's cells and edges, which bound it); runs are what
the cluster spreads. The same seed and parameters give the same regions.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("random", "seeded", "balanced", "quota", "lens", "template")


class Mulberry32:
    """Public 32-bit generator, one state word."""

    def __init__(self, seed: int) -> None:
        self.a = seed & 0xFFFFFFFF

    def uint32(self) -> int:
        self.a = (self.a + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.a
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        return (t ^ (t >> 14)) & 0xFFFFFFFF

    def random(self) -> float:
        return self.uint32() / 2**32

    def below(self, n: int) -> int:
        return int(self.random() * n)


class Scope:
    """Cells of one run in order, their neighbours, loads and lens values; pieces of the scope are linked by their
    closest cells so that every cell can be reached."""

    def __init__(self, cells: pd.DataFrame, weights: dict[str, float]) -> None:
        c = cells.sort_values("cell", kind="stable").drop_duplicates("cell")
        self.ids = c["cell"].to_numpy()
        self.lon, self.lat = c["lon"].to_numpy(float), c["lat"].to_numpy(float)
        self.load = np.maximum(0.0, c["load"].fillna(0).to_numpy(float))
        if self.load.sum() == 0:
            self.load = np.ones(len(c))
        x = c["lens"].fillna(0).to_numpy(float)
        self.lens = (x - x.mean()) / x.std() if len(x) and x.std() > 0 else np.zeros(len(x))
        at = {v: k for k, v in enumerate(self.ids)}
        self.near: list[list[int]] = [sorted({at[v] for v in vs if v in at and at[v] != k}) if vs is not None else [] for k, vs in enumerate(c["neighbours"])]
        for u, vs in enumerate(self.near):
            for v in vs:
                if u not in self.near[v]:
                    self.near[v].append(u)
        self.crossings = self._link()
        self.w = {"balance": 1.0, "compactness": 0.2, "lens": 0.0} | weights

    def _pieces(self) -> list[list[int]]:
        seen, out = [False] * len(self.ids), []
        for s in range(len(self.ids)):
            if not seen[s]:
                piece, seen[s] = [s], True
                for u in piece:
                    for v in self.near[u]:
                        if not seen[v]:
                            seen[v] = True
                            piece.append(v)
                out.append(piece)
        return out

    def _link(self) -> list[tuple[int, int]]:
        pieces = sorted(self._pieces(), key=lambda p: (-len(p), p[0]))
        links, main = [], list(pieces[0]) if pieces else []
        for p in pieces[1:]:
            a, b = np.array(main), np.array(p)
            best = (math.inf, 0, 0)
            for u in b:
                d2 = ((self.lon[a] - self.lon[u]) * math.cos(math.radians(self.lat[u]))) ** 2 + (self.lat[a] - self.lat[u]) ** 2
                k = int(np.argmin(d2))
                best = min(best, (float(d2[k]), int(a[k]), int(u)))
            _, u, v = best
            self.near[u].append(v)
            self.near[v].append(u)
            links.append((u, v))
            main += p
        return links


def _seeds(s: Scope, k: int, rng: Mulberry32) -> list[int]:
    """Cells drawn by load without replacement."""
    left, chosen = s.load.copy(), []
    for _ in range(min(k, len(s.ids))):
        left_sum = np.cumsum(left)
        if left_sum[-1] <= 0:
            rest = [i for i in range(len(s.ids)) if i not in chosen]
            pick = rest[rng.below(len(rest))]
        else:
            pick = min(int(np.searchsorted(left_sum, rng.random() * left_sum[-1], side="right")), len(left) - 1)
        chosen.append(pick)
        left[pick] = 0.0
    return chosen


def _grow(s: Scope, seeds: list[int], by_load: bool) -> np.ndarray:
    """Regions grown from seeds: by distance from the seed, or the lightest region first."""
    region, sums, heap = np.full(len(s.ids), -1, np.int64), np.zeros(len(seeds)), []
    for r, u in enumerate(seeds):
        heapq.heappush(heap, (0.0, 0.0, u, r))
    waiting: list[list] = [[] for _ in seeds]
    while heap:
        _, dist, u, r = heapq.heappop(heap)
        if region[u] < 0:
            region[u] = r
            sums[r] += s.load[u]
            for v in s.near[u]:
                if region[v] < 0:
                    step = dist + math.hypot((s.lon[u] - s.lon[v]) * math.cos(math.radians(s.lat[u])), s.lat[u] - s.lat[v])
                    heapq.heappush(waiting[r] if by_load else heap, (step, step, v, r))
        if by_load:
            while waiting[r] and region[waiting[r][0][2]] >= 0:
                heapq.heappop(waiting[r])
            if waiting[r]:
                d, _, v, _ = heapq.heappop(waiting[r])
                heapq.heappush(heap, (sums[r], d, v, r))
    return region


def _bisect(s: Scope, members: np.ndarray, quota: int, first: int, region: np.ndarray, lens: bool) -> None:
    """Halves along the principal axis of place (or of the lens) until each part is one region."""
    if quota <= 1 or len(members) <= 1:
        region[members] = first
        return
    if lens and np.ptp(s.lens[members]) > 0:
        x = s.lens[members]
    else:
        xy = np.stack([s.lon[members] * np.cos(np.radians(s.lat[members])), s.lat[members]])
        xy = xy - xy.mean(1, keepdims=True)
        v = np.ones(2)
        for _ in range(40):
            w = xy @ (xy.T @ v)
            norm = np.linalg.norm(w)
            if norm == 0:
                break
            v = w / norm
        x = v @ xy
    order = members[np.lexsort((s.ids[members], x))]
    small = quota // 2
    sums = np.cumsum(s.load[order])
    cut = int(np.clip(np.searchsorted(sums, sums[-1] * small / quota) + 1, 1, len(order) - 1))
    _bisect(s, order[:cut], small, first, region, lens)
    _bisect(s, order[cut:], quota - small, first + small, region, lens)


def _mend(s: Scope, region: np.ndarray) -> np.ndarray:
    """Gives every piece of a region but its heaviest to the neighbouring region with most of its edges."""
    for _ in range(len(s.ids)):
        seen, pieces = np.zeros(len(region), bool), {}
        for u in range(len(region)):
            if not seen[u]:
                piece, seen[u] = [u], True
                for a in piece:
                    for b in s.near[a]:
                        if not seen[b] and region[b] == region[u]:
                            seen[b] = True
                            piece.append(b)
                pieces.setdefault(int(region[u]), []).append(piece)
        loose = [p for r in pieces for p in sorted(pieces[r], key=lambda p: (-s.load[p].sum(), -len(p), p[0]))[1:]]
        if not loose:
            break
        for p in loose:
            near: dict[int, int] = {}
            for u in p:
                for v in s.near[u]:
                    if region[v] != region[u]:
                        near[int(region[v])] = near.get(int(region[v]), 0) + 1
            if near:
                region[p] = min(near, key=lambda r: (-near[r], r))
    return region


def _keeps(s: Scope, region: np.ndarray, u: int) -> bool:
    """Whether the region of ``u`` stays in one piece without it. Searches from its neighbours take turns, so that a small
    piece is walked once and a large one no farther; searches that meet go on as one."""
    r, near = region[u], s.near
    mine = [v for v in near[u] if region[v] == r]
    if len(mine) <= 1:
        return bool(mine)
    by = {v: k for k, v in enumerate(mine)}
    by[u] = -1
    root, queues, heads = list(range(len(mine))), [[v] for v in mine], [0] * len(mine)
    open_ = list(root)
    while True:
        for k in list(open_):
            if root[k] != k:
                continue
            if heads[k] == len(queues[k]):
                return False
            x = queues[k][heads[k]]
            heads[k] += 1
            for v in near[x]:
                if region[v] == r:
                    j = by.get(v)
                    if j is None:
                        by[v] = k
                        queues[k].append(v)
                    elif j >= 0 and root[j] != k:
                        j = root[j]
                        queues[k] += queues[j][heads[j] :]
                        root = [k if i == j else i for i in root]
                        open_.remove(j)
                        if len(open_) == 1:
                            return True


def _anneal(s: Scope, region: np.ndarray, k: int, rng: Mulberry32, moves: int, plateau: int) -> np.ndarray:
    """Moves boundary cells; accepts what lowers the cost and, by chance, what raises it a little. In its cooler half it
    stops once ``plateau`` moves have brought no new best cost (looked at every 5,000 moves)."""
    # plain lists, as single numbers are read and written all the time
    load, count = np.bincount(region, s.load, k).tolist(), np.bincount(region, minlength=k).tolist()
    lens, target = np.bincount(region, s.lens, k).tolist(), float(s.load.sum()) / k
    loads, values, region = s.load.tolist(), s.lens.tolist(), region.tolist()
    edge = [u for u in range(len(region)) if any(region[v] != region[u] for v in s.near[u])]
    place = {u: i for i, u in enumerate(edge)}
    edges = max(1, sum(map(len, s.near)) // 2)
    total = max(1e-12, float(np.sum(s.lens**2)))

    def delta(u: int, b: int) -> float:
        a, x = region[u], loads[u]
        bal = ((load[a] - x - target) ** 2 + (load[b] + x - target) ** 2 - (load[a] - target) ** 2 - (load[b] - target) ** 2) / target**2 / k
        cut = sum((region[v] != b) - (region[v] != a) for v in s.near[u]) / edges
        between = lambda total_, n: total_**2 / n if n else 0.0
        y = values[u]
        spread = -(between(lens[a] - y, count[a] - 1) + between(lens[b] + y, count[b] + 1) - between(lens[a], count[a]) - between(lens[b], count[b])) / total
        return s.w["balance"] * bal + s.w["compactness"] * cut + s.w["lens"] * spread

    def propose() -> tuple[int, int] | None:
        if not edge:
            return None
        u = edge[rng.below(len(edge))]
        others = sorted({region[v] for v in s.near[u]} - {region[u]})
        return u, others[rng.below(len(others))]

    sample = [abs(delta(*p)) for p in (propose() for _ in range(400)) if p]
    t0 = 0.02 * (sum(sample) / len(sample) if sample else 0.0)
    cost = best = 0.0
    last = 0
    for i in range(moves):
        if i and i % 5_000 == 0 and 2 * i > moves and i - last > plateau:
            break
        p, chance = propose(), rng.random()
        if p is None or count[region[p[0]]] <= 1:
            continue
        u, b = p
        change = delta(u, b)
        t = t0 * (1 - 0.999 * i / moves)
        if (change <= 0 or (t > 0 and chance < math.exp(-change / t))) and _keeps(s, region, u):
            a = region[u]
            load[a], load[b], lens[a], lens[b] = load[a] - loads[u], load[b] + loads[u], lens[a] - values[u], lens[b] + values[u]
            count[a], count[b] = count[a] - 1, count[b] + 1
            region[u] = b
            for w in (u, *s.near[u]):
                if any(region[v] != region[w] for v in s.near[w]):
                    if w not in place:
                        place[w] = len(edge)
                        edge.append(w)
                elif w in place:
                    at, end = place.pop(w), edge.pop()
                    if end != w:
                        edge[at], place[end] = end, at
            cost += change
            if cost < best - 1e-12:
                best, last = cost, i
    return np.array(region, np.int64)


def solve(cells: pd.DataFrame, *, n: int, method: str, seed: int, moves: int = 0, weights: dict[str, float] | None = None, plateau: int = 50_000) -> pd.DataFrame:
    """cell, region of one run. ``cells``: cell, lon, lat, load, lens, neighbours and, for method template, region0."""
    s, rng = Scope(cells, weights or {}), Mulberry32(seed)
    if not len(s.ids):
        return pd.DataFrame({"cell": s.ids, "region": np.empty(0, np.int32)})
    n = max(1, min(n, len(s.ids)))
    if method == "template":
        given = cells.sort_values("cell", kind="stable").drop_duplicates("cell")["region0"].fillna(-1).to_numpy(int)
        region = np.where(given >= 0, given, 0)
        n = int(region.max()) + 1
    elif method in ("quota", "lens"):
        region = np.zeros(len(s.ids), np.int64)
        _bisect(s, np.arange(len(s.ids)), n, 0, region, method == "lens")
        region = _mend(s, region)
    else:
        seeds = _seeds(s, n, rng) if method != "random" else [int(x) for x in sorted(range(len(s.ids)), key=lambda _: rng.random())[:n]]
        region = _grow(s, seeds, method == "balanced")
    if moves:
        region = _anneal(s, region, n, rng, moves, plateau)
    return pd.DataFrame({"cell": s.ids, "region": region.astype(np.int32)})


def solve_runs(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, cell, region of every row of ``runs`` (run_id, scope, n, method, seed, moves) over the cells of its
    ``scope`` (``cells`` has scope, cell, lon, lat, load, lens, neighbours; region0 is optional)."""
    c = cells if "region0" in cells.columns else cells.withColumn("region0", F.lit(None).cast("int"))
    j = runs.join(c, "scope")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        out = solve(pdf, n=int(r["n"]), method=str(r["method"]), seed=int(r["seed"]), moves=int(r["moves"]))
        out.insert(0, "run_id", r["run_id"])
        return out

    return j.groupBy("run_id").applyInPandas(one, "run_id string, cell bigint, region int")
