"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.operators.skew import hot_groups, replicate, salt, small


def _poisson_cdf(rate: float, n: int) -> np.ndarray:
    """P(X <= k) for k = 0..n-1, by logarithms so that large rates do not underflow."""
    k = np.arange(n)
    logs = k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k]) if rate > 0 else np.where(k == 0, 0.0, -np.inf)
    return np.minimum(1.0, np.cumsum(np.exp(logs)))


def capped_rate(mean: float, cap: int) -> float:
    """The Poisson rate at which the counts, cut off at ``cap``, have the given mean; inf if no rate reaches it."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    reached = lambda r: float(np.sum(1 - _poisson_cdf(r, cap)))
    low, high = 0.0, max(1.0, 2 * mean)
    while reached(high) < mean and high < 1e6:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if reached(mid) < mean else (low, mid)
    return (low + high) / 2


def _thresholds(batches):
    """Adds the rate and the thresholds that a uniform number is held against: the count is how many it reaches."""
    for p in batches:
        caps = p["max_repeats"].fillna(0).clip(lower=0).astype(int)
        want = (p["target_tokens"] / p["source_tokens"].where(p["source_tokens"] > 0)).fillna(0.0)
        rates = [capped_rate(m, c) for m, c in zip(want, caps)]
        cuts = [[0.0] * c if math.isinf(r) else _poisson_cdf(r, c).tolist() if r > 0 else [1.0] * c for r, c in zip(rates, caps)]
        yield p.assign(repeat_rate=[float(c) if math.isinf(r) else r for r, c in zip(rates, caps)], cuts=cuts, is_capped=[bool(math.isinf(r)) for r in rates])


def mix_plan(counted: DataFrame, targets: DataFrame, *, source: str, tokens: str) -> DataFrame:
    """One row per row of ``targets`` (``mix_key``, ``source``, ``target_share``, ``max_repeats``, ``size_factor``)
    with the tokens it should and can get and the repetition rate. Documents are summed per source on the map side; a
    single total goes to the driver."""
    have = counted.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    total = have.agg(F.sum("source_tokens")).first()[0] or 0
    t = targets.select("mix_key", "source", "target_share", "max_repeats", "size_factor").distinct().join(have, "source", "left").select(
        "mix_key", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats",
        F.coalesce("source_docs", F.lit(0)).cast("bigint").alias("source_docs"), F.coalesce("source_tokens", F.lit(0)).cast("bigint").alias("source_tokens"),
        (F.coalesce("target_share", F.lit(0.0)) * F.coalesce("size_factor", F.lit(0.0)) * F.lit(float(total))).alias("target_tokens"),
    )
    schema = "mix_key string, source string, target_share double, max_repeats int, source_docs bigint, source_tokens bigint, target_tokens double, repeat_rate double, cuts array<double>, is_capped boolean"
    return t.mapInPandas(_thresholds, schema)


def _uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) from a hash, the same on every run and executor."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def draw_counts(docs: DataFrame, plan: DataFrame, *, key: str, source: str, seed: int = 0) -> DataFrame:
    """Every document of ``docs`` that a mix draws, with ``mix_key`` and ``copies`` >= 1: a Poisson number with the
    mean of its source in the mix, cut off at the most repeats, by inversion of a number hashed from seed, mix and
    key. The plan is broadcast if it is small (counted), else joined on salted sources."""
    p = plan.where("target_share > 0").select(F.col("source").alias(source), "mix_key", "cuts")
    p, n = small(p)
    hot = None if n <= 20_000 else hot_groups(docs.select(source), [source], 1_000_000)
    if hot is not None:
        docs, p = salt(docs, hot, [source], F.col(key)), replicate(p, hot, [source])
    on = [source] if hot is None else [source, "_salt"]
    u = _uniform(F.lit(seed), "mix_key", key)
    return (
        docs.join(p, on)
        .withColumn("_u", u)
        .withColumn("copies", F.size(F.filter("cuts", lambda c: c <= F.col("_u"))))
        .where("copies > 0")
        .drop("_u", "cuts", "_salt")
    )


def draw(docs: DataFrame, plan: DataFrame, *, key: str, source: str, seed: int = 0) -> DataFrame:
    """The mixes themselves: each drawn document once per copy (``copy_no`` from 1), in a random order over the whole
    mix (range shuffle by ``shuffle_key``, a hash of seed, mix, key and copy).

    Defined results: documents without source or of a source without target, and sources with a share or most repeats
    of 0 or null, are not drawn; a source that cannot reach its share has every document at the most repeats; the
    same seed draws the same copies; empty tables give none; other columns pass through.
    """
    c = draw_counts(docs, plan, key=key, source=source, seed=seed)
    copies = c.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    return copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "mix_key", key, "copy_no")).orderBy("mix_key", "shuffle_key")


def mix_shares(counted: DataFrame, plan: DataFrame, *, key: str, source: str, tokens: str, seed: int = 0) -> DataFrame:
    """What each source of each mix really reached: documents, copies, tokens and the share of the mix's tokens."""
    got = draw_counts(counted, plan, key=key, source=source, seed=seed).groupBy("mix_key", F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("drawn_docs"), F.sum("copies").alias("drawn_copies"), F.sum(F.col("copies") * F.col(tokens)).alias("drawn_tokens"), F.max("copies").alias("most_copies")
    )
    zero = F.lit(0).cast("bigint")
    r = plan.drop("cuts").join(got, ["mix_key", "source"], "left").select(
        "mix_key", "source", "target_share", "max_repeats", "source_docs", "source_tokens", "target_tokens", "repeat_rate", "is_capped",
        *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("drawn_docs", "drawn_copies", "drawn_tokens", "most_copies")],
    )
    whole = r.groupBy("mix_key").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    return r.join(whole, "mix_key").withColumn("actual_share", F.coalesce(F.try_divide("drawn_tokens", "mix_tokens"), F.lit(0.0)))
