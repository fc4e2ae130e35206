"""Validity in time: resolving dates, spans, intervals, change logs, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = "9999-12-31"


def valid_on(date: Column | str, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity: start <= date < end, an end of null is open."""
    date = F.lit(date) if isinstance(date, str) else date
    return (F.col(start) <= date) & (F.col(end).isNull() | (date < F.col(end)))


def resolve_units(rows: DataFrame, date: str, truths: list[str]) -> DataFrame:
    return rows.where(valid_on(date) & F.col("truth").isin(truths))


def intervals(days: DataFrame, day: str) -> DataFrame:
    """Consecutive distinct days as [since, until); the last is open (null)."""
    d = days.select(F.col(day).alias("since")).where("since IS NOT NULL").distinct()
    return d.withColumn("until", F.lead("since").over(Window.orderBy("since")))


def merge_spans(spans: DataFrame, keys: list[str], start: str, end: str, same: list[str], least: str) -> DataFrame:
    """Gaps and islands: neighbouring spans (one ends where the next begins) with equal ``same`` become one, with the
    least of ``least``."""
    w = Window.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last(), *same, least)
    before = lambda c: F.lag(c).over(w)
    joined = before(end).eqNullSafe(F.col(start)) & F.col(start).isNotNull()
    for c in same:
        joined = joined & before(c).eqNullSafe(F.col(c))
    s = spans.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy(*keys, "_island", *same).agg(F.min(start).alias(start), F.max(F.struct(F.coalesce(end, F.lit(OPEN)).alias("k"), F.col(end).alias("e")))["e"].alias(end), F.min(least).alias(least))
    return g.select(*keys, *same, start, end, least)


def row_validity(changes: DataFrame, unit: str, date: str, seq: str, kind: str) -> DataFrame:
    """A change log as rows with the next change's date as end; a dissolve only ends, rows of no length are dropped."""
    w = Window.partitionBy(unit).orderBy(date, seq)
    return changes.withColumn("valid_to", F.lead(date).over(w)).where((F.col(kind) != "dissolve") & (F.col("valid_to").isNull() | (F.col(date) < F.col("valid_to")))).withColumnRenamed(date, "valid_from")


def carried(facts: DataFrame, probes: DataFrame, *, at: str, value: str, keys: list[str], bucket: Column | None = None, inclusive: bool = True, forward: bool = False) -> DataFrame:
    """As-of join by union, sort and carry: each probe with the last ``value`` at or before (``inclusive``) or before
    its time; ``forward`` takes the first at or after. Probes keep their columns. Without ``keys`` a ``bucket`` that
    never falls as time grows (say the decade) spreads the rows; what is carried from bucket to bucket is one row each.
    """
    cols = [c for c in probes.columns if c not in {*keys, at}]
    # ties: facts first where they count, probes first where they do not
    a = facts.select(*keys, at, F.col(value).alias("_v"), F.lit(0 if inclusive else 1).alias("_tie"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in cols]).withColumn("_fact", F.lit(True))
    b = probes.select(*keys, at, F.lit(None).cast(facts.schema[value].dataType).alias("_v"), F.lit(1 if inclusive else 0).alias("_tie"), *cols).withColumn("_fact", F.lit(False))
    rows = a.unionByName(b).withColumn("_b", F.lit(0) if keys or bucket is None else bucket)
    order = F.col(at).desc() if forward else F.col(at).asc()
    by_value = F.col("_v").desc_nulls_last() if forward else F.col("_v").asc_nulls_first()
    w = Window.partitionBy(*keys, "_b").orderBy(order, "_tie", by_value).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("NOT _fact").drop("_v", "_tie", "_fact")
    if keys or bucket is None:
        return near.drop("_b")
    best = F.min_by if forward else F.max_by
    ends = rows.groupBy("_b").agg(best("_v", F.when(F.col("_fact"), F.struct(at, "_v"))).alias("_edge"))
    along = Window.orderBy(F.col("_b").desc() if forward else F.col("_b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = ends.select("_b", F.last("_edge", ignorenulls=True).over(along).alias("_edge"))
    return near.join(edge, "_b").withColumn(value, F.coalesce(value, "_edge")).drop("_b", "_edge")


def interval_overlaps(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str]) -> DataFrame:
    """Pairs of equal ``keys`` whose half-open intervals meet, with their common part as [since, until)."""
    end = lambda c: F.coalesce(F.col(c), F.lit(OPEN))
    j = left.join(right, keys).withColumn("since", F.greatest(l[0], r[0])).withColumn("until", F.least(end(l[1]), end(r[1])))
    return j.where("since < until").withColumn("until", F.when(F.col("until") < OPEN, F.col("until")))


def diff_full_outer(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and the list of changed fields, of ``b`` against ``a``."""
    l = a.select(key, F.struct(*fields).alias("_a"))
    r = b.select(key, F.struct(*fields).alias("_b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    j = l.join(r, key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.select(key, kind.alias("change"), F.when(kind == "changed", F.array_join(changed, ",")).otherwise("").alias("fields")).where("change IS NOT NULL")


def reference_clip(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Validity of an overlay: the later start and the earlier end of the row and of its drawing."""
    return interval_overlaps(rows, other, [key], ("valid_from", "valid_to"), ("ref_from", "ref_to"))
