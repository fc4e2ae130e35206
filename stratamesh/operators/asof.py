"""As-of joins: attributes as they were valid and known at an event's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.operators.skew import hot_groups, replicate, salt


def as_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    keys: list[str],
    event_id: str,
    event_date: str,
    observed_at: str,
    version_id: str,
    valid_from: str,
    valid_to: str,
    recorded_at: str,
    max_group_rows: int = 1_000_000,
) -> DataFrame:
    """``event_id`` and ``version_id`` of each event that has a version: of the versions of the same ``keys`` valid on
    the event's date and recorded no later than the event was observed, the one recorded last (greater id on a tie).

    Method: versions are cut at the entity's own validity bounds, events and version pieces are unioned and sorted, the
    segment of an event is carried forward by date, then within the segment the last version is carried forward by
    availability time, versions before events on the same instant. Both passes use one shuffle on the entity. Events
    never meet each other, so an entity with over ``max_group_rows`` events is salted by event and its few versions
    are given to every piece.

    Defined results: events with a null key, date or observation time, and versions with a null key, start or record
    time or an empty validity, match nothing; repeated rows count once; dates are ISO text or dates; an empty side
    gives no rows; other columns are not read.
    """
    k = [f"k{i}" for i in range(len(keys))]
    known = " AND ".join(f"{c} IS NOT NULL" for c in k)
    e = events.select(
        *[F.col(c).alias(a) for c, a in zip(keys, k)],
        F.expr(f"try_cast(`{event_date}` AS date)").alias("d"),
        F.col(observed_at).alias("at"),
        F.col(event_id).alias("eid"),
    ).where(f"{known} AND d IS NOT NULL AND at IS NOT NULL AND eid IS NOT NULL")
    v = (
        versions.select(
            *[F.col(c).alias(a) for c, a in zip(keys, k)],
            F.expr(f"try_cast(`{valid_from}` AS date)").alias("f"),
            F.expr(f"try_cast(`{valid_to}` AS date)").alias("t"),
            F.col(recorded_at).alias("at"),
            F.col(version_id).alias("vid"),
        )
        .where(f"{known} AND f IS NOT NULL AND (t IS NULL OR f < t) AND at IS NOT NULL AND vid IS NOT NULL")
        .distinct()
    )
    bounds = v.select(*k, F.explode(F.array("f", "t")).alias("b")).where("b IS NOT NULL").groupBy(*k).agg(F.sort_array(F.collect_set("b")).alias("bs"))
    covered = F.filter("bs", lambda b: (b >= F.col("f")) & (F.col("t").isNull() | (b < F.col("t"))))
    pieces = v.join(bounds, k).select(*k, F.explode(covered).alias("d"), "at", "vid").unionByName(
        bounds.select(*k, F.explode("bs").alias("d")), allowMissingColumns=True
    )
    hot = hot_groups(e.select(*k), k, max_group_rows)
    rows = (
        replicate(pieces, hot, k)
        .select(*k, "_salt", "d", "at", F.col("d").alias("b"), "vid", F.lit(None).cast(e.schema["eid"].dataType).alias("eid"))
        .unionByName(salt(e, hot, k, F.col("eid")).select(*k, "_salt", "d", "at", F.lit(None).cast("date").alias("b"), F.lit(None).cast(v.schema["vid"].dataType).alias("vid"), "eid"))
    )
    by_date = Window.partitionBy(*k, "_salt").orderBy("d", F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    in_segment = Window.partitionBy(*k, "_salt", "seg").orderBy("at", F.col("eid").isNotNull(), "vid", "eid")
    return (
        rows.withColumn("seg", F.last("b", ignorenulls=True).over(by_date))
        .where("seg IS NOT NULL")
        .withColumn("known", F.last("vid", ignorenulls=True).over(in_segment.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.lag("eid").over(in_segment))
        .where("eid IS NOT NULL AND known IS NOT NULL AND NOT (eid <=> before)")
        .select(F.col("eid").alias(event_id), F.col("known").alias(version_id))
    )
