"""Queries on validity in time: unit rows, events and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamesh.functions import scalar as S
from stratamesh.operators import replay as R
from stratamesh.operators import temporal as T
from stratamesh.plans import carrier as C
from stratamesh.plans.registry import Registry
from stratamesh.session import table

query = Registry()
DAY = "1850-01-01"
def _decade() -> Column:
    return F.expr("substring(at, 1, 3)")

_VALID = f"valid_from <= '{DAY}' AND (valid_to IS NULL OR '{DAY}' < valid_to)"


@query(f"SELECT DISTINCT unit_row_key, unit_id, truth, name FROM unit_rows WHERE {_VALID} AND truth IN ('dejure', 'disputed')")
def resolve_units(spark: SparkSession, d: str) -> DataFrame:
    return T.resolve_units(C.unit_rows(spark, d), DAY, ["dejure", "disputed"]).select("unit_row_key", "unit_id", "truth", "name")


@query(f"SELECT DISTINCT geometry_ref, min(valid_from) AS since FROM unit_rows WHERE {_VALID} GROUP BY geometry_ref")
def resolve_references(spark: SparkSession, d: str) -> DataFrame:
    return C.unit_rows(spark, d).where(T.valid_on(DAY)).groupBy("geometry_ref").agg(F.min("valid_from").alias("since"))


@query(f"SELECT DISTINCT unit_row_key, unit_id FROM unit_rows WHERE {_VALID} AND truth = 'dejure'")
def active_rows(spark: SparkSession, d: str) -> DataFrame:
    return T.resolve_units(C.unit_rows(spark, d), DAY, ["dejure"]).select("unit_row_key", "unit_id").orderBy("unit_id", "unit_row_key")


@query("SELECT unit_id, unit_row_key, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY valid_from, unit_row_key) AS INTEGER) AS place FROM (SELECT DISTINCT unit_id, unit_row_key, valid_from FROM unit_rows)")
def unit_history(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every unit, oldest first."""
    return C.unit_rows(spark, d).select("unit_id", "unit_row_key", F.row_number().over(Window.partitionBy("unit_id").orderBy("valid_from", "unit_row_key")).alias("place"))


@query("SELECT unit_id, bool_or(CAST(valid_from[:4] AS INT) <= 1850 AND (valid_to IS NULL OR 1850 < CAST(valid_to[:4] AS INT))) AS is_open FROM unit_rows GROUP BY unit_id")
def open_in_year(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of a unit's periods, held as an array, is open in a year."""
    p = C.unit_rows(spark, d).groupBy("unit_id").agg(F.collect_list(F.struct(S.date_to_year(F.col("valid_from")).alias("a"), S.date_to_year(F.col("valid_to")).alias("b"))).alias("periods"))
    return p.select("unit_id", F.exists("periods", lambda x: (x["a"] <= 1850) & (x["b"].isNull() | (F.lit(1850) < x["b"]))).alias("is_open"))


@query("""SELECT event_key, (SELECT max(day) FROM (SELECT DISTINCT event_date AS day FROM unit_events WHERE event_kind <> 'check') WHERE day <= strftime(p.observed_at - INTERVAL 170 YEAR, '%Y-%m-%d')) AS day
FROM (SELECT DISTINCT event_key, observed_at FROM unit_events WHERE event_kind = 'check') p""")
def asof_event(spark: SparkSession, d: str) -> DataFrame:
    """The current event of each probe date: the latest on or before it."""
    probes = table(spark, d, "unit_events").where("event_kind = 'check'").select("event_key", F.date_format(F.col("observed_at") - F.expr("INTERVAL 170 YEARS"), "yyyy-MM-dd").alias("at")).distinct()
    days = C.event_days(spark, d).select(F.col("day").alias("at"), "day").distinct()
    return T.carried(days, probes, at="at", value="day", keys=[], bucket=_decade()).select("event_key", "day")


@query("""WITH days AS (SELECT DISTINCT event_date AS day FROM unit_events WHERE event_kind <> 'check' AND event_date IS NOT NULL), probes AS (SELECT DISTINCT valid_from AS at_day FROM unit_rows)
SELECT at_day, (SELECT min(day) FROM days WHERE day > at_day) AS next_day, (SELECT max(day) FROM days WHERE day < at_day) AS previous_day FROM probes""")
def asof_next_prev(spark: SparkSession, d: str) -> DataFrame:
    days = C.event_days(spark, d).select(F.col("day").alias("at"), "day").distinct()
    probes = C.unit_rows(spark, d).select(F.col("valid_from").alias("at"), F.col("valid_from").alias("at_day")).distinct()
    nxt = T.carried(days, probes, at="at", value="day", keys=[], bucket=_decade(), inclusive=False, forward=True).select("at_day", F.col("day").alias("next_day"))
    return nxt.join(T.carried(days, probes, at="at", value="day", keys=[], bucket=_decade(), inclusive=False).select("at_day", F.col("day").alias("previous_day")), "at_day")


@query("SELECT day AS since, lead(day) OVER (ORDER BY day) AS until FROM (SELECT DISTINCT event_date AS day FROM unit_events WHERE event_kind <> 'check' AND event_date IS NOT NULL)")
def intervals(spark: SparkSession, d: str) -> DataFrame:
    return T.intervals(C.event_days(spark, d), "day")


_SPANS = "SELECT DISTINCT unit_id, truth, sovereign, status, valid_from, valid_to, coalesce(confidence, 1.0) AS share FROM unit_rows WHERE valid_to IS NULL OR valid_from < valid_to"


@query(f"""WITH spans AS ({_SPANS}), flagged AS (
  SELECT *, CASE WHEN lag(valid_to) OVER w = valid_from AND lag(sovereign) OVER w IS NOT DISTINCT FROM sovereign AND lag(status) OVER w IS NOT DISTINCT FROM status THEN 0 ELSE 1 END AS fresh
  FROM spans WINDOW w AS (PARTITION BY unit_id, truth ORDER BY valid_from, valid_to NULLS LAST, sovereign, status, share)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY unit_id, truth ORDER BY valid_from, valid_to NULLS LAST, sovereign, status, share ROWS UNBOUNDED PRECEDING) AS island FROM flagged)
SELECT unit_id, truth, sovereign, status, min(valid_from) AS valid_from, nullif(max(coalesce(valid_to, '9999-12-31')), '9999-12-31') AS valid_to, min(share) AS share
FROM islands GROUP BY unit_id, truth, island, sovereign, status""")
def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "unit_rows").where("valid_to IS NULL OR valid_from < valid_to").select("unit_id", "truth", "sovereign", "status", "valid_from", "valid_to", F.coalesce("confidence", F.lit(1.0)).alias("share")).distinct()
    return T.merge_spans(spans, ["unit_id", "truth"], "valid_from", "valid_to", ["sovereign", "status"], "share")


_LATEST = "SELECT * FROM unit_changes WHERE event_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY recorded_at DESC) = 1"


def latest_changes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "unit_changes").groupBy("change_id").agg(F.max_by(F.struct("unit_id", "event_date", "kind", "name", "status", "sovereign", "capital", "scenario_id"), "recorded_at").alias("x"))
    return t.select("change_id", "x.*").where("event_date IS NOT NULL")


@query(f"""WITH latest AS (SELECT * FROM unit_changes QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY recorded_at DESC) = 1)
SELECT unit_id, change_id, event_date AS valid_from, valid_to FROM (SELECT *, lead(event_date) OVER (PARTITION BY unit_id ORDER BY event_date, change_id) AS valid_to FROM latest WHERE event_date IS NOT NULL)
WHERE kind <> 'dissolve' AND (valid_to IS NULL OR event_date < valid_to)""")
def row_validity(spark: SparkSession, d: str) -> DataFrame:
    return T.row_validity(latest_changes(spark, d), "unit_id", "event_date", "change_id", "kind").select("unit_id", "change_id", "valid_from", "valid_to")


@query("""WITH latest AS (SELECT * FROM unit_changes QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY recorded_at DESC) = 1), e AS (
  SELECT *, coalesce(last_value(CASE kind WHEN 'create' THEN true WHEN 'dissolve' THEN false END IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY event_date, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before
  FROM latest WHERE event_date IS NOT NULL)
SELECT change_id, unit_id, CASE WHEN kind = 'create' AND before THEN 'exists already' WHEN kind <> 'create' AND NOT before THEN 'does not exist' ELSE 'ok' END AS verdict FROM e""")
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    return R.event_fold(latest_changes(spark, d), unit="unit_id", date="event_date", seq="change_id", kind="kind").select("change_id", "unit_id", "verdict")


@query("""WITH r AS (SELECT DISTINCT unit_row_key, unit_id, valid_from, valid_to FROM unit_rows WHERE truth = 'dejure'), s AS (SELECT DISTINCT unit_row_key AS ref_key, unit_id, valid_from, valid_to FROM unit_rows WHERE truth <> 'dejure')
SELECT unit_row_key, ref_key, greatest(r.valid_from, s.valid_from) AS since, nullif(least(coalesce(r.valid_to, '9999-12-31'), coalesce(s.valid_to, '9999-12-31')), '9999-12-31') AS until
FROM r JOIN s USING (unit_id) WHERE greatest(r.valid_from, s.valid_from) < least(coalesce(r.valid_to, '9999-12-31'), coalesce(s.valid_to, '9999-12-31'))""")
def reference_clip(spark: SparkSession, d: str) -> DataFrame:
    r = C.unit_rows(spark, d)
    a = r.where("truth = 'dejure'").select("unit_row_key", "unit_id", "valid_from", "valid_to")
    b = r.where("truth <> 'dejure'").select(F.col("unit_row_key").alias("ref_key"), "unit_id", F.col("valid_from").alias("ref_from"), F.col("valid_to").alias("ref_to"))
    return T.reference_clip(a, b, "unit_id").select("unit_row_key", "ref_key", "since", "until")


def _at(layer: str, day: str) -> str:
    return f"SELECT DISTINCT unit_id, name, status, sovereign, capital FROM unit_rows WHERE truth = '{layer}' AND valid_from <= '{day}' AND (valid_to IS NULL OR '{day}' < valid_to) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY valid_from DESC, unit_row_key DESC) = 1"


def state_at(spark: SparkSession, d: str, day: str, truth: str) -> DataFrame:
    w = Window.partitionBy("unit_id").orderBy(F.col("valid_from").desc(), F.col("unit_row_key").desc())
    return T.resolve_units(C.unit_rows(spark, d), day, [truth]).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("unit_id", "name", "status", "sovereign", "capital")


@query(f"""WITH a AS ({_at('dejure', '1820-01-01')}), b AS ({_at('dejure', '1860-01-01')}), j AS (
  SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, CASE WHEN a.unit_id IS NULL THEN 'added' WHEN b.unit_id IS NULL THEN 'removed' END AS k,
    array_to_string(list_filter([CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.sovereign IS DISTINCT FROM b.sovereign THEN 'sovereign' END, CASE WHEN a.capital IS DISTINCT FROM b.capital THEN 'capital' END], lambda x: x IS NOT NULL), ',') AS f
  FROM a FULL JOIN b ON a.unit_id = b.unit_id)
SELECT unit_id, coalesce(k, 'changed') AS change, CASE WHEN k IS NULL THEN f ELSE '' END AS fields FROM j WHERE k IS NOT NULL OR f <> ''""")
def diff_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return T.diff_full_outer(state_at(spark, d, "1820-01-01", "dejure"), state_at(spark, d, "1860-01-01", "dejure"), "unit_id", ["name", "status", "sovereign", "capital"])


@query(f"""WITH v AS (SELECT DISTINCT unit_id, geometry_ref, sovereign, truth FROM unit_rows WHERE {_VALID})
SELECT DISTINCT a.unit_id, b.sovereign AS claimant FROM v a JOIN v b ON a.status_key = b.status_key AND a.unit_id <> b.unit_id WHERE a.truth = 'disputed' AND b.truth = 'disputed' AND b.sovereign IS NOT NULL""".replace("SELECT DISTINCT unit_id, geometry_ref, sovereign, truth", "SELECT DISTINCT unit_id, status AS status_key, sovereign, truth"))
def other_claimants(spark: SparkSession, d: str) -> DataFrame:
    """Sovereigns of other disputed units of the same kind on a date."""
    v = C.unit_rows(spark, d).where(T.valid_on(DAY) & (F.col("truth") == "disputed")).select("unit_id", "status", "sovereign").distinct()
    other = v.select("status", F.col("unit_id").alias("other"), F.col("sovereign").alias("claimant"))
    return v.join(other, "status").where("unit_id <> other AND claimant IS NOT NULL").select("unit_id", "claimant").distinct()


@query("""WITH days AS (SELECT DISTINCT event_date AS day FROM unit_events WHERE event_kind <> 'check' AND event_date IS NOT NULL), sk AS (SELECT DISTINCT event_key, event_date FROM unit_events WHERE event_kind = 'check' AND event_date IS NOT NULL)
SELECT event_key, (SELECT max(day) FROM days WHERE day <= event_date) AS since FROM sk WHERE event_date <= '1850-01-01'""")
def skipped_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Checks up to a date with the event window they fall in."""
    probes = table(spark, d, "unit_events").where("event_kind = 'check' AND event_date <= '1850-01-01'").select("event_key", F.col("event_date").alias("at")).distinct()
    days = C.event_days(spark, d).select(F.col("day").alias("at"), F.col("day").alias("since")).distinct()
    return T.carried(days, probes, at="at", value="since", keys=[], bucket=_decade()).select("event_key", "since")


@query("SELECT DISTINCT sovereign FROM unit_rows WHERE sovereign IS NOT NULL")
def sovereign_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unit_rows").select("sovereign").where("sovereign IS NOT NULL").distinct().orderBy("sovereign")


@query("SELECT DISTINCT event_date AS day FROM unit_events WHERE event_kind <> 'check' AND event_date IS NOT NULL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.event_days(spark, d).select("day").distinct().orderBy("day")


@query("""WITH g AS (SELECT DISTINCT unit_row_key, coalesce(name, '') || '|' || coalesce(sovereign, '') AS shape, geometry_ref FROM unit_rows)
SELECT g.unit_row_key, sha256(shape) AS shape_key, first_value(geometry_ref) OVER (PARTITION BY shape ORDER BY unit_row_key) AS shared_ref FROM g""")
def dedupe_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Equal shapes share the reference of their first user."""
    g = C.unit_rows(spark, d).select("unit_row_key", F.concat(F.coalesce("name", F.lit("")), F.lit("|"), F.coalesce("sovereign", F.lit(""))).alias("shape"), "geometry_ref")
    return g.select("unit_row_key", F.sha2("shape", 256).alias("shape_key"), F.first("geometry_ref").over(Window.partitionBy("shape").orderBy("unit_row_key").rowsBetween(Window.unboundedPreceding, 0)).alias("shared_ref"))


@query("""WITH r AS (SELECT DISTINCT unit_row_key, unit_id, truth, valid_from, valid_to FROM unit_rows)
SELECT DISTINCT a.unit_row_key AS row_a, b.unit_row_key AS row_b FROM r a JOIN r b ON a.unit_id = b.unit_id AND a.truth = b.truth AND a.unit_row_key < b.unit_row_key
WHERE greatest(a.valid_from, b.valid_from) < least(coalesce(a.valid_to, '9999-12-31'), coalesce(b.valid_to, '9999-12-31'))""")
def atlas_validate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one unit and layer whose validity overlaps."""
    r = C.unit_rows(spark, d)
    a = r.select(F.col("unit_row_key").alias("row_a"), "unit_id", "truth", "valid_from", "valid_to")
    b = r.select(F.col("unit_row_key").alias("row_b"), "unit_id", "truth", F.col("valid_from").alias("f"), F.col("valid_to").alias("t"))
    return T.interval_overlaps(a, b, ["unit_id", "truth"], ("valid_from", "valid_to"), ("f", "t")).where("row_a < row_b").select("row_a", "row_b").distinct()


@query("""WITH days AS (SELECT DISTINCT event_date AS day FROM unit_events WHERE event_kind = 'create' AND event_date IS NOT NULL), r AS (SELECT DISTINCT unit_row_key, unit_id, valid_from, valid_to FROM unit_rows WHERE truth = 'dejure')
SELECT day, unit_id, count(*) AS n_rows FROM days JOIN r ON valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY day, unit_id HAVING count(*) > 1""")
def scenario_check(spark: SparkSession, d: str) -> DataFrame:
    """No unit twice on a date: units with several valid rows on an event date. The days meet the rows through
    decades, so that the range condition has an equi-key."""
    days = C.event_days(spark, d).where("event_kind = 'create'").select("day").distinct().withColumn("decade", F.floor(S.date_to_year(F.col("day")) / 10))
    r = C.unit_rows(spark, d).where("truth = 'dejure'").select("unit_row_key", "unit_id", "valid_from", "valid_to")
    last = F.coalesce(S.date_to_year(F.col("valid_to")), F.lit(days.agg(F.max("day")).first()[0] or "1000").substr(1, 4).cast("int"))
    first = S.date_to_year(F.col("valid_from"))
    r = r.where(last >= first).withColumn("decade", F.explode(F.sequence(F.floor(first / 10), F.floor(last / 10))))
    return days.join(r, "decade").where(T.valid_on(F.col("day"))).groupBy("day", "unit_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


@query("""WITH days AS (SELECT DISTINCT event_date AS day FROM unit_events WHERE event_kind = 'create' AND event_date IS NOT NULL), iv AS (SELECT day AS since, coalesce(lead(day) OVER (ORDER BY day), '9999-12-31') AS until FROM days),
r AS (SELECT DISTINCT unit_row_key, unit_id, sovereign, confidence, valid_from, coalesce(valid_to, '9999-12-31') AS valid_to FROM unit_rows WHERE truth = 'dejure')
SELECT since, unit_id, unit_row_key FROM iv JOIN r ON valid_from < until AND since < valid_to
QUALIFY row_number() OVER (PARTITION BY since, unit_id ORDER BY datediff('day', CAST(greatest(since, valid_from) AS DATE), CAST(least(until, valid_to) AS DATE)) DESC, unit_row_key) = 1""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """For each interval between events and each unit, the row that covers most of it (ties: smaller key)."""
    iv = T.intervals(C.event_days(spark, d).where("event_kind = 'create'"), "day").withColumn("until", F.coalesce("until", F.lit(T.OPEN)))
    r = C.unit_rows(spark, d).where("truth = 'dejure'").select("unit_row_key", "unit_id", "valid_from", F.coalesce("valid_to", F.lit(T.OPEN)).alias("valid_to"))
    top = S.date_to_year(F.lit(iv.agg(F.max("since")).first()[0] or "1000-01-01"))
    decades = lambda a, b: F.explode(F.sequence(F.floor(S.date_to_year(a) / 10), F.floor(F.greatest(S.date_to_year(a), F.least(S.date_to_year(b), top + 10)) / 10)))
    j = iv.withColumn("k", decades(F.col("since"), F.col("until"))).join(r.withColumn("k", decades(F.col("valid_from"), F.col("valid_to"))), "k").where("valid_from < until AND since < valid_to").drop("k").distinct()
    days = F.datediff(F.least("until", "valid_to").cast("date"), F.greatest("since", "valid_from").cast("date"))
    w = Window.partitionBy("since", "unit_id").orderBy(days.desc(), "unit_row_key")
    return j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("since", "unit_id", "unit_row_key")


@query("""SELECT unit_row_key, lpad(CAST(CAST(valid_from[:4] AS INT) AS VARCHAR), 4, '0') || '-01-01' AS year_start, CAST(valid_from[:4] AS INT) AS year, strftime(CAST(valid_from AS DATE), '%-d %b %Y') AS long_date, CASE WHEN confidence > 0.9 THEN valid_from WHEN confidence > 0.5 THEN valid_from[:7] ELSE valid_from[:4] END AS partial
FROM (SELECT DISTINCT unit_row_key, valid_from, confidence FROM unit_rows)""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "unit_rows").select("unit_row_key", "valid_from", "confidence").distinct()
    y = S.date_to_year(F.col("valid_from"))
    precision = F.when(F.col("confidence") > 0.9, 11).when(F.col("confidence") > 0.5, 10).otherwise(9)
    return r.select("unit_row_key", S.year_to_date(y).alias("year_start"), y.alias("year"), S.long_date(F.col("valid_from")).alias("long_date"), S.partial_date(F.col("valid_from"), precision).alias("partial"))


@query("""WITH days AS (SELECT unit_id, event_date, title, event_key FROM (SELECT DISTINCT unit_id, event_date, title, event_key, date_confidence FROM unit_events WHERE event_date IS NOT NULL))
SELECT unit_id, event_date AS dated, event_key FROM days QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY event_date, title, event_key) = 1""")
def dated_places(spark: SparkSession, d: str) -> DataFrame:
    """The earliest dated fact of each unit, by a composite key."""
    e = table(spark, d, "unit_events").where("event_date IS NOT NULL").groupBy("unit_id").agg(F.min(F.struct("event_date", "title", "event_key")).alias("x"))
    return e.select("unit_id", F.col("x.event_date").alias("dated"), F.col("x.event_key").alias("event_key"))


@query()
def scenario_replay(spark: SparkSession, d: str) -> DataFrame:
    """Every scenario against the recorded history, each one run. A unit's first create in a scenario is its base row,
    all later changes are events (creates too, so a unit can live again); an event that cannot happen is left out."""
    ch = latest_changes(spark, d)
    ch = ch.withColumn("_nth", F.when(F.col("kind") == "create", F.row_number().over(Window.partitionBy("scenario_id", "unit_id", "kind").orderBy("event_date", "change_id"))))
    rows = ch.where("_nth = 1").select("scenario_id", F.col("unit_id").alias("unit"), F.col("event_date").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), "name", "status", "sovereign")
    events = ch.where("kind <> 'create' OR _nth > 1").select("scenario_id", F.col("event_date").alias("date"), F.concat_ws(":", "scenario_id", "event_date").alias("event"), F.col("change_id").alias("seq"), "kind", F.col("unit_id").alias("unit"), "name", "status", "sovereign")
    return R.scenario_replay(rows, events, runs=["scenario_id"])


QUERIES, SQL = query.queries, query.sql
