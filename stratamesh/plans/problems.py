"""The queries of the data-processing problems over their whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.text import tidy_id
from stratamesh.operators.asof import as_known
from stratamesh.operators.hierarchy import descendants, listed_parents, nested_sets
from stratamesh.operators.history import build_history
from stratamesh.operators.orphans import orphan_references
from stratamesh.operators.proximity import pairs_within
from stratamesh.session import table
from stratamesh.sources.nested import instances, shred

FIELDS = ["name", "status", "sovereign", "capital"]


def unit_history(spark: SparkSession, d: str) -> DataFrame:
    return build_history(
        table(spark, d, "unit_changes"), entity="unit_id", date="event_date", change="change_id", known_at="recorded_at", kind="kind", fields=FIELDS, fields_set="fields_set"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unit_history(spark, d).select("unit_id", F.col("valid_from").cast("string").alias("valid_from"), F.coalesce(F.col("valid_to").cast("string"), F.lit("9999-12-31")).alias("valid_to"))


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    """The history with the values of every version."""
    return unit_history(spark, d).select("unit_id", *FIELDS, F.col("valid_from").cast("string").alias("valid_from"), F.coalesce(F.col("valid_to").cast("string"), F.lit("9999-12-31")).alias("valid_to"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return as_known(
        table(spark, d, "unit_events"), table(spark, d, "unit_rows"), keys=["unit_id", "truth"], event_id="event_key", event_date="event_date", observed_at="observed_at",
        version_id="unit_row_key", valid_from="valid_from", valid_to="valid_to", recorded_at="recorded_at",
    )


_PACK = r"(?:\.children\[\])*"
_CREATE = r"\.events\[\]\.changes\[\]"
_PATHS = rf"{_PACK}|{_PACK}\.regions\[\]\.id|(?:{_PACK}\.meta\.scenario)?{_CREATE}\.create"


def _position(ords: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit("0")), F.transform(ords, lambda o: o.cast("string"))), ".")


def _whole(c: Column) -> Column:
    """Text of a number or of a string that holds one, as whole number; null if it is none."""
    t = F.trim(c)
    n = t.try_cast("double")
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")).otherwise(F.when((n == F.floor(n)) & (F.abs(n) < 9e15), n.cast("bigint")))


def nested_tables(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows of packs, regions and created units: (raw_id, entity, parent_id, child_id), repeats included. Records are
    parsed once; every object of the pivoted table then says itself which row it is."""
    t = shred(table(spark, d, "raw_records"), key="raw_id", payload="payload", keep=["record_kind"], repeated=["children", "regions", "events", "changes"], paths=_PATHS)
    g = instances(t, ["raw_id", "record_kind"], F.regexp_extract("path", r"^(.*\[\])?", 0), {"id": "id", "created": "create"})
    up = F.slice("ords", 1, F.size("ords") - 1)
    pack = F.col("record_kind") == "pack"
    event = F.concat(F.lit("/"), F.get("ords", F.size("ords") - 2).cast("string"))

    def row(entity: str, parent: Column, child: Column) -> Column:
        return F.struct(F.lit(entity).alias("entity"), parent.alias("parent_id"), child.alias("child_id"))

    found = (
        F.when(pack & F.col("ancestor").rlike(rf"^{_PACK}$"), row("pack", F.when(F.size("ords") > 0, _position(up)).otherwise(""), _position(F.col("ords"))))
        .when(pack & F.col("ancestor").endswith(".regions[]"), row("region", _position(up), _whole(F.col("id")).cast("string")))
        .when(pack & F.col("ancestor").endswith(".scenario.events[].changes[]"), row("create", F.concat(_position(F.slice("ords", 1, F.greatest(F.lit(0), F.size("ords") - 2))), event), F.col("created")))
        .when((F.col("record_kind") == "scenario") & (F.col("ancestor") == ".events[].changes[]"), row("create", event, F.col("created")))
    )
    return g.select("raw_id", found.alias("found")).where("found.child_id IS NOT NULL").select("raw_id", "found.*")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_tables(spark, d).distinct()


def _objects(spark: SparkSession, d: str, ancestors: str, attributes: dict[str, str]) -> DataFrame:
    """One row for each object at a path that matches ``ancestors``, with the scalars at its ``attributes``; one parse."""
    fields = "|".join(a.replace(".", r"\.") for a in attributes.values())
    t = shred(table(spark, d, "raw_records"), key="raw_id", payload="payload", keep=["record_kind"], repeated=["children", "regions", "events", "changes"], paths=rf"(?:{ancestors})(?:\.(?:{fields}))?")
    return instances(t, ["raw_id", "record_kind"], F.regexp_extract("path", r"^(.*\[\])?", 0), attributes)


def _holder(below: int) -> Column:
    """Position of the pack that holds an object with so many lists of its own; empty for a scenario record."""
    return F.when(F.col("record_kind") == "pack", _position(F.slice("ords", 1, F.greatest(F.lit(0), F.size("ords") - below)))).otherwise("")


def _ord(back: int) -> Column:
    return F.get("ords", F.size("ords") - back)


def p3_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every pack with its parent and settings."""
    g = _objects(spark, d, _PACK, {"method": "meta.method", "mesh_version": "meta.meshVersion", "pack_name": "meta.id", "scope_kind": "meta.scope.kind"}).where("record_kind = 'pack'")
    parent = F.when(F.size("ords") > 0, _position(F.slice("ords", 1, F.size("ords") - 1))).otherwise("")
    return g.select("raw_id", _position(F.col("ords")).alias("pack"), parent.alias("parent"), "method", "mesh_version", "pack_name", "scope_kind")


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """Every region, keyed to its pack; its id as a whole number, null where it is none."""
    g = _objects(spark, d, rf"{_PACK}\.regions\[\]", {"id": "id", "region_name": "name", "capital": "capital"}).where("record_kind = 'pack'")
    return g.select("raw_id", _holder(1).alias("pack"), _ord(1).alias("region_no"), _whole(F.col("id")).alias("region"), "region_name", "capital")


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a scenario, keyed to the pack that holds the scenario (empty for a scenario record)."""
    g = _objects(spark, d, rf"(?:{_PACK}\.meta\.scenario)?\.events\[\]", {"event_date": "date", "title": "title", "note": "note"}).where((F.col("record_kind") == "scenario") == (F.col("ancestor") == ".events[]"))
    return g.select("raw_id", _holder(1).alias("holder"), _ord(1).alias("event_no"), "event_date", "title", "note")


_CHANGE = {"created": "create", "altered": "alter", "renamed": "rename", "dissolved": "dissolve", "new_name": "name", "status": "status", "sovereign": "sovereign", "capital": "capital"}


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change, keyed to its event."""
    g = _objects(spark, d, rf"(?:{_PACK}\.meta\.scenario)?{_CREATE}", _CHANGE).where((F.col("record_kind") == "scenario") == (F.col("ancestor") == ".events[].changes[]"))
    return g.select("raw_id", _holder(2).alias("holder"), _ord(2).alias("event_no"), _ord(1).alias("change_no"), *_CHANGE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cells, places, cmas, points = (table(spark, d, t) for t in ("cells", "places", "cmas", "map_points"))

    def refs(df: DataFrame, name: str, key: str, domain: str, ref: Column) -> DataFrame:
        return df.select(F.lit(domain).alias("domain"), ref.alias("ref"), F.col("loaded_at").alias("at"), F.lit(name).alias("from_table"), F.col(key).alias("from_key"))

    def index(c: Column) -> Column:
        return F.when(c != -1, c.cast("string"))

    all_refs = (
        refs(cells, "cells", "cell", "cell", F.explode(F.transform(F.array_distinct("neighbours"), index)))
        .unionByName(refs(places, "places", "place_key", "cell", index(F.col("cell"))))
        .unionByName(refs(cmas, "cmas", "cma_key", "cell", F.explode(F.transform(F.array_distinct("cells"), index))))
        .unionByName(refs(points, "map_points", "point_key", "id", F.nullif(tidy_id(F.col("cell_id")), F.lit("-1"))))
    )
    parents = cells.select(F.lit("cell").alias("domain"), F.col("cell").cast("string").alias("ref"), "loaded_at", "deleted_at").unionByName(
        cells.select(F.lit("id").alias("domain"), tidy_id(F.col("id")).alias("ref"), "loaded_at", "deleted_at")
    )
    return (
        orphan_references(all_refs, parents)
        .select("from_table", "from_key", F.col("ref").alias("missing_ref"), "reason", F.date_format("at", "yyyy-MM").alias("ref_month"))
        .distinct()
    )


def tree_sets(spark: SparkSession, d: str, *, with_path: bool = False) -> DataFrame:
    links = listed_parents(table(spark, d, "tree_nodes"), node="node_id", parent="parent_id", children="children", updated_at="updated_at")
    return nested_sets(links, with_path=with_path)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_sets(spark, d).select(F.col("node").alias("node_id"), F.coalesce("root", F.lit("")).alias("root_id"), F.col("depth").alias("node_depth"), "n_below")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full paths: the titles' nodes from the root down, joined by a slash; null in or below loops."""
    return tree_sets(spark, d, with_path=True).select(F.col("node").alias("node_id"), F.array_join("path", "/").alias("node_path"))


def p5_sets(spark: SparkSession, d: str) -> DataFrame:
    """Every node's preorder range in its tree: what lies below a node is in the same root with ``lo`` in its range. In
    or below loops the root is empty and the range -1."""
    return tree_sets(spark, d).select(F.col("node").alias("node_id"), F.coalesce("root", F.lit("")).alias("root_id"), "lo", "hi")


def p5_below(spark: SparkSession, d: str) -> DataFrame:
    """Everything below every node, one row a pair."""
    return descendants(tree_sets(spark, d)).select(F.col("node").alias("node_id"), "below")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(table(spark, d, "map_points"), key="point_key", lat="lat", lng="lng", radius_km=0.25).select(F.col("a").alias("point_a"), F.col("b").alias("point_b"))


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p2_found, p3_found, p3_packs, p3_regions, p3_events, p3_changes, p4_found, p5_found, p5_paths, p5_sets, p5_below, p6_found)}

_NORM = r"trim(regexp_replace(nfc_normalize({0}), '[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'))"
_HISTORY = f"""
WITH one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY recorded_at DESC) AS rn FROM unit_changes)
  WHERE rn = 1 AND event_date IS NOT NULL
), alive AS (
  SELECT *, last_value(CASE kind WHEN 'create' THEN 1 WHEN 'dissolve' THEN 0 END IGNORE NULLS)
            OVER (PARTITION BY unit_id ORDER BY event_date, change_id) AS on_after FROM one
), lives AS (
  SELECT *, sum(CASE WHEN kind = 'create' AND coalesce(on_before, 0) = 0 THEN 1 ELSE 0 END)
            OVER (PARTITION BY unit_id ORDER BY event_date, change_id) AS life
  FROM (SELECT *, lag(on_after) OVER (PARTITION BY unit_id ORDER BY event_date, change_id) AS on_before FROM alive)
), vals AS (
  SELECT unit_id, event_date, change_id, on_after,
    {", ".join(f"(last_value(CASE WHEN on_after = 1 AND list_contains(fields_set, '{f}') THEN {{'v': {_NORM.format(f)}}} END IGNORE NULLS) OVER (PARTITION BY unit_id, life ORDER BY event_date, change_id)).v AS {f}" for f in FIELDS)}
  FROM lives
), days AS (
  SELECT unit_id, event_date, CASE WHEN on_after = 1 THEN {{'name': name, 'status': status, 'sovereign': sovereign, 'capital': capital}} END AS st
  FROM vals QUALIFY row_number() OVER (PARTITION BY unit_id, event_date ORDER BY change_id DESC) = 1
), points AS (
  SELECT *, lag(st) OVER (PARTITION BY unit_id ORDER BY event_date) AS was FROM days
), changed AS (
  SELECT *, lead(event_date) OVER (PARTITION BY unit_id ORDER BY event_date) AS until
  FROM points WHERE st IS DISTINCT FROM was
)
SELECT unit_id, {{0}}event_date AS valid_from, coalesce(until, '9999-12-31') AS valid_to FROM changed WHERE st IS NOT NULL
"""
_TREE = """
WITH RECURSIVE newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC) AS rn FROM tree_nodes) WHERE rn = 1
), told AS (
  SELECT child, min(node_id) AS lister FROM (SELECT node_id, unnest(children) AS child FROM newest) GROUP BY child
), links AS (
  SELECT n.node_id, p.node_id AS parent
  FROM newest n LEFT JOIN told t ON t.child = n.node_id LEFT JOIN newest p ON p.node_id = coalesce(n.parent_id, t.lister)
), walk AS (
  SELECT node_id, [node_id] AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.node_id, list_append(w.path, l.node_id) FROM links l JOIN walk w ON l.parent = w.node_id
), below AS (SELECT up, count(*) - 1 AS n FROM (SELECT unnest(path) AS up FROM walk) GROUP BY up)
"""
_RECORDS = r"""
WITH RECURSIVE bare AS (
  SELECT raw_id, record_kind, regexp_replace(payload, '^[\s\p{Z}\x{feff}]+|[\s\p{Z}\x{feff}]+$', '', 'g') AS s FROM raw_records
), opened AS (
  SELECT raw_id, record_kind, CASE WHEN s LIKE '"%' AND json_valid(s) THEN regexp_replace(json_extract_string(s, '$'), '^[\s\p{Z}\x{feff}]+|[\s\p{Z}\x{feff}]+$', '', 'g') ELSE s END AS s FROM bare
), good AS (
  SELECT raw_id, record_kind, CAST(s AS JSON) AS j FROM (SELECT * FROM opened WHERE CASE WHEN json_valid(s) THEN json_type(s) = 'OBJECT' ELSE false END)
), packs AS (
  SELECT raw_id, '' AS up, '0' AS pos, j FROM good WHERE record_kind = 'pack'
  UNION ALL
  SELECT raw_id, pos, pos || '.' || (i - 1), kids[i] FROM (
    SELECT raw_id, pos, kids, unnest(range(1, len(kids) + 1)) AS i FROM (
      SELECT raw_id, pos, CASE json_type(j, '$.children') WHEN 'ARRAY' THEN CAST(j->'$.children' AS JSON[]) WHEN 'OBJECT' THEN [j->'$.children'] ELSE [] END AS kids FROM packs)
  ) WHERE json_type(kids[i]) = 'OBJECT'
), regions AS (
  SELECT raw_id, pos, rs[i] AS r, i - 1 AS no FROM (SELECT raw_id, pos, rs, unnest(range(1, len(rs) + 1)) AS i FROM (SELECT raw_id, pos, CASE json_type(j, '$.regions') WHEN 'ARRAY' THEN CAST(j->'$.regions' AS JSON[]) WHEN 'OBJECT' THEN [j->'$.regions'] ELSE [] END AS rs FROM packs))
), stories AS (
  SELECT raw_id, pos, j->'$.meta.scenario' AS s FROM packs
  UNION ALL SELECT raw_id, '', j FROM good WHERE record_kind = 'scenario'
), happenings AS (
  SELECT raw_id, pos AS holder, i - 1 AS event_no, pos || '/' || (i - 1) AS pos, es[i] AS e FROM (
    SELECT raw_id, pos, es, unnest(range(1, len(es) + 1)) AS i FROM (
      SELECT raw_id, pos, CASE json_type(s, '$.events') WHEN 'ARRAY' THEN CAST(s->'$.events' AS JSON[]) WHEN 'OBJECT' THEN [s->'$.events'] ELSE [] END AS es FROM stories))
), changes AS (
  SELECT raw_id, holder, event_no, pos, i - 1 AS change_no, cs[i] AS c FROM (SELECT raw_id, holder, event_no, pos, cs, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT raw_id, holder, event_no, pos, CASE json_type(e, '$.changes') WHEN 'ARRAY' THEN CAST(e->'$.changes' AS JSON[]) WHEN 'OBJECT' THEN [e->'$.changes'] ELSE [] END AS cs FROM happenings))
)
"""


def _scalar(j: str, path: str, name: str) -> str:
    return f"CASE WHEN json_type({j}, '$.{path}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN {j}->>'$.{path}' END AS {name}"


SQL = {
    "p1_found": _HISTORY.replace("{0}", ""),
    "p1_history": _HISTORY.replace("{0}", "st.name AS name, st.status AS status, st.sovereign AS sovereign, st.capital AS capital, "),
    "p2_found": """
SELECT event_key, unit_row_key FROM (
  SELECT e.event_key, v.unit_row_key, row_number() OVER (PARTITION BY e.event_key ORDER BY v.recorded_at DESC, v.unit_row_key DESC) AS rn
  FROM unit_events e JOIN unit_rows v ON v.unit_id = e.unit_id AND v.truth = e.truth
   AND v.valid_from <= e.event_date AND (v.valid_to IS NULL OR e.event_date < v.valid_to) AND v.recorded_at <= e.observed_at
) WHERE rn = 1""",
    "p3_found": _RECORDS + r"""
SELECT raw_id, 'pack' AS entity, up AS parent_id, pos AS child_id FROM packs
UNION
SELECT raw_id, 'region', pos, CAST(CAST(TRY_CAST(r->>'$.id' AS DOUBLE) AS BIGINT) AS VARCHAR) FROM regions WHERE TRY_CAST(r->>'$.id' AS DOUBLE) IS NOT NULL
UNION
SELECT raw_id, 'create', pos, c->>'$.create' FROM changes WHERE c->>'$.create' IS NOT NULL""",
    "p3_packs": _RECORDS + "SELECT raw_id, pos AS pack, up AS parent, " + ", ".join(_scalar("j", p, n) for n, p in (("method", "meta.method"), ("mesh_version", "meta.meshVersion"), ("pack_name", "meta.id"), ("scope_kind", "meta.scope.kind"))) + " FROM packs",
    "p3_regions": _RECORDS + "SELECT raw_id, pos AS pack, CAST(no AS INTEGER) AS region_no, CASE WHEN TRY_CAST(r->>'$.id' AS DOUBLE) = floor(TRY_CAST(r->>'$.id' AS DOUBLE)) THEN CAST(TRY_CAST(r->>'$.id' AS DOUBLE) AS BIGINT) END AS region, " + ", ".join(_scalar("r", p, n) for n, p in (("region_name", "name"), ("capital", "capital"))) + " FROM regions WHERE json_type(r) = 'OBJECT'",
    "p3_events": _RECORDS + "SELECT raw_id, holder, CAST(event_no AS INTEGER) AS event_no, " + ", ".join(_scalar("e", p, n) for n, p in (("event_date", "date"), ("title", "title"), ("note", "note"))) + " FROM happenings WHERE json_type(e) = 'OBJECT'",
    "p3_changes": _RECORDS + "SELECT raw_id, holder, CAST(event_no AS INTEGER) AS event_no, CAST(change_no AS INTEGER) AS change_no, " + ", ".join(_scalar("c", p, n) for n, p in _CHANGE.items()) + " FROM changes WHERE json_type(c) = 'OBJECT'",
    "p4_found": r"""
WITH refs AS (
  SELECT 'cells' AS from_table, cell AS from_key, CAST(n AS VARCHAR) AS ref, loaded_at AS seen_at, 0 AS by_id FROM (SELECT cell, loaded_at, unnest(neighbours) AS n FROM cells) WHERE n <> -1
  UNION SELECT 'places', place_key, CAST(cell AS VARCHAR), loaded_at, 0 FROM places WHERE cell <> -1
  UNION SELECT 'cmas', cma_key, CAST(n AS VARCHAR), loaded_at, 0 FROM (SELECT cma_key, loaded_at, unnest(cells) AS n FROM cmas) WHERE n <> -1
  UNION SELECT 'map_points', point_key, lower(trim(cell_id)), loaded_at, 1 FROM map_points WHERE cell_id IS NOT NULL AND trim(cell_id) <> '-1'
), parents AS (
  SELECT CAST(cell AS VARCHAR) AS ref, loaded_at, deleted_at, 0 AS by_id FROM cells UNION ALL SELECT lower(trim(id)), loaded_at, deleted_at, 1 FROM cells
), met AS (
  SELECT r.from_table, r.from_key, r.ref, r.seen_at, count(p.ref) AS n, coalesce(bool_and(p.loaded_at > r.seen_at), false) AS late,
         coalesce(bool_or(p.loaded_at <= r.seen_at AND (p.deleted_at IS NULL OR r.seen_at < p.deleted_at)), false) AS good
  FROM refs r LEFT JOIN parents p ON p.ref = r.ref AND p.by_id = r.by_id GROUP BY ALL
)
SELECT DISTINCT from_table, from_key, ref AS missing_ref, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason, strftime(seen_at, '%Y-%m') AS ref_month
FROM met WHERE NOT good""",
    "p5_found": _TREE + """
SELECT n.node_id, coalesce(w.path[1], '') AS root_id, CAST(coalesce(len(w.path) - 1, -1) AS BIGINT) AS node_depth, CAST(coalesce(b.n, -1) AS BIGINT) AS n_below
FROM newest n LEFT JOIN walk w ON w.node_id = n.node_id LEFT JOIN below b ON b.up = n.node_id AND w.node_id IS NOT NULL""",
    "p5_paths": _TREE + """
SELECT n.node_id, array_to_string(w.path, '/') AS node_path FROM newest n LEFT JOIN walk w ON w.node_id = n.node_id""",
    "p5_below": _TREE + """
SELECT up AS node_id, node_id AS below FROM (SELECT node_id, unnest(path) AS up FROM walk) WHERE up <> node_id""",
    "p6_found": """
WITH p AS (
  SELECT DISTINCT point_key AS k, lat, lng FROM map_points
  WHERE lat IS NOT NULL AND lng IS NOT NULL AND abs(lat) <= 90 AND abs(lng) <= 180 AND NOT (lat = 0 AND lng = 0)
)
SELECT DISTINCT a.k AS point_a, b.k AS point_b FROM p a JOIN p b ON a.k < b.k AND abs(a.lat - b.lat) < 0.003
WHERE 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 0.25""",
}
