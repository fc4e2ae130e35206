"""Regions as GeoJSON, KML, Markdown and record packs; canonical gzip files."""

from __future__ import annotations

import gzip
import hashlib
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.functions.scalar import kml_colour, signed_area, slug, xml_escape


def wound(ring: Column, outer: bool) -> Column:
    """A ring in the required direction: outer rings counter-clockwise, holes clockwise."""
    a = signed_area(ring)
    return F.when((a < 0) if outer else (a > 0), F.reverse(ring)).otherwise(ring)


def geojson_features(regions: DataFrame, properties: list[str]) -> DataFrame:
    """region, feature: one GeoJSON feature for each region with ``ring`` (array of struct x, y, not closed)."""
    pts = F.transform(wound(F.col("ring"), True), lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(pts, F.slice(pts, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return regions.select("region", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("region", *properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def kml_placemarks(regions: DataFrame, name: str, colour: str) -> DataFrame:
    """region, placemark: KML of each region with ``ring``."""
    pts = wound(F.col("ring"), True)
    text = F.array_join(F.transform(F.concat(pts, F.slice(pts, 1, 1)), lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return regions.select("region", F.concat(F.lit("<Placemark><name>"), xml_escape(F.col(name)), F.lit("</name><Style><PolyStyle><color>"), kml_colour(F.col(colour)), F.lit("</color></PolyStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>"), text, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")).alias("placemark"))


def pack_json(assignment: DataFrame, regions: DataFrame, meta: dict) -> DataFrame:
    """One JSON text: meta, the regions in order and the assignment as an encoded column (cells in order). One row per
    mesh: its cells bound the array."""
    from stratamesh.sources.codec import encode_int32

    a = assignment.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "region"))), lambda x: x["region"]).alias("r")).select(F.struct(F.lit("id").alias("kind"), F.lit("int32").alias("dtype"), F.lit("le").alias("byteOrder"), F.size("r").alias("length"), encode_int32(F.col("r")).alias("data")).alias("assignment"))
    r = regions.agg(F.array_sort(F.collect_list(F.struct("region", *[c for c in regions.columns if c != "region"]))).alias("regions"))
    return a.crossJoin(r).select(F.to_json(F.struct(F.from_json(F.lit(json.dumps(meta)), "map<string,string>").alias("meta"), "regions", "assignment")).alias("pack"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text file part per partition; the caller chooses how many."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_json_gz(value: object, path: str) -> str:
    """Canonical compact JSON, gzipped without a time, put in place whole. Returns its SHA-256."""
    raw = gzip.compress(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), 9, mtime=0)
    with open(path + ".tmp", "wb") as f:
        f.write(raw)
    os.replace(path + ".tmp", path)
    return hashlib.sha256(raw).hexdigest()


def export_name(title: Column, kind: str) -> Column:
    """File name of an export: slug and the ending of its kind."""
    return F.concat(F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("export")), F.lit("." + {"geojson": "geojson", "topojson": "topo.json", "kml": "kml", "markdown": "md", "pack": "json"}[kind]))


def verify_rebuild(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names whose hashes differ or that one side lacks."""
    j = old.select("name", F.col("sha").alias("a")).join(new.select("name", F.col("sha").alias("b")), "name", "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("name", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("changed").alias("state"))
