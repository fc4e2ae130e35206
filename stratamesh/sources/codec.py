"""Column envelopes, topologies, share links and record packs as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_int32(data: Column) -> Column:
    """Base64 of little-endian int32 as array<int>, without leaving the JVM."""
    h = F.hex(F.unbase64(data))
    byte = lambda i, k: F.substr(h, (i * 8 + 1 + 2 * k).cast("int"), F.lit(2))
    value = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("bigint")
    signed = lambda v: F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int")
    return F.when(F.length(h) >= 8, F.transform(F.sequence(F.lit(0), F.floor(F.length(h) / 8) - 1), lambda i: signed(value(i)))).otherwise(F.when(data.isNotNull(), F.array().cast("array<int>")))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_float32(data: pd.Series) -> pd.Series:
    import base64

    import numpy as np

    return data.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))


def encode_int32(values: Column) -> Column:
    """array<int> as base64 of little-endian int32."""
    h = F.transform(values, lambda v: F.lpad(F.hex(F.when(v < 0, v.cast("bigint") + 2**32).otherwise(v.cast("bigint"))), 8, "0"))
    swapped = F.transform(h, lambda x: F.concat(F.substring(x, 7, 2), F.substring(x, 5, 2), F.substring(x, 3, 2), F.substring(x, 1, 2)))
    return F.base64(F.unhex(F.array_join(swapped, "")))


@F.pandas_udf(T.StringType())
def encode_float32(values: pd.Series) -> pd.Series:
    import base64

    import numpy as np

    return values.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


def envelope_errors(columns: DataFrame) -> DataFrame:
    """Columns (name, kind, unit, dtype, length, data) that break a rule: whole-number kinds are int32 and others
    float32, money is in millions, measures have a unit, and the length is that of the data."""
    whole = F.col("kind").isin("count", "id")
    rules = [
        (F.when(whole, F.col("dtype") != "int32").otherwise(F.col("dtype") != "float32"), "dtype"),
        ((F.col("kind") == "money") & ~F.col("unit").eqNullSafe(F.lit("cad_millions")), "unit of money"),
        ((F.col("kind") == "measure") & ~F.coalesce(F.col("unit").rlike("^[a-z][a-z0-9_]*$"), F.lit(False)), "unit of measure"),
        (F.octet_length(F.unbase64("data")) != 4 * F.col("length"), "length"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    return columns.select("name", F.explode(found).alias("error"))


def decode_arcs(arcs: DataFrame, scale: tuple[float, float], translate: tuple[float, float]) -> DataFrame:
    """arc, pos, x, y of delta-encoded quantised arcs (arc, points: array of [dx, dy])."""
    p = arcs.select("arc", F.posexplode("points").alias("pos", "p"))
    w = Window.partitionBy("arc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda k: F.sum(F.get("p", F.lit(k))).over(w) * scale[k] + translate[k]
    return p.select("arc", "pos", at(0).alias("x"), at(1).alias("y"))


def encode_arcs(points: DataFrame, scale: tuple[float, float], translate: tuple[float, float]) -> DataFrame:
    """The inverse of ``decode_arcs``."""
    q = lambda c, k: F.round((F.col(c) - translate[k]) / scale[k]).cast("bigint")
    w = Window.partitionBy("arc").orderBy("pos")
    d = points.select("arc", "pos", q("x", 0).alias("qx"), q("y", 1).alias("qy"))
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    return d.select("arc", "pos", F.array(step("qx"), step("qy")).alias("p")).groupBy("arc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("points"))


def share_link(spec: Column) -> Column:
    """JSON text as base64url without padding."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(spec, "utf-8")), r"\s", ""), "+/", "-_"), F.lit("="))


def open_link(link: Column) -> Column:
    b = F.translate(link, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(b, (F.ceil(F.length(b) / 4) * 4).cast("int"), F.lit("="))), "utf-8")


def markdown_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Cells of the rows of Markdown tables, rules and heads left out by the caller: ``cells`` array<string>."""
    t = F.trim(line)
    rows = lines.where(t.startswith("|") & ~t.rlike(r"^\|[\s:|-]+\|$"))
    return rows.select(F.transform(F.split(F.regexp_replace(t, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature, properties (JSON text), rings (polygon, ring, array of struct x, y) of polygons in a collection."""
    point = "array<double>"
    schema = f"features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    polygon = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", f"array<array<{point}>>"))).otherwise(F.from_json("f.geometry.coordinates", f"array<array<array<{point}>>>"))
    r = f.select("feature", F.col("f.properties").alias("properties"), F.posexplode(polygon).alias("polygon", "rs"))
    r = r.select("feature", "properties", "polygon", F.posexplode("rs").alias("ring", "ps"))
    return r.withColumn("points", F.transform("ps", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))).drop("ps")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """name and ring (array of struct x, y) of the polygons of placemarks."""
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    k = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    text = F.trim(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"))
    pair = lambda s: F.split(s, ",")
    return k.select("name", F.transform(F.split(text, r"\s+"), lambda s: F.struct(F.get(pair(s), F.lit(0)).cast("double").alias("x"), F.get(pair(s), F.lit(1)).cast("double").alias("y"))).alias("ring")).where("ring IS NOT NULL")


def census_profile(long: DataFrame, geo: str, characteristic: str, value: str, wanted: list[int]) -> DataFrame:
    """Long rows to one wide row per place; only wanted characteristics are read, text that is no number is null."""
    x = long.where(F.col(characteristic).isin(wanted)).select(geo, characteristic, F.expr(f"try_cast(`{value}` AS double)").alias("_v"))
    return x.groupBy(geo).pivot(characteristic, wanted).agg(F.min("_v"))
