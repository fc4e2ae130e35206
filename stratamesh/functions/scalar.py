"""Scalar functions: rounding, ratios, dates, hashes, strings, colours and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity (-2.5 gives -2)."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def half_even(x: Column, digits: int = 0) -> Column:
    """Banker's rounding."""
    return F.bround(x, digits)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def year_to_date(year: Column) -> Column:
    """First day of a year as ISO text."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-01"))


def date_to_year(date: Column) -> Column:
    return F.substring(date, 1, 4).cast("int")


def long_date(date: Column) -> Column:
    """15 Jul 1870."""
    return F.date_format(date.cast("date"), "d MMM yyyy")


def partial_date(date: Column, precision: Column) -> Column:
    """ISO text cut to its precision (11 day, 10 month, else year)."""
    return F.when(precision == 11, date).when(precision == 10, F.substring(date, 1, 7)).otherwise(F.substring(date, 1, 4))


def slug(text: Column) -> Column:
    """Lower case, marks of the Latin-1 letters dropped, runs of other characters one hyphen, none at the ends."""
    # Fixed value: the accented letters and their bases.
    bare = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as bigint."""
    digits = F.hex(F.encode(text, "utf-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(digits, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint"))
    step = lambda h, b: ((h.bitwiseXOR(b)).cast("decimal(38,0)") * F.lit(16777619).cast("decimal(10,0)") % F.lit(4294967296).cast("decimal(10,0)")).cast("bigint")
    return F.when(F.length(text) > 0, F.aggregate(bytes_, F.lit(2166136261).cast("bigint"), step)).otherwise(F.when(text.isNotNull(), F.lit(2166136261).cast("bigint")))


def _mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two unsigned 32-bit numbers, without leaving bigint."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def mulberry32(seed: Column, draw: Column) -> Column:
    """The ``draw``-th (from 1) unsigned 32-bit number of the generator with this seed."""
    mask = F.lit(0xFFFFFFFF)
    a = (seed.cast("bigint") + _mul32(draw.cast("bigint").bitwiseAND(mask), F.lit(0x6D2B79F5))).bitwiseAND(mask)
    t = _mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14))


KM_PER_DEGREE = 111.195


def flat_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance, the longitudes scaled at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + (lat2 - lat1) * (lat2 - lat1)) * KM_PER_DEGREE


def compass(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """One of eight directions from the first point to the second."""
    turn = F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1))
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(names, F.pmod(F.floor(turn / 45 + 0.5), F.lit(8)).cast("int"))


def signed_area(ring: Column) -> Column:
    """Twice the shoelace sum halved: positive for a counter-clockwise ring of structs x, y (closed or not)."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]) / 2


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast against one ring of structs x, y."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def in_polygon(rings: Column, x: Column, y: Column) -> Column:
    """Inside an odd number of rings (the outer one and holes)."""
    return F.size(F.filter(rings, lambda r: in_ring(r, x, y))) % 2 == 1


def lambert(lon: Column, lat: Column, centre: float = -95.0, south: float = 49.0, north: float = 77.0, radius: float = 6_371_000.0) -> Column:
    """Conformal conic projection on a sphere: struct x, y in metres."""
    t = lambda deg: math.tan(math.pi / 4 + math.radians(deg) / 2)
    n = math.log(math.cos(math.radians(south)) / math.cos(math.radians(north))) / math.log(t(north) / t(south))
    f = math.cos(math.radians(south)) * t(south) ** n / n
    rho = F.lit(radius * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    turn = F.radians(lon - centre) * n
    return F.struct((rho * F.sin(turn)).alias("x"), (F.lit(radius * f / t(0.0) ** n) - rho * F.cos(turn)).alias("y"))


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    part = lambda k: F.conv(F.substring(hex_colour, k, 2), 16, 10).cast("double") / 255
    lin = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return lin(part(2)) * 0.2126 + lin(part(4)) * 0.7152 + lin(part(6)) * 0.0722


def kml_colour(hex_colour: Column, alpha: str = "ff") -> Column:
    """#rrggbb as aabbggrr."""
    c = F.lower(hex_colour)
    return F.concat(F.lit(alpha), F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2))
