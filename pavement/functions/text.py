"""Text keys: join keys from city and file names, country, slug."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is dropped from a raster file name, in this order, and the
# letters that fold to something other than their base letter.
SUFFIXES = (".tif", ".tiff", "_LandUse", "LandUse", "_DEM", "DEM", "_10m", "10m")
LETTERS = {"ø": "o", "å": "a", "æ": "ae", "ö": "o", "ü": "u", "ä": "a", "é": "e", "è": "e"}


def _base_letters() -> tuple[str, str]:
    """Every accented character that is one base character plus combining marks."""
    accented, plain = [], []
    for code in range(0x80, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _base_letters()


def city_key(name: Column) -> Column:
    """Join key of a city or raster file name: no suffix, lower case, no accents, letters and digits only."""
    for suffix in SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    name = F.lower(name)
    for letter, base in LETTERS.items():
        name = F.replace(name, F.lit(letter), F.lit(base))
    return F.regexp_replace(F.translate(name, _ACCENTED, _PLAIN), r"[^\p{L}\p{N}]", "")


def country_of(city: Column) -> Column:
    """Text after the last ``", "``; the whole text when there is none."""
    return F.element_at(F.split(city, ", "), -1)


def slug(city: Column) -> Column:
    """File-name form of a city: separators and spaces become underscores."""
    return F.replace(F.replace(city, F.lit(", "), F.lit("_")), F.lit(" "), F.lit("_"))


def coordinate_text(kind: Column, coordinates: Column) -> Column:
    """Outer ring of a Polygon, or of the first part of a MultiPolygon, as ``"lat lng,lat lng"``.

    ``coordinates`` is the GeoJSON coordinate text; other geometry types give null.
    """
    polygon = F.from_json(coordinates, "array<array<array<string>>>")
    multi = F.from_json(coordinates, "array<array<array<array<string>>>>")
    ring = F.when(kind == "Polygon", F.get(polygon, F.lit(0))).when(
        kind == "MultiPolygon", F.get(F.get(multi, F.lit(0)), F.lit(0)))
    return F.when(ring.isNotNull(), F.concat_ws(",", F.transform(
        ring, lambda p: F.concat_ws(" ", F.get(p, F.lit(1)), F.get(p, F.lit(0))))))


def extract_json_value(reply: Column, key: str, default=0) -> Column:
    """Scalar under ``key`` of a JSON object; the default when the key is absent, null for a bad reply."""
    keys = F.json_object_keys(reply)
    present = F.array_contains(keys, F.lit(key))
    return F.when(present, F.get_json_object(reply, f"$['{key}']")).when(
        keys.isNotNull(), F.lit(str(default)))
