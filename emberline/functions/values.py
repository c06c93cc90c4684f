"""Conversions, rounding, texts and facility types."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from zero by way of a decimal, so that engines agree."""
    return F.round(x.cast("decimal(18,6)"), places).cast("double")


def fixed(x: Column, places: int) -> Column:
    """The number with so many places, half to even, no thousands marks."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def acq_datetime(date: Column, hhmm: Column) -> Column:
    """Date plus an HHMM number."""
    t = hhmm.cast("int")
    return date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.floor(t / 100).cast("int"), t % 100, F.lit(0))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


@F.pandas_udf(LongType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    """64-bit FNV-1a of UTF-8, as a signed number; null stays null."""

    def one(text):
        if text is None:
            return None
        h = 0xCBF29CE484222325
        for b in text.encode("utf-8"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return _signed(h)

    return pd.Series([one(t) for t in texts], dtype="Int64")


def _tag(tags: Column, key: str) -> Column:
    return F.get(F.array(F.try_element_at(tags, F.lit(key))), 0)


def facility_type(tags: Column) -> Column:
    """Facility type of map tags: the first rule that holds."""
    industrial, landuse, works, power = (_tag(tags, k) for k in ("industrial", "landuse", "man_made", "power"))
    lower = lambda k: F.lower(F.coalesce(_tag(tags, k), F.lit("")))
    burns = F.lit(False)
    for fuel in ("coal", "gas", "oil", "thermal", "nuclear"):
        burns = burns | lower("plant:source").contains(fuel)
    stored = ("lng", "lpg", "gas")
    rules = (
        ((power == "plant") & burns, "thermal_power_plant"),
        (industrial == "refinery", "refinery"),
        (industrial.isin("oil", "gas", "oil_and_gas", "oil_gas"), "oil_gas_facility"),
        (industrial.isin("petrochemical", "chemical", "chemistry"), "petrochemical"),
        (industrial.isin("steel", "metal", "scrap_metal", "metallurgical"), "steel_or_metal"),
        (F.coalesce(industrial.isin("mine", "mining"), F.lit(False)) | F.coalesce(landuse == "quarry", F.lit(False)), "mining"),
        (lower("product").isin(*stored) | lower("substance").isin(*stored) | F.coalesce(industrial.isin(*stored), F.lit(False)), "lng_or_storage_terminal"),
        (landuse == "industrial", "industrial_area"),
        (works == "works", "general_factory"),
        (power == "plant", "thermal_power_plant"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("unknown_industrial")


def is_industrial(tags: Column) -> Column:
    """Whether the map selectors take an object with these tags."""
    industrial, landuse, works, power = (_tag(tags, k) for k in ("industrial", "landuse", "man_made", "power"))
    parts = (F.coalesce(industrial, F.lit("")) != "", landuse.isin("industrial", "quarry"), works == "works", power == "plant")
    return F.coalesce(parts[0], F.lit(False)) | F.coalesce(parts[1], F.lit(False)) | F.coalesce(parts[2], F.lit(False)) | F.coalesce(parts[3], F.lit(False))


# Fuels that burn, by registry, and the family of each fuel.
WRI_THERMAL = ("Coal", "Gas", "Oil", "Petcoke", "Biomass", "Waste", "Cogeneration")
OSMPP_THERMAL = ("Hard Coal", "Lignite", "Natural Gas", "Oil", "Petcoke", "Solid Biomass", "Biogas", "Waste")
FUEL_FAMILY = {
    "Coal": "coal", "Hard Coal": "coal", "Lignite": "coal", "Gas": "gas", "Natural Gas": "gas", "Biogas": "gas", "Oil": "oil", "Biomass": "bio", "Solid Biomass": "bio",
    "Waste": "bio", "Cogeneration": "bio", "Petcoke": "petcoke",
}


def fuel_family(fuel: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FUEL_FAMILY.items() for x in pair])
    return F.try_element_at(table, fuel)


# Land-cover classes by code.
LAND_COVER = {
    1: "tree_cover", 2: "shrubland", 3: "grassland", 4: "cropland", 5: "built_up", 6: "bare",
    7: "snow_ice", 8: "water", 9: "wetlands", 10: "mangroves", 11: "moss_lichen",
}


def land_cover(code: Column) -> Column:
    """struct(class, fracs, note) of a provider's class code."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in LAND_COVER.items() for x in pair]), code)
    note = F.when(code.isNull(), "no class value in response").when(name.isNull(), F.concat(F.lit("unknown class code "), code.cast("string"))).otherwise(F.concat(F.lit("esri class "), code.cast("string"), F.lit(" ("), name, F.lit(")")))
    return F.struct(name.alias("landcover_class"), F.when(name.isNotNull(), F.create_map(F.lit("dominant_class"), name)).alias("landcover_fracs"), F.substring(note, 1, 300).alias("landcover_note"))
