"""Facilities: registries to one shape, geometry of map ways, upsert, duplicates between registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from emberline.functions.geo import grid_cell, haversine, rings_of, turned
from emberline.functions.values import OSMPP_THERMAL, WRI_THERMAL, facility_type, fnv1a64, fuel_family, is_industrial


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _tags(pairs: dict[str, Column]) -> Column:
    """Map of the texts that are not blank."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(F.trim(v), F.lit("")).alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def from_wri(raw: DataFrame, thermal_only: bool = True) -> DataFrame:
    """Plants of the world registry that burn fuel, with an id hashed from theirs."""
    lat, lon = F.trim("latitude").try_cast("double"), F.trim("longitude").try_cast("double")
    rows = raw.filter(_finite(lat) & _finite(lon))
    if thermal_only:
        rows = rows.filter(F.col("primary_fuel").isin(*WRI_THERMAL))
    tags = _tags({"power": F.lit("plant"), "fuel": F.col("primary_fuel"), "capacity_mw": F.col("capacity_mw"), "country": F.col("country"), "owner": F.col("owner"), "commissioning_year": F.col("commissioning_year"), "gppd_idnr": F.col("gppd_idnr"), "wepp_id": F.col("wepp_id"), "url": F.col("url")})
    return rows.select(
        F.lit("wri").alias("osm_type"), fnv1a64("gppd_idnr").alias("osm_id"), F.col("name"), F.lit("thermal_power_plant").alias("facility_type"), tags.alias("tags"), F.lit("wri/v1.3.0").alias("source"),
        lat.alias("latitude"), lon.alias("longitude"), F.col("primary_fuel").alias("fuel"), F.col("country"),
    )


def from_osm_powerplants(raw: DataFrame, thermal_only: bool = True) -> DataFrame:
    """Plants of the map-based registry; the id column is kind/number, anything else is left out."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    kind, number = F.split("id", "/")[0], F.get(F.split("id", "/"), 1).try_cast("long")
    rows = raw.filter(_finite(lat) & _finite(lon) & (F.size(F.split("id", "/")) == 2) & number.isNotNull())
    if thermal_only:
        rows = rows.filter(F.col("Fueltype").isin(*OSMPP_THERMAL))
    tags = _tags({"power": F.lit("plant"), "fuel": F.col("Fueltype"), "capacity_mw": F.col("Capacity"), "country": F.col("Country"), "technology": F.col("Technology"), "start_date": F.col("DateIn")})
    return rows.select(
        kind.alias("osm_type"), number.alias("osm_id"), F.col("Name").alias("name"), F.lit("thermal_power_plant").alias("facility_type"), tags.alias("tags"), F.lit("osm-powerplants").alias("source"),
        lat.alias("latitude"), lon.alias("longitude"), F.col("Fueltype").alias("fuel"), F.col("Country").alias("country"),
    )


def registries(wri: DataFrame, osmpp: DataFrame) -> DataFrame:
    return from_wri(wri).unionByName(from_osm_powerplants(osmpp))


def cross_source_duplicates(a: DataFrame, b: DataFrame, metres: float = 1200.0) -> DataFrame:
    """(osm_type, osm_id of a; dup_type, dup_id, dup_m of b): each plant of a that b has too.

    The nearest of the same type, and of the same fuel family where both are known, within the
    square of cells around and so many metres; ties go to the smaller id.
    """
    here = grid_cell(F.col("latitude"), F.col("longitude"))
    la, lo = here["la"], here["lo"]
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((la + i).alias("la"), (lo + j).alias("lo")))))
    left = a.select("osm_type", "osm_id", "facility_type", "latitude", "longitude", fuel_family(F.col("fuel")).alias("family"), F.struct(la.alias("la"), lo.alias("lo")).alias("cell"))
    right = b.select(F.col("osm_type").alias("dup_type"), F.col("osm_id").alias("dup_id"), "facility_type", F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"), fuel_family(F.col("fuel")).alias("b_family"), F.explode(around).alias("cell"))
    near = left.join(right, ["cell", "facility_type"]).withColumn("dup_m", haversine(F.col("latitude"), F.col("longitude"), F.col("b_lat"), F.col("b_lon")))
    same = F.col("family").isNull() | F.col("b_family").isNull() | (F.col("family") == F.col("b_family"))
    best = near.filter(same & (F.col("dup_m") <= metres)).groupBy("osm_type", "osm_id").agg(F.min(F.struct("dup_m", "dup_id", "dup_type")).alias("m"))
    return best.select("osm_type", "osm_id", "m.dup_type", "m.dup_id", "m.dup_m")


def import_report(rows: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """(value, n) by a column, most frequent first; countries are asked for with most=12."""
    out = rows.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(most) if most else out


def last_of_each(batch: DataFrame, order: str) -> DataFrame:
    """Of rows with one (osm_type, osm_id) the last."""
    rest = [c for c in batch.columns if c not in ("osm_type", "osm_id")]
    return batch.groupBy("osm_type", "osm_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("osm_type", "osm_id", *[F.col("r")[c].alias(c) for c in rest])


def upsert(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """stored with batch put in: new values win where present, first_seen_at stays, was_inserted says what is new.

    A stored value outlives a missing one for name and geometry. Of batch rows with one key the one with the
    largest values stays; give the last by ``last_of_each`` where there is an order. One shuffle join on the key.
    """
    key = ["osm_type", "osm_id"]
    rest = [c for c in batch.columns if c not in key]
    comparable = [c for c in rest if not isinstance(batch.schema[c].dataType, MapType)]
    batch = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*(comparable or key))).alias("_r")).select(*key, "_r.*")
    values = [c for c in batch.columns if c not in key]
    new = batch.select(*key, F.struct(*values).alias("_new"))
    old = stored.select(*key, F.struct(*[c for c in stored.columns if c not in key]).alias("_old"))
    both = old.join(new, key, "full_outer")
    cols = []
    for c in stored.columns:
        if c in key:
            continue
        if c == "first_seen_at":
            value = F.coalesce(F.col("_old")[c], now)
        elif c == "updated_at":
            value = F.when(F.col("_new").isNotNull(), now).otherwise(F.col("_old")[c])
        elif c not in values:
            value = F.col("_old")[c]
        elif c in ("name", "geometry"):
            value = F.coalesce(F.col("_new")[c], F.col("_old")[c])
        else:
            value = F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])
        cols.append(value.alias(c))
    return both.select(*key, *cols, F.col("_old").isNull().alias("was_inserted"))


# Map objects.


def valid_osm(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("osm_type").isin("node", "way", "relation") & F.col("osm_id").isNotNull())


def _coordinates(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.format_string("%.7f %.7f", p["lon"], p["lat"])), ", ")


def way_wkt(points: Column) -> Column:
    """POLYGON of a closed run of four points or more, else LINESTRING; null below two points."""
    closed = (F.size(points) >= 4) & (F.get(points, 0) == F.get(points, F.size(points) - 1))
    return F.when(F.size(points) < 2, None).when(closed, F.concat(F.lit("POLYGON(("), _coordinates(points), F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING("), _coordinates(points), F.lit(")")))


def way_point(points: Column) -> Column:
    """Mean of a polygon's vertices, the closing one counted twice; the middle vertex of a line."""
    closed = (F.size(points) >= 4) & (F.get(points, 0) == F.get(points, F.size(points) - 1))
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[name]) / F.size(points)
    middle = F.get(points, F.floor(F.size(points) / 2).cast("int"))
    return F.when(closed, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))).when(F.size(points) >= 2, F.struct(middle["lat"].alias("lat"), middle["lon"].alias("lon")))


def on_surface(rows: DataFrame) -> DataFrame:
    """rows with surface: struct(lat, lon), a point inside the polygons of rings; null where no ring is closed.

    A parallel halfway between two neighbouring vertex latitudes, those around the middle of the tallest ring, meets no vertex; of its runs
    inside, holes and parts heeded, the widest (to 1e-9 degrees, the first of equal ones) has the point in its middle. Longitudes are counted on from the first vertex.
    """
    closed = lambda r: (F.size(r) > 3) & (F.get(r, 0) == F.element_at(r, -1))
    origin = F.col("rings")[0][0]["lon"]
    point = lambda p: F.struct(turned(p["lon"], origin).alias("lon"), p["lat"].alias("lat"))
    y, lats, xs = F.col("_y"), F.col("_lats"), F.col("_xs")

    def crossing(r: Column, i: Column) -> Column:
        a, b = F.get(r, i), F.get(r, i + 1)
        return F.when((a["lat"] > y) != (b["lat"] > y), (b["lon"] - a["lon"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    crossings = F.flatten(F.transform("_areas", lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: crossing(r, i))))
    tall = lambda f, r: f(F.transform(r, lambda p: p["lat"]))
    ring = lambda r, i: F.struct(F.round(tall(F.array_max, r) - tall(F.array_min, r), 9).alias("tall"), (-i).alias("first"), ((tall(F.array_max, r) + tall(F.array_min, r)) / 2).alias("middle"))
    run = lambda i: F.struct(F.round(F.get(xs, i + 1) - F.get(xs, i), 9).alias("wide"), (-i).alias("first"), ((F.get(xs, i) + F.get(xs, i + 1)) / 2).alias("lon"))
    steps = [
        {"_areas": F.transform(F.filter("rings", closed), lambda r: F.transform(r, point))},
        {"_lats": F.array_sort(F.array_distinct(F.transform(F.flatten("_areas"), lambda p: p["lat"])))},
        {"_middle": F.array_max(F.transform("_areas", ring))["middle"]},
        {"_y": (F.array_max(F.filter(lats, lambda v: v <= F.col("_middle"))) + F.array_min(F.filter(lats, lambda v: v > F.col("_middle")))) / 2},
        {"_xs": F.array_sort(F.filter(crossings, lambda x: x.isNotNull()))},
        {"_run": F.when(F.size(xs) > 1, F.array_max(F.transform(F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2)), run)))},
        {"surface": F.when(F.col("_run").isNotNull(), F.struct(y.alias("lat"), turned(F.col("_run.lon"), F.lit(0.0)).alias("lon")))},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    return rows.drop(*[c for step in steps[:-1] for c in step])


def located(batch: DataFrame) -> DataFrame:
    """batch(geometry, latitude, longitude, ...) with the place of a polygon inside of it; other places stay."""
    shaped = F.col("geometry").startswith("POLYGON") | F.col("geometry").startswith("MULTIPOLYGON")
    found = on_surface(batch.withColumn("rings", F.when(shaped, rings_of(F.col("geometry")))))
    place = {c: F.coalesce(F.col("surface")[k], F.col(c)) for c, k in (("latitude", "lat"), ("longitude", "lon"))}
    return found.withColumns(place).select(batch.columns)


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, geometry, latitude, longitude, tags) of ways: references resolved in order by a shuffle join.

    A way with a missing node has no geometry. A way's points are gathered per way (at most two
    thousand nodes by the map's own rules).
    """
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref", "left")
    points = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("lon", "lat").alias("p"), F.col("lat").isNull().alias("lost")))).alias("x"))
    points = points.select("id", F.when(~F.exists("x", lambda e: e["lost"]), F.transform("x", lambda e: e["p"])).alias("points"))
    out = ways.select("id", "tags").join(points, "id", "left")
    return out.select("id", way_wkt(F.col("points")).alias("geometry"), way_point(F.col("points"))["lat"].alias("latitude"), way_point(F.col("points"))["lon"].alias("longitude"), "tags")


def from_map(nodes: DataFrame, ways: DataFrame, source: str = "osm") -> DataFrame:
    """Facilities among nodes and ways; what the selectors don't take is left out before the join."""
    own = nodes.filter(is_industrial(F.col("tags")))
    point = F.format_string("POINT(%.7f %.7f)", F.col("lon"), F.col("lat"))
    a = own.select(F.lit("node").alias("osm_type"), F.col("id").alias("osm_id"), F.try_element_at("tags", F.lit("name")).alias("name"), facility_type(F.col("tags")).alias("facility_type"), "tags", F.lit(source).alias("source"), point.alias("geometry"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    w = way_geometry(ways.filter(is_industrial(F.col("tags"))), nodes).filter(F.col("geometry").isNotNull())
    b = w.select(F.lit("way").alias("osm_type"), F.col("id").alias("osm_id"), F.try_element_at("tags", F.lit("name")).alias("name"), facility_type(F.col("tags")).alias("facility_type"), "tags", F.lit(source).alias("source"), "geometry", "latitude", "longitude")
    return a.unionByName(b)


def from_elements(elements: DataFrame, source: str = "osm_live") -> DataFrame:
    """Facilities among the elements of map-query answers, which carry their own points; what has no place is left out."""
    own = valid_osm(elements.filter(is_industrial(F.col("tags"))))
    spot = F.when(F.col("osm_type") == "node", F.struct("lat", "lon")).otherwise(way_point(F.col("points")))
    wkt = F.when(F.col("osm_type") == "node", F.format_string("POINT(%.7f %.7f)", F.col("lon"), F.col("lat"))).otherwise(way_wkt(F.col("points")))
    rows = own.select("osm_type", "osm_id", F.try_element_at("tags", F.lit("name")).alias("name"), facility_type(F.col("tags")).alias("facility_type"), "tags", F.lit(source).alias("source"), wkt.alias("geometry"), spot.alias("_at"))
    return rows.filter(F.col("_at.lat").isNotNull() & F.col("_at.lon").isNotNull()).select(*rows.columns[:-1], F.col("_at.lat").alias("latitude"), F.col("_at.lon").alias("longitude"))
