"""Distances and cells as Column expressions.

Cells are cubes in earth-centred space: a point is turned into x, y, z metres, so that neither the
poles nor the date line need care. Two points within r metres along the surface are within r in
each of x, y and z, so looking into the cells that a cube of half-width r around a point touches
finds all of them, exactly, anywhere. A cell is named by a 64-bit hash of its place: joins on one
long are the fast ones, and cells that shared a name would only add pairs for the distance check.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

R = 6371000.0
METRES_PER_DEGREE = 111320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * R) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def turned(lon: Column, origin: Column) -> Column:
    """The longitude within half a turn of an origin; one that is so already stays as it is, to the last bit."""
    return lon - 360.0 * F.round((lon - origin) / 360)


def box_distance(lat: Column, lon: Column, flat: Column, flon: Column, half: Column) -> Column:
    """Metres to the nearest point of a box of half-width ``half`` degrees (null: a point). Longitudes wrap."""
    h = F.coalesce(half, F.lit(0.0))
    clamp = lambda x, c: F.greatest(c - h, F.least(c + h, x))
    return haversine(lat, lon, clamp(lat, flat), clamp(turned(lon, flon), flon))


def in_box(lat: Column, lon: Column, flat: Column, flon: Column, half: Column) -> Column:
    return F.coalesce((F.abs(lat - flat) <= half) & (F.abs(turned(lon, flon) - flon) <= half), F.lit(False))


def xyz(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.lit(R) * F.cos(a) * F.cos(b), F.lit(R) * F.cos(a) * F.sin(b), F.lit(R) * F.sin(a)]


def own_cell(lat: Column, lon: Column, size: Column | float) -> Column:
    """The cell that holds a point."""
    return F.xxhash64(*[F.floor(v / size).cast("int") for v in xyz(lat, lon)])


def cells_within(lat: Column, lon: Column, reach: Column | float, size: Column | float) -> Column:
    """Array of the cells that points within ``reach`` metres can lie in."""
    reach = reach if isinstance(reach, Column) else F.lit(float(reach))
    x, y, z = (F.sequence(F.floor((v - reach) / size).cast("int"), F.floor((v + reach) / size).cast("int")) for v in xyz(lat, lon))
    return F.flatten(F.transform(x, lambda a: F.flatten(F.transform(y, lambda b: F.transform(z, lambda c: F.xxhash64(a, b, c))))))


#: Cells of a scale are four times as wide as those of the one before.
SCALES = tuple(range(9))


def scale_of(extent: Column, size: Column | float) -> Column:
    """The first scale whose cells are wide enough for an extent: however far a thing reaches, it goes to a few cells."""
    return F.coalesce(*[F.when(extent <= size * 4.0**k / 2, k) for k in SCALES[:-1]], F.lit(SCALES[-1]))


def width(size: Column | float, scale: Column) -> Column:
    return size * F.pow(F.lit(4.0), scale)


def at_scales(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The rows once for each _scale in use; used has the few scales (and what else they go by), a row each."""
    every = rows.withColumn("_scale", F.explode(F.array(*[F.lit(k) for k in SCALES])))
    return every.join(F.broadcast(used), used.columns, "left_semi")


def cell_join(left: DataFrame, right: DataFrame, radius: float, left_at: tuple[str, str], right_at: tuple[str, str], extent: str | None = None) -> DataFrame:
    """Pairs of rows that may be within ``radius`` metres: an equi-join on cells, exact distance to be checked.

    Each left row has one cell; a right row goes to the few cells that it can be met from. extent
    names a right column with the metres that the row reaches around its point; rows that reach far meet in wider cells, in which
    each left row is then listed too. Cells are three radii wide, so a point goes to fewer than five on average. A merge, since
    exploded rows are many more than Spark expects and would be broadcast.
    """
    size = 3.0 * radius
    if extent is None:
        here = left.withColumn("_cell", own_cell(F.col(left_at[0]), F.col(left_at[1]), size))
        there = right.withColumn("_cell", F.explode(cells_within(F.col(right_at[0]), F.col(right_at[1]), radius, size)))
        return here.hint("merge").join(there, "_cell").drop("_cell")
    far = F.coalesce(F.col(extent), F.lit(0.0))
    sized = right.withColumn("_scale", scale_of(far, size))
    there = sized.withColumn("_cell", F.explode(cells_within(F.col(right_at[0]), F.col(right_at[1]), far + radius, width(size, F.col("_scale")))))
    here = at_scales(left, sized.select("_scale").distinct()).withColumn("_cell", own_cell(F.col(left_at[0]), F.col(left_at[1]), width(size, F.col("_scale"))))
    return here.hint("merge").join(there, ["_scale", "_cell"]).drop("_scale", "_cell")


def grid_cell(lat: Column, lon: Column) -> Column:
    """The screening cell: hundredths of a degree, rounded half away from zero by way of a decimal."""
    whole = lambda x: F.round((x * 100).cast("decimal(18,6)")).cast("int")
    return F.struct(whole(lat).alias("la"), whole(lon).alias("lo"))


def reach_cells(metres: float) -> int:
    """Cells that a reach covers, at least the cell itself."""
    return math.ceil(max(0.0, metres) / 1113.2)


def grid_cells_near(cell: Column, reach: int) -> Column:
    """The square of cells around one."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.struct((cell["la"] + a).alias("la"), (cell["lo"] + b).alias("lo")))))


def radius_box(lat: Column, lon: Column, metres: Column | float) -> Column:
    """struct(west, south, east, north) around a point; a degree of longitude counts 0.2 of one of latitude at least."""
    metres = metres if isinstance(metres, Column) else F.lit(float(metres))
    dlat = metres / METRES_PER_DEGREE
    dlon = dlat / F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    return F.struct((lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north"))


def tiles_of(boxes: DataFrame, chunks: int) -> DataFrame:
    """boxes(west, south, east, north) cut into chunks x chunks tiles, each as the text "w,s,e,n" to six places."""
    steps = F.sequence(F.lit(0), F.lit(chunks - 1))
    edge = lambda low, high, k: F.col(low) + k * ((F.col(high) - F.col(low)) / chunks)
    parts = boxes.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    i, j = F.col("i"), F.col("j")
    return parts.select(F.format_string("%.6f,%.6f,%.6f,%.6f", edge("west", "east", i), edge("south", "north", j), edge("west", "east", i + 1), edge("south", "north", j + 1)).alias("tile"))


def rings_of(wkt: Column) -> Column:
    """array<array<struct<lon, lat>>> of a WKT POINT, LINESTRING, POLYGON or MULTIPOLYGON, holes included."""
    groups = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda p: F.struct(point(p)[0].cast("double").alias("lon"), point(p)[1].cast("double").alias("lat"))))


def _edges(ring: Column, step) -> Column:
    """What step(a, b) gives for each edge of a ring."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: step(F.get(ring, i), F.get(ring, i + 1)))


def in_rings(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd rule over all closed rings, so holes are outside. Longitudes are counted on from the first vertex, within half a turn.

    This walks all edges: for single polygons. ``operators/cover.py`` judges many points.
    """
    origin = rings[0][0]["lon"]
    here = turned(lon, origin)

    def crosses(a: Column, b: Column) -> Column:
        ax, bx = turned(a["lon"], origin), turned(b["lon"], origin)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (bx - ax) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + ax
        return F.when(spans & (here < at), 1).otherwise(0)

    closed = lambda r: (F.size(r) > 3) & (F.get(r, 0) == F.element_at(r, -1))
    hits = F.flatten(F.transform(rings, lambda r: F.when(closed(r), _edges(r, crosses)).otherwise(F.array().cast("array<int>"))))
    return F.coalesce(F.aggregate(hits, F.lit(0), lambda s, x: s + x) % 2 == 1, F.lit(False))


def edge_distance(lat: Column, lon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Great-circle metres to an edge; its nearest point is found in a local flat projection. Longitudes wrap."""
    wrap = lambda d: d - 360 * F.round(d / 360)
    c = F.cos(F.radians(lat))
    ax, ay = wrap(alon - lon) * c, alat - lat
    dx, dy = wrap(blon - alon) * c, blat - alat
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return haversine(lat, lon, alat + t * dy, alon + t * wrap(blon - alon))


def ring_distance(lat: Column, lon: Column, rings: Column) -> Column:
    """Metres to the nearest edge of any ring; a ring of one point is an edge to itself."""
    to_edge = lambda a, b: edge_distance(lat, lon, a["lat"], a["lon"], b["lat"], b["lon"])
    return F.array_min(F.flatten(F.transform(rings, lambda r: F.when(F.size(r) >= 2, _edges(r, to_edge)).otherwise(_edges(F.concat(r, r), to_edge)))))
