"""Polygons cut into cells of a grid of degrees, so that geometry travels in small pieces only.

A cell that no edge of a polygon touches lies wholly inside or outside: the inner ones are listed and need no
geometry. A cell that edges touch has just these edges, and whether its reference point is inside. A point
of the cell is inside if its path to the reference point, along its parallel and then along the reference meridian,
crosses an even number of edges when that one is inside, an odd number when not. Along the parallel that is
precisely the even-odd rule; where the parallel meets the reference meridian within rounding of an edge the verdict is left to rounding. The
reference point lies at an irrational part of its cell, so that round coordinates never meet it.

Longitudes are counted on from a polygon's first vertex, within half a turn: edges go the short way, over +-180
too, and a polygon reaches less than 180 degrees from that vertex. Cells are then brought back to one turn of the globe. Holes and
several parts need no care: all rings count alike. A ring that isn't closed (a line, a point) has a boundary but no inside.

Each polygon takes the first of LEVELS that covers it with at most twice the root of its edges, and four, cells a side, so a
simple shape has few cells at any size and a detailed one few edges in each; a point is looked up at each level in use.

Where all pairs are asked for (``containing``), a polygon goes by the detections around it: it takes the finest level at which a cell still
has MET of them on average. What is left to geometry is then the detections along its boundary, and the cells are fewer than what they meet.

Where many polygons lie over each other and only one is asked for (the smallest fid, or any), ``thinned`` cuts crowded boundary cells into finer
ones and drops those of a polygon that a smaller one covers wholly, so a point meets a few polygons, however many it lies in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import METRES_PER_DEGREE, haversine, in_box, turned
from emberline.tables import materialize

#: Cell sizes in degrees; each divides 360.
LEVELS = (0.02, 0.1, 0.5, 2.5, 10.0)
#: Where in its cell the reference point lies.
PART = 0.41421356237309503
#: Degrees that an edge is taken to be thicker, so that rounding loses no cell.
THICK = 1e-9
EDGE = ("ax", "ay", "bx", "by")
#: Boundary cells of so many polygons in one place are cut finer.
CROWDED = 8
#: Detections a cell, on average, that make it worth while to cut a polygon into cells of that size.
MET = 16
#: So many edges of a boundary cell are held as plain columns.
FEW = 4


def _by_level(level: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), level + 1)


def _size(level: Column) -> Column:
    return _by_level(level, LEVELS)


def _round_the_globe(level: Column, ix: Column) -> Column:
    """The cell's column within one turn, from -180 on."""
    n = _by_level(level, [round(360 / g) for g in LEVELS])
    return F.pmod(ix + n / 2, n).cast("int") - (n / 2).cast("int")


def _level(span: Column, edges: Column) -> Column:
    most = F.greatest(F.lit(4.0), 2 * F.sqrt(edges))
    return F.coalesce(*[F.when(span <= g * most, k) for k, g in enumerate(LEVELS[:-1])], F.lit(len(LEVELS) - 1))


def edges_of(sites: DataFrame) -> DataFrame:
    """(fid, level, ax, ay, bx, by, closed): the edges of the polygons, longitudes counted on from the first vertex."""
    origin = F.col("rings")[0][0]["lon"]
    point = lambda p: F.struct(turned(p["lon"], origin).alias("lon"), p["lat"].alias("lat"))
    # A lone point is an edge to itself.
    ring = lambda r: F.when(F.size(r) > 1, r).otherwise(F.concat(r, r))
    placed = sites.filter(F.size(F.flatten("rings")) > 0).select("fid", F.transform("rings", lambda r: F.transform(ring(r), point)).alias("rings"))
    every = F.flatten("rings")
    span = lambda c: F.array_max(F.transform(every, lambda p: p[c])) - F.array_min(F.transform(every, lambda p: p[c]))

    def pieces(r: Column) -> Column:
        closed = (F.size(r) > 3) & (F.get(r, 0) == F.element_at(r, -1))
        return F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(F.get(r, i)["lon"].alias("ax"), F.get(r, i)["lat"].alias("ay"), F.get(r, i + 1)["lon"].alias("bx"), F.get(r, i + 1)["lat"].alias("by"), closed.alias("closed")))

    # The extent once a polygon, in columns of their own: beside the explode it would be found again for every edge.
    sized = placed.select("fid", "rings", F.greatest(span("lon"), span("lat")).alias("span"), F.size(every).alias("n"))
    return sized.select("fid", "span", "n", F.explode(F.flatten(F.transform("rings", pieces))).alias("e")).select("fid", _level(F.col("span"), F.col("n")).alias("level"), "e.*")


def _lon_at(lat: Column, e: dict[str, Column]) -> Column:
    return (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]


def _lat_at(lon: Column, e: dict[str, Column]) -> Column:
    return (e["by"] - e["ay"]) * (lon - e["ax"]) / F.nullif(e["bx"] - e["ax"], F.lit(0.0)) + e["ay"]


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def polygon_cells(sites: DataFrame) -> DataFrame:
    """(fid, level, cell, ix, iy, inside: of the reference point, edges: those that touch the cell) of sites(fid, rings).

    ix is within one turn of the globe, and so are the edges of its cell.
    """
    return cells_of(edges_of(sites.repartition(_partitions(sites), "fid")))


def _fitted(edges: DataFrame, points: DataFrame) -> DataFrame:
    """The edges at the finest level, up to their own, whose cells have MET detections on average by the counts of the cells at their own level."""
    west, east = (f(g("ax", "bx")) for f, g in ((F.min, F.least), (F.max, F.greatest)))
    south, north = (f(g("ay", "by")) for f, g in ((F.min, F.least), (F.max, F.greatest)))
    boxes = edges.groupBy("fid", "level").agg(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))
    g = _size(F.col("level"))
    reach = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - THICK) / g).cast("int"), F.floor((F.col(high) + THICK) / g).cast("int")))
    at = boxes.withColumn("ix", reach("west", "east")).withColumn("iy", reach("south", "north")).select("fid", "level", F.xxhash64("level", _round_the_globe(F.col("level"), F.col("ix")), "iy").alias("cell"))
    counts = _looked_up(points, edges).groupBy("level", "cell").agg(F.count("*").alias("n"))
    around = at.hint("merge").join(counts, ["level", "cell"], "left").groupBy("fid", "level").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean"))
    fine = F.coalesce(*[F.when((F.lit(k) < F.col("level")) & (F.col("mean") * (F.lit(size) / g) * (F.lit(size) / g) >= MET), k) for k, size in enumerate(LEVELS[:-1])], F.col("level"))
    fitted = edges.hint("merge").join(around, ["fid", "level"], "left").select("fid", fine.alias("level"), *EDGE, "closed")
    # An edge becomes many cells: dealt out first.
    return fitted.repartition(_partitions(edges), "fid")


def cells_of(edges: DataFrame) -> DataFrame:
    """``polygon_cells`` of polygons that are given by their edges."""
    cols = {c: F.col(c) for c in EDGE}
    g = _size(F.col("level"))
    low, high = (f(c["ay"], c["by"]) for f, c in ((F.least, cols), (F.greatest, cols)))
    rows = edges.withColumn("iy", F.explode(F.sequence(F.floor((low - THICK) / g).cast("int"), F.floor((high + THICK) / g).cast("int"))))
    clip = lambda lat: F.greatest(low, F.least(high, lat))
    flat = cols["ay"] == cols["by"]
    ends = [F.when(flat, own).otherwise(_lon_at(clip(lat), cols)) for own, lat in ((cols["ax"], F.col("iy") * g - THICK), (cols["bx"], (F.col("iy") + 1) * g + THICK))]
    touched = rows.withColumn("ix", F.explode(F.sequence(F.floor((F.least(*ends) - THICK) / g).cast("int"), F.floor((F.greatest(*ends) + THICK) / g).cast("int"))))
    edge = F.struct(*EDGE, "closed")
    touched = touched.select("fid", "level", "ix", "iy", F.lit(False).alias("inside"), edge.alias("edge"))
    # Runs of cells between two crossings of the row's reference parallel.
    parallel = (F.col("iy") + PART) * g
    across = rows.filter(F.col("closed") & ((cols["ay"] > parallel) != (cols["by"] > parallel))).groupBy("fid", "level", "iy").agg(F.sort_array(F.collect_list(_lon_at(parallel, cols))).alias("xs"))
    first = lambda x: F.ceil(x / g - PART).cast("int")
    run = F.explode(F.filter(F.transform("xs", lambda x, i: F.struct(first(x).alias("from"), (first(F.get("xs", i + 1)) - 1).alias("to"), (i % 2 == 0).alias("in"))), lambda r: r["in"] & (r["to"] >= r["from"])))
    within = across.select("fid", "level", "iy", run.alias("run")).select("fid", "level", F.explode(F.sequence(F.col("run.from"), F.col("run.to"))).alias("ix"), "iy", F.lit(True).alias("inside"), F.lit(None).cast("struct<ax:double,ay:double,bx:double,by:double,closed:boolean>").alias("edge"))
    cells = touched.unionByName(within).groupBy("fid", "level", "ix", "iy").agg(F.bool_or("inside").alias("inside"), F.collect_list("edge").alias("edges"))
    column = _round_the_globe(F.col("level"), F.col("ix"))
    cells = cells.withColumns({"column": column, "turns": 360.0 * F.round((F.col("ix") - column) * g / 360)})
    shifted = F.transform("edges", lambda e: F.struct((e["ax"] - F.col("turns")).alias("ax"), e["ay"].alias("ay"), (e["bx"] - F.col("turns")).alias("bx"), e["by"].alias("by"), e["closed"].alias("closed")))
    return cells.select("fid", "level", F.xxhash64("level", "column", "iy").alias("cell"), F.col("column").alias("ix"), "iy", "inside", shifted.alias("edges"))


def _covered(cells: DataFrame) -> DataFrame:
    """Boundary cells that no smaller fid covers wholly, and of inner cells one a place, of the smallest fid."""
    inner = cells.filter(F.size("edges") == 0).groupBy("level", "cell", "ix", "iy").agg(F.min("fid").alias("least"))
    cut = cells.filter(F.size("edges") > 0)
    # A place with those that hold it: the same cell, and the wider ones around it.
    places = cut.select("level", "cell", "ix", "iy").distinct()
    holders = []
    for k, g in enumerate(LEVELS):
        for wide, h in list(enumerate(LEVELS))[k:]:
            n = round(h / g)
            holders.append(F.when(F.col("level") == k, F.struct(F.lit(wide).alias("level"), F.floor(F.col("ix") / n).cast("int").alias("ix"), F.floor(F.col("iy") / n).cast("int").alias("iy"))))
    held = places.select(F.col("level").alias("own"), F.col("cell").alias("place"), F.explode(F.array_compact(F.array(*holders))).alias("h")).select("own", "place", "h.level", F.xxhash64("h.level", "h.ix", "h.iy").alias("cell"))
    least = held.hint("merge").join(inner, ["level", "cell"]).groupBy(F.col("own").alias("level"), F.col("place").alias("cell")).agg(F.min("least").alias("least"))
    left = cut.hint("merge").join(least, ["level", "cell"], "left").filter("least IS NULL OR fid < least").drop("least")
    return left.unionByName(inner.select(F.col("least").alias("fid"), "level", "cell", "ix", "iy", F.lit(True).alias("inside"), F.expr("CAST(array() AS array<struct<ax:double,ay:double,bx:double,by:double,closed:boolean>>)").alias("edges")))


def _finer(cells: DataFrame) -> DataFrame:
    """Boundary cells cut into those of the level below that an edge touches or that lie inside."""
    n = F.element_at(F.array(*[F.lit(round(LEVELS[max(k, 1)] / LEVELS[max(k, 1) - 1])) for k in range(len(LEVELS))]), F.col("level") + 1)
    parts = F.explode(F.sequence(F.lit(0), n * n - 1)).alias("part")
    rows = cells.select("fid", "level", "inside", "edges", "ix", "iy", n.alias("n"), parts)
    rows = rows.withColumns({"fx": F.col("ix") * F.col("n") + F.col("part") % F.col("n"), "fy": F.col("iy") * F.col("n") + F.floor(F.col("part") / F.col("n")).cast("int")})
    g = _size(F.col("level") - 1)
    low, high, left, right = F.col("fy") * g - THICK, (F.col("fy") + 1) * g + THICK, F.col("fx") * g - THICK, (F.col("fx") + 1) * g + THICK

    def touches(e: Column) -> Column:
        bottom, top = F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
        clip = lambda lat: F.greatest(bottom, F.least(top, lat))
        p, q = (F.when(e["ay"] == e["by"], own).otherwise(_lon_at(clip(lat), e)) for own, lat in ((e["ax"], low), (e["bx"], high)))
        return (bottom <= high) & (top >= low) & (F.least(p, q) <= right) & (F.greatest(p, q) >= left)

    inside = in_cell((F.col("fy") + PART) * g, (F.col("fx") + PART) * g)
    cut = rows.withColumns({"inner": inside, "some": F.filter("edges", touches)}).filter(F.col("inner") | (F.size("some") > 0))
    fine = F.col("level") - 1
    return cut.select("fid", fine.alias("level"), F.xxhash64(fine, "fx", "fy").alias("cell"), F.col("fx").alias("ix"), F.col("fy").alias("iy"), F.col("inner").alias("inside"), F.col("some").alias("edges"))


def thinned(cells: DataFrame) -> DataFrame:
    """Of ``polygon_cells`` what tells the smallest fid that a point is inside of, or on the edge of: a written table, few rows a place."""
    left = materialize(_covered(materialize(cells)))
    for _ in LEVELS[1:]:
        crowded = left.filter((F.size("edges") > 0) & (F.col("level") > 0)).groupBy("level", "cell").count().filter(F.col("count") > CROWDED).select("level", "cell")
        if crowded.isEmpty():
            break
        cut = left.filter(F.size("edges") > 0)
        # A cell becomes many: dealt out first, by a number that adaptive execution leaves alone.
        dealt = cut.hint("merge").join(crowded, ["level", "cell"], "left_semi").repartition(_partitions(cells), "fid", "cell")
        finer = _finer(dealt)
        stay = cut.hint("merge").join(crowded, ["level", "cell"], "left_anti").unionByName(left.filter(F.size("edges") == 0))
        left = materialize(_covered(materialize(stay.unionByName(finer))))
    return left


def box_cells(sites: DataFrame) -> DataFrame:
    """(fid, level, cell, flat, flon, half_deg): the cells that boxes of sites(fid, flat, flon, half_deg) touch."""
    half = F.col("half_deg")
    sized = sites.filter("half_deg IS NOT NULL AND flat IS NOT NULL AND flon IS NOT NULL").select("fid", "flat", "flon", "half_deg", _level(2 * half, F.lit(4)).alias("level"))
    g = _size(F.col("level"))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half - THICK) / g).cast("int"), F.floor((F.col(c) + half + THICK) / g).cast("int")))
    rows = sized.withColumn("ix", reach("flon")).withColumn("iy", reach("flat"))
    return rows.select("fid", "level", F.xxhash64("level", _round_the_globe(F.col("level"), F.col("ix")), "iy").alias("cell"), "flat", "flon", "half_deg").distinct()


def _looked_up(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points(id, latitude, longitude) at each level in use, with its cell and the longitude in the cell's turn."""
    level = F.explode(F.array(*[F.lit(k) for k in range(len(LEVELS))])).alias("level")
    at = points.select("id", "latitude", "longitude", level).join(F.broadcast(cells.select("level").distinct()), "level", "left_semi")
    g = _size(F.col("level"))
    # Wider cells by whole numbers from the finest: a point on a cell's border then lies in cells that hold each other.
    place = lambda c: F.floor(F.floor(F.col(c) / LEVELS[0]) / _by_level(F.col("level"), [round(g / LEVELS[0]) for g in LEVELS])).cast("int")
    at = at.withColumns({"ix": place("longitude"), "iy": place("latitude")})
    column = _round_the_globe(F.col("level"), F.col("ix"))
    return at.select("id", "latitude", (F.col("longitude") - 360.0 * F.round((F.col("ix") - column) * g / 360)).alias("longitude"), "level", F.xxhash64("level", column, "iy").alias("cell"))


def in_cell(lat: Column, lon: Column) -> Column:
    """Whether a point of a cell of ``polygon_cells`` is inside."""
    g = _size(F.col("level"))
    qx, qy = (F.col("ix") + PART) * g, (F.col("iy") + PART) * g

    def crossed(s: Column, e: Column) -> Column:
        x, y = _lon_at(lat, e), _lat_at(qx, e)
        along = ((e["ay"] > lat) != (e["by"] > lat)) & ((lon < x) != (qx < x))
        up = ((e["ax"] > qx) != (e["bx"] > qx)) & ((lat < y) != (qy < y))
        odd = F.coalesce(along, F.lit(False)) != F.coalesce(up, F.lit(False))
        return s != (e["closed"] & odd)

    return F.when(F.size("edges") == 0, F.col("inside")).otherwise(F.aggregate("edges", F.col("inside"), crossed))


def _plain(cells: DataFrame) -> DataFrame:
    """Boundary cells of at most FEW edges with these as plain columns, and of ``in_cell`` what needs no point: for ``_judged``."""
    g = _size(F.col("level"))
    qx, qy = (F.col("ix") + PART) * g, (F.col("iy") + PART) * g
    deep = lambda e: F.nullif(e["by"] - e["ay"], F.lit(0.0))
    up = lambda e: F.when((e["ax"] > qx) != (e["bx"] > qx), _lat_at(qx, e))
    # An edge that isn't there, or not of a closed ring, is one that no path crosses.
    none = {"ax": 0.0, "ay": 0.0, "by": 0.0, "wide": 0.0, "deep": 1.0, "up": float("inf")}
    edge = lambda e: F.when(e["closed"], F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["by"].alias("by"), (e["bx"] - e["ax"]).alias("wide"), deep(e).alias("deep"), up(e).alias("up")))
    held = cells.select("fid", "level", "cell", F.coalesce("inside", F.lit(False)).alias("inside"), qx.alias("qx"), qy.alias("qy"), F.transform("edges", edge).alias("edges"))
    return held.select("*", *[F.coalesce(F.get("edges", F.lit(i))[c], F.lit(x)).alias(f"{c}{i}") for i in range(FEW) for c, x in none.items()]).drop("edges")


def _judged() -> Column:
    """``in_cell`` of a detection that has met a cell of ``_plain``: arithmetic on columns, which Spark compiles into the join."""
    lat, lon, qx, qy = (F.col(c) for c in ("latitude", "longitude", "qx", "qy"))

    def crossed(s: Column, i: int) -> Column:
        ax, ay, by, wide, deep, up = (F.col(f"{c}{i}") for c in ("ax", "ay", "by", "wide", "deep", "up"))
        x = wide * (lat - ay) / deep + ax
        return s != ((((ay > lat) != (by > lat)) & ((lon < x) != (qx < x))) != ((lat < up) != (qy < up)))

    return reduce(crossed, range(FEW), F.col("inside"))


def within_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, fid): each detection with each polygon of ``polygon_cells`` that it lies inside."""
    at = _looked_up(points, cells)
    return at.hint("merge").join(cells, ["level", "cell"]).filter(in_cell(F.col("latitude"), F.col("longitude"))).select("id", "fid")


def _many_within(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``within_cells`` where a detection lies inside many: inner cells meet ids alone, boundary cells of few edges plain columns.

    Cells are dealt by a number that adaptive execution leaves alone, since what they meet is many times what it sees.
    """
    at = _looked_up(points, cells).filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    dealt = lambda rows: rows.repartition(_partitions(rows), "level", "cell")
    met = lambda left, right: dealt(left).hint("merge").join(dealt(right), ["level", "cell"])
    n = F.size("edges")
    inner = met(at.select("id", "level", "cell"), cells.filter((n == 0) & F.col("inside")).select("fid", "level", "cell"))
    few = met(at, _plain(cells.filter((n > 0) & (n <= FEW)))).filter(_judged())
    many = met(at, cells.filter(n > FEW)).filter(in_cell(F.col("latitude"), F.col("longitude")))
    return reduce(DataFrame.unionByName, [x.select("id", "fid") for x in (inner, few, many)])


def first_touching(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, fid, outside): of the polygons that a detection is inside of, or at no distance from, the one with the smallest fid."""
    met = _looked_up(points, cells).hint("merge").join(cells, ["level", "cell"])
    met = met.select("id", "fid", "latitude", "longitude", in_cell(F.col("latitude"), F.col("longitude")).alias("inside"), "edges")
    inside = met.filter("inside").select("id", "fid", F.lit(False).alias("outside"))
    # Its place is within a hair of the edge: only there the distance is asked for.
    close = F.exists("edges", lambda e: (F.least(e["ax"], e["bx"]) - THICK <= F.col("longitude")) & (F.col("longitude") <= F.greatest(e["ax"], e["bx"]) + THICK) & (F.least(e["ay"], e["by"]) - THICK <= F.col("latitude")) & (F.col("latitude") <= F.greatest(e["ay"], e["by"]) + THICK))
    by = met.filter(~F.col("inside") & close).select("id", "fid", "latitude", "longitude", F.explode("edges").alias("edge"), F.lit(None).cast("double").alias("half_deg"), F.lit(0.0).alias("flat"), F.lit(0.0).alias("flon"))
    on = with_metres(by).filter("metres = 0").select("id", "fid", F.lit(True).alias("outside"))
    return inside.unionByName(on).groupBy("id").agg(F.min(F.struct("fid", "outside")).alias("one")).select("id", "one.*")


def inside_any(points: DataFrame, facilities: DataFrame) -> DataFrame:
    """(id): the detections inside some facility, by polygon or box, each once; far less work than ``containing`` where facilities lie over each other."""
    if "rings" not in facilities.columns:
        return containing(points, facilities).select("id").distinct()
    cells = thinned(polygon_cells(facilities.filter("rings IS NOT NULL").select("fid", "rings")))
    found = within_cells(points, cells).select("id")
    boxes = facilities.filter("rings IS NULL").drop("rings")
    return found.unionByName(containing(points, boxes).select("id")).distinct()


def containing(points: DataFrame, facilities: DataFrame) -> DataFrame:
    """(id, fid): each detection with each facility, by polygon or box, that it lies inside; a polygon goes before a box."""
    found = []
    boxed = facilities
    if "rings" in facilities.columns:
        # Written, or every filter on rings would make them again, before they are dealt out.
        facilities = materialize(facilities.select([c for c in facilities.columns if c in ("fid", "rings", "flat", "flon", "half_deg")]))
        sites = facilities.filter("rings IS NOT NULL").select("fid", "rings")
        edges = materialize(edges_of(sites.repartition("fid")))
        found.append(_many_within(points, materialize(cells_of(_fitted(edges, points)))))
        boxed = facilities.filter("rings IS NULL")
    if "half_deg" in facilities.columns:
        cells = box_cells(boxed)
        at = _looked_up(points, cells)
        inside = in_box(F.col("latitude"), F.col("longitude"), F.col("flat"), F.col("flon"), F.col("half_deg"))
        found.append(at.hint("merge").join(cells, ["level", "cell"]).filter(inside).select("id", "fid"))
    return reduce(DataFrame.unionByName, found) if found else points.select("id").limit(0).withColumn("fid", F.lit(None).cast("long"))


def boundary_sites(cells: DataFrame) -> DataFrame:
    """(fid, site, flat, flon, extent_m, edges): the cells that boundaries touch, each a small site around its centre."""
    g = _size(F.col("level"))
    return cells.filter(F.size("edges") > 0).select("fid", F.col("cell").alias("site"), ((F.col("iy") + 0.5) * g).alias("flat"), ((F.col("ix") + 0.5) * g).alias("flon"), (g * METRES_PER_DEGREE * 0.72).alias("extent_m"), "edges")


def with_metres(pairs: DataFrame) -> DataFrame:
    """pairs with metres: from (latitude, longitude) to the edge, or where it is null to the box or point of the site.

    ``geo.edge_distance`` step by step: as one expression each step would be repeated in the next.
    """
    lat, lon, e = F.col("latitude"), F.col("longitude"), F.col("edge")
    wrap = lambda d: d - 360 * F.round(d / 360)
    h = F.coalesce(F.col("half_deg"), F.lit(0.0))
    clamp = lambda x, c: F.greatest(c - h, F.least(c + h, x))
    steps = [
        {"_c": F.cos(F.radians(lat)), "_ax": wrap(e["ax"] - lon), "_ay": e["ay"] - lat, "_dx": wrap(e["bx"] - e["ax"]), "_dy": e["by"] - e["ay"], "_lon": turned(lon, F.col("flon"))},
        {"_px": F.col("_ax") * F.col("_c"), "_pdx": F.col("_dx") * F.col("_c")},
        {"_length": F.col("_pdx") * F.col("_pdx") + F.col("_dy") * F.col("_dy"), "_dot": F.col("_px") * F.col("_pdx") + F.col("_ay") * F.col("_dy")},
        {"_t": F.when(F.col("_length") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("_dot") / F.col("_length")))).otherwise(0.0)},
        {"_nlat": F.coalesce(e["ay"] + F.col("_t") * F.col("_dy"), clamp(lat, F.col("flat"))), "_nlon": F.coalesce(e["ax"] + F.col("_t") * F.col("_dx"), clamp(F.col("_lon"), F.col("flon")))},
        {"metres": haversine(lat, lon, F.col("_nlat"), F.col("_nlon"))},
    ]
    for step in steps:
        pairs = pairs.withColumns(step)
    return pairs.drop(*[c for step in steps[:-1] for c in step])
