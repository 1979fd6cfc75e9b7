"""Points, areas and features on a metric grid: joins by grid cell, then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

#: area layers in the order in which a hit wins
LAYER_PRIORITY = [21, 15, 20]
DIRECT_METRES, CONTEXT_METRES, NEAR_METRES = 120.0, 1500.0, 250.0


def rectangle_rings(areas: DataFrame) -> DataFrame:
    """area_id, layer_id and rings: a 2000 x 1500 m shell with a hole from (500, 500) to (1000, 800)."""
    def ring(points):
        return F.array(*(F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y")) for dx, dy in points))

    shell = ring([(0.0, 0.0), (0.0, 1500.0), (2000.0, 1500.0), (2000.0, 0.0), (0.0, 0.0)])
    hole = ring([(500.0, 500.0), (1000.0, 500.0), (1000.0, 800.0), (500.0, 800.0), (500.0, 500.0)])
    return areas.select("area_id", "layer_id", F.array(shell, hole).alias("rings"))


def segments(ring: Column) -> Column:
    """The sides of a ring, closed if it is open."""
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.transform(F.sequence(F.lit(1), F.size(closed) - 1), lambda i: F.struct(F.element_at(closed, i).alias("a"), F.element_at(closed, i + 1).alias("b")))


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right from the point meets the ring's sides an odd number of times."""
    def crosses(s):
        up = (s["a"]["y"] > y) != (s["b"]["y"] > y)
        rise = s["b"]["y"] - s["a"]["y"]
        at = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.when(rise == 0, F.lit(1e-12)).otherwise(rise) + s["a"]["x"]
        return up & (x < at)

    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def inside(rings: Column, x: Column, y: Column) -> Column:
    """In an odd number of rings: in the shell and in no hole, for any number of parts."""
    return F.size(F.filter(rings, lambda r: crossings(r, x, y))) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace rule."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def envelope(rings: Column) -> tuple[Column, Column, Column, Column]:
    xs = F.transform(F.flatten(rings), lambda p: p["x"])
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, cell: float) -> tuple[Column, Column]:
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return span(low_x, high_x), span(low_y, high_y)


def sides(rings: Column) -> Column:
    """The sides of all rings in one list of (ax, ay, bx, by)."""
    each = F.filter(F.transform(rings, segments), lambda s: s.isNotNull())
    return F.transform(F.flatten(each), lambda s: F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), s["b"]["x"].alias("bx"), s["b"]["y"].alias("by")))


def inside_sides(sides: Column, x: Column, y: Column) -> Column:
    """As inside(), from the sides of all rings: in an odd number of rings is to meet an odd number of sides."""
    def crosses(s):
        rise = s["by"] - s["ay"]
        at = (s["bx"] - s["ax"]) * (y - s["ay"]) / F.when(rise == 0, F.lit(1e-12)).otherwise(rise) + s["ax"]
        return ((s["ay"] > y) != (s["by"] > y)) & (x < at)

    return F.size(F.filter(sides, crosses)) % 2 == 1


def area_cells(areas: DataFrame, margin: float, cell: float, level: bool = False) -> DataFrame:
    """One row per area and grid cell (acx, acy) that its envelope (x0, y0, x1, y1), widened by the margin, touches.

    Sides are made here, once for each area and not for each pair; level ones, which no ray meets, only where they are
    asked for.
    """
    every = sides(F.col("rings"))
    kept = every if level else F.filter(every, lambda s: s["ay"] != s["by"])
    ends = dict(zip(("x0", "y0", "x1", "y1"), envelope(F.col("rings")), strict=True))
    flat = areas.select(*(c for c in areas.columns if c not in ("rings", *ends)), *(c.alias(n) for n, c in ends.items()), kept.alias("sides"))
    cx, cy = cells(*(F.col(c) - margin for c in ("x0", "y0")), *(F.col(c) + margin for c in ("x1", "y1")), cell)
    return flat.withColumn("acx", F.explode(cx)).withColumn("acy", F.explode(cy))


def feature_cells(features: DataFrame, metres: float, cell: float, fx: str = "fx", fy: str = "fy") -> DataFrame:
    """One row per feature and grid cell (acx, acy) that the square around it touches."""
    cx, cy = cells(F.col(fx) - metres, F.col(fy) - metres, F.col(fx) + metres, F.col(fy) + metres, cell)
    return features.withColumn("acx", F.explode(cx)).withColumn("acy", F.explode(cy))


def with_cell(points: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col(x) / cell), "cy": F.floor(F.col(y) / cell)})


def at_cell(points: DataFrame, gridded: DataFrame, cell: float, test: Column, how: str = "inner", more: Column | None = None) -> DataFrame:
    """Points joined with rows of their cell that pass the test. A merge join at any size: tables that are small as
    files are large once they are dealt over cells, so none is broadcast."""
    met = (F.col("cx") == F.col("acx")) & (F.col("cy") == F.col("acy"))
    return with_cell(points, "east", "north", cell).join(gridded.hint("merge"), (met if more is None else met & more) & test, how)


def in_envelope(margin: float) -> Column:
    e, n = F.col("east"), F.col("north")
    return (e >= F.col("x0") - margin) & (e <= F.col("x1") + margin) & (n >= F.col("y0") - margin) & (n <= F.col("y1") + margin)


def in_sides() -> Column:
    """Within the envelope, and a metre around it that allows for rounding, and then by the exact test."""
    return in_envelope(1.0) & inside_sides(F.col("sides"), F.col("east"), F.col("north"))


def within(metres: float, fx: str = "fx", fy: str = "fy") -> Column:
    return (F.abs(F.col("east") - F.col(fx)) <= metres) & (F.abs(F.col("north") - F.col(fy)) <= metres)


def one_each(rows: DataFrame, id_col: str) -> bool:
    """Whether no two rows share an identifier."""
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def point_in_area(points: DataFrame, areas: DataFrame, cell: float = 1000.0) -> DataFrame:
    """(pt_id, area_id, layer_id) of every point inside an area."""
    return at_cell(points, area_cells(areas, 0.0, cell), cell, in_sides()).select("pt_id", "area_id", "layer_id")


def point_in_parts(points: DataFrame, parts: DataFrame, cell: float = 1000.0) -> DataFrame:
    """As point_in_area, each row once, for areas in several parts.

    A point lies in one cell, and what is found there is told apart there; only where points share an identifier rows
    from different cells can be equal.
    """
    hits = at_cell(points, area_cells(parts, 0.0, cell), cell, in_sides())
    hits = hits.dropDuplicates(["cx", "cy", "pt_id", "area_id", "layer_id"]).select("pt_id", "area_id", "layer_id")
    return hits if one_each(points, "pt_id") else hits.distinct()


def priority_hits(points: DataFrame, areas: DataFrame, cell: float = 1000.0) -> DataFrame:
    """point_in_area's rows of the first layer that has any, for each point.

    The first layer is found by a smallest rank, put together in each task; then the areas of that layer alone are met
    again. No point's hits are sorted or sent together.
    """
    rank = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in LAYER_PRIORITY)), F.col("layer_id")), F.lit(-1))
    ranked = area_cells(areas, 0.0, cell).withColumn("rank", rank)
    first = at_cell(points, ranked, cell, in_sides()).groupBy("pt_id").agg(F.min("rank").alias("first"))
    same = F.col("first") == F.col("rank")
    return at_cell(points.join(written(first, "first-layer").hint("merge"), "pt_id"), ranked, cell, in_sides(), more=same).select("pt_id", "area_id", "layer_id")


def features_in_square(points: DataFrame, features: DataFrame, metres: float, fx: str = "fx", fy: str = "fy") -> DataFrame:
    """Pairs whose distance along each axis is at most `metres` (a square, not a circle)."""
    return at_cell(points, feature_cells(features, metres, metres, fx, fy), metres, within(metres, fx, fy)).drop("cx", "cy", "acx", "acy")


def areas_in_square(points: DataFrame, areas: DataFrame, metres: float, cell: float = 1000.0) -> DataFrame:
    """(pt_id, area_id) of areas whose envelope meets the square around the point."""
    return at_cell(points, area_cells(areas, metres, cell).drop("sides"), cell, in_envelope(metres)).select("pt_id", "area_id", "layer_id")


def context(points: DataFrame, areas: DataFrame, features: DataFrame, metres: float = CONTEXT_METRES) -> DataFrame:
    """(pt_id, kind, feature_id), each once, of the areas and features in the square around each point.

    An area that holds a point is among them. A pair is met in the point's cell alone, so rows can be equal only where
    points, areas or features share identifiers; only then are they told apart, as they are many times more than all
    points and features.
    """
    a = areas_in_square(points, areas, metres).select("pt_id", F.lit("area").alias("kind"), F.col("area_id").alias("feature_id"))
    p = features_in_square(points, features, metres).select("pt_id", F.lit("point").alias("kind"), "feature_id")
    every = a.unionByName(p)
    alone = one_each(points, "pt_id") and one_each(areas, "area_id") and one_each(features, "feature_id")
    return every if alone else every.distinct()


def side_distance(s: Column, x: Column, y: Column) -> Column:
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    length = dx * dx + dy * dy
    along = ((x - s["ax"]) * dx + (y - s["ay"]) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return F.hypot(x - (s["ax"] + t * dx), y - (s["ay"] + t * dy))


def outer_distance(sides: Column, x: Column, y: Column) -> Column:
    """The distance to the nearest side of any ring, for points outside the area."""
    return F.array_min(F.transform(sides, lambda s: side_distance(s, x, y)))


def nearest_feature(points: DataFrame, areas: DataFrame, features: DataFrame, metres: float = NEAR_METRES, cell: float = 1000.0) -> DataFrame:
    """The nearest area or point feature within `metres`; areas win ties, then the smaller id.

    Nothing is nearer than an area around the point; distances are worked out for the points without one.
    """
    e, n = F.col("east"), F.col("north")
    around = written(point_in_area(points, areas, cell).groupBy("pt_id").agg(F.min("area_id").alias("feature_id")), "around")
    rest = points.join(around.hint("merge"), "pt_id", "left_anti")
    a = at_cell(rest, area_cells(areas, metres, cell, level=True), cell, in_envelope(metres + 1.0))
    a = a.select("pt_id", outer_distance(F.col("sides"), e, n).alias("distance"), F.lit(0).alias("kind"), F.col("area_id").alias("feature_id"))
    p = features_in_square(rest, features, metres)
    p = p.select("pt_id", F.hypot(e - F.col("fx"), n - F.col("fy")).alias("distance"), F.lit(1).alias("kind"), "feature_id")
    both = a.unionByName(p).filter(F.col("distance") <= metres)
    best = both.groupBy("pt_id").agg(F.min(F.struct("distance", "kind", "feature_id")).alias("s"))
    best = best.select("pt_id", "s.feature_id", F.when(F.col("s.kind") == 0, "area").otherwise("point").alias("kind"), "s.distance")
    return around.select("pt_id", "feature_id", F.lit("area").alias("kind"), F.lit(0.0).alias("distance")).unionByName(best)


def assess(points: DataFrame, areas: DataFrame, features: DataFrame, cell: float = 500.0) -> DataFrame:
    """Protection status of every point from direct area hits, direct features and what lies near.

    Verdicts ask whether there is a hit, not which: semi joins by cells end a point's search with its first one, and no
    pairs are built. What lies near is asked for approximate points without a direct hit alone, as it changes no other.
    """
    e, n = F.col("east"), F.col("north")
    at = points.select("pt_id", "east", "north")
    zones = at_cell(at, area_cells(areas, 0.0, cell), cell, in_sides(), "left_semi").select("pt_id", F.lit(True).alias("zone"), F.lit(False).alias("building"))
    buildings = at_cell(at, feature_cells(features, DIRECT_METRES, cell), cell, within(DIRECT_METRES), "left_semi").select("pt_id", F.lit(False).alias("zone"), F.lit(True).alias("building"))
    flags = written(zones.unionByName(buildings).groupBy("pt_id").agg(F.bool_or("zone").alias("zone"), F.bool_or("building").alias("building")), "assess-hits")
    rest = at.join(points.filter("location_precision = 'approximate'").select("pt_id").hint("merge"), "pt_id", "left_semi").join(flags.hint("merge"), "pt_id", "left_anti")
    near_area = in_envelope(NEAR_METRES + 1.0) & (outer_distance(F.col("sides"), e, n) <= NEAR_METRES)
    near_feature = within(NEAR_METRES) & (F.hypot(e - F.col("fx"), n - F.col("fy")) <= NEAR_METRES)
    near = at_cell(rest, area_cells(areas, NEAR_METRES, cell, level=True), cell, near_area, "left_semi").unionByName(at_cell(rest, feature_cells(features, NEAR_METRES, cell), cell, near_feature, "left_semi"))
    near = near.select("pt_id").distinct().withColumn("near", F.lit(True))
    z, b, close = (F.coalesce(c, F.lit(False)) for c in ("zone", "building", "near"))
    status = (
        F.when(e.isNull() | n.isNull(), F.lit(None).cast("string"))
        .when(z & b, "combined-hit")
        .when(b, "protected-point")
        .when(z, "protected-zone")
        .when((F.col("location_precision") == "approximate") & close, "manual-review")
        .otherwise("no-hit")
    )
    return points.join(flags.hint("merge"), "pt_id", "left").join(near.hint("merge"), "pt_id", "left").select("pt_id", status.alias("protection_status"))


def assessment_changes(stored: DataFrame, assessed: DataFrame) -> DataFrame:
    """pt_id, old and new status of the records whose verdict differs from the stored one; verdicts that could not be
    given change nothing. stored: pt_id, protection_status."""
    old = stored.select("pt_id", F.col("protection_status").alias("old_status"))
    rows = old.hint("merge").join(assessed.select("pt_id", F.col("protection_status").alias("new_status")), "pt_id")
    return rows.filter(F.col("new_status").isNotNull() & ~F.col("old_status").eqNullSafe(F.col("new_status")))


def parse_lv95(text: Column) -> Column:
    """struct(east, north) from 'a, b' in either order; null outside the country's range."""
    parts = F.transform(F.split(F.regexp_replace(text, "[' ]", ""), "[,;/]"), lambda p: p.try_cast("double"))
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    is_e, is_n = (lambda v: v.between(2400000, 2900000)), (lambda v: v.between(1000000, 1400000))
    make = lambda e, n: F.struct(e.alias("east"), n.alias("north"))
    return F.when(is_e(a) & is_n(b), make(a, b)).when(is_e(b) & is_n(a), make(b, a))


def lv95_in_text(text: Column) -> Column:
    """struct(east, north) of the first pair of metres in a text; null without one, or outside the country's range."""
    pair = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(2\d{6})\D+(1\d{6,7})\b", i)
    return parse_lv95(F.concat_ws(",", pair(1), pair(2)))


def to_wgs84(east: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude by the published approximation (about one metre); null out of bounds."""
    y, x = (east - 2600000) / 1000000, (north - 1200000) / 1000000
    lon = (2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y) * 100 / 36
    lat = (16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x) * 100 / 36
    ok = lat.between(45, 48.5) & lon.between(5, 11)
    return F.when(ok, lat), F.when(ok, lon)


def closed_ring(ring: Column) -> Column:
    """Finite points alone, the first one again at the end; empty with fewer than three points."""
    def close(points):
        closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
        return F.when(F.size(points) >= 3, closed).otherwise(F.slice(points, 1, 0))

    finite = lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)
    kept = F.filter(F.coalesce(ring, F.array().cast("array<struct<x:double,y:double>>")), lambda p: finite(p["x"]) & finite(p["y"]))
    return F.element_at(F.transform(F.array(kept), close), 1)


def is_clockwise(ring: Column) -> Column:
    """Whether the points of a closed ring run clockwise, or it has no area: such a ring is a shell."""
    return ring_area(ring) <= 0


def assemble(features: DataFrame, id_col: str, rings_col: str = "rings") -> DataFrame:
    """id_col, part, rings: the polygons of each feature's rings, the shell first and its holes after it.

    Rings are closed, and those of fewer than four points go. Clockwise rings are shells. A hole goes to the first shell
    that holds its first point; a hole outside all of them becomes a shell, turned round, and may take later holes. In
    a feature without shells every ring becomes a polygon of its own. Parts are numbered from 0, shells in their order
    before such orphans; a feature without a ring left has no parts.

    Rings meet in a join within their feature, by envelope first, and only the numbers of the rings around a hole are
    put together; a feature's rings are never compared in one expression.
    """
    rows = features.select(id_col, F.posexplode(rings_col).alias("n", "raw")).select(id_col, "n", closed_ring(F.col("raw")).alias("ring")).filter(F.size("ring") >= 4)
    x0, y0, x1, y1 = envelope(F.array("ring"))
    rows = rows.withColumns({"shell": is_clockwise(F.col("ring")), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "x": F.col("ring")[0]["x"], "y": F.col("ring")[0]["y"]})
    rows = written(rows, "rings")
    holes = rows.filter("not shell").select(id_col, F.col("n").alias("hole"), F.col("x").alias("px"), F.col("y").alias("py"))
    around = rows.select(id_col, F.col("n").alias("outer"), "shell", "ring", "x0", "y0", "x1", "y1")
    boxed = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    met = holes.join(around, id_col).filter((F.col("shell") | (F.col("outer") < F.col("hole"))) & boxed & crossings(F.col("ring"), F.col("px"), F.col("py")))
    met = met.groupBy(id_col, "hole").agg(F.min(F.when(F.col("shell"), F.col("outer"))).alias("first"), F.sort_array(F.collect_list(F.when(~F.col("shell"), F.col("outer")))).alias("earlier"))
    owned = met.filter("first is not null").select(id_col, F.col("hole").alias("n"), F.col("first").alias("owner"))
    # holes outside all shells: one after another, each looks for the first orphan before it
    lost = rows.filter("not shell").select(id_col, F.col("n").alias("hole")).join(met, [id_col, "hole"], "left").filter("first is null")
    lost = lost.join(rows.groupBy(id_col).agg(F.bool_or("shell").alias("any")), id_col)
    lost = lost.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("hole", F.when(F.col("any"), F.coalesce("earlier", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("earlier")))).alias("lost"))

    def settle(done, h):
        taken = F.filter(h["earlier"], lambda e: F.exists(done, lambda d: (d["n"] == e) & (d["owner"] == e)))
        return F.concat(done, F.array(F.struct(h["hole"].alias("n"), F.coalesce(F.try_element_at(taken, F.lit(1)), h["hole"]).alias("owner"))))

    settled = F.aggregate("lost", F.array().cast("array<struct<n:int,owner:int>>"), settle)
    orphans = lost.select(id_col, F.explode(settled).alias("s")).select(id_col, "s.n", "s.owner")
    shells = rows.filter("shell").select(id_col, "n", F.col("n").alias("owner"))
    owner = shells.unionByName(owned).unionByName(orphans)
    parts = rows.join(owner, [id_col, "n"]).withColumn("turned", F.when(~F.col("shell") & (F.col("owner") == F.col("n")), F.reverse("ring")).otherwise(F.col("ring")))
    inner = F.array_sort(F.collect_list(F.struct((F.col("n") != F.col("owner")).alias("inner"), "n", F.col("turned").alias("ring"))))
    parts = parts.groupBy(id_col, "owner").agg(inner.alias("r"), F.bool_or((F.col("n") == F.col("owner")) & ~F.col("shell")).alias("orphan"))
    order = Window.partitionBy(id_col).orderBy("orphan", "owner")
    return parts.select(id_col, (F.row_number().over(order) - 1).alias("part"), F.transform("r", lambda r: r["ring"]).alias("rings"))
