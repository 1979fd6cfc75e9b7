"""Spatial queries over generated points, areas and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import duck as D
from ..functions import text as T
from ..operators import spatial as S
from .register import query

INSIDE = """(p.east >= a.x0 AND p.east < a.x0 + 2000 AND p.north >= a.y0 AND p.north < a.y0 + 1500
  AND NOT (p.east >= a.x0 + 500 AND p.east < a.x0 + 1000 AND p.north >= a.y0 + 500 AND p.north < a.y0 + 800))"""
HITS = f"hits AS (SELECT p.pt_id, a.area_id, a.layer_id FROM gpt p JOIN gar a ON {INSIDE})"
FIRST = "first_hits AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY pt_id ORDER BY CASE layer_id WHEN 21 THEN 1 WHEN 15 THEN 2 ELSE 3 END) AS r FROM hits) WHERE r = 1)"
# distance to the outside of the shell, or to the hole's sides when in the hole
NEAR = f"""near AS (SELECT pt_id, CASE WHEN ins THEN 0.0 WHEN ex < 0 OR ex > 2000 OR ny < 0 OR ny > 1500
    THEN sqrt(power(greatest(-ex, ex - 2000, 0), 2) + power(greatest(-ny, ny - 1500, 0), 2))
    ELSE least(ex - 0, 2000 - ex, ny - 0, 1500 - ny, CASE WHEN ex BETWEEN 500 AND 1000 AND ny BETWEEN 500 AND 800 THEN least(ex - 500, 1000 - ex, ny - 500, 800 - ny) ELSE 1e9 END) END AS distance, 0 AS kind, area_id AS feature_id
  FROM (SELECT p.pt_id, a.area_id, p.east - a.x0 AS ex, p.north - a.y0 AS ny, {INSIDE} AS ins FROM gpt p JOIN gar a ON p.east BETWEEN a.x0 - 250 AND a.x0 + 2250 AND p.north BETWEEN a.y0 - 250 AND a.y0 + 1750)
  UNION ALL SELECT p.pt_id, sqrt(power(p.east - f.fx, 2) + power(p.north - f.fy, 2)), 1, f.feature_id FROM gpt p JOIN gbl f ON abs(p.east - f.fx) <= 250 AND abs(p.north - f.fy) <= 250),
best AS (SELECT pt_id, arg_min(struct_pack(d := distance, k := kind, f := feature_id), struct_pack(d := distance, k := kind, f := feature_id)) AS s FROM near WHERE distance <= 250 GROUP BY 1)"""


def areas(t):
    return S.rectangle_rings(t.gar)


@query("e16_point_in_polygon", f"WITH {HITS} SELECT * FROM hits", "gpt", "gar")
def e16(t):
    return S.point_in_area(t.gpt, areas(t))


@query("e17_layer_priority", f"WITH {HITS}, {FIRST} SELECT pt_id, area_id, layer_id FROM first_hits", "gpt", "gar")
def e17(t):
    return S.priority_hits(t.gpt, areas(t))


@query("e18_point_buffer", "SELECT p.pt_id, f.feature_id FROM gpt p JOIN gbl f ON abs(p.east - f.fx) <= 120 AND abs(p.north - f.fy) <= 120", "gpt", "gbl")
def e18(t):
    return S.features_in_square(t.gpt, t.gbl, S.DIRECT_METRES).select("pt_id", "feature_id")


@query("e19_context", f"""WITH {HITS}, ctx AS (SELECT p.pt_id, 'area' AS kind, a.area_id AS feature_id FROM gpt p JOIN gar a ON p.east BETWEEN a.x0 - 1500 AND a.x0 + 3500 AND p.north BETWEEN a.y0 - 1500 AND a.y0 + 3000
 UNION SELECT pt_id, 'area', area_id FROM hits
 UNION SELECT p.pt_id, 'point', f.feature_id FROM gpt p JOIN gbl f ON abs(p.east - f.fx) <= 1500 AND abs(p.north - f.fy) <= 1500) SELECT * FROM ctx""", "gpt", "gar", "gbl")
def e19(t):
    return S.context(t.gpt, areas(t), t.gbl)


@query("e20_nearest_feature", f"WITH {NEAR} SELECT pt_id, s.f AS feature_id, CASE WHEN s.k = 0 THEN 'area' ELSE 'point' END AS kind, round(s.d, 4) AS distance FROM best", "gpt", "gar", "gbl")
def e20(t):
    return S.nearest_feature(t.gpt, areas(t), t.gbl).withColumn("distance", F.round("distance", 4))


ASSESS = f"""WITH {HITS}, {FIRST}, {NEAR}, z AS (SELECT DISTINCT pt_id FROM first_hits), b AS (SELECT DISTINCT p.pt_id FROM gpt p JOIN gbl f ON abs(p.east - f.fx) <= 120 AND abs(p.north - f.fy) <= 120),
v AS (SELECT p.pt_id, CASE WHEN z.pt_id IS NOT NULL AND b.pt_id IS NOT NULL THEN 'combined-hit' WHEN b.pt_id IS NOT NULL THEN 'protected-point' WHEN z.pt_id IS NOT NULL THEN 'protected-zone'
  WHEN location_precision = 'approximate' AND best.pt_id IS NOT NULL THEN 'manual-review' ELSE 'no-hit' END AS protection_status
  FROM gpt p LEFT JOIN z USING (pt_id) LEFT JOIN b USING (pt_id) LEFT JOIN best USING (pt_id))"""


@query("i45_protection_decision", ASSESS + " SELECT * FROM v", "gpt", "gar", "gbl")
def i45(t):
    return S.assess(t.gpt, areas(t), t.gbl)


STORED = ["no-hit", "protected-zone", "no-hit", "manual-review", "combined-hit", None, "protected-point"]


@query("j8_assess_all", ASSESS + f", o AS (SELECT pt_id, {D.pick('pt_id', STORED)} AS old_status FROM gpt) SELECT pt_id, old_status, protection_status AS new_status FROM v JOIN o USING (pt_id) WHERE old_status IS DISTINCT FROM protection_status", "gpt", "gar", "gbl")
def j8(t):
    """The records that an assessment of all rewrites: those alone whose verdict changes."""
    return S.assessment_changes(t.gpt.select("pt_id", T.pick(F.col("pt_id"), STORED).alias("protection_status")), i45(t))


@query("j8_assessment_report", ASSESS + f", o AS (SELECT pt_id, {D.pick('pt_id', STORED)} AS old_status FROM gpt) SELECT count(*) AS total, count(*) FILTER (old_status IS DISTINCT FROM protection_status) AS updated FROM v JOIN o USING (pt_id)", "gpt", "gar", "gbl")
def j8_report(t):
    total, updated = t.gpt.agg(F.count(F.lit(1)).alias("total")), j8(t).agg(F.count(F.lit(1)).alias("updated"))
    return total.crossJoin(updated)  # one row each


@query("f15_combined_assessment", ASSESS + """ SELECT pt_id % 50 AS grp, CASE WHEN bool_or(protection_status = 'combined-hit') OR (bool_or(protection_status = 'protected-point') AND bool_or(protection_status = 'protected-zone')) THEN 'combined-hit'
 WHEN bool_or(protection_status = 'protected-point') THEN 'protected-point' WHEN bool_or(protection_status = 'protected-zone') THEN 'protected-zone' WHEN bool_or(protection_status = 'manual-review') THEN 'manual-review' ELSE 'no-hit' END AS status FROM v GROUP BY 1""", "gpt", "gar", "gbl")
def f15(t):
    has = lambda s: F.bool_or(F.col("protection_status") == s)
    status = F.when(has("combined-hit") | (has("protected-point") & has("protected-zone")), "combined-hit").when(has("protected-point"), "protected-point").when(has("protected-zone"), "protected-zone").when(has("manual-review"), "manual-review").otherwise("no-hit")
    return i45(t).groupBy((F.col("pt_id") % 50).alias("grp")).agg(status.alias("status"))


@query("f16_centroid", "SELECT pt_id % 20 AS grp, round(avg(east), 3) AS east, round(avg(north), 3) AS north FROM gpt GROUP BY 1", "gpt")
def f16(t):
    return t.gpt.groupBy((F.col("pt_id") % 20).alias("grp")).agg(F.round(F.avg("east"), 3).alias("east"), F.round(F.avg("north"), 3).alias("north"))


@query("i38_coordinate_parse", "SELECT pt_id, CASE WHEN pt_id % 5 <> 0 THEN east END AS east, CASE WHEN pt_id % 5 <> 0 THEN north END AS north FROM gpt", "gpt")
def i38(t):
    e, n = F.format_string("%.1f", F.col("east")), F.format_string("%.1f", F.col("north"))
    text = F.when(F.col("pt_id") % 5 == 0, F.concat(F.lit("12,"), n)).when(F.col("pt_id") % 2 == 0, F.concat_ws(", ", n, e)).otherwise(F.concat_ws(",", e, n))
    return t.gpt.select("pt_id", S.parse_lv95(text).alias("c")).select("pt_id", "c.east", "c.north")


@query("i38_coordinates_in_text", "SELECT pt_id, CASE WHEN pt_id % 4 <> 0 THEN floor(east) END AS east, CASE WHEN pt_id % 4 <> 0 THEN floor(north) END AS north FROM gpt", "gpt")
def i38_text(t):
    """The coordinates that stand in a text."""
    e, n = F.floor("east").cast("string"), F.floor("north").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("Fax 056 "), n), F.concat(F.lit("Koordinaten "), e, F.lit(" / "), n, F.lit(" (LV95)")), F.concat(F.lit("Ost: "), e, F.lit(", Nord: "), n), F.concat(e, F.lit("/"), n)), (F.col("pt_id") % 4 + 1).cast("int"))
    return t.gpt.select("pt_id", S.lv95_in_text(text).alias("c")).select("pt_id", "c.east", "c.north")


@query("i39_ring_orientation", "SELECT area_id, r AS ring, CAST(CASE WHEN r = 1 THEN -3000000.0 ELSE 150000.0 END AS DOUBLE) AS area FROM gar, (SELECT unnest([1, 2]) AS r)", "gar")
def i39(t):
    return areas(t).select("area_id", F.posexplode("rings").alias("p", "points")).select("area_id", (F.col("p") + 1).alias("ring"), F.round(S.ring_area(F.col("points")), 3).alias("area"))


#: corners of rectangles as (x, y, width, height, clockwise, closed); what each becomes: part and place in it
RAW_RINGS = [
    [(0, 0, 2000, 1500, True, True, 0, 0), (500, 500, 500, 300, False, True, 0, 1)],
    [(500, 500, 500, 300, False, False, 0, 1), (0, 0, 2000, 1500, True, False, 0, 0), (3000, 0, 500, 500, True, True, 1, 0), (3100, 100, 100, 100, False, True, 1, 1)],
    [(0, 0, 900, 900, False, True, 0, 0), (100, 100, 100, 100, False, True, 1, 0)],
    [(0, 0, 500, 500, True, True, 0, 0), (1000, 0, 800, 800, False, False, 1, 0), (1100, 100, 100, 100, False, True, 1, 1), (100, 100, 100, 100, False, True, 0, 1)],
    [(0, 0, 500, 500, True, True, 0, 0), (100, 100, 400, 0, None, True, None, None)],
]


def raw_features(t):
    """Features with rings as they are delivered: any order, open or closed, holes before their shell, and fragments."""
    def corners(x, y, w, h, clockwise, closed, *_):
        if clockwise is None:
            return [(float(x), float(y)), (float(x + w), float(y))]
        p = [(x, y), (x, y + h), (x + w, y + h), (x + w, y)] if clockwise else [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        return [(float(a), float(b)) for a, b in (p + p[:1] if closed else p)]

    cases = t.spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in corners(*r)] for r in case]) for k, case in enumerate(RAW_RINGS)], "k long, shape array<array<struct<x:double,y:double>>>")
    rows = t.gar.join(F.broadcast(cases), F.col("area_id") % len(RAW_RINGS) == F.col("k"))  # a row for each case
    moved = F.transform("shape", lambda r: F.transform(r, lambda p: F.struct((F.col("x0") + p["x"]).alias("x"), (F.col("y0") + p["y"]).alias("y"))))
    return rows.select("area_id", "layer_id", moved.alias("rings"))


PARTS = ", ".join(f"({i}, {r[6]}, {r[7]}, {float(r[2] * r[3])})" for i, case in enumerate(RAW_RINGS) for r in case if r[6] is not None)


@query("i39_assembled_polygons", f"""SELECT area_id, part, count(*) AS rings, CAST(sum(CASE WHEN place = 0 THEN area ELSE -area END) AS DOUBLE) AS area, CAST(min(CASE WHEN place = 0 THEN -area END) AS DOUBLE) AS shell_area
FROM gar JOIN (VALUES {PARTS}) v(k, part, place, area) ON k = area_id % {len(RAW_RINGS)} GROUP BY 1, 2""", "gar")
def i39_assembled(t):
    """Polygons with their holes, from rings in any order and direction; areas of shells are negative, as they run clockwise."""
    parts = S.assemble(raw_features(t), "area_id")
    areas = F.transform("rings", lambda r: S.ring_area(r))
    total = F.abs(areas[0]) - F.aggregate(F.slice(areas, 2, F.size("rings")), F.lit(0.0), lambda s, a: s + F.abs(a))
    return parts.select("area_id", "part", F.size("rings").cast("long").alias("rings"), F.round(total, 3).alias("area"), F.round(areas[0], 3).alias("shell_area"))


BOXES = ", ".join(f"({i}, {r[6]}, {r[7]}, {r[0]}, {r[1]}, {r[2]}, {r[3]})" for i, case in enumerate(RAW_RINGS) for r in case if r[6] is not None)


@query("e16_point_in_assembled", f"""WITH b AS (SELECT area_id, layer_id, part, place, x0 + x AS a0, x0 + x + w AS a1, y0 + y AS b0, y0 + y + h AS b1 FROM gar JOIN (VALUES {BOXES}) v(k, part, place, x, y, w, h) ON k = area_id % {len(RAW_RINGS)}),
m AS (SELECT pt_id, area_id, layer_id, part, count(*) AS n FROM gpt p JOIN b ON east >= a0 AND east < a1 AND north >= b0 AND north < b1 GROUP BY 1, 2, 3, 4)
SELECT DISTINCT pt_id, area_id, layer_id FROM m WHERE n % 2 = 1""", "gpt", "gar")
def e16_assembled(t):
    """Points inside any polygon that a feature's delivered rings make up."""
    parts = S.assemble(raw_features(t), "area_id").join(t.gar.select("area_id", "layer_id"), "area_id")
    return S.point_in_parts(t.gpt, parts)


@query("i40_envelopes", "SELECT area_id, x0 AS low_x, y0 AS low_y, x0 + 2000 AS high_x, y0 + 1500 AS high_y FROM gar", "gar")
def i40(t):
    x0, y0, x1, y1 = S.envelope(F.col("rings"))
    return areas(t).select("area_id", x0.alias("low_x"), y0.alias("low_y"), x1.alias("high_x"), y1.alias("high_y"))


@query("i41_wgs84", """WITH q AS (SELECT pt_id, (east - 2600000) / 1000000 AS y, (north - 1200000) / 1000000 AS x FROM gpt)
SELECT pt_id, round((16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x) * 100 / 36, 6) AS lat,
 round((2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y) * 100 / 36, 6) AS lon FROM q""", "gpt")
def i41(t):
    lat, lon = S.to_wgs84(F.col("east"), F.col("north"))
    return t.gpt.select("pt_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("i42_feature_ids", "SELECT concat(layer_id, ':', area_id) AS feature FROM gar", "gar")
def i42(t):
    return t.gar.select(F.concat_ws(":", F.col("layer_id").cast("string"), F.col("area_id").cast("string")).alias("feature"))
