"""Joins by grid cell: against plain loops, and without broadcasts, whatever the size of the files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from noticelake.operators import spatial as S
from noticelake.plans import registry

RINGS = "array<array<struct<x:double,y:double>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def places(spark):
    """Points (some share an identifier, some have no place), areas of one or two rings, and features."""
    rng = random.Random(5)
    points = [(i % 70, *((None, 1.0) if i == 3 else (rng.uniform(-900, 4000), rng.uniform(-900, 4000))), rng.choice(["approximate", "precise", None])) for i in range(80)]
    areas = []
    for i in range(9):
        x, y, r = rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(100, 700)
        ring = lambda r, k: [(x + r * math.cos(2 * math.pi * j / k), y + r * math.sin(2 * math.pi * j / k)) for j in range(k)]  # noqa: B023, E731
        areas.append((i, rng.choice([21, 15, 20]), [ring(r, rng.randint(3, 7)), ring(r / 3, 4)]))
    areas.append((9, 15, [[(0.0, 0.0), (0.0, 800.0), (800.0, 800.0), (800.0, 0.0), (0.0, 0.0)]]))
    features = [(i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(30)]
    as_rings = lambda rs: [[{"x": a, "y": b} for a, b in r] for r in rs]
    return points, areas, features, spark.createDataFrame(points, "pt_id long, east double, north double, location_precision string"), spark.createDataFrame([(i, l, as_rings(r)) for i, l, r in areas], f"area_id long, layer_id int, rings {RINGS}"), spark.createDataFrame(features, "feature_id long, fx double, fy double")


def sides(rings):
    return [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]


def inside(rings, x, y):
    n = 0
    for (ax, ay), (bx, by) in sides(rings):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            n += 1
    return n % 2 == 1


def distance(rings, x, y):
    def to(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        length = dx * dx + dy * dy
        t = 0.0 if length == 0 else min(1.0, max(0.0, ((x - a[0]) * dx + (y - a[1]) * dy) / length))
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    return 0.0 if inside(rings, x, y) else min(to(a, b) for a, b in sides(rings))


def located(points):
    return [(i, x, y) for i, x, y, _ in points if x is not None]


def test_point_in_area(places):
    points, areas, _, p, a, _ = places
    got = S.point_in_area(p, a)
    assert sorted(map(tuple, got.collect())) == sorted((i, k, l) for i, x, y in located(points) for k, l, r in areas if inside(r, x, y))
    assert "Broadcast" not in plan(got) and "SortMergeJoin" in plan(got)


def test_features_in_square(places):
    points, _, features, p, _, f = places
    got = S.features_in_square(p, f, 300.0).select("pt_id", "feature_id")
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, x, y in located(points) for k, fx, fy in features if abs(x - fx) <= 300 and abs(y - fy) <= 300)
    assert "Broadcast" not in plan(got)


def test_first_layer(places):
    points, areas, _, p, a, _ = places
    hits = [(i, k, l) for i, x, y in located(points) for k, l, r in areas if inside(r, x, y)]
    first = {i: min(S.LAYER_PRIORITY.index(l) for j, _, l in hits if j == i) for i, _, _ in hits}
    got = S.priority_hits(p, a)
    assert sorted(map(tuple, got.collect())) == sorted(h for h in hits if S.LAYER_PRIORITY.index(h[2]) == first[h[0]])
    assert "Window" not in plan(got) and "Broadcast" not in plan(got)  # no point's hits are sorted


def test_parts_of_an_area(spark, places):
    points, areas, _, p, a, _ = places
    twice = a.unionByName(a.filter("area_id % 2 = 0"))
    got = S.point_in_parts(p, twice)
    assert sorted(map(tuple, got.collect())) == sorted({(i, k, l) for i, x, y in located(points) for k, l, r in areas if inside(r, x, y)})
    own = S.point_in_parts(p.dropDuplicates(["pt_id"]), twice)
    assert plan(own).count("Exchange") == plan(S.point_in_area(p.dropDuplicates(["pt_id"]), twice)).count("Exchange")  # hits are told apart where they are met


def test_context(places):
    points, areas, features, p, a, f = places
    box = lambda r: (min(x for q in r for x, _ in q), min(y for q in r for _, y in q), max(x for q in r for x, _ in q), max(y for q in r for _, y in q))
    want = {(i, "area", k) for i, x, y in located(points) for k, _, r in areas for b in [box(r)] if b[0] - 400 <= x <= b[2] + 400 and b[1] - 400 <= y <= b[3] + 400}
    want |= {(i, "point", k) for i, x, y in located(points) for k, fx, fy in features if abs(x - fx) <= 400 and abs(y - fy) <= 400}
    assert sorted(map(tuple, S.context(p, a, f, 400.0).collect())) == sorted(want)
    alone = S.context(p.filter("pt_id >= 10"), a, f, 400.0)
    assert "Aggregate" not in plan(alone) and "Broadcast" not in plan(alone)  # pairs are not sent round to be told apart


def test_nearest(places):
    points, areas, features, p, a, f = places
    best = {}
    for i, x, y in located(points):
        near = [(distance(r, x, y), "area", k) for k, _, r in areas] + [(math.hypot(x - fx, y - fy), "point", k) for k, fx, fy in features if abs(x - fx) <= 300 and abs(y - fy) <= 300]
        best[i] = min([b for b in near if b[0] <= 300] + ([best[i]] if best.get(i) else []), default=None)
    got = S.nearest_feature(p, a, f, 300.0)
    assert {r.pt_id: (round(r.distance, 6), r.kind, r.feature_id) for r in got.collect()} == {i: (round(b[0], 6), *b[1:]) for i, b in best.items() if b}
    assert "Broadcast" not in plan(got)


def test_verdicts(places):
    points, areas, features, p, a, f = places
    flags = {}
    for i, x, y in located(points):
        z, b, n = flags.get(i, (False, False, False))
        direct = any(abs(x - fx) <= S.DIRECT_METRES and abs(y - fy) <= S.DIRECT_METRES for _, fx, fy in features)
        near = any(distance(r, x, y) <= S.NEAR_METRES for _, _, r in areas) or any(math.hypot(x - fx, y - fy) <= S.NEAR_METRES for _, fx, fy in features)
        flags[i] = (z or any(inside(r, x, y) for _, _, r in areas), b or direct, n or near)
    want = []
    for i, x, _, precision in points:
        z, b, n = flags.get(i, (False, False, False))
        want.append((i, None if x is None else "combined-hit" if z and b else "protected-point" if b else "protected-zone" if z else "manual-review" if precision == "approximate" and n else "no-hit"))
    got = S.assess(p, a, f)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len({s for _, s in want}) == 6
    assert "Broadcast" not in plan(got)


@pytest.mark.parametrize("name", ["i45_protection_decision", "j8_assess_all", "j8_assessment_report", "f15_combined_assessment"])
def test_assessments_broadcast_no_table(spark, name):
    text = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
