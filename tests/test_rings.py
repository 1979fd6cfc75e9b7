"""Polygons from rings against a plain version, and delivered cases."""

import random

from noticelake.operators import spatial

KIND = "id int, rings array<array<struct<x:double,y:double>>>"


def closed(ring):
    ring = [p for p in ring or [] if None not in p and all(abs(v) < float("inf") for v in p)]
    return [] if len(ring) < 3 else ring if ring[0] == ring[-1] else [*ring, ring[0]]


def holds(ring, p):
    inside, (px, py) = False, p
    for (x1, y1), (x2, y2) in zip(ring, [ring[-1], *ring]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def plain(rings):
    shells, holes = [], []
    for r in map(closed, rings):
        if len(r) >= 4:
            turn = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(r, r[1:]))
            (shells if turn >= 0 else holes).append([r] if turn >= 0 else r)
    if not shells:
        return [[h[::-1]] for h in holes]
    for h in holes:
        home = next((s for s in shells if holds(s[0], h[0])), None)
        home.append(h) if home else shells.append([h[::-1]])
    return shells


def run(spark, features):
    data = [(i, [[{"x": x, "y": y} for x, y in r] if r is not None else None for r in rings]) for i, rings in features.items()]
    got = spatial.assemble(spark.createDataFrame(data, KIND).repartition(3), "id").collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.id, r.part)):
        out.setdefault(r.id, []).append([[(p.x, p.y) for p in ring] for ring in r.rings])
        assert r.part == len(out[r.id]) - 1
    return out


def square(x, y, size, clockwise, close=True):
    p = [(x, y), (x, y + size), (x + size, y + size), (x + size, y)]
    p = [(float(a), float(b)) for a, b in (p if clockwise else [p[0], *p[:0:-1]])]
    return [*p, p[0]] if close else p


def test_delivered_cases(spark):
    features = {
        1: [square(0, 0, 10, True), square(2, 2, 6, False)],  # a shell with a hole
        2: [square(2, 2, 6, False), square(0, 0, 10, True, False)],  # the hole first, the shell open
        3: [square(0, 0, 10, False)],  # no shell: the hole becomes one
        4: [square(0, 0, 10, True), square(20, 0, 10, False), square(22, 2, 2, False)],  # an orphan that takes a later hole
        5: [square(0, 0, 10, True), square(20, 0, 10, True), square(21, 1, 2, False)],  # two parts
        6: [[(0.0, 0.0), (1.0, 1.0)], [], None, [(float("nan"), 0.0), (1.0, 1.0), (2.0, 0.0)]],  # nothing is left
        7: [square(0, 0, 10, True), [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]],  # no area: a shell of its own
    }
    got = run(spark, features)
    assert got == {i: plain(r) for i, r in features.items() if plain(r)}
    assert [len(p) for p in got[4]] == [1, 2] and [len(p) for p in got[5]] == [1, 2] and 6 not in got
    assert run(spark, {1: []}) == {}


def test_random_rings_against_the_plain_version(spark):
    rng = random.Random(5)
    features = {i: [square(rng.randrange(40), rng.randrange(40), rng.choice([1, 3, 9, 25]), rng.random() < 0.3, rng.random() < 0.7) for _ in range(rng.randrange(1, 12))] for i in range(120)}
    assert run(spark, features) == {i: plain(r) for i, r in features.items()}
