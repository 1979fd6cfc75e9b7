"""Page strategies and the dispatch by source type against plain Python."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from noticelake.plans import webpages
from noticelake.sources import payloads

BLOCK = "<p>Bauherrschaft: A Bauvorhaben: {} Bauplatz: Weg 1</p>"
ROW = "<tr><td>{}</td><td>A</td><td>{}</td></tr>"
HEAD = "<tr></tr><tr><th>Nr</th><th>Bauherrschaft</th><th>Bauvorhaben</th></tr>"
LINK = '<a href="/the/und/les">the und les</a>'
PAGES = {
    1: BLOCK.format("Garage") + BLOCK.format("Haus") + LINK,
    2: LINK + LINK,
    3: f"<table>{HEAD}{ROW.format(1, 'Stall')}{ROW.format(2, 'Dach')}<tr><td>x</td></tr></table>",
    4: f"<title>Other</title><table><tr><th>Nr</th></tr>{ROW.format(1, 'No')}</table>",
    5: "<p>no feed</p>",
    6: "<title>Bauherrschaft</title>",
    10: "a feed is put here",
    15: "<title>Empty</title>",
}


@pytest.fixture
def t(spark):
    npg = spark.createDataFrame([(i, "https://a.example/p", h) for i, h in PAGES.items()], "page_id long, url string, html string")
    site = [(15, 0, "https://a.example.ch/", '<li><a href="/baugesuche">Baugesuche</a></li>'), (16, 1, "https://a.example.ch/baugesuche", "<p>Baugesuche: Parzelle 1</p>"), (6, 0, "https://b.example.ch/", '<a href="/kontakt">Baugesuch</a>')]
    return SimpleNamespace(npg=npg, site=spark.createDataFrame(site, "page_id long, place int, url string, html string"))


def strategies(html):
    blocks = re.findall("Bauvorhaben: (.*?) Bauplatz:", html)
    links = re.findall("<a [^>]*>(.*?)</a>", html)
    rows = [r for r in (re.findall("<t[dh]>(.*?)</t[dh]>", x) for x in re.findall("<tr>(.*?)</tr>", html)) if r]
    grid = [r[2] for r in rows[1:] if len(r) >= 3] if rows and "Bauherrschaft" in rows[0] else []
    whole = ["".join(re.findall("<title>(.*?)</title>", html)[:1])]
    return next((n, titles) for n, titles in enumerate([blocks, links, grid, whole]) if titles)


def test_page_strategies(t):
    want = [(i, n, title) for i, h in PAGES.items() for n, titles in [strategies(h)] for title in titles]
    assert sorted(map(tuple, webpages.a5(t).select("page_id", "strategy", "title").collect())) == sorted(want)
    assert {n for _, n, _ in want} == {0, 1, 2, 3}


def test_dispatch(t):
    got = {r.page_id: (r["items"], r.reader) for r in webpages.a16(t).collect()}
    want = {1: (2, "html"), 2: (2, "html"), 3: (2, "html"), 4: (0, "none"), 5: (0, "none"), 6: (0, "none"), 10: (2, "xml"), 15: (1, "discovered")}
    assert got == want


def test_frames_are_trusted_by_their_address(spark):
    html = '<iframe src="https://x.example.com/baugesuche"></iframe><iframe src="https://b.example.ch/wetter"></iframe><iframe src="https://b.example.ch/publikation"></iframe><iframe srcdoc="Bauplatz"></iframe><iframe srcdoc="Wetter"></iframe><iframe src="/d"></iframe>'
    pages = spark.createDataFrame([(1, "https://a.example.com/", html)], "page_id long, url string, html string")
    stored = spark.createDataFrame([("https://b.example.ch/publikation", "Bauvorhaben"), ("https://a.example.com/d", "Bauvorhaben"), ("https://x.example.com/baugesuche", "Bauplatz")], "url string, html string")
    got = {(r.pos, r.src, r.body) for r in payloads.frames(pages, stored).collect()}
    assert got == {(2, "https://b.example.ch/publikation", "Bauvorhaben"), (3, None, "Bauplatz")}


def test_archive_stops_at_the_first_empty_page(spark):
    entry = '<article class="entry"><b class="rubric">Baugesuche</b><i class="title">{}</i></article>'
    rows = [(0, True, entry.format("a") + entry.format("b")), (1, False, ""), (2, True, entry.format("a")), (3, True, ""), (4, True, entry.format("c"))]
    pages = spark.createDataFrame(rows, "page long, ok boolean, html string")
    assert sorted((r.title, r.page) for r in payloads.archive_scan(pages, "title").collect()) == [("a", 0), ("b", 0)]
    r = payloads.archive_report(pages, "title").first()
    assert (r.pages, r.failed, r.raw, r.imported, r.skipped, r.first_page, r.last_page) == (4, 1, 3, 2, 1, 0, 2)
    assert payloads.archive_scan(pages.filter(F.col("page") < 3), "title").count() == 2
