"""Finding a site's permit page among its links, and judging stored pages.

Scores are data: a rule names what it looks at and a list of (pattern, points), of which the first that matches counts.
The same lists make the SQL of the registered queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import catalog as C
from . import pages as P
from .worklist import first_per_key

#: fixed values: patterns and points of the scores, in lower case
PERMIT = "baugesuch|baupublikation|auflagebaugesuche"
WRONG_TOPIC = r"einbürger|fahrplan|verkehrsverbund|\bzvv\b|gemeindeversammlung|abstimmung|\bwahlen\b|newsletter|veranstaltung|\bagenda\b|kontakt|impressum|datenschutz|\blogin\b|\bjobs\b|stellen|bibliothek|kindergarten|erteilte baubewilligung|erteilte bewilligung|baubewilligung erteilt"
PUBLICATION = "baugesuch|baupublikation|öffentliche auflage|amtliche publikation|amtliches publikationsorgan|baubewilligung"
CONCRETE = "bauherrschaft|bauobjekt|bauplatz|orts?lage|parzelle|planauflage|einwendungen|einsprachefrist|auflage vom"
LISTING = r"anzeige der ergebnisse|ergebnisse\s+\d+\s+bis|insgesamt\s+\d+|rubrik|amtliche publikationen|amtliches publikationsorgan|öffentliche auflagen"
LISTING_PATH = "baugesuche?$|baupublikationen?|baugesuchspublikationen?|auflagebaugesuche|amtliche-publikationen?|publikationen?|oeffentliche-auflage|öffentliche-auflage|laufende-auflagen|aktuell(?:es)?$"
SINGLE_PATH = r"/news-detail/|/archiv-detail/|/artikel/|/news/\d+\b|/\d{4}/\d{2}/\d{2}/"
NOT_PENDING = r"\b(?:erteilte baubewilligungen?|baubewilligung(?:en)? erteilt|erteilte bewilligungen?)\b"
PROTECTED = "login-geschützt|login geschützt|zugriff geschützt|anmeldung erforderlich|ebauportal|smartserviceportal"
LINK_RULES = [
    ("path", [(PERMIT, 6), ("öffentliche-auflage|amtliche-publikation", 4), ("publikation", 2)]),
    ("near", [("baugesuch|baupublikation", 5), ("öffentliche auflage", 4), ("amtliche publikation|amtliches publikationsorgan", 3), ("publikation", 1)]),
    ("context", [(LISTING, 3)]),
    ("path", [(SINGLE_PATH, -4)]),
]
CONTENT_RULES = [
    ("path", [(PERMIT, 10), ("öffentliche-auflage", 7), ("publikation", 4)]),
    ("text", [("baugesuch|baupublikation", 8)]),
    ("text", [("öffentliche auflage", 5)]),
    ("text", [("amtliche publikation|amtliches publikationsorgan", 3)]),
    ("text", [(CONCRETE, 5)]),
    ("path", [(LISTING_PATH, 7)]),
    ("text", [(LISTING, 5)]),
    ("both", [("ebauportal|login-geschützt|login geschützt", -6)]),
    ("both", [(NOT_PENDING, -18)]),
    ("path", [(SINGLE_PATH, -22)]),
]
#: fixed values: signals of an audited page: name, points, what is looked at, pattern, and a pattern of the text that rules it out
SOURCE_SIGNAL = "baugesuch|baupublikation|baubewilligung|planauflage|oeffentliche auflage|öffentliche auflage|amtliche publikation|amtliches publikationsorgan"
FIELD_SIGNAL = "bauherrschaft|bauobjekt|bauvorhaben|bauplatz|ortslage|parzelle|planauflage|einsprachefrist|einwendungen|auflage vom|auflagefrist|gesuchsteller"
LIST_SIGNAL = r"rubrik|baugesuche|anzeige der ergebnisse|ergebnisse\s+\d+\s+bis|insgesamt\s+\d+|laufende auflagen|öffentliche auflagen"
AUDIT_RULES = [
    ("url-permit", 14, "path", PERMIT, None),
    ("text-publication", 12, "text", SOURCE_SIGNAL, None),
    ("permit-fields", 8, "text", FIELD_SIGNAL, None),
    ("listing", 6, "text", LIST_SIGNAL, None),
    ("portal", 6, "both", r"ebauportal|\be-?bau\b", None),
    ("wrong-topic", -10, "path", WRONG_TOPIC, SOURCE_SIGNAL),
    ("single-notice", -12, "path", SINGLE_PATH, LIST_SIGNAL),
    ("protected", 0, "both", PROTECTED, None),
]
ACCEPT = 8


def score(rules: list, **subjects: Column) -> Column:
    """Sum over the rules of the points of each one's first pattern that matches; one array, so that the code stays small."""
    points = []
    for subject, choices in rules:
        c = F.when(F.lit(False), 0)
        for pattern, n in choices:
            c = c.when(subjects[subject].rlike(pattern), n)
        points.append(c.otherwise(0))
    return total(points)


def total(points: list[Column]) -> Column:
    return F.aggregate(F.array(*points), F.lit(0), lambda s, p: s + p)


def path_of(url: Column) -> Column:
    """Path and query of an address, decoded, in lower case."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    return F.lower(F.coalesce(F.try_url_decode(raw), raw))


def link_candidates(pages: DataFrame) -> DataFrame:
    """page_id, target, score of the links to the page's own host that speak for permits; each target's best."""
    links = P.anchors_in_context(pages)
    links = P.once(links, target=P.resolve(F.col("url"), F.col("href")), label=F.lower("label"), context=F.lower("context"))
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#]+)", 1))
    rows = links.filter((host(F.col("target")) == host(F.col("url"))) & C.is_public_url(F.col("target")))
    rows = P.once(rows, path=path_of(F.col("target")))
    label, context = F.col("label"), F.col("context")
    rows = rows.filter(~label.rlike(WRONG_TOPIC) & ~F.col("path").rlike(WRONG_TOPIC))
    rows = rows.withColumn("score", score(LINK_RULES, path=F.col("path"), near=F.concat_ws(" ", label, context), context=context)).filter("score > 0")
    return rows.groupBy("page_id", "target").agg(F.max("score").alias("score"))


def content_scores(pages: DataFrame) -> DataFrame:
    """target, content_score of the pages that publish permits by their text, or by their address and some sign in the page."""
    linked = F.regexp_count(F.lower("html"), F.lit(r"(?s)<a\s[^>]*>[^<]*(?:baugesuch|baupublikation)"))
    text = F.lower(T.strip_html(P.content_region(F.col("html"))))
    rows = P.once(pages.select(F.col("url").alias("target"), "html"), path=path_of(F.col("target")), text=text, linked=linked).withColumn("both", F.concat_ws(" ", "path", "text"))
    terms = lambda c: F.regexp_count(c, F.lit("baugesuch|baupublikation"))
    counts = F.when(terms("text") >= 2, 3).otherwise(0) + F.when(terms("both") >= 3, 5).otherwise(0) + F.when(F.col("linked") >= 2, 8).otherwise(0)
    by_text = F.col("text").rlike(PUBLICATION)
    by_url = F.col("path").rlike(PUBLICATION) & ((F.col("linked") > 0) | F.col("text").rlike(CONCRETE) | F.col("text").rlike(LISTING))
    points = score(CONTENT_RULES, path=F.col("path"), text=F.col("text"), both=F.col("both")) + counts
    return rows.filter(by_text | by_url).select("target", points.alias("content_score"))


def discover(starts: DataFrame, pages: DataFrame, first: int = 12, accept: int = ACCEPT) -> DataFrame:
    """page_id, target, total: for each start page the best stored page among its `first` best links, if it reaches `accept`."""
    short = first_per_key(link_candidates(starts), ["page_id"], [F.desc("score"), "target"], first)
    rated = short.join(content_scores(pages), "target").withColumn("total", F.col("score") + F.col("content_score"))
    return first_per_key(rated.filter(F.col("total") >= accept), ["page_id"], [F.desc("total"), "target"]).select("page_id", "target", "total")


def audit(pages: DataFrame, found: DataFrame, verified: DataFrame) -> DataFrame:
    """page_id, score, signals, status, confidence of pages (page_id, url, html, http_status).

    found: (page_id, ...) pages for which discovery knows a better one; verified: (page_id) of sources that were confirmed
    by hand, which counts where the page itself cannot be read.
    """
    title, path = P.title(F.col("html")), path_of(F.col("url"))
    rows = P.once(pages, path=path, text=F.lower(F.concat_ws(" ", title, T.strip_html(F.col("html")))))
    rows = rows.withColumn("both", F.concat_ws(" ", "path", "text"))
    hit = {}
    for name, _, subject, pattern, unless in AUDIT_RULES:
        hit[name] = F.col(subject).rlike(pattern) & (~F.col("text").rlike(unless) if unless else F.lit(True))
    several = F.regexp_count("both", F.lit("baugesuch|baupublikation")) >= 2
    points = total([*(F.when(hit[name], p).otherwise(0) for name, p, *_ in AUDIT_RULES), F.when(several, 5).otherwise(0)])
    names = F.array_compact(F.array(*(F.when(hit[name], F.lit(name)) for name, *_ in AUDIT_RULES), F.when(several, F.lit("several"))))
    rows = rows.withColumns({"score": points, "signals": F.array_join(names, ",")})
    rows = rows.join(found.select("page_id", F.lit(True).alias("found")), "page_id", "left").join(verified.select("page_id", F.lit(True).alias("verified")), "page_id", "left")
    ok, locked = F.col("http_status") == 200, F.col("http_status").isin(401, 403)
    has = lambda n: F.array_contains(F.split("signals", ","), n)
    verdicts = [
        (F.col("verified").isNotNull() & ~ok, "ok-external-verified", F.lit(84)),
        (F.col("found").isNotNull(), "ok-discovered", F.when(ok, 90).otherwise(86)),
        (locked, "protected-or-login", F.lit(78)),
        (~ok, "needs-review-unreachable", F.lit(35)),
        (F.col("score") >= 22, "ok-direct", F.lit(96)),
        ((F.col("score") >= 12) & has("text-publication"), "ok-direct-low", F.lit(88)),
        (F.col("path").rlike("publikation"), "ok-official-publication-list", F.lit(82)),
        (has("protected"), "protected-or-login", F.lit(76)),
    ]
    status, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for c, name, n in verdicts:
        status, sure = status.when(c, name), sure.when(c, n)
    weak = F.greatest(F.lit(45), F.least(F.lit(72), 45 + F.col("score")))
    return rows.select("page_id", "score", "signals", status.otherwise("needs-review-weak-signal").alias("status"), sure.otherwise(weak).alias("confidence"))
