"""The project of a notice: what a label, the parts of its title or the name of its page say, else a given name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from . import addresses as A

#: fixed values: labels of a project, and those that may follow
LABELS = ["Bauobjekt", "Bauvorhaben", "Bauprojekt"]
FOLLOWING = (
    r"Bauplatz|Baustelle|Standort|Lage|Bauherr|Bauherrschaft|Gesuchsteller/in|Grundeigentümer/in|Grundeigentümer|Projektverfasser|Bewilligungen|Weitere\s+Bewilligung|Weitere\s+Bewilligungen|"
    r"Frist|Auflagefrist|Planauflage|Publiziert|Publikation"
)
#: fixed values: what stands around a project's name
CUTS = [
    r"(?is)\s*-\s*(?:frist|auflage|publiziert)\b.*$", r"(?i)\bBG\s*20\d{2}(?:[-/.]\d+)?\b", r"(?i)\bBaugesuch(?:e)?\b[:\s-]*", r"(?i)\bAmtliche Publikation(?:en)?\b[:\s-]*", r"(?i)\bPublikation\b[:\s-]*",
    r"(?iu)\b(?:Gesuchsteller(?:/in)?|Grundeigentümer(?:/in)?|Bauherr(?:schaft)?|Projektverfasser)\b.*$", r"(?i)\bZusatzgesuche?\b.*$", r"(?is)\bFrist bis\b.*$", r"(?i)\(\s*ohne Profilierung\s*\)",
]
#: fixed values: names that are no project
LISTING = r"(?i)\b(facebook|instagram|youtube|linkedin|whatsapp|gemeinderatsnachrichten|nachrichten|newsletter|veranstaltungen|agenda|termine|vernehmlassung(?:en)?|news|aktuelles)\b"
ARCHIVE = r"(?i)\b(rss|archiv|archive|newsarchive|author|category|feed)\b"
DOWNLOAD = r"(?i)\b(herunterladen|download)\b"
MONTH = r"(?iu)^(?:januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember)\s+20\d{2}$"
GARBLED = r"(?iu)\b(name-sort|datum-sort|data-page-length|_kategorieid|_thumbnail|customerid=|readspeaker|sind sie sicher, dass sie diesen eintrag löschen möchten|cms cms)\b"
GRANTED = r"(?i)\b(erteilte baubewilligungen?|baubewilligung(?:en)? erteilt|erteilte bewilligungen?)\b"
#: fixed values: the project that says no more than that there is a request, the mark of what is no open request, and most characters
REQUEST, NOT_IMPORTED, MOST = "Baugesuch", "Nicht importieren", 120


def lone_date(x: Column) -> Column:
    """A text that is nothing but a day, a month with its year, or a year."""
    return A.any_of(x, [rf"(?iu)^{dates.PART}$", r"(?i)^20\d{2}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:[+-]\d{2}:\d{2}|Z)?)?$", MONTH, r"^\d{4}$"])


def trimmed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"^[,;/\s-]+|[,;/\s-]+$", ""))


def cleaned(x: Column, address: Column) -> Column:
    """A part of a notice without the address (a sanitized one) and what else stands around a project; '' for what is none."""
    def judged(t):
        none = (t == "") | A.any_of(t, [GARBLED, DOWNLOAD, ARCHIVE, LISTING, MONTH]) | lone_date(t)
        return F.when(none, "").otherwise(T.shorten(t, MOST, "…"))

    def without_address(t):
        first = F.concat(F.lit(r"(?isu)^(.*?)(?:,|/)?\s*\Q"), F.replace(address, F.lit("\\"), F.lit("")), F.lit(rf"\E{A.END}"))
        return F.when(address == "", t).otherwise(trimmed(F.regexp_replace(t, first, F.lit("$1"))))

    return T.bound(T.bound(trimmed(A.cut(T.collapse(x), CUTS)), without_address), judged)


def page_name(url: Column) -> Column:
    """The last part of a page's path as words, without its kind of file."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    last = F.coalesce(F.try_url_decode(F.regexp_extract(path, r"([^/]+)/*$", 1)), F.lit(""))
    return F.regexp_replace(F.regexp_replace(last, r"(?i)\.(?:html?|php|pdf)$", ""), "[_-]+", " ")


def in_front_of(title: Column, address: Column) -> Column:
    """The parts of a title that stand in front of the address, the nearest first."""
    at = F.instr(F.lower(title), F.lower(address))
    front = F.regexp_replace(title.substr(F.lit(1), at - 1), r"[,\s;/-]+$", "")
    return F.when((address != "") & (at > 1), F.reverse(F.split(front, r"\s*[;,/]\s*"))).otherwise(F.array().cast("array<string>"))


def project_name(text: Column, fallback: Column, address: Column, url: Column) -> Column:
    """The project that a notice names.

    A label's value goes before the title's parts: what follows the part with the word for a request; what follows a
    semicolon; what stands before the address; the page's name. The first of these that is left after cleaning counts.
    A title of a request, its applicant and a place names no project. Without a name: the mark of granted permits, the
    fallback unless it is a date or a listing, or just a request. Blank and null arguments count as empty.
    """
    def named(t, a):
        labelled = A.first_of(F.array(*(T.collapse(F.regexp_extract(t, rf"(?iu){label}\s*:?\s*(.+?)(?=\b(?:{FOLLOWING})\b\s*:|$)", 1)) for label in LABELS)))
        after_request = F.regexp_extract(t, r"(?i)^(?:(?:(?!\bbaugesuch\b)[^/])*/)*?[^/]*\bbaugesuch\b[^/]*(?:/\s*)+([^/]+)", 1)
        parts = F.split(t, r"\s*,\s*")
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        placed = part(2).rlike(A.STREET) | part(2).rlike(r"(?i)\bParz(?:elle|\.| Nr\.?)?\s*\d{1,6}\b")
        applicant = part(0).rlike("(?i)^baugesuch$") & placed & (part(1) != "") & ~part(1).rlike(A.STREET) & ~part(1).rlike(r"(?i)\bparz")
        title = F.trim(F.regexp_replace(t, r"(?i)\s*-\s*frist\b.*$", ""))
        titled = T.bound(title, lambda h: F.concat(F.array(F.regexp_extract(h, r"^[^;]*;(.*)$", 1)), in_front_of(h, a), F.array(page_name(url))))
        none = F.array().cast("array<string>")

        def chosen(s):
            sources = F.when(s["label"] != "", F.array(s["label"])).when(t == "", none).when(s["after"] != "", F.array(s["after"])).when(s["applicant"], none).otherwise(titled)
            return F.struct(s["label"].alias("label"), ((s["after"] == "") & s["applicant"]).alias("applicant"), A.first_of(F.transform(sources, lambda x: cleaned(x, a))).alias("name"))

        def told(s):
            other = T.collapse(fallback)
            no_name = (other == "") | lone_date(other) | A.any_of(other, [LISTING, ARCHIVE, DOWNLOAD])
            return (
                F.when(s["label"] != "", F.regexp_replace(s["name"], r"[.;:,]\s*$", "")).when(s["name"] != "", s["name"]).when(s["applicant"], REQUEST)
                .when(t.rlike(GRANTED), NOT_IMPORTED).when(no_name, REQUEST).otherwise(T.shorten(other, MOST, "…"))
            )

        facts = F.struct(labelled.alias("label"), T.collapse(after_request).alias("after"), applicant.alias("applicant"))
        return T.bound(T.bound(facts, chosen), told)

    return T.bound(T.collapse(text), lambda t: T.bound(A.sanitize(F.coalesce(address, F.lit(""))), lambda a: named(t, a)))


def specificity(project: Column) -> Column:
    """0 for no project or what is not to be imported, 1 for a request without a name, 2 for a name."""
    p = T.collapse(project)
    return F.when(p.isin("", NOT_IMPORTED), 0).when(p == REQUEST, 1).otherwise(2)
