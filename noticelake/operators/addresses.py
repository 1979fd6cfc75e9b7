"""Addresses out of texts, titles and page addresses: candidates, what makes them an address, and the most specific one.

Everything is a column. Each step binds what the next one looks at, so that a text is searched once for each rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

END = "(?![A-Za-z0-9_])"
MONTHS = "januar|februar|märz|maerz|marz|april|mai|juni|juli|august|september|oktober|november|dezember"
#: fixed values: how streets end, in a text with a number too
STREET = rf"(?i)(?:strasse|weg|gasse|platz|allee|ring|rain|hof|matt|halde|park|dorf|steig|quai|ufer|matte|acker|feld|weid|zelg|zelgli|hubel|hueb|huebel|büel|bühl){END}"
STREET_ENDS = "strasse|weg|gasse|gässli|gaessli|platz|allee|ring|rain|hof|matt|halde|park|dorf|steig|quai|ufer|matte|acker|feld|weid|zelg|zelgli|hubel|hueb|huebel|büel|bühl"
PARCEL_ONLY = r"(?i)^Parzelle\s+\d{1,6}$"
PARCEL = r"(?iu)\bParz(?:ellen?|\.| Nr\.?)?\s*(?:[-:]|\s)*(?:(?:(?:GB|Grundbuch)\s+)?[\p{L}() .'-]+?\s+)?(?:Nrn?\.?|Nr\.?)?\s*(\d{1,6})\b"
#: fixed values: words that follow an address, and what is cut from one
NOTICE = r"öffentliche(?:\s+auflage)?|publiziert|publikation|veröffentlicht|frist(?:ende)?|einsprachfrist|auflage(?:frist)?|mehr lesen|zuletzt synchronisiert"
CUTS = [
    rf"(?i)\s+(?:{NOTICE}){END}(?s:.*)$",
    r"(?i)^(?:Bauherrschaft|Bauherr|Gesuchsteller(?:/in)?|Grundeigentümer(?:/in)?)\s*:\s*[^,;]+,\s*",
    r"(?i)^[–-]\s*20\d{2}(?:[-/.]\d+)?\s*-\s*,?\s*",
    rf"(?i)(?<![A-Za-z0-9_])(?:{NOTICE}){END}(?s:.*)$",
    r"(?i)\b(?:Zone(?:\(n\))?|Weitere Bewilligungen?|Kant(?:onale)?\.?\s+Zustimmung|Planauflage|Zusatzgesuche?)\b(?s:.*)$",
    r"(?i)\bGebäude\s+Nr\.?\s*\d+[A-Za-z]?\b[;,]?\s*",
    r"(?i)\(\s*ohne Profilierung\s*\)",
]
#: fixed values: what is no address at all, and what is none unless it names a street (or, at last, a parcel)
NEVER = [
    rf"(?i)^(?:(?:mo|di|mi|do|fr|sa|so)[a-z]*,?\s*)?\d{{1,2}}\.\s*(?:\d{{1,2}}\.|(?:{MONTHS}))\s*\d{{4}}$|^\d{{4}}-\d{{2}}-\d{{2}}$|^\d{{4}}$",
    rf"(?i)^(?:im|ab)?\s*(?:anfang|mitte|ende)?\s*(?:{MONTHS})\s+20\d{{2}}$",
    rf"(?i)^vom\s+\d{{1,2}}\.\s*(?:{MONTHS})\s+20\d{{2}}\s+bis\s+\d{{1,2}}\.\s*(?:{MONTHS})\s+20\d{{2}}$",
    r"(?i)^(?:pdf|doc|src)\b[\w\s-]*\bbg\b",
    r"(?i)\b(facebook|instagram|youtube|linkedin|whatsapp|gemeinderatsnachrichten|nachrichten|newsletter|veranstaltungen|agenda|termine|vernehmlassung(?:en)?|news|aktuelles)\b",
    r"(?i)\b(rss|archiv|archive|newsarchive|author|category|feed)\b",
    r"(?i)\b(name-sort|datum-sort|data-page-length|_kategorieid|_thumbnail|customerid=|readspeaker|sind sie sicher, dass sie diesen eintrag löschen möchten|cms cms)\b",
]
NO_STREET = [
    r"(?i)\b(erteilte baubewilligungen?|baubewilligung(?:en)? erteilt|erteilte bewilligungen?)\b",
    r"(?i)\b(herunterladen|download)\b",
    r"(?i)\bBG\s*20\d{2}(?:[-/.]\d+)?\b",
    r"(?i)\b(baugesuch(?:e)?|baubewilligung(?:en)?|baupublikation(?:en)?|publikation(?:en)?|öffentliche auflage|amtliche publikation(?:en)?|gemeindequelle|gemeinde-webseite|wohnraumstrategie|einbürgerungen|gemeinderatsnachrichten|facebook)\b",
]
NO_PLACE = r"(?i)\b(einwohnergemeinde|ortsbürgergemeinde|projektänderung|bauausschreibung|kanzlei|baupublikationen|auflagebaugesuche|amtliche publikationen?)\b"
PROJECT = r"(?i)\b(sanierung|umbau|umnutzung|anbau|neubau|ersatzneubau|erweiterung|ausbau|rückbau|rueckbau|renovation|aufwertungsmassnahmen?|baugesuch|publikation)\b"
NOT_IMPORTED = r"(?i)(?:öffentliche auflage|baugesuch(?:-nr)?|publiziert|planauflage|auflagefrist|gemeindekanzlei)"
#: fixed values: labels of an address in the order in which they are looked for, and those that may follow
#: fixed values: parcels in a gazette, lists of parcels, and parcels by themselves where lists are looked for
GAZETTE_PARCEL = r"(?iu)\b(?:Parzellen?|Parz|Kat(?:aster)?|GB|Grundst(?:ü|ue)ck)\.?[-:\s]*(?:(?:(?:GB|Grundbuch)\s+)?[\p{L}() .'-]+?\s+)?(?:Nrn?\.?:?[-:\s]*)?(\d{1,6})"
PARCEL_LIST = r"(?iu)\b(?:Parzellen?|Parz)\s*\.?\s*(?:-|:|\s)*(?:(?:(?:GB|Grundbuch)\s+)?[\p{L}() .'-]+?\s+)?(?:Nrn?\.?|Nr\.?)?\s*(\d{1,6}(?:\s*(?:,|/|und)\s*\d{1,6}){0,9})"
PARCEL_OF_LIST = r"(?iu)\b(?:Parzellen?|Parz)\s*\.?\s*(?:-|:|\s)*(?:(?:(?:GB|Grundbuch)\s+)?[\p{L}() .'-]+?\s+)?(?:Nrn?\.?|Nr\.?)?\s*(\d{1,6})\b"
#: fixed values: labels of a place
LABELS = [r"Parzelle\s+/\s+Strasse", "Parzelle/Strasse", "Bauplatz", "Baustelle", "Standort", "Lage"]
FOLLOWING = r"Bauherr|Bauherrschaft|Gesuchsteller/in|Grundeigentümer/in|Grundeigentümer|Bauobjekt|Bauvorhaben|Bauprojekt|Bewilligungen|Weitere\s+Bewilligung|Weitere\s+Bewilligungen|Frist|Auflagefrist|Planauflage|Projektverfasser|Publiziert|Publikation|Zone|Zone\(n\)"
OWN_PARCEL = r"(?i)^\s*Parz(?:elle|\.| Nr\.?)?\s*(?:Nr\.?\s*)?\d{1,6}\s*,?\s*"
LABEL_CUTS = [
    OWN_PARCEL, r"^\s*\d{1,6}\s*,\s*(?=[A-ZÄÖÜ][A-Za-zÄÖÜäöüéèà'’.-])", r"(?i),\s*Parz(?:elle|\.| Nr\.?)?.*$", r"(?i)\bParz(?:elle|\.| Nr\.?)?\s*(?:Nr\.?\s*)?\d{1,6}\b", *CUTS[5:],
    r"(?i)\b(?:Zone(?:\(n\))?|Weitere Bewilligungen?|Kant(?:onale)?\.?\s+Zustimmung|Planauflage)\b.*$", r"(?i)[\s/,]*\bBG\s*20\d{2}\.\d+\b.*$",
]
#: fixed values: streets and named places with a number
SPOKEN = [
    rf"(?iu)\b([A-ZÄÖÜ][A-Za-zÄÖÜäöüéèà'’.-]*(?:{STREET_ENDS})\s+\d+[A-Za-z]?)\b",
    rf"\b([A-ZÄÖÜ][A-Za-zÄÖÜäöüéèà'’.-]+(?:\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüéèà'’.-]+){{1,6}}(?:{STREET_ENDS})?\s+\d+[A-Za-z]?)\b",
]


def cut(x: Column, patterns: list[str]) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    return x


def any_of(x: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches; each is compiled once, which a pattern out of an array is not."""
    out = x.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | x.rlike(p)
    return out


def first_of(values: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(1)), F.lit(""))


def parcel(x: Column) -> Column:
    return F.regexp_extract(x, PARCEL, 1)


def gazette_parcel(x: Column) -> Column:
    """The first parcel of a gazette's text, which also names registers and plots of land; '' for none."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), GAZETTE_PARCEL, 1)


def parcels(x: Column) -> Column:
    """All parcels of a text, each once: those of lists, then single ones. Postcodes with their town are none."""
    def found(t):
        lists = F.transform(F.regexp_extract_all(t, F.lit(PARCEL_LIST), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"(\d{1,6})"), F.lit(1)))
        return F.array_distinct(F.concat(F.flatten(lists), F.regexp_extract_all(t, F.lit(PARCEL_OF_LIST), F.lit(1))))

    return T.bound(F.regexp_replace(T.collapse(x), r"(?u),\s*\d{4}\s+[A-ZÄÖÜ][\p{L}() .'-]+", " "), found)


def sanitize(x: Column) -> Column:
    """An address without what stands around it; '' for what is none. A street goes before a parcel in the same text."""
    def judged(t):
        street = t.rlike(STREET)
        refused = (t == "") | ~t.rlike("[A-Za-zÄÖÜäöü0-9]") | any_of(t, NEVER) | (~street & any_of(t, NO_STREET)) | (~street & t.rlike(NO_PLACE) & ~t.rlike(r"(?i)\bParz(?:elle|\.| Nr\.?)?\b"))
        plain = F.regexp_replace(cut(t, [OWN_PARCEL]), r"\b(?:\d{4}\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüéèà'’.-]+(?:\s*\([^)]+\))?)(?![A-Za-z0-9_])", "")
        number = parcel(t)
        return F.when(refused, "").when(street, F.trim(F.regexp_replace(plain, r"^[,;:-]+\s*|\s*[,;:\-.]+$", ""))).when(number != "", F.concat(F.lit("Parzelle "), number)).otherwise(t)

    edges = F.regexp_replace(F.regexp_replace(T.collapse(x), r"^[,;:-]+\s*", ""), r"\s*[,;:-]+$", "")
    return T.bound(T.collapse(cut(edges, CUTS)), judged)


def from_text(x: Column) -> Column:
    """The first address of a text: behind a label (its street, else its parcel), else a street or place with a number."""
    def labelled(value):
        def street_or_parcel(s):
            sure = s.rlike(STREET) | (s.rlike(r"\b\d{1,4}[A-Za-z]?\b") & s.rlike("[A-Za-zÄÖÜäöü]") & ~s.rlike(NEVER[0]))
            number = parcel(value)
            return F.when((s != "") & sure, s).when(number != "", F.concat(F.lit("Parzelle "), number)).otherwise("")

        return T.bound(sanitize(F.trim(cut(value, LABEL_CUTS))), street_or_parcel)

    def found(t):
        values = F.array(*(T.collapse(F.regexp_extract(t, rf"(?i){label}\s*:?\s*(.+?)(?=\b(?:{FOLLOWING})(?![A-Za-z0-9_])\s*:|$)", 1)) for label in LABELS))
        spoken = F.array(*(F.regexp_extract(t, p, 1) for p in SPOKEN))
        behind = F.when(t.rlike(f"(?i){'|'.join(LABELS)}"), F.transform(F.filter(values, lambda v: v != ""), labelled)).otherwise(F.array().cast("array<string>"))
        return first_of(F.concat(behind, F.transform(F.filter(spoken, lambda v: v != ""), sanitize)))

    # the first mention of a request goes
    once = lambda t: F.when(t.rlike(r"(?i)\bBaugesuche?\b"), F.regexp_replace(t, r"(?i)^(.*?)\bBaugesuche?\b[:\s-]*", "$1")).otherwise(t)
    return T.bound(T.bound(T.collapse(x), once), lambda t: F.when(t == "", "").otherwise(found(t)))


def from_title(x: Column) -> Column:
    """The last part of a title, between slashes, that holds an address."""
    return first_of(F.transform(F.reverse(F.split(T.collapse(x), r"\s*/\s*")), from_text))


def capitalised(x: Column) -> Column:
    """Words with a capital where the whole text has none."""
    words = F.transform(F.split(x, r"\s+"), lambda w: F.when(w.rlike(r"^\d+[A-Za-z]?$"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))))
    return F.when(~x.rlike("[A-ZÄÖÜ]") & x.rlike("[a-zäöü]"), F.array_join(words, " ")).otherwise(x)


def from_url(x: Column) -> Column:
    """The address in the last part of a page's path that is no lone number."""
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(x, F.lit("")), r"^(?i)https?://[^/?#]+([^?#]*)", 1), "/"), lambda p: p != "")
    last = T.bound(parts, lambda p: F.when((F.size(p) > 1) & F.try_element_at(p, F.lit(-1)).rlike(r"^\d+$"), F.try_element_at(p, F.lit(-2))).otherwise(F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(""))))
    slug = T.bound(last, lambda p: F.coalesce(F.try_url_decode(p), F.lit("")))
    slug = F.regexp_replace(F.regexp_replace(slug, r"(?i)\.(?:html?|php|pdf)$", ""), r"(?i)^bg[-_]?20\d{2}(?:[-_.]?\d+)?[-_]?", "")
    return from_text(T.bound(F.translate(slug, "_-", "  "), capitalised))


def more_specific(first: Column, second: Column) -> Column:
    """The second of two addresses where it says more: a number, a street for a parcel or no street, a corner, or much more text."""
    numbered, street = (lambda a: a.rlike(r"\d+[A-Za-z]?$")), (lambda a: a.rlike(STREET))
    longer = street(first) & street(second) & ((second.contains("/") & ~first.contains("/")) | (F.length(second) > F.length(first) + 6))
    better = (numbered(second) & ~numbered(first)) | (first.rlike(PARCEL_ONLY) & ~second.rlike(PARCEL_ONLY)) | (street(second) & ~street(first)) | longer
    return F.when(first == "", second).when(second == "", first).when(better, second).otherwise(first)


def best(candidates: list[Column]) -> Column:
    """The most specific of candidates in the order in which they are believed, by one pass over them."""
    kept = F.transform(F.filter(F.array(*candidates), lambda c: F.coalesce(c, F.lit("")) != ""), sanitize)
    return F.aggregate(kept, F.lit(""), more_specific)


def ladder(text: Column, title: Column, url: Column) -> Column:
    """The address of a notice from its text, its title and its page."""
    return best([from_text(text), from_title(title), from_url(url)])


def imported(address: Column, number: Column) -> Column:
    """The address as it is stored: too long, a notice, a project or a number becomes the parcel, if there is one."""
    def stored(a):
        place = a.rlike(STREET) | a.rlike(PARCEL_ONLY)
        none = (a == "") | (F.length(a) > 120) | a.rlike(NOT_IMPORTED) | (~place & a.rlike(PROJECT)) | a.rlike(r"^\d{4,}")
        parcel_text = F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("Parzelle "), number)).otherwise("")
        return F.when(none, parcel_text).otherwise(capitalised(a))

    return T.bound(sanitize(address), stored)
