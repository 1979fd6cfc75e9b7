"""Finding addresses and parcels in a gazetteer, and repairing the location of records with what is found.

A name may stand anywhere inside an entry's text, so entries are indexed by their words and by short pieces of their
text without blanks. A request looks up one key for its municipality and one for its street or parcel; what meets on
both keys is tested exactly. No entry meets a request that shares neither.

Entries with the same text fit the same requests, so each text is indexed once and stands for its first entry. Requests
are written out: where they are few, entries are cut down to their keys before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.work import written
from . import spatial as S

#: fixed values: names at least so long may be contained in an entry's text, shorter ones must be a word of it
WHOLE_TOWN, WHOLE_STREET = 8, 6
#: fixed values: origins that stand for a whole region
COARSE = ["gg25", "kantone", "district", "gazetteer", "sn25", "zipcode"]
#: fixed values: words that are no street names
STREET_STOP_WORDS = """adresse aus amtsblatt pruefen lage bauplatz baustelle standort bauobjekt bauvorhaben bauherr bauherrschaft neubau umbau abbruch
anbau ersatzneubau sanierung gartengestaltung garten umnutzung parzelle parzellen gemeinde schweiz aargau kanton zone frist der die das und von ueber
mit fuer den dem ohne sowie objekt projekt""".split()
#: fixed values: how words for streets end
STREET_ENDS = "strasse|weg|gasse|platz|allee|ring|rain|hof|matt|halde|park|dorf|steig|quai|ufer|matte|acker|feld|weid|zelg|zelgli|hubel|hueb|huebel|büel|bühl"
END = "(?![A-Za-z0-9_])"
NONE = "array<string>"
#: fixed values: dates, and addresses that are not asked for
DATES = r"(?:\d{1,2}\.\d{1,2}\.20\d{2}|(?:(?:montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag),?\s*)?\d{1,2}\.\s*(?:januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember)\s*20\d{2})"
NO_ADDRESS = r"(?i)\b(einwohnergemeinde|ortsbürgergemeinde|projektänderung|bauausschreibung|kanzlei|baupublikationen|auflagebaugesuche|amtliche publikationen?|sanierung|umbau|umnutzung|anbau|neubau|ersatzneubau|erweiterung|ausbau|rückbau|rueckbau|renovation|aufwertungsmassnahmen?|baugesuch|publikation)(?![A-Za-z0-9_])"
LONE_NUMBER = r"(?iu)^(?:Haus(?:nummer|nr\.?)?|Geb(?:äude)?(?:\s+Nr\.?)?|Nr\.?)?\s*(\d{1,4}[a-z]?)$"
WITH_NUMBER = r"^[A-Za-zÄÖÜäöü][A-Za-zÄÖÜäöüéèà.'-]*(?:\s+[A-Za-zÄÖÜäöüéèà0-9.'-]+){0,3}\s+\d{1,3}\s?[a-z]?$"


def loose(x: Column) -> Column:
    """Lower case letters and digits alone; umlauts as two letters; without (ag)."""
    t = F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("(ag)"), F.lit(""))
    for sign, letters in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        t = F.replace(t, F.lit(sign), F.lit(letters))
    return F.regexp_replace(t, "[^a-z0-9]", "")


def words(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), T.WHITE), loose), lambda w: w != "")


def street_token(address: Column) -> Column:
    """The longest word of four letters or more, street names first; '' without any. The earlier of equally long ones."""
    parts = F.split(F.regexp_replace(T.collapse(address), "[.,;:/()]", " "), T.WHITE)
    named = F.transform(parts, lambda w, i: F.struct((~w.rlike(f"(?i)(?:{STREET_ENDS}){END}")).alias("plain"), (-F.length(loose(w))).alias("short"), i.alias("i"), loose(w).alias("token"), w.rlike("[A-Za-zÄÖÜäöü]").alias("letters")))
    able = F.filter(named, lambda w: w["letters"] & (w["short"] <= -4) & ~w["token"].isin(*STREET_STOP_WORDS))
    return F.coalesce(F.try_element_at(F.array_sort(able), F.lit(1))["token"], F.lit(""))


def parcel_token(address: Column) -> Column:
    return F.regexp_extract(T.collapse(address), r"(?i)^Parzellen?\s+(?:Nrn?\.?\s+)?(\d{1,6})$", 1)


def has_house_number(address: Column) -> Column:
    """Whether a number of up to three digits is left without dates and longer numbers."""
    t = F.regexp_replace(F.regexp_replace(T.collapse(address), f"(?i){DATES}", " "), r"\b\d{4,}\b", " ")
    return t.rlike(r"(?i)\b\d{1,3}\s?[a-z]?\b")


def can_ask(address: Column) -> Column:
    """Whether a gazetteer is asked for an address: a parcel, or a street or name with a number that is no project."""
    t = T.collapse(address)
    return t.rlike(r"(?i)^Parzelle\s+\d{1,6}$") | (~t.rlike(LONE_NUMBER) & ~t.rlike(NO_ADDRESS) & (t.rlike(f"(?i)(?:{STREET_ENDS}){END}") | t.rlike(WITH_NUMBER)))


def lv95(first: Column, second: Column) -> tuple[Column, Column]:
    """East and north, whichever comes first."""
    east, north = (lambda v: v.between(2400000, 2900000)), (lambda v: v.between(1000000, 1400000))
    swapped = north(first) & east(second)
    return F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)


def pieces(x: Column, n: int, mark: str) -> Column:
    """All pieces of n letters, with a mark in front."""
    def every(x):
        found = F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.concat(F.lit(mark), x.substr(i, F.lit(n))))
        return F.when(F.length(x) >= n, found).otherwise(F.array().cast(NONE))

    return T.bound(x, every)


def lookup_key(token: Column, whole: int) -> Column:
    """The key of a name: its first `whole` letters where it may be contained, else the name as a word."""
    return F.when(F.length(token) >= whole, F.concat(F.lit("g:"), F.substring(token, 1, whole))).otherwise(F.concat(F.lit("t:"), token))


def index_keys(words: Column, text: Column, whole: int) -> Column:
    """All keys under which an entry, by its words and its loose text, may be looked up."""
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("t:"), w)), pieces(text, whole, "g:")))


def names(token: Column, words: Column, text: Column, whole: int) -> Column:
    """Whether an entry names the token: as a word, or anywhere in its text where the token is long enough."""
    return F.array_contains(words, token) | ((F.length(token) >= whole) & F.contains(text, token))


def match_addresses(requests: DataFrame, entries: DataFrame, id_col: str, approximate: bool = True) -> DataFrame:
    """id_col, x, y, precision of the requests (municipality, address) that the gazetteer finds.

    entries: entry_id, label, detail, origin, x, y, rank. An entry fits if its text names the municipality and the
    parcel, or else the street, of the request. A fit is precise if the entry stands for no region and the request is a
    parcel or has a house number. The first precise entry by rank wins, else (approximate) the first one.

    Addresses are taken apart once for each distinct municipality and address, and answered once for each distinct
    municipality, street, parcel and presence of a number.
    """
    town, street, parcel = loose(F.col("municipality")), street_token(F.col("address")), parcel_token(F.col("address"))
    spoken = ["municipality", "address"]  # null in either is never found
    asked = requests.select(spoken).distinct().filter(can_ask(F.col("address")))
    asked = written(asked.select(*spoken, town.alias("town"), street.alias("street"), parcel.alias("parcel"), has_house_number(F.col("address")).alias("numbered")), "asked")
    request = ["town", "street", "parcel", "numbered"]
    places = F.array_compact(F.array(F.when(F.col("parcel") != "", F.concat(F.lit("p:"), "parcel")), F.when(F.col("street") != "", lookup_key(F.col("street"), WHOLE_STREET))))
    each = asked.filter("town <> ''").select(request).distinct().withColumn("at", lookup_key(F.col("town"), WHOLE_TOWN)).withColumn("place", F.explode(places))
    each = written(each, "requests")

    label = F.concat_ws(" ", T.blank_to_null(F.col("label")), T.blank_to_null(F.col("detail")))
    coarse = F.coalesce(F.lower("origin").isin(*COARSE), F.lit(False))
    text = F.col("label")
    numbers = F.filter(F.transform(F.split(text, T.WHITE), lambda w: F.regexp_replace(w, "[^0-9]", "")), lambda w: w != "")
    found = first_entries(entries, label.alias("label"), coarse.alias("coarse")).select("first", "coarse", words(text).alias("words"), loose(text).alias("text"), numbers.alias("numbers"))
    found = found.withColumn("at", F.explode(index_keys(F.col("words"), F.col("text"), WHOLE_TOWN))).join(each.select("at").distinct(), "at", "left_semi")
    keys = F.concat(F.transform("numbers", lambda n: F.concat(F.lit("p:"), n)), index_keys(F.col("words"), F.col("text"), WHOLE_STREET))
    found = found.withColumn("place", F.explode(F.array_distinct(keys))).drop("numbers").join(each, ["at", "place"])

    by_parcel = F.col("place").startswith("p:")
    fits = lambda token, whole: names(F.col(token), F.col("words"), F.col("text"), whole)
    found = found.filter(fits("town", WHOLE_TOWN) & (by_parcel | fits("street", WHOLE_STREET)))
    vague = F.col("coarse") | ~((F.col("parcel") != "") | F.col("numbered"))
    best = found.groupBy(*request).agg(F.min(F.struct(vague.alias("vague"), "first")).alias("s"))
    best = best if approximate else best.filter("not s.vague")
    answers = asked.join(best, request).select(*spoken, "s.first.x", "s.first.y", F.when(F.col("s.vague"), "approximate").otherwise("precise").alias("precision"))
    return requests.select(id_col, *spoken).join(written(answers, "answers"), spoken).select(id_col, "x", "y", "precision")


def first_entries(entries: DataFrame, *by: Column) -> DataFrame:
    """`by`, first: of the entries with a place that are equal in `by` the first by rank, as (rank, entry_id, x, y)."""
    east, north = lv95(F.col("x"), F.col("y"))
    rows = entries.filter("x is not null and y is not null").select(*by, F.struct("rank", "entry_id", east.alias("x"), north.alias("y")).alias("first"))
    return rows.groupBy(*(c for c in rows.columns if c != "first")).agg(F.min("first").alias("first"))


def match_parcels(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """municipality, parcel, x, y of the requests that are found: the first entry whose detail begins with the parcel's
    number and names the municipality, at any length."""
    short = 4
    asked = requests.select("municipality", "parcel").distinct().select("municipality", "parcel", loose(F.col("municipality")).alias("town")).filter("town <> '' and parcel <> ''")
    asked = written(asked.withColumn("at", F.substring("town", 1, short)), "asked")
    found = first_entries(entries, F.col("detail")).select("first", F.split(F.trim("detail"), T.WHITE)[0].alias("parcel"), loose(F.col("detail")).alias("text"))
    found = found.join(asked.select("parcel").distinct(), "parcel", "left_semi")
    sizes = F.flatten(F.array(*(pieces(F.col("text"), n, "") for n in range(1, short + 1))))
    found = found.withColumn("at", F.explode(F.array_distinct(sizes))).join(asked, ["parcel", "at"]).filter(F.contains("text", "town"))
    best = found.groupBy("municipality", "parcel").agg(F.min("first").alias("s"))
    return best.select("municipality", "parcel", "s.x", "s.y")


#: fixed values: patterns of parcels, streets and labels in the texts of records
PLACEHOLDER = r"(?i)^adresse\s+(?:pruefen|prüfen|von\s+(?:webseite|pdf)\s+(?:pruefen|prüfen)|aus\s+amtsblatt\s+(?:pruefen|prüfen))$"
PARCEL = r"(?iu)\b(?:Parzellen?|Parz)\s*\.?\s*(?:-|:|\s)*(?:(?:(?:GB|Grundbuch)\s+)?[\p{L}() .'-]+?\s+)?(?:Nrn?\.?|Nr\.?)?\s*(\d{1,6})\b"
PARCELS = r"(?iu)\b(?:Parzellen?|Parz)\s*\.?\s*(?:-|:|\s)*(?:(?:(?:GB|Grundbuch)\s+)?[\p{L}() .'-]+?\s+)?(?:Nrn?\.?|Nr\.?)?\s*(\d{1,6}(?:\s*(?:,|/|und)\s*\d{1,6}){0,9})"
STREET = r"\b([A-ZÄÖÜ][A-Za-zÄÖÜäöüéèàÉÈÀ.\- ]{0,58}(?:strasse|str\.|weg|gasse|platz|allee|ring|rain|halde|steig|matte|acker|feld|quai|ufer)\s*(?:\d{1,4}[A-Za-z]?)?)(?![A-Za-z0-9_])"
NAMED = r"\b((?:Am|Im|In der|In den|An der|Auf der|Beim|Bei der|Obere|Untere|Unter|Ober)\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüéèàÉÈÀ.\- ]{2,54}\s+\d{1,4}[A-Za-z]?)\b"
LABEL = r"(?i)(?<!Auf)\b(?:Parzelle\s*/\s*Strasse|Bauparzelle|Objektadresse|Bauplatz|Bauort|Baustelle|Standort|Ortslage|Lage)\s*:?\s*"
NEXT_FIELD = r"(?i)(?:\||\b(?:Parzelle\s*/\s*Strasse|Bauparzelle|Objektadresse|Bauherr(?:schaft)?|Bauobjekt|Bauvorhaben|Projektverfasser|Grundeigentümer(?:in)?|Zone|Kant\.?\s*Bewilligungen?|weitere\s+Baubewilligungen?|Bemerkung|Öffentliche Auflage|Auflagefrist|Auflage|Allfällige|Einwendung|Baugesuchnummer|Publikation|Publ\.-Nr\.|Stelle|Rubrik|Frist)(?![A-Za-z0-9_]))"
#: fixed values: what ends a location, and the largest group of parcels that is looked up
TAILS = [
    r"^[,.;:/\s-]+", r"(?i)\s+öffentliche(?:\s+auflage)?\b.*$", r"(?i)\s+auflage\b.*$", r"(?i)\s+zone\b.*$", r"(?i)\s+parz\s*\.?\s*:.*$", r"(?i)\s+parzellen?\b.*$",
    r"^\s*\d{1,6}\s*,\s*(?=[A-ZÄÖÜ][A-Za-zÄÖÜäöüéèà'’.-])", r"(?i)\s+gebäude\s+nr\.?\s+\d+.*$",
    r"(?i)\s+\d{1,2}\.\s*(?:januar|februar|märz|maerz|april|mai|juni|juli|august|september|oktober|november|dezember)\s+\d{4}.*$", r"\s+\d{1,2}\.\s*[A-ZÄÖÜ][a-zäöü]+.*$",
]
MOST_PARCELS = 10
NUMBER = r"^\d{1,6}$"


def last_match(x: Column, pattern: str) -> Column:
    """The first group of a pattern's last match; null without any."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(-1))


def clean_location(x: Column) -> Column:
    """A location without what follows it; of several parts the last that names a street; the last address in it."""
    t = T.collapse(x)
    for tail in TAILS:
        t = F.regexp_replace(t, tail, "")
    weak = r"(?i)\b[A-ZÄÖÜ]?[a-zäöü]{3,}(?:strasse|str\.|weg|gasse|platz|allee|ring|rain|halde|steig|matte|acker|feld|quai|ufer)(?![A-Za-z0-9_])"
    part = lambda t: F.coalesce(F.try_element_at(F.filter(F.transform(F.split(t, r"\s*/\s*"), T.collapse), lambda s: s.rlike(weak)), F.lit(-1)), t)
    last = lambda pattern: lambda t: T.collapse(F.coalesce(last_match(t, pattern), t))
    return T.bound(T.bound(T.bound(F.trim(t), part), last(STREET)), last(NAMED))


def labelled_segments(x: Column) -> Column:
    """What stands between each label of a location and the next field."""
    parts = F.split(F.regexp_replace(T.collapse(x), LABEL, "\u0001"), "\u0001")
    return T.bound(parts, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda s: T.collapse(F.regexp_replace(s, NEXT_FIELD + "(?s:.*)$", ""))))


def parcels_in(x: Column) -> Column:
    """Numbers of the parcels that a text lists or names, in order."""
    t = F.regexp_replace(T.collapse(x), r"(?u),\s*\d{4}\s+[A-ZÄÖÜ][\p{L}() .'-]+", " ")
    listed = lambda t: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(PARCELS), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"\d{1,6}"), F.lit(0))))
    return T.bound(t, lambda t: F.array_distinct(F.concat(listed(t), F.regexp_extract_all(t, F.lit(PARCEL), F.lit(1)))))


#: the type of a ladder
CANDIDATES = "array<struct<kind:string,queries:array<string>,repair_address:string,repair_parcel:string>>"


def candidate(kind: Column, queries: Column, address: Column, parcel: Column) -> Column:
    return F.struct(kind.alias("kind"), queries.alias("queries"), address.alias("repair_address"), parcel.alias("repair_parcel"))


def ladder(texts: list[Column], source_text: Column | None) -> Column:
    """Candidates of a record in the order in which they are tried: a group of parcels, parcels, addresses.

    texts: address, parcel, project and description; source_text is the text of the record's page, once that is read.
    """
    address, parcel, project, description = (F.coalesce(c, F.lit("")) for c in texts)
    named = F.when(T.collapse(parcel) != "", F.concat(F.lit("Parzelle "), parcel)).otherwise(F.lit(""))
    source = [source_text] if source_text is not None else []
    plain, none = T.collapse(address), F.array().cast(NONE)
    own = F.when(T.collapse(parcel).rlike(NUMBER), T.collapse(parcel)).otherwise(
        T.first_filled(F.regexp_extract(plain, r"(?i)^parzelle(?:\s+nr\.?)?\s+(\d{1,6})$", 1), F.regexp_extract(plain, r"(?i)\bParzellen?\s+Nrn?\.?\s+(\d{1,6})\b", 1))
    )
    labelled = F.array_distinct(F.flatten(F.transform(labelled_segments(source[0]), parcels_in))) if source else none
    listed = F.array_distinct(F.flatten(F.transform(F.array(named, project, description, *source), parcels_in)))
    found = F.concat(
        F.flatten(F.transform(F.array(address, named, project, description, *source), labelled_segments)), F.array(address),
        F.regexp_extract_all(plain, F.lit(STREET), F.lit(1)), F.regexp_extract_all(plain, F.lit(NAMED), F.lit(1)),
    )
    # a location is cleaned once as a candidate and once more before it is asked for
    asked = F.array_distinct(F.transform(F.transform(found, clean_location), clean_location))
    asked = F.filter(asked, lambda q: (F.length(q) >= 4) & ~q.rlike(r"(?i)^(?:Gemeinde|Regionale Bauverwaltung)(?![A-Za-z0-9_])") & ~q.rlike(PLACEHOLDER))
    number = r"(?i)[a-zäöü]{3,}.*\b\d{1,4}[a-z]?\b"
    of_address = F.transform(asked, lambda q: candidate(F.when(q.rlike(number), "address").otherwise("weak-address"), F.array(q), q, F.lit("")))

    def of_parcels(c: Column) -> Column:
        own, labelled, listed, open_ = (c[k] for k in ("own", "labelled", "listed", "open"))
        alone = F.when(own.isNotNull() & (F.size(listed) <= 1), F.array(own)).when(own.isNull() & (F.size(labelled) == 1), labelled).when(own.isNull() & (F.size(listed) == 1), listed).otherwise(none)
        alone = F.transform(alone, lambda p: candidate(F.lit("parcel"), F.array(p), F.when(open_, F.concat(F.lit("Parzelle "), p)).otherwise(F.lit("")), p))
        group = F.when(F.size(labelled) > 1, labelled).otherwise(listed)
        joined = F.array_join(group, ", ")
        whole = F.array(candidate(F.lit("parcel-group"), group, F.when(open_, F.concat(F.lit("Parzellen "), joined)).otherwise(F.lit("")), joined))
        return F.concat(F.when(own.isNull() & F.size(group).between(2, MOST_PARCELS), whole).otherwise(F.array().cast(CANDIDATES)), alone)

    return F.concat(T.bound(F.struct(own.alias("own"), labelled.alias("labelled"), listed.alias("listed"), plain.rlike(PLACEHOLDER).alias("open")), of_parcels), of_address)


def repair_locations(records: DataFrame, addresses: DataFrame, parcels: DataFrame, id_col: str) -> DataFrame:
    """id_col, kind, query, x, y, precision, points, repair_address, repair_parcel of the records that can be located.

    records: municipality, address, parcel, project_type, description, source_text. A record's candidates are tried in
    order, those with its source text after all others, and the first that is found wins. Of a group of parcels each
    one must be found: points has the place of each, x and y is the middle of them. addresses and parcels are entries
    of the gazetteer. What is found depends on a record's texts alone, so records with equal texts are located once.
    """
    whose = ["municipality", "address", "parcel", "project_type", "description", "source_text"]
    named = records.select(id_col, *(F.coalesce(c, F.lit("")).alias(c) for c in whose))  # null and blank say the same
    place_of = _locate(written(named.select(*whose).distinct().withColumn("text_id", F.monotonically_increasing_id()), "texts"), addresses, parcels)
    return named.join(place_of, whose).select(id_col, "kind", "query", "x", "y", "precision", "points", "repair_address", "repair_parcel")


def _locate(records: DataFrame, addresses: DataFrame, parcels: DataFrame) -> DataFrame:
    """repair_locations of records with a text_id, with their texts."""
    id_col, whose = "text_id", [c for c in records.columns if c != "text_id"]
    texts = [F.col(c) for c in ("address", "parcel", "project_type", "description")]
    later = F.when(T.collapse(F.col("source_text")) != "", ladder(texts, F.col("source_text"))).otherwise(F.array().cast(CANDIDATES))
    steps = records.select(id_col, "municipality", F.posexplode(F.concat(ladder(texts, None), later)).alias("place", "c"))
    steps = steps.select(id_col, "municipality", "place", "c.*", F.size("c.queries").alias("asked")).withColumn("query", F.explode("queries")).drop("queries")
    steps = written(steps, "steps")
    by_parcel = steps.filter("kind in ('parcel', 'parcel-group')").join(match_parcels(steps.filter("kind in ('parcel', 'parcel-group')").select("municipality", F.col("query").alias("parcel")), parcels).withColumnRenamed("parcel", "query"), ["municipality", "query"])
    request = ["municipality", "address"]
    spoken = steps.filter("kind in ('address', 'weak-address')").select("municipality", F.col("query").alias("address")).distinct().withColumn("request", F.struct(*request))
    by_address = steps.filter("kind in ('address', 'weak-address')").join(match_addresses(spoken, addresses, "request").select(F.col("request.municipality").alias("municipality"), F.col("request.address").alias("query"), "x", "y", "precision"), ["municipality", "query"])
    found = by_parcel.withColumn("precision", F.lit("precise")).unionByName(by_address)
    # division: as many parcels found as were asked for
    each = found.groupBy(id_col, "place", "kind", "asked", "repair_address", "repair_parcel").agg(
        F.sort_array(F.collect_set(F.struct("query", "x", "y"))).alias("points"), F.min("precision").alias("precision"),  # MOST_PARCELS at most
    ).filter(F.size("points") == F.col("asked"))
    first = each.groupBy(id_col).agg(F.min_by(F.struct("kind", "points", "precision", "repair_address", "repair_parcel"), "place").alias("s")).select(id_col, "s.*")
    middle = lambda c: F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]) / F.size("points"), 3)
    first = first.select(id_col, "kind", F.array_join(F.transform("points", lambda p: p["query"]), ", ").alias("query"), middle("x").alias("x"), middle("y").alias("y"), "precision", "points", "repair_address", "repair_parcel")
    return written(records.select(id_col, *whose).join(first, id_col).drop(id_col), "located")


def assess_repairs(repairs: DataFrame, areas: DataFrame, features: DataFrame, id_col: str) -> DataFrame:
    """repairs with the verdict over all their points: both kinds of hits together, else the strongest of them.

    Repairs at the same points get the same verdict, and each place is assessed once.
    """
    found = ["precision", "points"]
    sets = written(repairs.select(*found).distinct().withColumn("set_id", F.monotonically_increasing_id()), "point-sets")
    spot = F.struct("precision", F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("pt_id")
    each = sets.select("set_id", "precision", F.explode("points").alias("p")).select("set_id", spot).distinct()
    points = each.select("pt_id").distinct().select("pt_id", F.col("pt_id.x").alias("east"), F.col("pt_id.y").alias("north"), F.col("pt_id.precision").alias("location_precision"))
    verdicts = each.join(S.assess(points, areas, features), "pt_id")
    has = lambda s: F.bool_or(F.col("protection_status") == s)
    verdict = (
        F.when(has("combined-hit") | (has("protected-point") & has("protected-zone")), "combined-hit").when(has("protected-point"), "protected-point")
        .when(has("protected-zone"), "protected-zone").when(has("manual-review"), "manual-review").otherwise("no-hit")
    )
    of_set = verdicts.groupBy("set_id").agg(verdict.alias("protection_status"))
    return repairs.join(written(sets.join(of_set, "set_id").drop("set_id"), "set-verdicts"), found).select(*repairs.columns, "protection_status")


def apply_repairs(records: DataFrame, repairs: DataFrame, id_col: str) -> DataFrame:
    """Records with the coordinates, verdict and, where the repair has them, address and parcel of their repair."""
    new = repairs.select(id_col, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("precision").alias("_p"), F.col("repair_address").alias("_a"), F.col("repair_parcel").alias("_q"), F.col("protection_status").alias("_s"))
    rows = records.join(new, id_col, "left")
    fresh = F.col("_x").isNotNull()
    filled = lambda new, old: F.when(fresh & (F.col(new) != ""), F.col(new)).otherwise(F.col(old))
    return rows.withColumns({
        "east": F.coalesce("_x", "east"), "north": F.coalesce("_y", "north"), "location_precision": F.coalesce("_p", "location_precision"), "address": filled("_a", "address"),
        "parcel": filled("_q", "parcel"), "ambiguous_address": F.when(fresh, False).otherwise(F.col("ambiguous_address")), "protection_status": F.coalesce("_s", "protection_status"),
    }).select(records.columns)
