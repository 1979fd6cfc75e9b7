"""From notice text to record fields, and the rules that judge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T

LABELS = ["Bauherrschaft:", "Bauvorhaben:", "Bauplatz:", "Parzelle", "Auflage"]
STREET = r"(?i)(strasse|str\.|weg|gasse|platz|rain|matte|acker|halde|hof)"


def parcel_number(x: Column) -> Column:
    return F.regexp_extract(x, r"(?i)(?:parzelle|parz\.|gb)\s*(?:nr\.?)?\s*(\d+)", 1)


def street_address(x: Column) -> Column:
    """The first street name with a house number."""
    return F.regexp_extract(x, r"([\p{Lu}][\p{L}]*(?:strasse|str\.|weg|gasse|platz))\s+(\d+[a-z]?)", 0)


def weak_address(a: Column) -> Column:
    """Blank, a placeholder, a lone number, a parcel only, or no digit and no street."""
    t = F.trim(F.coalesce(a, F.lit("")))
    return (t == "") | F.lower(t).isin("-", "unbekannt", "k.a.", "n/a") | t.rlike(r"^\d+$") | t.rlike(r"(?i)^parzelle") | ~(t.rlike(r"\d") | t.rlike(STREET))


def geocodable(a: Column) -> Column:
    t = F.trim(F.coalesce(a, F.lit("")))
    return t.rlike(STREET) | t.rlike(r"(?i)parzelle\s*(nr\.?)?\s*\d") | t.rlike(r"^[\p{L} .-]+\s\d+[a-z]?$")


def fields(texts: DataFrame, body: str = "body") -> DataFrame:
    """Adds applicant, project, address, parcel, publication and deadline."""
    b = F.col(body)
    return dates.with_range(texts, body, "publication_date", "deadline_date").withColumns({
        "applicant": T.labelled_value(b, "Bauherrschaft", ["Bauvorhaben", "Bauplatz", "Auflage"]),
        "project": T.labelled_value(b, "Bauvorhaben", ["Bauplatz", "Parzelle", "Auflage"]),
        "place": street_address(b),
        "parcel": parcel_number(b),
    })


def relevance(b: Column) -> Column:
    """struct of evidence flags of a text."""
    return F.struct(
        b.rlike("(?i)baugesuch|bauvorhaben").alias("keyword"), (parcel_number(b) != "").alias("parcel"), (street_address(b) != "").alias("address"),
        b.rlike(dates.DAY).alias("dated"), b.rlike(r"(?i)\.pdf").alias("pdf"), b.rlike("(?i)suche|sitemap|reglement").alias("generic"),
    )


def is_relevant(f: Column) -> Column:
    identified = f["parcel"] | f["address"]
    return ~f["generic"] & ((f["keyword"] & (identified | f["dated"])) | (identified & f["dated"]) | (f["pdf"] & identified))


def is_relevant_feed(b: Column) -> Column:
    """A feed entry that names a request, or a dated project with a place."""
    f = relevance(b)
    return b.rlike("(?i)gesuch") | (f["keyword"] & (f["parcel"] | f["address"]) & f["dated"])


def lone_date(x: Column) -> Column:
    """A text that is nothing but a date, a month with its year, or a year."""
    return F.trim(x).rlike(r"^(\d{1,2}\.\s*\d{1,2}\.\s*\d{4}|\d{4}|[A-Za-zä]+ 20\d{2})$")


def clean_address(x: Column) -> Column:
    """Without rests of tags and attributes; entities decoded."""
    plain = F.regexp_replace(T.decode_entities(x), r"<[^<>]*>|(?:class|id|style)=\"[^\"]*\">?|data-[a-z]+='[^']*'", " ")
    return T.collapse(plain)


def sanitize_address(x: Column) -> Column:
    """The address, or nothing where it is weak."""
    return F.when(weak_address(x), F.lit("")).otherwise(T.collapse(x))


def house_number(a: Column) -> Column:
    return F.regexp_extract(a, r"\s(\d+[a-z]?)$", 1)


def street_name(a: Column) -> Column:
    return F.regexp_extract(a, r"^(.*?)\s+\d+[a-z]?$", 1)


#: fixed values: words that are no street names
STREET_STOP_WORDS = """adresse aus amtsblatt pruefen lage bauplatz baustelle standort bauobjekt bauvorhaben bauherr bauherrschaft neubau umbau abbruch
anbau ersatzneubau sanierung gartengestaltung garten umnutzung parzelle parzellen gemeinde schweiz aargau kanton zone frist der die das und von ueber
mit fuer den dem ohne sowie objekt projekt""".split()


def street_token(a: Column) -> Column:
    """The longest word of four letters or more that is no stop word; words that end like a street go first."""
    words = F.filter(F.split(T.key(a), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STREET_STOP_WORDS) & ~w.rlike(r"^\d"))
    street = lambda w: w.rlike("(strasse|str|weg|gasse|platz|rain|matte|acker|halde)$").cast("int")
    ranked = F.transform(words, lambda w, i: F.struct((-street(w)).alias("s"), (-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["w"]


def refine(records: DataFrame, gazetteer: DataFrame, id_col: str) -> DataFrame:
    """Fills address, parcel, dates and coordinates of records (id, municipality, body, verdict) from their texts.

    The street of the text, else its parcel, is the address. What the gazetteer finds gives the coordinates. A record
    without any location is left to a manual review unless it is protected already; the note says what was done.
    """
    rows = fields(records).withColumn("address", T.first_filled(F.col("place"), F.when(F.col("parcel") != "", F.concat(F.lit("Parzelle "), "parcel"))))
    found = gazetteer_match(rows.select(id_col, "municipality", "address", "parcel"), gazetteer, id_col)
    rows = rows.join(found, id_col, "left").withColumn("address", F.coalesce("address", F.lit("")))
    nowhere = (F.col("address") == "") & F.col("x").isNull()
    open_ = ~F.coalesce("verdict", F.lit("")).isin("protected-zone", "protected-point", "combined-hit")
    return rows.withColumns({"verdict": F.when(nowhere & open_, "manual-review").otherwise(F.col("verdict")), "note": F.when(nowhere, "location unclear").otherwise("refined")})


def review_cause(address: Column, parcel: Column, has_coordinates: Column) -> Column:
    return (
        F.when(has_coordinates, "has-coords").when((T.blank_to_null(address).isNull()) & (parcel != ""), "parcel-only")
        .when(~weak_address(address), "address-strong-no-coords").when(F.trim(address) != "", "address-weak").otherwise("no-location")
    )


def gazetteer_match(records: DataFrame, gazetteer: DataFrame, id_col: str) -> DataFrame:
    """records: id, municipality, address, parcel. The gazetteer's best entry: equal parcel and town, else equal street and number and town; precise before approximate, then rank."""
    r = records.select(F.col(id_col), T.municipality(F.col("municipality")).alias("m"), T.blank_to_null(T.address(F.col("address"))).alias("a"), T.blank_to_null(T.parcel(F.col("parcel"))).alias("p"))
    g = gazetteer.select(T.municipality(F.col("municipality")).alias("m"), T.address(F.col("label")).alias("a"), T.parcel(F.col("parcel")).alias("p"), "x", "y", "precise", "rank")
    by_parcel = r.filter("p is not null").join(g.drop("a"), ["m", "p"]).select(id_col, F.lit(0).alias("kind"), "precise", "rank", "x", "y")
    by_street = r.filter("a is not null").join(g.drop("p"), ["m", "a"]).select(id_col, F.lit(1).alias("kind"), "precise", "rank", "x", "y")
    best = by_parcel.unionByName(by_street).groupBy(id_col).agg(F.min(F.struct("kind", (~F.col("precise")).alias("approximate"), "rank", "x", "y")).alias("s"))
    return best.select(id_col, F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.when(F.col("s.kind") == 0, "parcel").otherwise("address").alias("matched_by"))


#: rules that are held against the documents at a time
RULE_BLOCK = 1000


def term_rules(documents: DataFrame, rules: DataFrame, text_col: str, most: int = 24) -> DataFrame:
    """Pairs of documents and rules (include, exclude: terms joined by a bar) that accept them.

    A rule has at most `most` terms each way. Terms are searched inside the texts, so each document meets each rule;
    the rules are dealt to blocks of RULE_BLOCK, and a block is broadcast at a time.
    """
    text = T.collapse(F.lower(F.col(text_col)))
    terms = lambda c: F.filter(F.transform(F.slice(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), 1, most), lambda t: T.collapse(F.lower(t))), lambda t: t != "")
    r = rules.withColumns({"_in": terms("include"), "_out": terms("exclude")})
    blocks = max(1, -(-rules.count() // RULE_BLOCK))
    if blocks > 1:
        r = r.withColumn("_block", F.row_number().over(Window.orderBy(*rules.columns)) % blocks)
    d = documents.withColumn("_t", text)
    hit = lambda c: F.exists(c, lambda t: F.contains(F.col("_t"), t))
    out = None
    for k in range(blocks):
        block = F.broadcast(r.filter(F.col("_block") == k).drop("_block") if blocks > 1 else r)  # at most RULE_BLOCK rules
        pairs = d.crossJoin(block).filter(((F.size("_in") == 0) | hit("_in")) & ~hit("_out")).drop("_in", "_out", "_t")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def source_rules(documents: DataFrame, rules: DataFrame, text_col: str, source_col: str = "source", most: int = 24) -> DataFrame:
    """The documents that the include and exclude terms of their own source accept. A source without a rule accepts all.

    rules: source, include, exclude; one row for each source.
    """
    terms = lambda c: F.filter(F.transform(F.slice(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), 1, most), lambda t: T.collapse(F.lower(t))), lambda t: t != "")
    r = rules.select(source_col, terms("include").alias("_in"), terms("exclude").alias("_out"))
    rows = documents.join(r, source_col, "left").withColumn("_t", T.collapse(F.lower(F.col(text_col))))
    hit = lambda c: F.coalesce(F.exists(c, lambda t: F.contains(F.col("_t"), t)), F.lit(False))
    return rows.filter((F.coalesce(F.size("_in"), F.lit(0)) <= 0) | hit("_in")).filter(~hit("_out")).select(documents.columns)


#: fixed values: words that tell a project's scale; large ones go first, then small ones
LARGE_PROJECT = r"(?iu)mehrfamilienh(?:aus|äuser)|\bmfh\b|wohnüberbauung|arealüberbauung|überbauung|industrie(?:halle|bau)|gewerbebau|geschäftshaus|schul(?:haus|anlage)|mehrzweckhalle|spital|pflegeheim|hotel|wohn- und geschäftshaus"
SMALL_PROJECT = r"(?iu)wärmepumpe|photovoltaik|pv-anlage|solaranlage|dachfenster|fensterersatz|reklame|werbeanlage|klimaanlage|ladestation|e-ladestation|sichtschutz|pergola|gartenhaus|geräteschuppen|velounterstand|carport|schwimmbecken|pool|fassaden(?:änderung|anstrich)|dachsanierung"
MEDIUM_PROJECT = r"(?iu)einfamilienhaus|\befh\b|doppeleinfamilienhaus|reihenhaus|anbau|umbau|aufstockung|umnutzung|ersatzneubau|neubau|sanierung|renovation|garage|terrasse|balkon|dachausbau"


def project_scale(*parts: Column) -> Column:
    """gross, klein, mittel or nicht-klassiert by the words of a project's texts."""
    t = F.concat_ws(" ", *(T.blank_to_null(p) for p in parts))
    return F.when(t.rlike(LARGE_PROJECT), "gross").when(t.rlike(SMALL_PROJECT), "klein").when(t.rlike(MEDIUM_PROJECT), "mittel").otherwise("nicht-klassiert")


#: fixed values: what marks content that is no permit notice, and the words that speak for one all the same
SEARCH_RESULTS = r"(?i)\b(suchergebnisse?|suchresultate|search results?|resultate)\b"
BULLETIN = r"(?i)\b(mitteilungsblatt|infoblatt)\b"
OTHER_PROCEDURE = r"(?i)\b(plangenehmigungsverfahren|elektrizit(?:ä|ae)tsgesetz|eleg)\b"
OTHER_TOPIC = r"(?i)\b(gemeinderat|gemeindeversammlung|traktanden|protokoll|beschl(?:ü|ue)sse?|reglemente?|budget|rechnung|steuer|abstimmung|wahl|nutzungsplanung|bno|zonenvorschriften|gestaltungsplan|familiengartenzone|vorpr(?:ü|ue)fung|mitwirkung|genehmigung)\b"
OTHER_URL = r"(?i)(regionalebauverwaltung\.ch|/bauen/baubewilligungen/ebau-aargau|(?:^|[\\/_-])bno(?:[\\/_.-]|$)|nutzungsordnung)"
PUBLICATION_ROUTE = r"(?i)/_rtr/(?:beschluesse|rechtsgueltigeamtlichepublikationen|reglemente|projektemain|budgetrechung|sucheeinerpublikation)(?:[/?#]|$)"
PERMIT_SIGNAL = r"(?i)\b(baugesuche?|baupublikation(?:en)?|baubewilligung(?:en)?|bauherr(?:schaft)?|bauobjekt|bauvorhaben|bauprojekt|bauplatz|baustelle|objektadresse|standort)\b"


def is_off_topic(text: Column, url: Column) -> Column:
    """Search results (not on a detail page), other addresses, publication routes, bulletins, other procedures, topics without a permit signal."""
    t, u = T.collapse(text), F.coalesce(url, F.lit(""))
    both = F.concat_ws(" ", u, t)
    detail = u.rlike(r"(?i)/(detail|id|item)[/=-]?[0-9]+")
    return (t != "") & ((both.rlike(SEARCH_RESULTS) & ~detail) | u.rlike(OTHER_URL) | u.rlike(PUBLICATION_ROUTE) | both.rlike(BULLETIN) | both.rlike(OTHER_PROCEDURE) | (both.rlike(OTHER_TOPIC) & ~both.rlike(PERMIT_SIGNAL)))


#: fixed values: patterns of addresses that no permit has (a month and year, a menu entry, a topic), and topics in any text
JUNK_ADDRESS = [
    "Januar 20%", "Februar 20%", "März 20%", "April 20%", "Mai 20%", "Juni 20%", "Juli 20%", "August 20%", "September 20%", "Oktober 20%", "November 20%", "Dezember 20%",
    "%Facebook%", "%Instagram%", "%Youtube%", "%Gemeinderatsnachrichten%", "%Aktuelles%", "%News%", "%Vernehmlassung%",
]
JUNK_TOPICS = ["%Wohnraumstrategie%", "%Stadtteilziele%", "%Förderprogramm%", "%Stadtbibliothek%", "%Einbürgerung%", "%Altlasten%", "%Zertifizierung%"]
#: fixed values: patterns of source addresses, addresses and projects that are junk whatever else a record holds
JUNK_URLS = [
    "%/category/%", "%/author/%", "%/newsarchive/%", "%/route/rss-%", "%/suche%", "%/search%", "%/_rtr/%", "%Vorpruefungsbericht%", "%Vorprüfungsbericht%", "%Nutzungsplanung%", "%Familiengartenzone%", "%Baugesuchumschlag%", "%Formular_Baugesuch%",
    "%formular%baugesuch%", "%OnlineSchalter%Bauverwaltung%", "%regionalebauverwaltung.ch%", "%/bauen/baubewilligungen/ebau-aargau%", "%bno_%", "%bno-%", "%Mitteilungsblatt%", "%Infoblatt%", "%Katasterplan%", "%Situationsplan%",
]
MONTH = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
JUNK_ALWAYS = ["Archiv RSS%", "Baubewilligungen Baubewilligung BG 2025%", "Erteilte Baubewilligungen%", "vom %.% bis %.%", "Pdf%Bg%", "%Mitteilungsblatt%"]
JUNK_SPAN = rf"(?i)^(?:Im|Ab Anfang|Ab Mitte|Ab Ende) (?:{MONTH}) 20"
JUNK_PROJECTS = [
    "Erteilte Baubewilligungen%", "%Suchergebnisse%", "%Mitteilungsblatt%", "%Infoblatt%", "%Plangenehmigungsverfahren%", "%Elektrizitätsgesetz%", "%Elektrizitaetsgesetz%", "%EleG%", "%Familiengartenzone%", "%Vorprüfungsbericht%", "%Nutzungsplanung%",
    "%Bau- und Nutzungsordnung%", "%BNO%", "%Mitwirkung%", "%Genehmigung%", "%Gemeinde Oberentfelden%",
]
JUNK_PROJECT_NAMES = ["RSS", "Archiv", "Baubewilligungen", "Nicht importieren", "2"]
#: fixed values: the source whose records are judged, and the address that stands for none
JUNK_SOURCE, NO_ADDRESS = "Gemeinde-Webseite", "Adresse von Webseite prüfen"


def junk_records(records: DataFrame, comments: DataFrame, id_col: str = "id") -> DataFrame:
    """id_col of the records of web pages that are no permits: untouched, without comment, and either of a source address,
    address or project that is junk by itself, or without parcel and coordinates and with no address, or of an unclear
    one with junk in address, project or description. Patterns tell capitals apart only outside A-Z."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    like = lambda c, patterns: F.array_contains(F.array(*(F.coalesce(F.col(c).ilike(p), F.lit(False)) for p in patterns)), True)
    topic = like("address", JUNK_ADDRESS + JUNK_TOPICS) | like("project_type", JUNK_TOPICS) | like("description", JUNK_TOPICS)
    nowhere = blank("parcel") & blank("coordinates") & (F.coalesce(F.col("address") == NO_ADDRESS, F.lit(False)) | (F.coalesce("ambiguous_address", F.lit(False)) & topic))
    named = F.coalesce(F.col("project_type").isin(JUNK_PROJECT_NAMES), F.lit(False)) | F.coalesce(F.col("address").rlike(JUNK_SPAN), F.lit(False))
    always = like("source_url", JUNK_URLS) | like("address", JUNK_ALWAYS) | like("project_type", JUNK_PROJECTS) | named
    untouched = (F.col("source") == JUNK_SOURCE) & (F.col("workflow_status") == "new") & blank("assignee") & blank("note")
    return records.filter(untouched & (nowhere | always)).select(id_col).join(comments.select(id_col).distinct(), id_col, "left_anti")


def prune_junk(records: DataFrame, patterns: list[tuple[str, str]], comments: DataFrame, id_col: str = "id") -> DataFrame:
    """Without untouched, uncommented records of unclear place that a (column, LIKE pattern) calls junk."""
    junk = F.lit(False)
    for column, pattern in patterns:
        junk = junk | F.coalesce(F.col(column).like(pattern), F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    untouched = (F.col("workflow_status") == "new") & blank("assignee") & blank("note") & F.col("ambiguous_address")
    gone = records.filter(junk & untouched).select(id_col).join(comments.select(id_col), id_col, "left_anti")
    return records.join(gone, id_col, "left_anti")


def markup_junk(x: Column) -> Column:
    """Rests of markup or of a document's inner structure, or two characters or more that could not be decoded."""
    markup = x.rlike(r"(?i)<[a-z/!]|=\s*[\"']|\bdata-[\w-]+|%5[bd]|class=|box[\s-]box|tx_[a-z_]+|filter%|/publikation")
    document = x.rlike(r"%PDF-|/FlateDecode|\bendobj\b|\bendstream\b")
    return F.coalesce(markup | document | (F.length(x) - F.length(F.replace(x, F.lit("\ufffd"), F.lit(""))) >= 2), F.lit(False))
