"""Text normalisation and extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
WHITE = r"[\s ﻿]+"
#: fixed values: words that carry no identity in an address or project
STOP_WORDS = """der die das den dem des ein eine einer eines und oder mit von vom zur zum fur auf im in am an bei
gegen bestehend bestehenden modern neue neuer baugesuch bauvorhaben""".split()


def bound(x: Column, f) -> Column:
    """f(x), with x worked out once however often f uses it, in lambdas too."""
    return F.element_at(F.transform(F.array(x), f), 1)


def collapse(x: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), WHITE, " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def plain(x: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTS, PLAIN)


def base(x: Column) -> Column:
    """Lower case without accents, white space collapsed."""
    return collapse(plain(x))


def terms(x: Column) -> Column:
    """Letters and digits alone, what stands between them as one blank."""
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def key(x: Column) -> Column:
    """base with ss for the sharp s, all but letters and digits as blanks."""
    return F.trim(F.regexp_replace(F.replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTS, PLAIN), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def municipality(x: Column) -> Column:
    """A trailing ag, bracketed or bare, goes; other signs become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(base(x), r"\s*\(?ag\)?\s*$", ""), "[^a-z0-9]+", " "))


def municipality_strict(x: Column) -> Column:
    """As municipality, but a bare ag goes only as a word of its own."""
    return F.trim(F.regexp_replace(F.regexp_replace(base(x), r"(\s*\(ag\)|(^|\s)ag)\s*$", ""), "[^a-z0-9]+", " "))


def parcel(x: Column) -> Column:
    words = r"(^|[^a-z0-9_])(parzelle|parz|grundstuck|nr|gb)($|[^a-z0-9_])"
    once = F.regexp_replace(base(x), words, "$1 $3")
    left = F.contains(once, F.lit("parz")) | F.contains(once, F.lit("nr")) | F.contains(once, F.lit("gb")) | F.contains(once, F.lit("grundstuck"))
    twice = F.when(left, F.regexp_replace(once, words, "$1 $3")).otherwise(once)  # words side by side
    return F.regexp_replace(twice, "[^a-z0-9]+", "")


def address(x: Column) -> Column:
    return terms(F.replace(plain(x), F.lit("strasse"), F.lit("str")))


def project(x: Column) -> Column:
    return terms(plain(x))


def token_signature(x: Column, most: int) -> Column:
    """Distinct tokens of three characters or more outside the stop words, sorted, the first `most`."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    tokens = F.filter(F.split(key(x), r"\s+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(tokens)), 1, most), " ")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger number of tokens; 0 where one side has none."""
    x, y = (F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / most)


def code_point(n: Column) -> Column:
    """The character of a code point; null where there is none."""
    ok = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(F.when(ok, n).otherwise(F.lit(32))), 8, "0")), "UTF-32"))


def decode_entities(x: Column) -> Column:
    """Named and numeric entities of markup; the ampersand last, so that what was encoded twice is decoded once."""
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("auml", "ä"), ("ouml", "ö"), ("uuml", "ü"), ("Auml", "Ä"), ("Ouml", "Ö"), ("Uuml", "Ü"), ("eacute", "é"), ("egrave", "è"), ("szlig", "ß")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))

    def put(text, entity):
        digits = F.regexp_replace(entity, "[&#xX;]", "")
        n = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return F.replace(text, entity, F.coalesce(code_point(n), entity))

    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    x = bound(x, lambda t: F.when(F.contains(t, F.lit("&#")), F.aggregate(found(t), t, put)).otherwise(t))
    return F.replace(x, F.lit("&amp;"), F.lit("&"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes, decoded; '' without it."""
    pattern = rf"""(?i){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    return decode_entities(F.concat(*(F.regexp_extract(tag, pattern, g) for g in (1, 2, 3))))


def attributes(tag: Column) -> Column:
    """All attributes of a tag by their names in lower case; of one name the first value stays."""
    pattern = F.lit(r"""(?i)\s([a-z][a-z0-9_:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
    group = lambda n: F.regexp_extract_all(tag, pattern, F.lit(n))
    pairs = F.transform(F.arrays_zip(group(1).alias("k"), group(2).alias("a"), group(3).alias("b"), group(4).alias("c")), lambda m: F.struct(F.lower(m["k"]).alias("k"), decode_entities(F.concat(m["a"], m["b"], m["c"])).alias("v")))
    first = lambda out, m: F.when(F.array_contains(F.transform(out, lambda o: o["k"]), m["k"]), out).otherwise(F.concat(out, F.array(m)))
    return F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), first))


def strip_html(x: Column) -> Column:
    """Text of a page: scripts and styles go, tags become blanks, entities are decoded."""
    for tag in ("script", "style"):
        x = F.regexp_replace(x, f"(?is)<{tag}[^>]*>.*?</{tag}[^>]*>", " ")
    return collapse(decode_entities(F.regexp_replace(x, "<[^>]*>", " ")))


def shorten(x: Column, most: int, mark: str = "...") -> Column:
    """Texts over `most` characters end after most - 1 in a mark."""
    c = collapse(x)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit(mark))).otherwise(c)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def reference_id(prefix: str, digits: int, *parts: Column) -> Column:
    """Prefix and the first hex digits of the SHA-1 of the filled parts joined by a bar; null without any."""
    basis = F.concat_ws("|", *(blank_to_null(p) for p in parts))
    return F.when(basis != "", F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(basis.cast("binary")), 1, digits))))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "ja"), F.lit(False))


def labelled_value(x: Column, label: str, following: list[str]) -> Column:
    """What stands between a label and the next of the following labels, or the end."""
    stop = "|".join(following)
    return F.trim(F.regexp_extract(x, rf"(?i){label}\s*:?\s*(.+?)\s*(?:{stop}|$)", 1))


def pick(key: Column, values: list) -> Column:
    """The text of a case by a number; %k in it stands for the number."""
    chosen = F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values) + 1).cast("int"))
    return F.replace(chosen, F.lit("%k"), key.cast("string"))


def source_kind(x: Column) -> Column:
    """Kind of a source by words in its name; authority before municipality before import."""
    n = base(x)
    word = lambda p: n.rlike(rf"(^|[^a-z0-9_])({p})($|[^a-z0-9_])")
    return (
        F.when(n == "", "import")
        .when(word("amtsblatt"), "amtsblatt")
        .when(word("gemeinde(seite|webseite|portal|quelle|import|feed|pdf)?") | word("kommunal(e|er|es)?"), "municipality")
        .when(word("api|agis|arcgis|import|export|json|datensatz|dataset"), "import")
        .when(word("baugesuch(e)?|baupublikation(en)?|bauverwaltung|auflage"), "municipality")
        .otherwise("import")
    )


#: fixed values: notes that ask for a place and for a deadline, the former name of the check that writes them, and its name
NO_PLACE = "KI-Datenprüfung: Standortangaben bleiben unvollständig - bitte von Hand prüfen."
NO_DEADLINE = "KI-Datenprüfung: Frist fehlt weiterhin - bitte von Hand prüfen."
FORMER_CHECK, CHECK = "KI-Datenprüfung", "Automatische Datenprüfung"


def append_notes(text: Column, notes: Column) -> Column:
    """A text with those of an array of notes that it does not hold yet, each once; null and blank notes are left out."""
    def joined(t):
        new = F.filter(F.array_distinct(F.transform(notes, collapse)), lambda n: (n != "") & ~F.contains(t, n))
        return collapse(F.array_join(F.concat(F.array(t), new), " "))

    return bound(collapse(text), joined)


def without_resolved(text: Column, located: Column, dated: Column) -> Column:
    """A text without the notes that a place or a deadline has settled meanwhile."""
    drop = lambda t, done, note: F.when(F.coalesce(done, F.lit(False)), F.replace(t, F.lit(note), F.lit(""))).otherwise(t)
    left = drop(drop(collapse(text), located, NO_PLACE), dated, NO_DEADLINE)
    return collapse(F.replace(left, F.lit(FORMER_CHECK), F.lit(CHECK)))
