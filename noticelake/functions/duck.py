"""The same text rules written for the other engine, for the SQL of registered queries."""

from __future__ import annotations


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g'))"


def base(x: str) -> str:
    return collapse(f"strip_accents(lower(coalesce({x}, '')))")


def key(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower(coalesce({x}, ''))), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def municipality(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({base(x)}, '\\s*\\(?ag\\)?\\s*$', ''), '[^a-z0-9]+', ' ', 'g'))"


def parcel(x: str) -> str:
    words = "'\\b(parzelle|parz|grundstuck|nr|gb)\\b'"
    return f"regexp_replace(regexp_replace({base(x)}, {words}, ' ', 'g'), '[^a-z0-9]+', '', 'g')"


def address(x: str) -> str:
    return collapse(f"regexp_replace(replace({base(x)}, 'strasse', 'str'), '[^a-z0-9 ]+', ' ', 'g')")


def project(x: str) -> str:
    return collapse(f"regexp_replace({base(x)}, '[^a-z0-9 ]+', ' ', 'g')")


def strip_html(x: str) -> str:
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '<{tag}[^>]*>.*?</{tag}[^>]*>', ' ', 'gis')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("auml", "ä"), ("ouml", "ö"), ("uuml", "ü"), ("Auml", "Ä"), ("Ouml", "Ö"), ("Uuml", "Ü"), ("szlig", "ß"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{sign}')"
    return collapse(x)


def content_region(x: str) -> str:
    for tag in ("header", "footer", "nav", "aside", "form"):
        x = f"regexp_replace({x}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gis')"
    main = f"nullif(regexp_extract({x}, '<main[^>]*>(.*?)</main>', 1, 'is'), '')"
    articles = f"nullif(array_to_string(regexp_extract_all({x}, '<article[^>]*>(.*?)</article>', 1, 'is'), ' '), '')"
    return f"coalesce({main}, {articles}, {x})"


def resolve(base: str, href: str) -> str:
    return f"""regexp_replace(CASE WHEN regexp_matches({href}, '^[A-Za-z]+://') THEN {href} WHEN {href} LIKE '/%' THEN regexp_extract({base}, '^([A-Za-z]+://[^/]+)', 1) || {href}
 ELSE regexp_extract({base}, '^([A-Za-z]+://[^/]+(/([^?#]*/)?)?)', 1) || {href} END, '#.*$', '')"""


def score(rules: list) -> str:
    """Points of (subject column, [(pattern, points)]) rules."""
    whens = (" ".join(f"WHEN regexp_matches({c}, '{p}') THEN {n}" for p, n in choices) for c, choices in rules)
    subjects = (c for c, _ in rules)
    return " + ".join(f"(CASE {w} ELSE 0 END)" for _, w in zip(subjects, whens))


def pick(key: str, values: list) -> str:
    """The value of a case by a number; %k in it stands for the number."""
    items = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)
    chosen = f"[{items}][{key} % {len(values)} + 1]"
    return f"replace({chosen}, '%k', CAST({key} AS VARCHAR))" if any(isinstance(v, str) for v in values) else chosen
