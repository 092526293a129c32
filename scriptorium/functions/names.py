"""Author lists by the conventions of ten styles, as array<struct<family, given, literal>>.

A style's convention is data: how its list is split and in which order a name's parts stand. One expression serves all
styles, so a plan grows by a few nodes a style and not by a parser a style.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.binding import let_sql

CAP = "[A-ZÀ-ɏ]"
INITIALS = rf"{CAP}\.(?:[-\s]*{CAP}\.)*"
PERSON = "struct<family:string,given:string,literal:string>"
_ET_AL = r",\s*et al\.?|\bet al\.?"
#: Words that name a kind of organisation; a longer list costs nothing but a longer pattern.
_BODIES = "Agency Association Authority Board Bureau Center Centre Collaboration College Commission Committee Company Consortium Consulting Corporation Council Department Federation Foundation Government Group Institute Institution Laboratory Ministry Network Office Organisation Organization Society Team Union University"
ORGANISATIONS = r"\b(?i:" + "|".join(_BODIES.split()) + r")\b|\b(?:Inc|Ltd|LLC|Corp|GmbH|AG|SA)\b"
#: Two or more capitalised words without stops and commas, small words between them.
_CAPITALISED = r"\p{Lu}[\p{L}\p{N}'’-]+"
_BODY_NAME = rf"^{_CAPITALISED}(?:\s+(?:{_CAPITALISED}|\p{{Lu}}|&|and|for|in|of|on|the))*\s+{_CAPITALISED}$"

#: Words after a family name that belong to it.
_SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
_JOINT = "\u0002"
_CUT = "\u0003"
#: style -> (order of a name's parts, where the list is split)
CONVENTIONS = {
    "apa": ("family first", r"\.\s*,\s*&\s*|\.\s*,\s*|\s*,?\s*&\s*"),
    "harvard": ("family first", r"\.\s*,\s*and\s+|\.\s*,\s*|\s*,?\s+and\s+"),
    "acs": ("family first", r"\s*;\s*"),
    "nature": ("family first", r"(?<=\.),\s*(?:&|and)?\s*|\s+and\s+|\s*&\s*"),
    "chicagoAD": ("given first", r",\s*and\s+|,?\s+and\s+|,\s*"),
    "chicagoFull": ("given first", r",\s*and\s+|,?\s+and\s+|,\s*"),
    "mla": ("given first", r",\s*and\s+|,?\s+and\s+|,\s*"),
    "ieee": ("given first", r",?\s+and\s+|,\s+"),
    "acm": ("given first", r"\s*,\s*(?i:and)?\s+|\s*,\s*|\s+(?i:and)\s+"),
    "vancouver": ("family, initials", r",\s*"),
}
_KEEPS_DOT = ("acs", "nature")
_INVERTED = ("chicagoAD", "chicagoFull", "mla")  # the first name stands family first


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _named(family: str = "null", given: str = "null", literal: str = "null") -> str:
    return f"named_struct('family', cast({family} as string), 'given', cast({given} as string), 'literal', cast({literal} as string))"


def _in(style: str, names: tuple[str, ...]) -> str:
    """In a lambda, IN leaves its list of values by an exception; equalities don't."""
    return "(" + " or ".join(f"{style} = {n!r}" for n in names) + ")"


def looks_like_org_sql(b: str) -> str:
    """Whether a block reads as the name of one organisation."""
    return f"rlike({b}, {quote(_BODY_NAME)})"


def _split_sql(text: str, pattern: str) -> str:
    """split(), whose pattern is compiled once and not for every row: the cuts are marked first. Texts that have the mark are split as they are."""
    return f"if(contains({text}, '{_CUT}'), split({text}, {quote(pattern)}), split(regexp_replace({text}, {quote(pattern)}, '{_CUT}'), '{_CUT}'))"


def people_sql(style: str, block: str) -> str:
    """SQL for the people in a block of text, by the style that an expression names.

    `et al.` ends the list; several capitalised words without initials are one organisation; a name that can't be split is
    a literal.
    """
    start = f"trim({let_sql('r', f"regexp_replace({block}, '^[&\\\\s]+', '')", f"if(contains(r, 'et al'), regexp_replace(r, {quote(rf'(?s)(?:{_ET_AL}).*\z')}, ''), r)")})"
    clean = f"if({_in(style, _KEEPS_DOT)}, {start}, regexp_replace({start}, '[.,;\\\\s]+$', ''))"
    inverted = f"if({_in(style, _INVERTED)}, regexp_replace(b, {quote(r'^([^,]+),\s+([^,]+?)(?=,|\s+and\s|\z)')}, {quote('$1' + _JOINT + '$2')}), b)"
    by_pattern: dict[str, list[str]] = {}
    for name, (_, pattern) in CONVENTIONS.items():
        by_pattern.setdefault(pattern, []).append(name)
    parts = "case " + " ".join(f"when {_in(style, tuple(v))} then {_split_sql("v", k)}" for k, v in by_pattern.items()) + " end"
    parts = let_sql("v", inverted, parts)
    bare = f"trim(regexp_replace(regexp_replace(x, '^(?:(?i:and)\\\\s+|&\\\\s*)', ''), '[,;]+$', ''))"
    order = lambda kind: _in(style, tuple(k for k, v in CONVENTIONS.items() if v[0] == kind))
    two = quote(r"^(.*\S)\s+(\S+)\z")
    words = "split(n, ' ')"
    suffixed = f"(size({words}) > 2 and array_contains(array({', '.join(map(quote, _SUFFIXES))}), lower(rtrim('.', element_at({words}, -1)))))"
    with_suffix = _named(f"rtrim('.', array_join(slice({words}, -2, 2), ' '))", f"array_join(slice({words}, 1, size({words}) - 2), ' ')")
    acronym = r"(length(n) > 3 and rlike(n, '^\\p{Lu}{2}') and not rlike(n, '\\p{Ll}'))"
    named = (
        f"case when contains(n, {quote(_JOINT)}) then {_named(f'trim(get(split(n, {quote(_JOINT)}), 0))', f'trim(get(split(n, {quote(_JOINT)}), 1))')}"
        f" when {order('family first')} then if(contains(n, ','), {_named("trim(substring_index(n, ',', 1))", "trim(substr(n, instr(n, ',') + 1))")}, {_named(literal='n')})"
        f" when {order('family, initials')} then {_named("get(split(n, ' '), 0)", "nullif(trim(substr(n, length(get(split(n, ' '), 0)) + 1)), '')")}"
        f" when {style} = 'acm' and (rlike(n, {quote(ORGANISATIONS)}) or {acronym}) then {_named(literal='n')}"
        f" when {style} = 'acm' and {suffixed} then {with_suffix}"
        f" when rlike(n, {two}) then {_named(f'regexp_extract(n, {two}, 2)', f'regexp_extract(n, {two}, 1)')} else {_named(literal='n')} end"
    )
    each = f"transform(filter(transform({parts}, x -> {bare}), n -> n <> ''), n -> {named})"
    initialled = f"({style} = 'vancouver' and rlike(b, {quote(rf'\s{CAP}{{1,3}}\z')}))"
    org = f"({looks_like_org_sql('b')} and not {initialled} and not {_in(style, (*_KEEPS_DOT, 'acm'))})"
    return let_sql("b", clean, f"case when b = '' then cast(array() as array<{PERSON}>) when not contains(b, ',') and not contains(b, ' and ') and {org} then array({_named(literal='b')}) else {each} end")


def people(style: str, block: str) -> Column:
    """People of a column, by a style's name in quotes or a column that holds one."""
    return F.expr(people_sql(style, block))


def is_truncated(block: Column) -> Column:
    return F.coalesce(block.contains("et al") & block.rlike(_ET_AL), F.lit(False))


def families(authors: Column) -> Column:
    """Family names, or the literal where an organisation comes first."""
    first = F.get(authors, F.lit(0))["literal"]
    return F.when(first.isNotNull(), F.array(first)).otherwise(F.filter(F.transform(authors, lambda a: a["family"]), lambda x: x.isNotNull()))
