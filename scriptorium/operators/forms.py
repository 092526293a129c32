"""Reference forms by style: tables of templates, and the engine that matches them as Column expressions.

A template is the look of an entry's text after its authors. `{title}` and other names are fields, a blank stands for
white space, `~` for white space that may be missing, `[[...]]` for an optional part. Forms are tried in order; the first
that matches gives all its fields from one regular expression replacement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.binding import let_sql

#: Publishers whose names don't say that they are one; a parameter of the forms, to be extended at will.
KNOWN_PUBLISHERS = ("Routledge", "Springer", "Elgar", "Elsevier", "Wiley", "Sage", "Palgrave", "Brill", "Kluwer", "Birkhäuser")
_IMPRINT = r"([^.]*(?:\b(?:Press|Publish[a-z]+|Verlag|Books|Editions)\b|" + "|".join(KNOWN_PUBLISHERS) + r")[^.]*)"
FIELDS = ("title", "container", "volume", "issue", "first", "last", "publisher", "place", "editor", "genre", "chapter")
_SEP = "\u0001"

#: What a field looks like: (expression, fields of its groups).
_TOKENS = {
    "title": ("(.+?)", ("title",)),
    "unquoted": ('([^"].+?)', ("title",)),
    "quoted": ('([^"]+?)', ("title",)),
    "container": ("(.+?)", ("container",)),
    "plain": (r"([^.]+?)", ("container",)),
    "nocomma": (r"([^,]*?)", ("container",)),
    "proceedings": (r"((?:Proceedings|Proc\.|Proceedings of)\b.+?)", ("container",)),
    "tail": ("(.+)", ("container",)),
    "v": (r"(\d{1,4})", ("volume",)),
    "i": (r"([^)]+)", ("issue",)),
    "n": (r"([0-9–-]+)", ("issue",)),
    "p": (r"(\d{1,6})\s*[–-]\s*(\d{1,6})", ("first", "last")),
    "s": (r"(\d{1,6})", ("first",)),
    "publisher": ("(.+?)", ("publisher",)),
    "press": (_IMPRINT, ("publisher",)),
    "place": ("(.+?)", ("place",)),
    "city": (r"\[?([^\]:]*)\]?", ("place",)),
    "editor": ("(.+?)", ("editor",)),
    "thesis": (r"((?:PhD|phd|Ph\.D\.) (?:thesis|dissertation))", ("genre",)),
    "imprint": (r"([^.]+?)", ("publisher",)),
    "preprint": (r"(arXiv(?i: preprint)?|[a-z]{2,6}Rxiv)", ("container",)),
    "chapter": (r"(\d{1,4})", ("chapter",)),
    "day": (r"(?:[A-Z][a-z]+\.?\s+\d{1,2}|\d{1,2}\s+[A-Z][a-z]+\.?)", ()),
    "y": (r"\d{4}", ()),
    "ed": (r"\(?\d+(?:st|nd|rd|th)\s*ed\.\)?", ()),
    "...": (".*", ()),
}


@dataclass(frozen=True)
class Form:
    style: str
    template: str
    type: str
    fixed_container: str | None = None

    def compiled(self) -> tuple[str, tuple[str, ...]]:
        """The whole-text expression and the fields of its groups."""
        out, fields = [], []
        for piece in re.split(r"(\{[^}]+\}|\[\[|\]\]|~| )", self.template):
            if piece.startswith("{"):
                expression, names = _TOKENS[piece[1:-1]]
                out.append(expression)
                fields += names
            else:
                out.append({"[[": "(?:", "]]": ")?", "~": r"\s*", " ": r"\s+"}.get(piece) or re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", piece))
        return r"(?s)^\s*" + "".join(out) + r"\s*\z", tuple(fields)


_Q = '"{quoted}[[.]][[,]]"[[.]][[,]]~'

FORMS = (
    Form("apa", "{title}. In {editor} (Ed[[s]].),~{container} (pp.~{p}).~{publisher}[[.]]", "chapter"),
    Form("apa", "{title}. In {container} (pp.~{p}).~{publisher}[[.]]", "chapter"),
    Form("apa", "{title}. In {preprint}.{...}", "article"),
    Form("apa", "{title} [{thesis}[[,~{imprint}]]].~{...}", "thesis"),
    Form("apa", "{title}. {plain},~{v}~({i})~,~{p}{...}", "article-journal"),
    Form("apa", "{title}. {nocomma},~{v}~,~{p}{...}", "article-journal"),
    Form("apa", "{title}. {container}~,~{p}{...}", "article-journal"),
    Form("apa", "{title}[[.]][[ {ed}]].~{press}[[.]]", "book"),
    Form("apa", "{title}. {imprint}[[.]]", "book"),
    Form("apa", "{title}[[.]]", "article-journal"),
    Form("harvard", _Q + "in {editor}~(ed[[s]][[.]])~{container}. {place}:~{publisher},~pp.~{p}{...}", "chapter"),
    Form("harvard", _Q + "in {container}. {place}:~{publisher},~pp.~{p}{...}", "chapter"),
    Form("harvard", _Q + "{preprint} [Preprint].{...}", "article"),
    Form("harvard", _Q + "{proceedings}. {place}:~{publisher},~pp.~{p}{...}", "paper-conference"),
    Form("harvard", _Q + "{container},~{v}~({i})~[[,]]~pp.~{p}{...}", "article-journal"),
    Form("harvard", _Q + "{container},~{v}~[[,]]~pp.~{p}{...}", "article-journal"),
    Form("harvard", _Q + "{container},~pp.~{p}{...}", "paper-conference"),
    Form("harvard", "{title}. {thesis}.~{publisher}[[.]]", "thesis"),
    Form("harvard", "{unquoted},~{nocomma}.~Available at{...}", "webpage"),
    Form("harvard", "{title}.[[ {ed}]] {place}:~{publisher}[[.]]", "book"),
    Form("harvard", _Q + "{plain}.~Available at{...}", "article-journal"),
    Form("harvard", _Q + "{tail}", "article-journal"),
    Form("harvard", "{title}. {...}", "article-journal"),
    Form("harvard", "{title}", "article-journal"),
    Form("chicagoAD", _Q + "In {preprint}.{...}", "article"),
    Form("chicagoAD", _Q + "In {container}, edited by {editor}.~{publisher}[[.]]", "chapter"),
    Form("chicagoAD", _Q + "{container} {v}~({i})~:~{p}{...}", "article-journal"),
    Form("chicagoAD", _Q + "{container} {v}~:~{p}{...}", "article-journal"),
    Form("chicagoAD", _Q + "{container} ({place})~,~{p}{...}", "paper-conference"),
    Form("chicagoAD", _Q + "In {container}. {...}", "chapter"),
    Form("chicagoAD", _Q + "{nocomma},~{day}[[.]]{...}", "article-journal"),
    Form("chicagoAD", _Q + "{thesis},~{publisher}[[.]]", "thesis"),
    Form("chicagoAD", _Q + "{tail}", "article-journal"),
    Form("chicagoAD", "{title}.[[ {ed}]] {press}[[.]]", "book"),
    Form("chicagoAD", "{title}. {imprint}[[.]]", "book"),
    Form("chicagoAD", "{title}[[.]]", "article-journal"),
    Form("chicagoFull", _Q + "In {preprint}.{...}", "article"),
    Form("chicagoFull", _Q + "In {container}, edited by {editor}.~{publisher}[[,~{y}]][[.]]", "chapter"),
    Form("chicagoFull", _Q + "{container} {v},~no[[s]].~{n}~[[({y})]]~:~{p}{...}", "article-journal"),
    Form("chicagoFull", _Q + "{container} {v}~[[({y})]]~:~{p}{...}", "article-journal"),
    Form("chicagoFull", _Q + "{container} ({place}[[,~{y}]])~,~{p}{...}", "paper-conference"),
    Form("chicagoFull", _Q + "In {container}. {...}", "chapter"),
    Form("chicagoFull", _Q + "{proceedings} ({place}),~{y}[[,~{p}]][[.]]{...}", "paper-conference"),
    Form("chicagoFull", _Q + "{nocomma},~{day},~{y}[[.]]{...}", "article-journal"),
    Form("chicagoFull", _Q + "{thesis},~{publisher}[[,~{y}]][[.]]", "thesis"),
    Form("chicagoFull", _Q + "{nocomma}~[[,]]~[[(]]{y}[[)]][[.]]{...}", "article-journal"),
    Form("chicagoFull", _Q + "{tail}", "article-journal"),
    Form("chicagoFull", "{title}.[[ {ed}]] {place}:~{publisher},~{y}[[.]]", "book"),
    Form("chicagoFull", "{title}.[[ {ed}]] {publisher},~{y}[[.]]", "book"),
    Form("chicagoFull", "{title}", "book"),
    Form("mla", _Q + "{container},~edited by {editor}.~{publisher},~{y},~pp.~{p}{...}", "chapter"),
    Form("mla", _Q + "{container},~edited by {editor},~{publisher},~{y},~pp.~{p}{...}", "chapter"),
    Form("mla", _Q + "{container},~vol.~{v}~,~no[[s]].~{n}~,~{y}~,~pp.~{p}{...}", "article-journal"),
    Form("mla", _Q + "{container},~vol.~{v}~,~{y}~,~pp.~{p}{...}", "article-journal"),
    Form("mla", _Q + "{proceedings} [{...}],~{y}[[,~pp.~{p}]]{...}", "paper-conference"),
    Form("mla", _Q + "{nocomma},~{day}~{y}{...}", "article-journal"),
    Form("mla", "{title}. {y}. {publisher},~{thesis}[[.]]", "thesis"),
    Form("mla", _Q + "{proceedings},~{publisher},~{y}[[,~pp.~{p}]]{...}", "paper-conference"),
    Form("mla", _Q + "{nocomma},~{y}{...}", "article-journal"),
    Form("mla", _Q + "{tail}", "article-journal"),
    Form("mla", "{title}.~[[{ed},~]]{publisher},~{y}[[.]]", "book"),
    Form("mla", "{title}", "book"),
    Form("vancouver", "{title} [{thesis}][[.]]~{city}:~{publisher};~{y}{...}", "thesis"),
    Form("vancouver", "{title}. In:~{proceedings}. {place}:~{publisher};~{y}.~p.~{p}{...}", "paper-conference"),
    Form("vancouver", "{title}. In:~{editor},~editor[[s]].~{container}. {place}:~{publisher};~{y}.~p.~{p}{...}", "chapter"),
    Form("vancouver", "{title}. {container}.~[[{y};]]{v}~({i})~:~{p}{...}", "article-journal"),
    Form("vancouver", "{title}. {container}.~[[{y};]]{v}~:~{p}{...}", "article-journal"),
    Form("vancouver", "{title}.[[ {ed}]] {place}:~{publisher};~{y}[[.]]", "book"),
    Form("vancouver", "{title}. {preprint} [Internet].{...}", "article"),
    Form("vancouver", "{container} [Internet].~{y}~[[.]]~{title}.~Available from{...}", "webpage"),
    Form("vancouver", "{title} [Internet].~{...}", "webpage"),
    Form("vancouver", "{title}. {plain}.~{y}.~Available from{...}", "article-journal"),
    Form("vancouver", "{title}. {tail}", "article-journal"),
    Form("vancouver", "{title}", "article-journal"),
    Form("nature", "{title}~({thesis}),~({publisher},~{place},~{y}){...}", "thesis"),
    Form("nature", "{title}. in {container} (ed[[s]].~{editor}) {p}~({publisher},~{place},~{y}){...}", "chapter"),
    Form("nature", "{title}. in {container} {p}~({publisher},~{place},~{y}){...}", "paper-conference"),
    Form("nature", "{title}.~({publisher},~{place},~{y})[[.]]", "book"),
    Form("nature", "{title}. {container} {v}~,~{p}~({y}){...}", "article-journal"),
    Form("nature", "{title}.~arXiv preprint{...}", "article", "arXiv preprint"),
    Form("nature", "{title}. {plain} ({y}){...}", "article-journal"),
    Form("nature", "{title}. {tail}", "article-journal"),
    Form("nature", "{title}", "article-journal"),
    Form("ieee", _Q + "in {container}~,~{editor},~Ed[[s]].~[[,]]~{place}:~{publisher},~{y},~pp.~{p}{...}", "chapter"),
    Form("ieee", _Q + "in {container},~{place}:~{publisher},~{y},~pp.~{p}{...}", "paper-conference"),
    Form("ieee", _Q + "{thesis},~{publisher},~{place},~{y}{...}", "thesis"),
    Form("ieee", _Q + "{container},~vol.~{v}~,~no[[s]].~{n}~,~pp.~{p}{...}", "article-journal"),
    Form("ieee", _Q + "{container},~vol.~{v}~,~pp.~{p}{...}", "article-journal"),
    Form("ieee", _Q + "{place}:~{publisher},~{y}[[.]]", "book"),
    Form("ieee", _Q + "{y}.~[Online]{...}", "webpage"),
    Form("ieee", _Q + "{plain}.~[[.]]~[Online]{...}", "webpage"),
    Form("ieee", _Q + "{nocomma},~{y}[[.]]{...}", "article-journal"),
    Form("ieee", _Q + "{tail}", "article-journal"),
    Form("ieee", "{title},~{ed} {place}:~{publisher},~{y}[[.]]", "book"),
    Form("ieee", "{title}.[[ {ed}]] {place}:~{publisher},~{y}[[.]]", "book"),
    Form("ieee", "{title}", "article-journal"),
    Form("acs", "{title}.~{thesis}~,~{publisher},~{y}{...}", "thesis"),
    Form("acs", "{title}.~In {container};~{editor},~Ed[[s]].~;~{publisher}:~{place},~{y};~pp~{p}{...}", "chapter"),
    Form("acs", "{title}.~In {container};~{publisher}:~{place},~{y};~pp~{p}{...}", "paper-conference"),
    Form("acs", "{title}. {container} {y},~{v}~({i})~,~{p}{...}", "article-journal"),
    Form("acs", "{title}. {container} {y},~{v}~,~{p}{...}", "article-journal"),
    Form("acs", "{title}[[,~{ed}]];~{publisher}:~{place},~{y}[[.]]", "book"),
    Form("acs", "{title}. {publisher}:~{place},~{y}[[.]]", "book"),
    Form("acs", "{title}.~arXiv preprint{...}", "article", "arXiv preprint"),
    Form("acs", "{title}.~{preprint}[[.]]~{y}{...}", "article"),
    Form("acs", "{title}. {tail}", "article-journal"),
    Form("acs", "{title}", "article-journal"),
    Form("acm", "{title}. In {container}, {editor} (Ed[[s]][[.]]). {publisher}[[,~{p}]][[.]]", "chapter"),
    Form("acm", "{title}. In {proceedings}. {publisher},~{p}[[.]]", "paper-conference"),
    Form("acm", "{title}. In {proceedings}.[[ {...}]]", "paper-conference"),
    Form("acm", "{title}. In {container}. {publisher},~{p}[[.]]", "chapter"),
    Form("acm", "{title}. In {container}[[.]]", "chapter"),
    Form("acm", "{title}. arXiv preprint{...}", "article", "arXiv preprint"),
    Form("acm", "{title}. {thesis}.~{publisher}[[.]]", "thesis"),
    Form("acm", "{title}. {publisher},~Chapter {chapter}~,~{p}{...}", "chapter"),
    Form("acm", "{title}. {container} {v},~{n}~({y})~,~{p}{...}", "article-journal"),
    Form("acm", "{title}. {container} {v}~({y})~,~{p}{...}", "article-journal"),
    Form("acm", "{title}. {container} {v},~{n}~({y})~,~{s}{...}", "article-journal"),
    Form("acm", "{title}. {container} {v}~({y})~,~{s}{...}", "article-journal"),
    Form("acm", "{title}. {container} ({y}).{...}", "article-journal"),
    Form("acm", "{title}. Vol.~{v}.~{publisher}[[.]]", "book"),
    Form("acm", "{title}. Number {y}.~{publisher}[[.]]", "book"),
    Form("acm", "{title}.~[[,]]~{s} pages[[.]]", "article"),
    Form("acm", "{title}. {publisher}[[.]]", "book"),
    Form("acm", "{title}[[.]]", "article-journal"),
)

STYLES = tuple(dict.fromkeys(f.style for f in FORMS))


@cache
def _places() -> dict[str, list[int]]:
    """Of each field, its 1-based part in every form's match (0: none)."""
    fields = [f.compiled()[1] for f in FORMS]
    return {name: [names.index(name) + 2 if name in names else 0 for names in fields] for name in FIELDS}


def _literal(text: str | None) -> str:
    """A SQL string literal."""
    return "cast(null as string)" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The tables go to Spark as SQL expressions: one call each instead of one a literal.


def matched(style: str, after: str) -> Column:
    """array<string> of two columns: the form's number, then its groups. Only the forms of the row's style are tried."""
    cut = _literal(_SEP)
    per_style: dict[str, list[str]] = {}
    for i, form in enumerate(FORMS):
        pattern, fields = form.compiled()
        # one match gives all groups; a text that doesn't match stays without separators
        groups = "".join(f"{_SEP}${k + 1}" for k in range(len(fields)))
        hit = f"if(contains(s, {cut}), split(concat('{i + 1}', s), {cut}), null)"
        per_style.setdefault(form.style, []).append(let_sql("s", f"regexp_replace({after}, {_literal(pattern)}, {_literal(groups)})", hit))
    return F.expr("case " + " ".join(f"when {style} = '{name}' then coalesce({', '.join(forms)})" for name, forms in per_style.items()) + " end")


def field(match: str, name: str) -> Column:
    """A field of a match; null where the form has none or left it empty."""
    at = f"get(array({', '.join(map(str, _places()[name]))}), cast(get({match}, 0) as int) - 1)"
    return F.expr(f"nullif(if({at} > 0, get({match}, {at} - 1), null), '')")


def form_type(match: str) -> Column:
    return F.expr(f"get(array({', '.join(_literal(f.type) for f in FORMS)}), cast(get({match}, 0) as int) - 1)")


def fixed_container(match: str) -> Column:
    return F.expr(f"get(array({', '.join(_literal(f.fixed_container) for f in FORMS)}), cast(get({match}, 0) as int) - 1)")
