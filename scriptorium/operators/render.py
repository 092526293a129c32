"""Records rendered as bibliography entries, as Column expressions.

A style is a function from a record's columns to one string; parts without a value vanish with their punctuation, as
concat() of a null is null and concat_ws() leaves nulls out. A record has type, author, author_etal, title, container,
volume, issue, page (first-last), year, doi, url, publisher, place, editor, genre, edition.

Styled text is the same text with marks around what is italic, bold or raised; `render_runs` gives it as runs. Marks are only
written where styled text is asked for, so a plain entry costs nothing for them.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.binding import let

#: Articles, conjunctions and prepositions, which title case leaves small.
SMALL_WORDS = "a about above across after against along amid among an and around as at before behind below beneath beside between beyond but by despite down during except for from in inside into like near nor of off on onto or out over per since so than the through throughout till to toward towards under until up upon versus via with within without yet".split()
#: Marks of styled text, on and off; they are taken out of the records' own texts.
MARKS = {"italic": ("\ue000", "\ue001"), "bold": ("\ue002", "\ue003"), "raised": ("\ue004", "\ue005")}
_ALL_MARKS = "".join(a + b for a, b in MARKS.values())
#: What may stand between a text's last character and its end.
_END = rf"[{_ALL_MARKS}]*\z"
_marked: ContextVar[bool] = ContextVar("marked", default=False)
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
C = F.col


def _or_null(c: Column) -> Column:
    """Null for an empty text; mentions its argument once, as these nest."""
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def cat(*parts: Column | str) -> Column:
    """All parts, or nothing if one is missing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def join(sep: str, *parts: Column | str) -> Column:
    """The parts that there are, none: null. One list a join: in lambdas each list costs more than what it holds."""
    return _or_null(F.array_join(F.array_remove(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts)), ""), sep))


def styled(c: Column, kind: str) -> Column:
    """c in a style; null and empty texts stay what they are."""
    if not _marked.get():
        return c
    on, off = MARKS[kind]
    return let(F.translate(c, _ALL_MARKS, ""), lambda c: F.when(c == "", c).otherwise(cat(on, c, off)))


def italic(c: Column) -> Column:
    return styled(c, "italic")


def initials(given: Column, dot: str = ".", gap: str = " ", hyphen: bool = True) -> Column:
    """`Ruth M.` as `R. M.`; hyphenated names keep their hyphen unless told otherwise."""
    short = F.regexp_replace(given, r"([A-ZÀ-ɏ])[^\s-]*", f"$1{dot}")
    short = short if hyphen else F.regexp_replace(short, "-", "")
    return F.regexp_replace(short, r"\s+", gap)


def family_first(a: Column, short: Callable[[Column], Column] | None, sep: str = ", ") -> Column:
    given = short(a["given"]) if short else a["given"]
    return F.coalesce(a["literal"], join(sep, a["family"], given))


def given_first(a: Column, short: Callable[[Column], Column] | None) -> Column:
    given = short(a["given"]) if short else a["given"]
    return F.coalesce(a["literal"], join(" ", given, a["family"]))


def name_list(names: Column, sep: str = ", ", last: str = ", and ", two: str | None = None, least: int = 0, shown: int = 1, et_al: str | Column = " et al.", use_last: bool = False) -> Column:
    """Names joined; from `least` names on, the first ones and `et_al` (or an ellipsis and the last name)."""

    def shown_names(names: Column) -> Column:
        n = F.size(names)
        head = lambda k: F.array_join(F.slice(names, F.lit(1), F.greatest(k, F.lit(0))), sep)
        pair = cat(F.get(names, F.lit(0)), last if two is None else two, F.get(names, F.lit(1)))
        whole = F.when(n == 1, F.get(names, F.lit(0))).when(n == 2, pair).when(n > 2, cat(head(n - 1), last, F.element_at(names, -1)))
        if not least:
            return whole
        cut = cat(head(F.lit(shown)), sep + "… ", F.element_at(names, -1)) if use_last else cat(head(F.lit(shown)), et_al)
        return F.when(n >= least, cut).otherwise(whole)

    return let(names, shown_names)


def title_case(c: Column) -> Column:
    """Capitals for all words and parts of hyphenated words, but small ones inside; what has a capital already is left alone."""

    def raised(part: Column) -> Column:
        lead = F.length(F.regexp_extract(part, "^([^A-Za-zÀ-ɏ]*)", 1))
        up = F.concat(F.substr(part, F.lit(1), lead), F.upper(F.substr(part, lead + 1, F.lit(1))), F.substr(part, lead + 2))
        return F.when(part.rlike(r"^[^A-Za-zÀ-ɏ]*\p{Ll}(?!\S*\p{Lu})"), up).otherwise(part)

    def all_words(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            parts = F.transform(F.split(w, "-"), lambda p, k: F.when((k > 0) & p.isin(SMALL_WORDS), p).otherwise(raised(p)))
            inside = (i > 0) & (i < F.size(words) - 1) & ~F.get(words, i - 1).rlike(r"[:.?!]\z")
            return F.when(inside & w.isin(SMALL_WORDS), w).otherwise(F.array_join(parts, "-"))

        return F.array_join(F.transform(words, one), " ")

    # without a part to raise, a title stays as it is and isn't taken apart
    return F.when(c.rlike(r"(?:^|[ -])[^A-Za-zÀ-ɏ -]*\p{Ll}"), let(F.split(c, " "), all_words)).otherwise(c)


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def quoted(c: Column, after: str = "") -> Column:
    """In curly quotes, with the comma or stop that follows drawn inside."""
    mark = lambda c: F.when(c.rlike(r"[.?!]\z") & F.lit(after == "."), F.lit("")).otherwise(F.lit(after))
    return let(c, lambda c: cat("“", c, mark(c), "”"))


def pages(page: Column, style: str = "expanded") -> Column:
    """A page range with an en dash: expanded, minimal, minimal-two or chicago."""
    full = F.regexp_replace(page, "-", "–")
    equal = F.length(F.split(page, "-")[0]) == F.length(F.get(F.split(page, "-"), F.lit(1)))
    cut = lambda least: F.when(equal, F.regexp_replace(page, rf"^(\d*)(\d{{{least},}})-\1(\d{{{least},}})$", "$1$2–$3")).otherwise(full)
    if style == "minimal":
        return F.regexp_replace(cut(1), "-", "–")
    if style == "minimal-two":
        return F.regexp_replace(cut(2), "-", "–")
    if style == "chicago":
        first = F.split(page, "-")[0].cast("int")
        return F.regexp_replace(F.when((first < 100) | (first % 100 == 0), full).when(first % 100 < 10, cut(1)).otherwise(cut(2)), "-", "–")
    return full


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return cat(n.cast("string"), end)


def letters(n: Column) -> Column:
    """1 as `a`, 26 as `z`, 27 as `aa`, as the columns of a sheet are named; up to five letters."""
    out, least = [], 0
    for k in range(5):
        least += 26**k  # the first number with a letter at this place; no place needs the others, so the expression grows by one letter each
        out.insert(0, F.when(n >= least, F.char(F.lit(97) + F.floor((n - least) / 26**k) % 26)).otherwise(F.lit("")))
    return F.concat(*out)


def page_label(page: Column, one: str = "p.", many: str = "pp.") -> Column:
    return F.when(page.rlike("[-–,&]"), F.lit(many)).otherwise(F.lit(one))


def month(n: Column, short: bool = False) -> Column:
    return F.get(F.array(*(F.lit(m[:3] + "." if short and len(m) > 4 else m) for m in MONTHS)), n - 1)


def collapse_numbers(numbers: Column) -> Column:
    """Sorted citation numbers with runs of three or more as ranges: `1–3,5`."""

    def step(acc: Column, n: Column) -> Column:
        last = F.element_at(acc, -1)
        grow = (F.size(acc) > 0) & (n == last["b"] + 1)
        kept = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(grow, F.concat(kept, F.array(F.struct(last["a"].alias("a"), n.alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(n.alias("a"), n.alias("b")))))

    runs = F.aggregate(F.array_sort(F.array_distinct(numbers)), F.array().cast("array<struct<a:int,b:int>>"), step)
    text = lambda r: F.when(r["b"] - r["a"] >= 2, F.concat_ws("–", r["a"].cast("string"), r["b"].cast("string"))).when(r["b"] > r["a"], F.concat_ws(",", r["a"].cast("string"), r["b"].cast("string"))).otherwise(r["a"].cast("string"))
    return F.array_join(F.transform(runs, text), ",")


def _people(short: Callable[[Column], Column] | None = None, first: str = "family", others: str = "family", sep: str = ", ", col: str = "author", **kw) -> Column:
    names = C(col)
    shown = F.transform(names, lambda a, i: F.when(i == 0, family_first(a, short, sep) if first == "family" else given_first(a, short)).otherwise(family_first(a, short, sep) if others == "family" else given_first(a, short)))
    return name_list(shown, **kw)


def _issue() -> Column:
    """The issue; a range has an en dash like pages."""
    return F.regexp_replace(C("issue"), r"(?<=\w)\s*-\s*(?=\w)", "–")


def _numbered_issue() -> Column:
    return join(" ", F.when(C("issue").isNotNull(), page_label(C("issue"), "no.", "nos.")), _issue())


def _edition() -> Column:
    """`2nd ed.` of a number, else the edition's own words."""
    number = C("edition").try_cast("int")
    return F.coalesce(cat(ordinal(number), " ed."), C("edition"))


def _link() -> Column:
    return F.coalesce(cat("https://doi.org/", C("doi")), C("url"))


def _kinds(**by_type: Column) -> Column:
    names = {"chapter": "chapter", "conference": "paper-conference", "book": "book", "thesis": "thesis", "web": "webpage"}
    out = None
    for k, column in by_type.items():
        if k in names:
            out = F.when(C("type") == names[k], column) if out is None else out.when(C("type") == names[k], column)
    return out.otherwise(by_type["other"])


def _stop(c: Column) -> Column:
    return let(c, lambda c: F.when(c.rlike(rf"[.?!]{_END}"), c).otherwise(cat(c, ".")))


def _et_al() -> Column:
    return cat(" ", italic(F.lit("et al.")))


def _nobody() -> Column:
    return F.coalesce(F.size("author"), F.lit(0)) <= 0


def _pair_of_kinds(**by_type: tuple[Column, Column]) -> tuple[Column, Column]:
    """By type, what stands for the work itself, and what says where it appeared."""
    return _kinds(**{k: v[0] for k, v in by_type.items()}), _kinds(**{k: v[1] for k, v in by_type.items()})


def apa() -> Column:
    """Without authors the title stands in their place, before the year."""
    who = _people(initials, last=", & ", least=21, shown=19, use_last=True)
    vip = join(", ", join("", italic(join(", ", C("container"), C("volume"))), cat("(", _issue(), ")")), pages(C("page")))
    ed = _people(initials, first="given", others="given", col="editor", last=", & ", two=" & ")
    date = cat("(", F.coalesce(C("year").cast("string"), F.lit("n.d.")), ").")
    own, rest = _pair_of_kinds(
        chapter=(C("title"), cat("In ", join(" ", cat(ed, " (Eds.),"), italic(C("container"))), F.coalesce(cat(" (pp. ", pages(C("page")), ")"), F.lit("")), ". ", C("publisher"))),
        conference=(C("title"), join(", ", italic(C("container")), pages(C("page")))), book=(join(" ", italic(C("title")), cat("(", _edition(), ")")), C("publisher")),
        thesis=(cat(italic(C("title")), " [", F.coalesce(C("genre"), F.lit("PhD thesis")), "]"), C("publisher")), web=(italic(C("title")), C("container")), other=(C("title"), vip),
    )
    return join(" ", cat(_stop(who), " ", date), _stop(own), F.when(_nobody(), date), _stop(rest), _link())


def harvard() -> Column:
    """Without authors an article's journal stands in their place, else the title; it isn't said again."""
    short = lambda g: initials(g, gap="")
    who = _people(short, last=" and ", least=4, et_al=_et_al())
    ed = _people(short, first="given", others="given", col="editor", last=" and ")
    q = quoted(C("title"), ",")
    pp = cat("pp. ", pages(C("page")))
    article = C("type") == "article-journal"
    own, rest = _pair_of_kinds(
        chapter=(q, cat("in ", join(" ", cat(ed, " (eds.)"), italic(C("container"))), ". ", join(", ", join(": ", C("place"), C("publisher")), pp))),
        conference=(q, join(", ", join(". ", italic(C("container")), join(": ", C("place"), C("publisher"))), pp)), book=(_stop(italic(C("title"))), join(" ", _edition(), join(": ", C("place"), C("publisher")))),
        thesis=(_stop(italic(C("title"))), cat(F.coalesce(C("genre"), F.lit("PhD thesis")), ". ", C("publisher"))), web=(cat(italic(C("title")), F.when(C("container").isNull(), ".").otherwise(",")), C("container")),
        other=(q, join(", ", italic(F.when(~(_nobody() & article), C("container"))), join("", C("volume"), cat("(", _issue(), ")")), pp)),
    )
    title = _kinds(chapter=quoted(C("title")), conference=quoted(C("title")), other=italic(C("title")))
    head = F.when(_nobody(), F.when(article, italic(C("container"))).otherwise(title)).otherwise(who)
    return join(" ", head, cat("(", F.coalesce(C("year").cast("string"), F.lit("no date")), ")"), F.when(~_nobody() | article, own), _stop(rest), cat("Available at: ", _link(), "."))


def _chicago_people() -> Column:
    return _people(None, others="given", last=", and ", two=", and ", least=7, shown=3, et_al=", et al.")


def _editors() -> Column:
    return _people(None, first="given", others="given", col="editor", last=", and ", two=" and ")


def chicago_author_date() -> Column:
    """Without authors the title stands in their place, before the year."""
    q = quoted(title_case(C("title")), ".")
    pg = pages(C("page"), "chicago")
    own, rest = _pair_of_kinds(
        chapter=(q, cat("In ", join(", ", italic(title_case(C("container"))), cat("edited by ", _editors())), ". ", C("publisher"))), conference=(q, join(", ", join(" ", italic(C("container")), cat("(", C("place"), ")")), pg)),
        book=(_stop(italic(title_case(C("title")))), join(" ", _edition(), C("publisher"))), thesis=(q, cat(F.coalesce(C("genre"), F.lit("PhD thesis")), ", ", C("publisher"))), web=(q, C("container")),
        other=(q, join(": ", join(" ", italic(C("container")), C("volume"), cat("(", _issue(), ")")), pg)),
    )
    year = cat(C("year").cast("string"), ".")
    return join(" ", _stop(_chicago_people()), F.when(~_nobody(), year), own, F.when(_nobody(), year), _stop(rest), cat(_link(), "."))


def chicago_notes() -> Column:
    q = quoted(title_case(C("title")), ".")
    pg, year = pages(C("page"), "chicago"), C("year").cast("string")
    home = _kinds(
        chapter=cat(q, " In ", join(", ", italic(title_case(C("container"))), cat("edited by ", _editors())), ". ", join(", ", C("publisher"), year), "."), conference=cat(q, " ", join(", ", join(" ", italic(C("container")), cat("(", C("place"), ")")), year, pg), "."),
        book=cat(italic(title_case(C("title"))), ". ", join(" ", _edition(), join(", ", C("publisher"), year)), "."), thesis=cat(q, " ", join(", ", F.coalesce(C("genre"), F.lit("PhD thesis")), C("publisher"), year), "."), web=cat(q, " ", join(", ", C("container"), year), "."),
        other=cat(q, " ", join(": ", join(" ", join(", ", join(" ", italic(C("container")), C("volume")), _numbered_issue()), cat("(", year, ")")), pg), "."),
    )
    return join(" ", _stop(_chicago_people()), home, cat(_link(), "."))


def _mla_people() -> Column:
    return _people(None, others="given", last=", and ", two=", and ", least=3, et_al=", et al.")


def mla() -> Column:
    who = _mla_people()
    q = quoted(title_case(C("title")), ".")
    pp, year = cat("pp. ", pages(C("page"), "minimal-two")), C("year").cast("string")
    home = _kinds(
        chapter=cat(q, " ", join(", ", italic(title_case(C("container"))), cat("edited by ", _editors()), C("publisher"), year, pp)), conference=cat(q, " ", join(", ", join(" ", italic(C("container")), cat("[", C("place"), "]")), year, pp)), book=cat(italic(title_case(C("title"))), ". ", join(", ", _edition(), C("publisher"), year)),
        thesis=cat(italic(title_case(C("title"))), ". ", join(". ", year, join(", ", C("publisher"), F.coalesce(C("genre"), F.lit("PhD thesis"))))), web=cat(q, " ", join(", ", italic(C("container")), year)), other=cat(q, " ", join(", ", italic(C("container")), cat("vol. ", C("volume")), _numbered_issue(), year, pp)),
    )
    return join(" ", _stop(who), cat(join(", ", home, _link()), "."))


def vancouver() -> Column:
    short = lambda g: initials(g, dot="", gap="", hyphen=False)
    who = _people(short, sep=" ", last=", ", least=7, shown=6, et_al=", et al.")
    ed = _people(short, sep=" ", col="editor", last=", ")
    pg, year = pages(C("page"), "minimal"), C("year").cast("string")
    press = join("; ", join(": ", C("place"), C("publisher")), year)
    home = _kinds(
        chapter=cat(C("title"), ". In: ", join(". ", cat(ed, ", editors"), C("container"), press, cat("p. ", pg))), conference=cat(C("title"), ". In: ", join(". ", C("container"), press, cat("p. ", pg))), book=cat(C("title"), ". ", join(" ", _edition(), press)),
        thesis=cat(C("title"), " [", F.coalesce(C("genre"), F.lit("PhD thesis")), "]. ", join("; ", join(": ", cat("[", C("place"), "]"), C("publisher")), year)), web=join(". ", cat(C("container"), " [Internet]"), year, C("title")),
        other=cat(C("title"), ". ", join(". ", C("container"), join(":", join("", cat(join(";", year, C("volume"))), cat("(", _issue(), ")")), pg))),
    )
    return join(" ", _stop(who), _stop(home), F.coalesce(cat("doi:", C("doi")), cat("Available from: ", C("url"))))


def nature() -> Column:
    who = _people(initials, last=" & ", least=6, et_al=_et_al())
    ed = _people(initials, col="editor", last=" & ")
    pg, year = pages(C("page")), C("year").cast("string")
    press = cat("(", join(", ", C("publisher"), C("place"), year), ")")
    inside = cat(C("title"), ". in ", join(" ", italic(C("container")), cat("(eds. ", ed, ")"), pg, press), ".")
    home = _kinds(chapter=inside, conference=inside, book=cat(italic(title_case(C("title"))), ". ", press, "."), thesis=cat(C("title"), ". ", press, "."), web=cat(join(". ", C("title"), C("container")), " ", C("url"), " (", year, ")."),
                  other=cat(C("title"), ". ", join(" ", join(", ", join(" ", italic(C("container")), styled(C("volume"), "bold")), pg), cat("(", year, ")")), "."))
    link = F.when(C("volume").isNull() & C("page").isNull() & (C("type") != "webpage") | C("type").isin("paper-conference", "chapter"), F.coalesce(cat("doi:", C("doi"), "."), cat(C("url"), ".")))
    return join(" ", _stop(who), home, link)


def ieee() -> Column:
    who = _people(initials, first="given", others="given", last=", and ", two=" and ", least=7, et_al=_et_al())
    ed = _people(initials, first="given", others="given", col="editor", last=", and ", two=" and ")
    q, pp, year = quoted(C("title"), ","), cat("pp. ", pages(C("page"))), C("year").cast("string")
    press = join(": ", C("place"), C("publisher"))
    home = _kinds(
        chapter=cat(q, " in ", join(", ", italic(C("container")), cat(ed, ", Eds."), press, year, pp)), conference=cat(q, " in ", join(", ", italic(C("container")), press, year, pp)), book=cat(F.coalesce(cat(italic(C("title")), ", ", _edition(), " "), cat(italic(C("title")), ". ")), join(", ", press, year)),
        thesis=cat(q, " ", join(", ", F.coalesce(C("genre"), F.lit("PhD thesis")), C("publisher"), C("place"), year)), web=cat(q, " ", C("container"), ". [Online]"), other=cat(q, " ", join(", ", italic(C("container")), cat("vol. ", C("volume")), cat("no. ", _issue()), pp, year)),
    )
    whole = C("type").isin("chapter", "paper-conference")  # their identifier is a sentence of its own
    told = let(cat("doi: ", C("doi")), lambda d: F.when(whole, join(". ", home, d)).otherwise(join(", ", home, d)))
    return F.concat_ws(" ", cat(who, ","), cat(told, "."), F.when(C("doi").isNull(), cat("Available: ", C("url"))))


def acs() -> Column:
    names = F.array_join(F.transform("author", lambda a: family_first(a, initials)), "; ")
    ed = F.when(F.size("editor") > 0, F.array_join(F.transform("editor", lambda a: family_first(a, initials)), ", "))
    t, pg, year = title_case(C("title")), pages(C("page")), C("year").cast("string")
    press = join(", ", join(": ", C("publisher"), C("place")), year)
    inside = cat(t, ". In ", join("; ", italic(C("container")), cat(ed, ", Eds."), press, cat("pp ", pg)), ".")
    home = _kinds(chapter=inside, conference=inside, book=cat(join(", ", italic(t), _edition()), "; ", press, "."), thesis=cat(t, ". ", join(", ", F.coalesce(C("genre"), F.lit("PhD thesis")), C("publisher"), year), "."), web=cat(C("title"), ". ", C("container"), "."),
                  other=cat(t, ". ", join(", ", join(" ", italic(C("container")), styled(year, "bold")), join(" ", italic(C("volume")), cat("(", _issue(), ")")), pg), "."))
    org = F.get(C("author"), F.lit(0))["literal"].isNotNull()
    return join(" ", F.when(org, _stop(names)).otherwise(_or_null(names)), home, _link())


def acm() -> Column:
    who = _people(None, first="given", others="given", last=", and ", two=" and ")
    t, pg, year = C("title"), pages(C("page")), C("year").cast("string")
    ed = _people(None, first="given", others="given", col="editor", last=", and ", two=" and ")
    home = _kinds(
        chapter=cat(t, ". In ", join(", ", italic(C("container")), cat(ed, " (Eds.)")), ". ", join(", ", C("publisher"), pg), "."), conference=cat(t, ". In ", italic(C("container")), ". ", join(", ", C("publisher"), pg), "."), book=cat(italic(t), ". ", C("publisher"), "."),
        thesis=cat(t, ". ", F.coalesce(C("genre"), F.lit("PhD thesis")), ". ", C("publisher"), "."), web=cat(t, "."), other=cat(t, ". ", join(", ", join(" ", join(", ", join(" ", italic(C("container")), C("volume")), _issue()), cat("(", year, ")")), pg), "."),
    )
    return join(" ", _stop(who), cat(year, "."), home, _link())


RENDERERS: dict[str, Callable[[], Column]] = {
    "apa": apa, "harvard": harvard, "chicagoAD": chicago_author_date, "chicagoFull": chicago_notes, "mla": mla,
    "vancouver": vancouver, "nature": nature, "ieee": ieee, "acs": acs, "acm": acm,
}
LABELS = {"vancouver": ("", ". "), "nature": ("", ". "), "ieee": ("[", "] "), "acm": ("[", "] "), "acs": ("(", ") ")}


def render(style: str, number: Column | None = None) -> Column:
    """The entry of a record in a style; numbered styles get their label if a number is given."""
    text = RENDERERS[style]()
    if number is None or style not in LABELS:
        return text
    left, right = LABELS[style]
    return cat(left, number.cast("string"), right, text)


def render_marked(style: str, number: Column | None = None) -> Column:
    """The entry with marks around what the style prints italic, bold or raised."""
    token = _marked.set(True)
    try:
        return render(style, number)
    finally:
        _marked.reset(token)


def to_runs(marked: Column) -> Column:
    """Marked text as runs; neighbours in the same style are one run, empty ones go."""
    from scriptorium.operators.markup import RUN

    def step(acc: Column, piece: Column) -> Column:
        lead = F.substring(piece, 1, 1)
        flag = lambda kind: F.when(lead == MARKS[kind][0], True).when(lead == MARKS[kind][1], False).otherwise(acc[kind])
        text = F.translate(piece, _ALL_MARKS, "")

        def added(run: Column) -> Column:
            last = F.element_at(F.concat(acc["runs"], F.array(F.lit(None).cast(RUN))), F.greatest(F.size(acc["runs"]), F.lit(1)))
            same = F.coalesce((last["italic"] == run["italic"]) & (last["bold"] == run["bold"]) & (last["sup"] == run["sup"]), F.lit(False))
            longer = F.struct(F.concat(last["text"], run["text"]).alias("text"), run["italic"].alias("italic"), run["bold"].alias("bold"), run["sup"].alias("sup"))
            before = F.slice(acc["runs"], F.lit(1), F.greatest(F.size(acc["runs"]) - 1, F.lit(0)))
            return F.when(run["text"] == "", acc["runs"]).when(same, F.concat(before, F.array(longer))).otherwise(F.concat(acc["runs"], F.array(run))).cast(f"array<{RUN}>")

        run = F.struct(text.alias("text"), flag("italic").alias("italic"), flag("bold").alias("bold"), flag("raised").alias("sup")).cast(RUN)
        return let(run, lambda run: F.struct(added(run).alias("runs"), run["italic"].alias("italic"), run["bold"].alias("bold"), run["sup"].alias("raised")))

    off = F.lit(False)
    start = F.struct(F.array().cast(f"array<{RUN}>").alias("runs"), off.alias("italic"), off.alias("bold"), off.alias("raised"))
    return F.aggregate(F.split(marked, f"(?=[{_ALL_MARKS}])"), start, step, lambda acc: acc["runs"])


def render_runs(style: str, number: Column | None = None) -> Column:
    """The entry as array<struct(text, italic, bold, sup)>."""
    return to_runs(render_marked(style, number))


#: What the styles' lists are sorted by.
SORT_KEYS = {"apa": ("author", "year", "title"), "harvard": ("author", "year", "title"), "chicagoAD": ("author", "year", "title"), "chicagoFull": ("author", "title", "year"), "mla": ("author", "title", "year")}
#: Words are compared without case and accents.
COLLATION = "UNICODE_CI_AI"
#: Styles that print a mark for authors who are those of the entry before, and what they print of authors.
SAME_AUTHORS = {"mla": ("———", _mla_people)}


def sort_keys(style: str) -> list[Column]:
    """A style's keys in the order of a language; an item without authors sorts by its title, one without a year first."""
    one = lambda a: F.coalesce(a["literal"], F.concat_ws(" ", a["family"], a["given"]))
    who = _or_null(F.array_join(F.transform("author", one), ", "))
    keys = {"author": F.coalesce(who, C("title")), "year": C("year"), "title": C("title")}
    return [F.collate(keys[k], COLLATION) if k != "year" else keys[k] for k in SORT_KEYS[style]]


def bibliography(records: DataFrame, style: str, key: str = "doc_id") -> DataFrame:
    """(key, entry_no, text): the style's order, its labels, and an entry a record.

    Other styles than the numbered ones sort by their keys, then by ordinal; those that cite by year print the letters of their citations.
    Numbered styles keep the order of citation (ordinal).
    """
    from scriptorium.operators.cite import CITE_STYLES, label_references

    if style in LABELS:
        ranked = records.withColumn("entry_no", F.row_number().over(Window.partitionBy(key).orderBy("ordinal")))
        return ranked.select(key, "entry_no", render(style, C("entry_no")).alias("text"))
    order = Window.partitionBy(key).orderBy(*sort_keys(style), "ordinal")
    ranked = records.withColumn("entry_no", F.row_number().over(order))
    if style in CITE_STYLES:
        ranked = label_references(ranked, style, key).withColumn("year", F.concat(C("year").cast("string"), F.coalesce(C("letter"), F.lit(""))))
    text = render(style)
    if style in SAME_AUTHORS:
        mark, people = SAME_AUTHORS[style]
        ranked = ranked.withColumn("_same", F.coalesce((F.size("author") > 0) & (F.lag("author").over(Window.partitionBy(key).orderBy("entry_no")) == C("author")), F.lit(False)))
        who = _stop(people())
        text = F.when(C("_same"), F.concat(F.lit(mark + "."), F.substr(text, F.length(who) + 1))).otherwise(text)
    return ranked.select(key, "entry_no", text.alias("text"))


def year_suffixes(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add year_suffix: a, b, c where authors and year of a document's records are equal, else null."""
    who = F.array_join(F.transform("author", lambda a: F.lower(F.coalesce(a["family"], a["literal"]))), " ")
    same = Window.partitionBy(key, "_who", "year")
    named = records.withColumn("_who", who).withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_k", F.row_number().over(same.orderBy("title")))
    return named.withColumn("year_suffix", F.when(F.col("_n") > 1, letters(F.col("_k")))).drop("_who", "_n", "_k")


def repeated_authors(entries: DataFrame, key: str = "doc_id", author: str = "author_text", mark: str = "---") -> DataFrame:
    """Replace an author text that equals the entry's before it."""
    before = F.lag(author).over(Window.partitionBy(key).orderBy("entry_no"))
    return entries.withColumn(author, F.when(before == F.col(author), F.lit(mark)).otherwise(F.col(author)))
