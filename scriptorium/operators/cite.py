"""Author-date citations: labels that tell a document's references apart, clusters of them, and their reading and resolution.

A reference is cited by names and a year. Where two references of a document would be cited alike, more names are shown, then initials,
then given names, and what is still alike gets a letter after the year. All groups are windows over references that are cited
alike so far, so no document is gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.binding import let, one_of
from scriptorium.operators.render import initials, letters

C = F.col


@dataclass(frozen=True)
class CiteStyle:
    """How a style cites: lists of `least` names and more show `shown`; `given` says whose given names may be added: those of
    first authors throughout a document, as far as `full` allows, or of any author where they are needed."""

    least: int
    shown: int
    two: str
    last: str
    gap: str  # between names and year
    given: str = "any"
    full: bool = True  # given names, not initials alone
    order: tuple[str, ...] = ("who", "year", "letter_no")


#: What the styles say of citations in text.
CITE_STYLES = {
    "apa": CiteStyle(3, 1, " & ", ", & ", ", ", "first", False),
    "harvard": CiteStyle(4, 1, " and ", " and ", ", ", order=("year", "who", "letter_no")),
    "chicagoAD": CiteStyle(3, 1, " and ", ", and ", " ", "first"),
}


def letter_number(c: Column) -> Column:
    """The number that letters stand for: `a` is 1, `aa` 27."""
    each = F.filter(F.split(c, ""), lambda x: x != "")
    many = F.aggregate(each, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 96)
    # the usual ones aren't taken apart: split() compiles its pattern for every row
    return F.when(c == "", 0).when(F.length(c) == 1, F.ascii(c) - 96).otherwise(many)


def names_text(names: Column, shown: Column, style: CiteStyle) -> Column:
    """A list of names as it stands in text, cut after `shown`."""
    n = F.size(names)
    head = lambda k: F.array_join(F.slice(names, F.lit(1), k), ", ")
    first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    cut = F.when(shown == 1, F.concat(first, F.lit(" et al."))).otherwise(F.concat(head(F.greatest(shown, F.lit(1))), F.lit(", et al.")))
    whole = F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(style.two), second)).otherwise(F.concat(head(F.greatest(n - 1, F.lit(1))), F.lit(style.last), F.element_at(names, -1)))
    return F.when(n == 0, F.lit(None).cast("string")).when(shown < n, cut).otherwise(whole)


def _first_difference(a: Column, b: Column) -> Column:
    """The 1-based place where two lists differ, 0 without a second list."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.when(b.isNull(), 0).otherwise(F.array_position(equal, False)).cast("int")


def _needed(rows: DataFrame, group: list[str], names: str) -> DataFrame:
    """Add _need: how many of `names` tell a row from all rows of its group whose names differ; 0 if none do.

    In the order of the lists, no other list shares more of its beginning than the list before or after it. Of equal lists the
    first stands beside the one before, the last beside the one after.
    """
    ordered = Window.partitionBy(*group).orderBy(names)
    beside = F.greatest(_first_difference(C(names), F.lag(names).over(ordered)), _first_difference(C(names), F.lead(names).over(ordered)))
    return rows.withColumn("_beside", beside).withColumn("_need", F.max("_beside").over(Window.partitionBy(*group, names))).drop("_beside")


def _leveled(authors: Column, level: Callable[[Column], Column]) -> Column:
    """Names at a level each: 0 family, 1 with initials, 2 with given names."""

    def one(a: Column, i: Column) -> Column:
        short = F.when(level(i) == 1, initials(a["given"])).when(level(i) == 2, a["given"])
        return F.coalesce(a["literal"], F.concat_ws(" ", F.array_remove(F.array(short), ""), a["family"]))

    return F.transform(authors, one)


def label_references(records: DataFrame, style: str, key: str = "doc_id") -> DataFrame:
    """records with who (names as cited), letter_no (null where the year alone is enough) and letter.

    records: key, ordinal, author, title, year. Without authors the title is cited. Names are compared as they are
    written. Rows alike in everything are told apart by title, then ordinal.
    """
    how = CITE_STYLES[style]
    none = F.lit(None).cast("string")
    title = F.array(F.struct(none.alias("family"), none.alias("given"), F.coalesce("title", F.lit("")).alias("literal")))
    people = F.transform("author", lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"), a["literal"].alias("literal")))
    rows = records.withColumn("_people", F.when(F.size("author") > 0, people).otherwise(title))
    at = lambda level: _leveled(C("_people"), lambda i: F.lit(level))
    if how.given == "first":
        alike = Window.partitionBy(key, "_family")
        lead = lambda level: F.coalesce(F.get(_leveled(F.slice("_people", 1, 1), lambda i: F.lit(level)), F.lit(0)), F.lit(""))
        rows = rows.withColumns({"_family": lead(0), "_short": lead(1), "_long": lead(2)})
        differ = lambda c: F.min(c).over(alike) != F.max(c).over(alike)
        # initials where those differ; given names, where a style has them, wherever they differ
        level = F.when(differ("_long"), 2).otherwise(0) if how.full else F.when(differ("_short"), 1).otherwise(0)
        rows = rows.withColumn("_level", level)
        rows = rows.withColumn("_names", _leveled(C("_people"), lambda i: F.when(i == 0, C("_level")).otherwise(0))).drop("_family", "_short", "_long", "_level")
    else:
        rows = rows.withColumn("_names", at(0))
    size = F.size("_names")
    rows = rows.withColumn("_shown", F.when(size < how.least, size).otherwise(F.lit(how.shown)))
    rows = rows.withColumn("_base", names_text(C("_names"), C("_shown"), how))
    # references that are cited alike at any later step are alike here: the windows below need no other partitioning
    group = [key, "year", "_base"]
    rows = _needed(rows, group, "_names")
    rows = rows.withColumn("_shown", F.greatest("_shown", F.least("_need", size)))
    rows = rows.withColumn("who", names_text(C("_names"), C("_shown"), how))
    for level in (1, 2) if how.given == "any" else ():
        rows = _needed(rows.withColumn("_try", at(level)), [*group, "who"], "_try")
        raised = F.zip_with(F.zip_with("_names", "_try", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.sequence(F.lit(1), size), lambda x, i: F.when(i <= C("_need"), x["b"]).otherwise(x["a"]))
        rows = rows.withColumn("_names", raised).withColumn("_shown", F.greatest("_shown", F.least("_need", size)))
        rows = rows.withColumn("who", names_text(C("_names"), C("_shown"), how))
    same = Window.partitionBy(*group, "who").orderBy("title", "ordinal")  # one order for both: one window
    number = F.when(F.count(F.lit(1)).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > 1, F.row_number().over(same))
    rows = rows.withColumn("letter_no", number.cast("int"))
    return rows.withColumn("letter", F.when(C("letter_no").isNotNull(), letters(C("letter_no")))).drop("_people", "_names", "_shown", "_base", "_need", "_try")


def _letters_text(year: Column, numbers: Column, collapse: str) -> Column:
    """A year with the letters cited with it: `2001a, 2001b`, `2001a, b` or `2001a–c`."""
    if collapse == "year":
        return F.when(F.size(numbers) == 0, year).otherwise(F.array_join(F.transform(numbers, lambda n: F.concat(year, letters(n))), ", "))
    if collapse == "suffix":
        return F.concat(year, F.array_join(F.transform(numbers, letters), ", "))
    # a letter starts an island if the one before it isn't cited
    starts = F.filter(numbers, lambda n: ~F.array_contains(numbers, n - 1))
    ends = F.filter(numbers, lambda n: ~F.array_contains(numbers, n + 1))
    island = lambda a, b: F.when(b - a >= 2, F.concat(letters(a), F.lit("–"), letters(b))).when(b > a, F.concat(letters(a), F.lit(", "), letters(b))).otherwise(letters(a))
    return F.concat(year, F.array_join(F.zip_with(starts, ends, island), ", "))


def clusters(cited: DataFrame, style: str, keys: tuple[str, ...] = ("doc_id", "cluster"), collapse: str = "year") -> DataFrame:
    """(keys, text): the citations of a cluster in one pair of brackets, in the style's order; names are said once.

    cited: keys, who, year, letter_no. Repeated citations count once. What has the same names stands together, where the
    first of it would. `collapse`: "year", "suffix" or "range", by how years and letters are gathered.
    """
    how = CITE_STYLES[style]
    order = [F.coalesce(C(c), F.lit(0)) if c != "who" else C(c) for c in how.order]
    per_year = cited.groupBy(*keys, "who", "year").agg(F.array_sort(F.collect_set("letter_no")).alias("n"), F.min(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))).alias("first"))
    year = F.coalesce(C("year").cast("string"), F.lit("n.d."))
    said = F.struct("first", _letters_text(year, C("n"), collapse).alias("said"))
    per_name = per_year.groupBy(*keys, "who").agg(F.array_sort(F.collect_list(said)).alias("years"))
    one = F.concat("who", F.lit(how.gap), F.array_join(F.transform("years", lambda y: y["said"]), ", "))
    each = per_name.select(*keys, F.struct(F.get("years", F.lit(0))["first"].alias("first"), one.alias("said")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["said"])
    return each.groupBy(*keys).agg(F.concat(F.lit("("), F.array_join(parts, "; "), F.lit(")")).alias("text"))


# --- reading --------------------------------------------------------------------------------------------------------

_YEAR = r"(?:1[5-9]|20)\d{2}"
#: Words before a citation that belong to the sentence.
_SIGNALS = r"^(?:(?:see|also|cf\.|e\.g\.|i\.e\.|compare|in|and|but|with)[,\s]+)+"
_GIVEN = r"^((?:\p{Lu}\.[-\s]?)+)\s*(.*)$"
#: What follows the names: years with letters, single letters, ranges of letters.
_TAIL = rf"(?:{_YEAR}[a-z]{{0,2}}|n\.d\.)(?:\s*[,–-]\s*(?:{_YEAR}[a-z]{{0,2}}|n\.d\.|[a-z]{{1,2}}\b))*"
#: A part that ends with its years, or with a place in the work after them; else the first year counts.
_AT_END = rf"(?s)^(.*?)[,\s]*({_TAIL})(?:\s*,\s*(?:pp?|ch|chap|vol|fig|sec)\.\s.*)?\s*$"
_ANYWHERE = rf"(?s)^(.*?)[,\s]*({_TAIL}).*$"
_YEARS = "array<struct<year:int,letter:string>>"
#: Marks where a text is cut.
_CUT = "\u0001"
MENTION = "array<struct<names:array<struct<given:string,family:string>>,et_al:boolean,year:int,letter:string>>"


def _words(bare: Column) -> Column:
    """A list of names cut where its signs are; marked first, as split() compiles a longer pattern for every row."""
    signs = r"\s*,?\s*&\s*|\s*,?\s+and\s+|\s*,\s*"
    return F.when(bare.contains(_CUT), F.split(bare, signs)).otherwise(F.split(F.regexp_replace(bare, signs, _CUT), _CUT))


def _names_of(said: Column) -> Column:
    """struct(names, et_al) of the words before a year."""

    def name(p: Column) -> Column:
        given = F.nullif(F.trim(F.regexp_extract(p, _GIVEN, 1)), F.lit(""))
        # without a stop behind its first letter a name has no initials
        return F.when(F.substring(p, 2, 1) == ".", F.struct(given.alias("given"), F.regexp_replace(p, _GIVEN, "$2").alias("family"))).otherwise(F.struct(F.lit(None).cast("string").alias("given"), p.alias("family")))

    def read(clean: Column) -> Column:
        et_al = clean.rlike(r"\bet al\.?")
        bare = F.trim(F.when(et_al, F.regexp_replace(clean, r",?\s*\bet al\.?.*$", "")).otherwise(clean))
        return F.struct(F.transform(F.filter(let(bare, _words), lambda p: p != ""), name).alias("names"), et_al.alias("et_al"))

    return let(F.regexp_replace(F.regexp_replace(F.trim(said), _SIGNALS, ""), r"[\s,(]+$", ""), read)


def _years_of(tail: Column) -> Column:
    """array<struct(year, letter)> of the words from the first year on: letters alone go with the year before, ranges are filled in."""
    tokens = F.regexp_extract_all(tail, F.lit(rf"{_YEAR}[a-z]{{0,2}}|n\.d\.|(?<![a-z.])[a-z]{{1,2}}\b|[–-]"), 0)
    start = F.struct(F.lit(None).cast("int").alias("year"), F.lit(0).alias("last"), F.lit(False).alias("to"), F.array().cast(_YEARS).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        numbered, undated = F.substring(t, 1, 1).between("0", "9"), t == "n.d."
        letter = F.when(undated, F.lit("")).when(numbered, F.substring(t, 5, 2)).otherwise(t)

        def with_letter(year: Column, n: Column) -> Column:
            fill = F.when(acc["to"] & (acc["last"] > 0) & (n > acc["last"]), F.sequence(acc["last"] + 1, n)).otherwise(F.array(n))
            found = F.transform(fill, lambda k: F.struct(year.alias("year"), F.when(k > 0, letters(k)).alias("letter")))
            return F.struct(year.alias("year"), n.cast("int").alias("last"), F.lit(False).alias("to"), F.concat(acc["out"], found).cast(_YEARS).alias("out"))

        year = F.when(numbered, F.substring(t, 1, 4).cast("int")).when(undated, F.lit(None).cast("int")).otherwise(acc["year"])
        dash = F.struct(acc["year"].alias("year"), acc["last"].alias("last"), F.lit(True).alias("to"), acc["out"].alias("out"))
        return F.when(one_of(t, "–", "-"), dash).otherwise(let(F.struct(year.alias("year"), letter_number(letter).alias("n")), lambda x: with_letter(x["year"], x["n"])))

    one = F.struct(F.substring(tail, 1, 4).cast("int").alias("year"), F.nullif(F.substring(tail, 5, 2), F.lit("")).alias("letter"))
    # a lone year with or without its letters is most of what is cited
    return F.when(tail.rlike(rf"^{_YEAR}[a-z]{{0,2}}\z"), F.array(one).cast(_YEARS)).otherwise(F.aggregate(tokens, start, step, lambda acc: acc["out"]))


def mentions(citation: Column) -> Column:
    """All that one citation names: array<struct(names, et_al, year, letter)>, an element per reference that is meant.

    `(see Orr 2001a, b; A. Ray & Lee, 2003–2004)`, `(Orr, 2001; 2003)` and `Orr et al. (2001, 2003)` are read: a part
    without names has those of the part before it.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(citation), r"^\(|\)$", ""), r"\s*\((?=\d|n\.d\.)", " ")
    parts = F.filter(F.transform(F.split(plain, ";"), lambda p: F.trim(p)), lambda p: p.rlike(rf"{_YEAR}|n\.d\."))
    start = F.struct(F.array().cast("array<struct<given:string,family:string>>").alias("names"), F.lit(False).alias("et_al"), F.array().cast(MENTION).alias("out"))

    def cut(part: Column) -> Column:
        """What stands before the years, the mark, and the years, which never hold the mark: one match gives both. A match changes the part."""
        marked = lambda pattern: F.regexp_replace(part, pattern, f"$1{_CUT}$2")
        return let(marked(_AT_END), lambda m: F.when(m == part, marked(_ANYWHERE)).otherwise(m))

    def step(acc: Column, part: Column) -> Column:
        def with_years(m: Column, tail: Column) -> Column:
            def with_names(own: Column) -> Column:
                found = F.transform(_years_of(tail), lambda y: F.struct(own["names"].alias("names"), own["et_al"].alias("et_al"), y["year"].alias("year"), y["letter"].alias("letter")))
                return F.struct(own["names"].alias("names"), own["et_al"].alias("et_al"), F.concat(acc["out"], found).cast(MENTION).alias("out"))

            before = F.struct(acc["names"].alias("names"), acc["et_al"].alias("et_al"))
            own = _names_of(F.substr(m, F.lit(1), F.length(m) - F.length(tail) - 1))
            return let(let(own, lambda o: F.when(F.size(o["names"]) > 0, o).otherwise(before)), with_names)

        return let(cut(part), lambda m: let(F.substring_index(m, _CUT, -1), lambda tail: with_years(m, tail)))

    every = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.filter(every, lambda m: F.size(m["names"]) > 0)


# --- resolution -----------------------------------------------------------------------------------------------------


def _surname(name: Column) -> Column:
    """The last word of a name, in small letters."""
    return F.lower(F.element_at(F.split(name, r"\s+"), -1))


def resolve(cited: DataFrame, listed: DataFrame, key: str = "doc_id", mention: str = "mention_id", least: int = 2) -> DataFrame:
    """(key, mention, status, ordinal, candidates) of every mention: `ok` with the reference that it means, `ambiguous` where
    several are meant equally well, `loose` where one or more agree in first surname and year only, or `not listed`.

    cited: key, mention and a mention's names, et_al, year, letter. listed: key, ordinal, author, year, letter. A reference is a candidate
    if first surname and year agree and its letter isn't another one. Of the candidates those of the best rank count: names
    that agree throughout (number, surnames, initials as they are or as far as given), then the letter. `et al.` stands for lists of `least`
    names and more.
    """
    name = lambda a: F.coalesce(a["family"], a["literal"])
    left = cited.select(key, mention, "names", "et_al", "year", "letter", _surname(F.get("names", F.lit(0))["family"]).alias("_by"))
    right = listed.select(key, C("ordinal"), C("author").alias("_author"), C("letter").alias("_letter"), C("year"), _surname(name(F.get("author", F.lit(0)))).alias("_by"))
    year = [left["year"].eqNullSafe(right["year"])]
    both = left.join(right, [left[key] == right[key], left["_by"] == right["_by"], *year], "left").select(left[key], mention, "names", "et_al", "letter", "ordinal", "_author", "_letter")

    def agrees(said: Column, a: Column) -> Column:
        """0 no, 1 as far as initials are given, 2 wholly."""
        own = name(a)
        whole = (F.lower(said["family"]) == F.lower(own)) | (F.lower(said["family"]) == F.lower(F.concat_ws(" ", a["given"], a["family"])))
        short, given = F.regexp_replace(initials(a["given"]), r"\s", ""), F.regexp_replace(said["given"], r"\s", "")
        return F.when(~whole, 0).when(given.isNull() | (given == short), 2).when(short.startswith(given), 1).otherwise(0)

    n, m = F.size("names"), F.size("_author")
    number = F.when(C("et_al"), (n < m) & (m >= least)).otherwise(n == m)
    alike = F.array_min(F.zip_with("names", F.slice("_author", 1, F.greatest(n, F.lit(1))), lambda s, a: F.coalesce(agrees(s, a), F.lit(0))))
    throughout = F.coalesce(F.when(number, alike), F.lit(0))
    fits = C("ordinal").isNotNull() & (C("letter").isNull() | C("_letter").isNull() | (C("letter") == C("_letter")))
    rank = F.when(fits, 2 * throughout + C("letter").eqNullSafe(C("_letter")).cast("int"))
    # one aggregate after another: joining the best ranks back would read and look up every mention twice
    at_rank = both.groupBy(key, mention, rank.alias("rank")).agg(F.count("ordinal").alias("candidates"), F.min("ordinal").alias("ordinal"))
    best = F.max(F.struct("rank", F.when(C("rank").isNull(), 0).otherwise(C("candidates")).alias("candidates"), "ordinal")).alias("b")
    at_best = at_rank.groupBy(key, mention).agg(best).select(key, mention, C("b.rank").alias("best"), C("b.candidates").alias("candidates"), C("b.ordinal").alias("ordinal"))
    status = F.when(C("best").isNull(), "not listed").when(C("best") < 2, "loose").when(C("candidates") == 1, "ok").otherwise("ambiguous")
    return at_best.select(key, mention, status.alias("status"), F.when(status == "ok", C("ordinal")).alias("ordinal"), "candidates")


def cross_check_names(resolved: DataFrame, listed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, status, times): references that are cited and that aren't, and with a null ordinal what is ambiguous or not listed."""
    times = resolved.groupBy(key, "status", "ordinal").agg(F.count(F.lit(1)).alias("times")).select(key, "ordinal", "status", "times")
    rows = times.union(listed.select(key, "ordinal", F.lit("not cited"), F.lit(0).cast("long")))
    cited = F.max("times").over(Window.partitionBy(key, "ordinal"))  # counts of one reference
    return rows.withColumn("_cited", cited).filter((C("times") > 0) | (C("_cited") == 0) | C("ordinal").isNull()).drop("_cited")
