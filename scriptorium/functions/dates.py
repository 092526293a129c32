"""Dates of one to three parts and ranges of them: printed by the largest part that differs, and read back.

A date is struct<from, to>, each array<int> of year, month and day as far as they are known; `to` is null for a single date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.binding import let

DATE = "struct<from:array<int>,to:array<int>>"
#: The months' names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_NAMES = "|".join(m[:3] for m in MONTHS)
#: The order of parts, and what stands before the last of them.
FORMS = {"mdy": ("md", ", ", "y"), "dmy": ("dm", " ", "y"), "ymd": ("y", ", ", "md")}


def of_parts(parts: Column) -> Column:
    """A date of CSL date-parts: a list for its beginning and perhaps one for its end; null without a year."""
    ints = lambda i: F.transform(F.get(parts, F.lit(i)), lambda x: x.cast("int"))
    return F.when(F.get(ints(0), F.lit(0)).isNotNull(), F.struct(ints(0).alias("from"), F.when(F.size(ints(1)) > 0, ints(1)).alias("to")).cast(DATE))


def year_of(date: Column) -> Column:
    return F.get(date["from"], F.lit(0))


def month_name(n: Column, short: bool = False) -> Column:
    return F.get(F.array(*(F.lit(m[:3] + "." if short and len(m) > 4 else m) for m in MONTHS)), n - 1)


def _day_and_month(p: Column, form: str, short: bool) -> Column:
    """What of a month and a day there is, in the form's order."""
    month, day = month_name(F.get(p, F.lit(1)), short), F.get(p, F.lit(2)).cast("string")
    return F.when(month.isNull(), F.lit("")).otherwise(F.concat_ws(" ", *((day, month) if form == "dmy" else (month, day))))


def _whole(p: Column, form: str, short: bool) -> Column:
    year, rest = F.get(p, F.lit(0)).cast("string"), _day_and_month(p, form, short)
    if form == "ymd":
        return F.when(rest == "", year).otherwise(F.concat(year, F.lit(", "), rest))
    comma = F.when((F.lit(form) == "mdy") & (F.size(p) > 2), F.lit(", ")).otherwise(F.lit(" "))
    return F.when(rest == "", year).otherwise(F.concat(rest, comma, year))


def show(date: Column, form: str = "mdy", short: bool = False) -> Column:
    """`May 3, 2020`, `3 May 2020` or `2020, May 3`, less what isn't known; in a range what is the same is said once:
    `May 3–5, 2020`, `3 May–2 June 2020`, `2019, December 30–2020, January 2`."""
    dash = F.lit("–")

    def ranged(d: Column) -> Column:
        a, b = d["from"], d["to"]
        at = lambda p, i: F.get(p, F.lit(i))
        same_size = F.size(a) == F.size(b)
        year, month = at(a, 0) == at(b, 0), at(a, 1) == at(b, 1)
        days = F.concat(at(a, 2).cast("string"), dash, at(b, 2).cast("string"))
        in_month = F.concat_ws(" ", *((days, month_name(at(a, 1), short)) if form == "dmy" else (month_name(at(a, 1), short), days)))
        in_year = F.concat(_day_and_month(a, form, short), dash, _day_and_month(b, form, short))
        said_year = at(a, 0).cast("string")
        comma = F.when((F.lit(form) == "mdy") & (F.size(a) > 2), F.lit(", ")).otherwise(F.lit(" "))
        framed = lambda c: F.concat(said_year, F.lit(", "), c) if form == "ymd" else F.concat(c, comma, said_year)
        apart = F.concat(_whole(a, form, short), dash, _whole(b, form, short))
        return (
            F.when(a == b, _whole(a, form, short)).when(~same_size | ~year | (F.size(a) < 2), apart)
            .when((F.size(a) > 2) & month, framed(in_month)).otherwise(framed(in_year))
        )

    return let(date, lambda d: F.when(d["to"].isNull(), _whole(d["from"], form, short)).otherwise(ranged(d)))


def _side(c: Column) -> Column:
    """struct(y, m, d) of what one side of a dash says; ISO dates are read too."""
    iso = c.rlike(r"^\s*\d{4}-\d{2}(?:-\d{2})?\s*$")
    number = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")
    month = F.nullif(F.regexp_extract(c, rf"\b({_NAMES})", 1), F.lit(""))
    named = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), month).cast("int")
    return F.struct(
        number(r"(?<!\d)(\d{4})(?!\d)").alias("y"), F.when(iso, number(r"^\s*\d{4}-(\d{2})")).otherwise(F.nullif(named, F.lit(0))).alias("m"),
        F.when(iso, number(r"-\d{2}-(\d{2})")).otherwise(number(r"(?<![\d–])(\d{1,2})(?![\d])")).alias("d"),
    )


def read(text: Column) -> Column:
    """The date that a text such as those of `show` says; null if it says no year."""

    def both(a: Column, b: Column) -> Column:
        one, two = F.coalesce(a["y"], b["y"]), F.coalesce(b["y"], a["y"])
        m1, m2 = F.coalesce(a["m"], F.when(a["d"].isNotNull() | b["d"].isNotNull() | a["y"].isNull(), b["m"])), F.coalesce(b["m"], F.when(b["d"].isNotNull() | b["y"].isNull(), a["m"]))
        parts = lambda y, m, d: F.array_compact(F.array(y, m, F.when(m.isNotNull(), d)))
        return F.when(one.isNotNull(), F.struct(parts(one, m1, a["d"]).alias("from"), parts(two, m2, b["d"]).alias("to")).cast(DATE))

    sides = F.split(text, "–", 2)
    alone = lambda a: F.when(a["y"].isNotNull(), F.struct(F.array_compact(F.array(a["y"], a["m"], F.when(a["m"].isNotNull(), a["d"]))).alias("from"), F.lit(None).cast("array<int>").alias("to")).cast(DATE))
    return let(sides, lambda s: F.when(F.size(s) < 2, let(_side(F.get(s, F.lit(0))), alone)).otherwise(let(F.struct(_side(F.get(s, F.lit(0))).alias("a"), _side(F.get(s, F.lit(1))).alias("b")), lambda x: both(x["a"], x["b"]))))


_DAY = rf"\d{{4}}-\d{{2}}-\d{{2}}|(?:{_NAMES})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+(?:{_NAMES})[a-z]*\.?,?\s+\d{{4}}|\d{{4}},?\s+(?:{_NAMES})[a-z]*\.?\s+\d{{1,2}}"


def accessed(text: Column) -> Column:
    """The day on which a site was looked at, by what an entry says of it: `[cited 2020 May 3]`, `(Accessed: 3 May 2020)`."""
    said = F.regexp_extract(text, rf"(?i:cited|accessed|retrieved):?\s+(?:on\s+)?({_DAY})", 1)
    return F.when(said != "", read(said))
