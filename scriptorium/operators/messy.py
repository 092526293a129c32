"""Generators of noise and of in-text citations, for tests and round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ligaturize(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ"))


def _broken(c: Column, token: Column, at: Column) -> Column:
    """c with a hyphen and a line end inside the first occurrence of token."""
    start = F.instr(c, token)
    cut = start + at
    return F.when(token.isNull() | (start == 0), c).otherwise(F.concat(F.substr(c, F.lit(1), cut - 1), F.lit("-\n"), F.substr(c, cut)))


def hyphenate_once(c: Column, min_length: int = 10) -> Column:
    """Break the first long word of letters after 55 percent of it, four letters at least."""
    word = F.regexp_substr(c, F.lit(rf"[A-Za-z]{{{min_length},}}"))
    return _broken(c, word, F.greatest(F.lit(4), F.floor(F.length(word) * 0.55).cast("int")))


def break_doi(c: Column) -> Column:
    """Break the first DOI or URL after 60 percent of it."""
    token = F.regexp_substr(c, F.lit(r"10\.\d{4,9}/\S+|https?://\S+"))
    return _broken(c, token, F.floor(F.length(token) * 0.6).cast("int"))


def messy(entries: DataFrame, key: str = "doc_id", number: str = "entry_no", raw: str = "raw") -> DataFrame:
    """Ligatures in all entries, a hyphenated word in every third, a broken identifier in the first that has one."""
    has = F.col(raw).rlike(r"10\.\d{4,9}/|https?://")
    first = F.min(F.when(has, F.col(number))).over(Window.partitionBy(key))
    out = entries.withColumn("_first", first)
    text = F.when(F.col(number) % 3 == 1, hyphenate_once(F.col(raw))).otherwise(F.col(raw))
    text = F.when(F.col(number) == F.col("_first"), break_doi(text)).otherwise(text)
    return out.withColumn(raw, ligaturize(text)).drop("_first")


def with_running_heads(lines: DataFrame, head: str, key: str = "doc_id", page: str = "page", pages: str = "pages") -> DataFrame:
    """Add a running head and a `Page n of m` foot to every page after the first of (key, page, line_no, line, pages)."""
    each = lines.select(key, page, pages).distinct().filter(F.col(page) > 1)
    heads = each.select(key, page, F.lit(-1).alias("line_no"), F.lit(head).alias("line"), pages)
    feet = each.select(key, page, F.lit(1 << 30).alias("line_no"), F.concat(F.lit("Page "), F.col(page).cast("string"), F.lit(" of "), F.col(pages).cast("string")).alias("line"), pages)
    return lines.select(key, page, "line_no", "line", pages).unionByName(heads).unionByName(feet)


def author_year_cite(author: Column, year: Column) -> Column:
    """`(Family, 2001)`, `(A & B, 2001)`, `(A et al., 2001)`; `n.d.` without a year, `Anonymous` without authors."""
    name = lambda i: F.coalesce(F.get(author, F.lit(i))["family"], F.get(author, F.lit(i))["literal"])
    n = F.coalesce(F.size(author), F.lit(0))
    who = F.when(n <= 0, "Anonymous").when(n == 1, name(0)).when(n == 2, F.concat(name(0), F.lit(" & "), name(1))).otherwise(F.concat(name(0), F.lit(" et al.")))
    return F.concat(F.lit("("), who, F.lit(", "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def mla_cite(author: Column, page: Column) -> Column:
    """`(Family 12)`, `(A and B 12)`, `(A et al. 12)`."""
    name = lambda i: F.coalesce(F.get(author, F.lit(i))["family"], F.get(author, F.lit(i))["literal"])
    n = F.coalesce(F.size(author), F.lit(0))
    who = F.when(n <= 0, "Anonymous").when(n == 1, name(0)).when(n == 2, F.concat(name(0), F.lit(" and "), name(1))).otherwise(F.concat(name(0), F.lit(" et al.")))
    return F.concat(F.lit("("), F.concat_ws(" ", who, F.regexp_extract(page, r"^\d+", 0)), F.lit(")"))


def numeric_cite(number: Column, kind: str = "bracket") -> Column:
    text = number.cast("string")
    if kind == "superscript":
        return F.translate(text, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    left, right = {"bracket": "[]", "paren_number": "()"}[kind]
    return F.concat(F.lit(left), text, F.lit(right))


def body(sentences: Column, cites: Column) -> Column:
    """Join sentences; every third ends with the next citation, taken in turn."""
    n = F.size(cites)
    with_cite = F.transform(sentences, lambda s, i: F.when((i % 3 == 2) & (n > 0), F.concat(s, F.lit(" "), F.get(cites, F.pmod(F.floor(i / 3).cast("int"), n)), F.lit("."))).otherwise(F.concat(s, F.lit("."))))
    return F.array_join(with_cite, " ")
