"""Registered queries of values that differ: what agrees with what, long lists, what is exported and catalogued."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import identifiers
from scriptorium.operators import catalog, match, parse, render
from scriptorium.plans import queries as base
from scriptorium.plans.synthetic import FAMILIES, RECORDS_SQL, pick, records, sql_pick

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(base.SQL["spurious"].replace(f"AS t FROM ({RECORDS_SQL})),", f"AS t FROM ({RECORDS_SQL}) WHERE id % 4 <> 0),", 1))
def spurious_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries that nothing expected matches, where a quarter isn't expected."""
    parsed, expected = base.sides(spark, sf_dir)
    expected = expected.filter("id % 4 <> 0")
    pairs = match.candidate_pairs(parsed, expected).withColumn("s", F.round("s", 9))
    return match.spurious(parsed, match.greedy_one_to_one(pairs)).select("doc_id", "ordinal", "title")


def _many_sql(least: int, shown: int, last: str, cut: str) -> str:
    return f"CASE WHEN n < {least} THEN array_to_string(f[1:n - 1], ', ') || '{last}' || f[n] ELSE array_to_string(f[1:{shown}], ', ') || {cut} END"


@query(
    f"""WITH r AS (SELECT id, [6, 19, 20, 21, 25][1 + k % 5] AS n, list_transform(range([6, 19, 20, 21, 25][1 + k % 5]), lambda j: {sql_pick(FAMILIES, "(k + 5 * j) % 12")}) AS f FROM ({RECORDS_SQL}))
    SELECT id, {_many_sql(21, 19, ", & ", "', … ' || f[n]")} AS apa, {_many_sql(7, 6, ", ", "', et al.'")} AS vancouver, {_many_sql(6, 1, " & ", "' et al.'")} AS nature FROM r"""
)
def lists_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of six to 25 names, as three styles cut them."""
    k = C("id")
    n = F.get(F.array(*map(F.lit, (6, 19, 20, 21, 25))), (k % 5).cast("int"))
    names = F.transform(F.sequence(F.lit(0), n - 1), lambda j: pick(FAMILIES, (k + 5 * j) % 12))
    rows = records(spark, sf_dir).select("id", names.alias("f"))
    return rows.select(
        "id", render.name_list(C("f"), last=", & ", least=21, shown=19, use_last=True).alias("apa"), render.name_list(C("f"), last=", ", least=7, shown=6, et_al=", et al.").alias("vancouver"),
        render.name_list(C("f"), last=" & ", least=6).alias("nature"),
    )


def _case(k: str, *values: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(
    f"""SELECT id, {_case("id % 8", "TRUE", "TRUE", "TRUE", "n_authors = 1", "FALSE", "TRUE", "TRUE", "FALSE")} AS authors, {_case("id % 5", "TRUE", "TRUE", "TRUE", "FALSE", "FALSE")} AS doi,
    {_case("id % 6", "TRUE", "TRUE", "FALSE", "FALSE", "TRUE", "TRUE")} AS container, round({_case("id % 4", "1.0", "5 / 6", "0.0", "6 / 8")}::DOUBLE, 6) AS title FROM ({RECORDS_SQL})"""
)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, identifiers, containers and titles against values that differ from them in known ways."""
    k, none, author = C("id"), F.lit(None).cast("string"), C("author")
    person = lambda family, literal: F.array(F.struct(family.alias("family"), none.alias("given"), literal.alias("literal")))

    def by(n: int, *values: Column) -> Column:
        out = F.when(k % n == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            out = out.when(k % n == i, v)
        return out

    upper = F.transform(author, lambda a: F.struct(F.upper(F.translate(a["family"], "ao", "áö")).alias("family"), a["given"].alias("given"), a["literal"].alias("literal")))
    first, rest, body = F.slice(author, 1, 1), F.slice(author, 2, 2), person(none, F.lit("Port Authority"))
    parsed = by(8, author, F.reverse(author), first, first, person(F.lit("Nobody"), none), body, upper, rest)
    expected = F.when(k % 8 == 5, person(none, F.lit("Port Authority of Graz"))).otherwise(author)
    doi = by(5, C("doi"), F.concat(F.lit("https://doi.org/"), F.upper("doi")), F.concat(F.lit("doi: "), "doi", F.lit(".")), F.concat("doi", F.lit("x")), none)
    home = by(6, C("container"), F.concat(F.lit("The "), "container"), F.lit("Quite Other Words"), none, none, F.upper("container"))
    title = by(4, C("title"), F.replace("title", F.lit("Study "), F.lit("")), F.lit("Something else"), F.concat("title", F.lit(" and more")))
    return records(spark, sf_dir).select(
        "id", match.author_ok(parsed, expected, (k % 8).isin(2, 7)).alias("authors"), match.doi_ok(doi, C("doi")).alias("doi"),
        match.container_ok(home, F.when(k % 6 != 4, C("container"))).alias("container"), F.round(match.title_similarity(title, C("title")), 6).alias("title"),
    )


_ARXIV, _ISBN = "'2101.' || lpad(CAST(id % 100000 AS VARCHAR), 5, '0')", "'978-3-16-' || lpad(CAST(id % 1000000 AS VARCHAR), 6, '0') || '-' || (id % 10)"


@query(
    f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'arXiv' END AS archive, CASE WHEN id % 3 = 0 THEN {_ARXIV} END AS location, CASE WHEN id % 3 = 1 THEN {_ISBN} END AS isbn, CASE WHEN id % 3 = 2 THEN doi END AS doi,
    'https://example.org/' || id AS url FROM ({RECORDS_SQL})"""
)
def export_of_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers found in an entry's text, and what the exported item says of them."""
    k = C("id")
    number = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    said = F.when(k % 3 == 0, F.concat(F.lit("arXiv: 2101."), number(5))).when(k % 3 == 1, F.concat(F.lit("ISBN 978-3-16-"), number(6), F.lit("-"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("doi:"), "doi"))
    raw = F.concat("title", F.lit(". "), said, F.lit(". https://example.org/"), k.cast("string"))
    rows = records(spark, sf_dir).withColumn("found", identifiers.extract_identifiers(raw)).withColumns({c: C(f"found.{c}") for c in ("doi", "url", "isbn", "arxiv")} | {"chapter": F.lit(None).cast("string")})
    item = rows.withColumn("key", k).withColumn("id", k.cast("string"))
    item = item.select(C("key").alias("id"), parse.csl_json(item).alias("csl"))
    return item.select("id", *(F.get_json_object("csl", f"$.{name}").alias(column) for column, name in {"archive": "archive", "location": "archive_location", "isbn": "ISBN", "doi": "DOI", "url": "URL"}.items()))


@query(
    f"""SELECT slug, '{{"slug":"' || slug || '","title":"' || title || '","description":"' || description || '"' || coalesce(',"created":"' || created || '"', '') || ',"tags":["' || tags[1] || '","' || tags[2] || '"]}}' AS data
    FROM ({base.ENTRIES_SQL})"""
)
def index_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cards(base.catalog_entries(spark, sf_dir)).select("slug", "data")
