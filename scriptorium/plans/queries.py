"""Registered queries of the reference operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import identifiers, names, text
from scriptorium.operators import catalog, citations, geometry, markup, match, messy, parse, render
from scriptorium.plans.synthetic import FAMILIES, GIVEN, RECORDS_SQL, part_count, records, sql_pick, table

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- text -----------------------------------------------------------------------------------------------------------

_ODD = "ﬁnd ‘one’ “two” three­ four‐five… six–seven"


@query(rf"""SELECT doc_id, md5(replace(replace(translate(text || '{_ODD}', '‘’“”{chr(0xA0)}{chr(0x2010)}{chr(0xAD)}', '''''""' || ' -'), 'ﬁ', 'fi'), '…', '...')) AS folded FROM documents""")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_text(F.concat("text", F.lit(_ODD)))).alias("folded"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS norm FROM documents")
def fuzzy_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fuzzy_norm(C("text"))).alias("norm"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text || '  end  .', '[ \t\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS squeezed,
 md5(regexp_replace(regexp_replace(regexp_replace(text || ' ( a ) , b', '\s+([,.;:!?])', '\1', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g')) AS tidy FROM documents""")
def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.collapse_spaces(F.concat("text", F.lit("  end  .")))).alias("squeezed"), F.md5(text.tidy_punct(F.concat("text", F.lit(" ( a ) , b")))).alias("tidy"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
 t AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS times FROM t)
 SELECT doc_id, count(*) AS kept_lines, sum(length(t))::BIGINT AS kept_chars FROM n
 WHERE t = '' OR NOT (regexp_matches(t, '^\d{1,3}$') OR regexp_matches(t, '(?i)^Page\s+\d+\s+of\s+\d+$') OR (times > 1 AND length(t) < 70)) GROUP BY doc_id""")
def strip_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = parse.strip_headers_footers(parse.to_lines(table(spark, sf_dir, "documents")))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_lines"), F.sum(F.length(text.trim_all(C("line")))).cast("long").alias("kept_chars"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, text FROM documents), t AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l)
 SELECT doc_id, t AS line, count(*) AS times FROM t WHERE t <> '' GROUP BY doc_id, t HAVING count(*) > 1""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse.to_lines(table(spark, sf_dir, "documents")).select("doc_id", text.trim_all(C("line")).alias("line"))
    return lines.filter("line <> ''").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


@query("""SELECT doc_id, count(*) AS n_lines, TRUE AS section_found FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def locate_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Opening line\nReferences\nEarlier list\n7. R E F E R E N C E S\n"), "text", F.lit("\nAppendix A\nTables")).alias("text"))
    return parse.locate_section(parse.to_lines(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("section_found").alias("section_found"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)), 1) AS n FROM documents),
 b AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, sum((regexp_replace(line, '^\s+|\s+$', '', 'g') = '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM l)
 SELECT doc_id, count(DISTINCT b) AS n_blocks FROM b WHERE t <> '' GROUP BY doc_id""")
def segment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return parse.segment_blocks(parse.to_lines(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))


@query(f"SELECT id, title AS rejoined FROM ({RECORDS_SQL})")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = messy.ligaturize(messy.hyphenate_once(C("title"), 6))
    return records(spark, sf_dir).select("id", text.fold_text(text.join_wrapped_lines(F.split(broken, "\n"))).alias("rejoined"))


# --- identifiers, years, numbers ------------------------------------------------------------------------------------


@query(f"""SELECT id, doi, 'https://example.org/item/' || id AS url, '2001.' || lpad(CAST(id % 100000 AS VARCHAR), 5, '0') AS arxiv, '978-3-16-148410-' || (id % 10) AS isbn FROM ({RECORDS_SQL})""")
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("id")
    line = F.concat(
        C("title"), F.lit(". doi:"), C("doi"), F.lit(". https://example.org/item/"), k.cast("string"), F.lit(". arXiv:2001."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v2 ISBN 978-3-16-148410-"), (k % 10).cast("string"), F.lit(".")
    )
    return records(spark, sf_dir).select("id", identifiers.extract_identifiers(line).alias("x")).select("id", "x.doi", "x.url", "x.arxiv", "x.isbn")


@query(f"SELECT id, year FROM ({RECORDS_SQL})")
def find_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = C("year").cast("string")
    line = F.when(C("id") % 3 == 0, F.concat(F.lit("pp. 1901–1999 in 12005 ("), y, F.lit("). 2001 notes"))).when(C("id") % 3 == 1, F.concat(F.lit("Vol 1987-1999: "), y, F.lit(";12, 20011 items"))).otherwise(F.concat(F.lit("Seen in 2019-20, then "), y))
    return records(spark, sf_dir).select("id", identifiers.find_year(line)["year"].alias("year"))


@query(f"SELECT id, volume, issue, page, container FROM ({RECORDS_SQL})")
def volume_issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    vip = F.concat(C("volume"), F.lit(" ("), C("issue"), F.lit("): "), F.replace("page", F.lit("-"), F.lit("–")))
    rows = records(spark, sf_dir).select("id", identifiers.split_container(F.concat("container", F.lit(" "), vip)).alias("s"))
    return rows.select("id", identifiers.volume_issue_pages(C("s.vip")).alias("v"), C("s.container").alias("container")).select("id", "v.volume", "v.issue", "v.page", "container")


@query(f"SELECT id, doi AS doi FROM ({RECORDS_SQL})")
def norm_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", identifiers.norm_doi(F.concat(F.lit("https://dx.doi.org/"), F.upper("doi"), F.lit("."))).alias("doi"))


# --- styles: rendering, votes and extraction ----------------------------------------------------------------------------

_K = "id"
_PEOPLE = [(sql_pick(FAMILIES, f"({_K} + {5 * j}) % 12"), sql_pick(GIVEN, f"({_K} + {7 * j}) % 12")) for j in range(3)]


def _sql_names(first: str, other: str, sep: str, last: str, two: str | None = None, et_al: str | None = None) -> str:
    """Names of one to three authors; f, g and i stand for family, given and initial."""
    shown = [(first if j == 0 else other).replace("{f}", f"' || {f} || '").replace("{g}", f"' || {g} || '").replace("{i}", f"' || left({g}, 1) || '") for j, (f, g) in enumerate(_PEOPLE)]
    a, b, c = (f"'{x}'" for x in shown)
    three = f"{a} || '{et_al}'" if et_al else f"{a} || '{sep}' || {b} || '{last}' || {c}"
    return f"CASE n_authors WHEN 1 THEN {a} WHEN 2 THEN {a} || '{last if two is None else two}' || {b} ELSE {three} END"


_PG = "replace(page, '-', '–')"
_LINK = "'https://doi.org/' || doi"
STYLE_SQL = {
    "apa": f"""{_sql_names("{f}, {i}.", "{f}, {i}.", ", ", ", & ")} || ' (' || year || '). ' || title || '. ' || container || ', ' || volume || '(' || issue || '), ' || {_PG} || '. ' || {_LINK}""",
    "harvard": f"""{_sql_names("{f}, {i}.", "{f}, {i}.", ", ", " and ")} || ' (' || year || ') “' || title || ',” ' || container || ', ' || volume || '(' || issue || '), pp. ' || {_PG} || '. Available at: ' || {_LINK} || '.'""",
    "chicagoAD": f"""{_sql_names("{f}, {g}", "{g} {f}", ", ", ", and ")} || '. ' || year || '. “' || title || '.” ' || container || ' ' || volume || ' (' || issue || '): ' || {_PG} || '. ' || {_LINK} || '.'""",
    "chicagoFull": f"""{_sql_names("{f}, {g}", "{g} {f}", ", ", ", and ")} || '. “' || title || '.” ' || container || ' ' || volume || ', no. ' || issue || ' (' || year || '): ' || {_PG} || '. ' || {_LINK} || '.'""",
    "mla": f"""{_sql_names("{f}, {g}", "{g} {f}", ", ", ", and ", et_al=", et al")} || '. “' || title || '.” ' || container || ', vol. ' || volume || ', no. ' || issue || ', ' || year || ', pp. ' || {_PG} || ', ' || {_LINK} || '.'""",
    "vancouver": f"""{_sql_names("{f} {i}", "{f} {i}", ", ", ", ")} || '. ' || title || '. ' || container || '. ' || year || ';' || volume || '(' || issue || '):' || {_PG} || '. doi:' || doi""",
    "nature": f"""{_sql_names("{f}, {i}.", "{f}, {i}.", ", ", " & ")} || ' ' || title || '. ' || container || ' ' || volume || ', ' || {_PG} || ' (' || year || ').'""",
    "ieee": f"""{_sql_names("{i}. {f}", "{i}. {f}", ", ", ", and ", " and ")} || ', “' || title || ',” ' || container || ', vol. ' || volume || ', no. ' || issue || ', pp. ' || {_PG} || ', ' || year || ', doi: ' || doi || '.'""",
    "acs": f"""{_sql_names("{f}, {i}.", "{f}, {i}.", "; ", "; ")} || ' ' || title || '. ' || container || ' ' || year || ', ' || volume || ' (' || issue || '), ' || {_PG} || '. ' || {_LINK}""",
    "acm": f"""{_sql_names("{g} {f}", "{g} {f}", ", ", ", and ", " and ")} || '. ' || year || '. ' || title || '. ' || container || ' ' || volume || ', ' || issue || ' (' || year || '), ' || {_PG} || '. ' || {_LINK}""",
}


def _render(style: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).select("id", render.render(style).alias("entry"))

    return run


def _extract(style: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = records(spark, sf_dir).select("id", F.lit(style).alias("style"), text.fold_text(render.render(style, C("ordinal") + 1)).alias("raw"))
        return parse.extract_fields(entries).select(
            "id", "type", "year", "title", "container", "volume", "issue", "page", F.array_join(names.families(C("author")), ";").alias("families"), C("author_etal").alias("etal"), "doi", "confidence"
        )

    return run


_FAM = [f for f, _ in _PEOPLE]
for _style, _sql in STYLE_SQL.items():
    query(f"SELECT id, {_sql} AS entry FROM ({RECORDS_SQL})", f"render_{_style}")(_render(_style))
    _all = f"CASE n_authors WHEN 1 THEN {_FAM[0]} WHEN 2 THEN {_FAM[0]} || ';' || {_FAM[1]} ELSE {_FAM[0]} || ';' || {_FAM[1]} || ';' || {_FAM[2]} END"
    if _style == "mla":
        _all = f"CASE n_authors WHEN 2 THEN {_FAM[0]} || ';' || {_FAM[1]} ELSE {_FAM[0]} END"
    query(
        f"""SELECT id, 'article-journal' AS type, year, title, container, volume, {"NULL::VARCHAR" if _style == "nature" else "issue"} AS issue, page, {_all} AS families,
        {"n_authors = 3" if _style == "mla" else "FALSE"} AS etal, {"NULL::VARCHAR" if _style == "nature" else "doi"} AS doi, 1.0::DOUBLE AS confidence FROM ({RECORDS_SQL})""",
        f"extract_{_style}",
    )(_extract(_style))

_ORDER = tuple(STYLE_SQL)


@cache
def _styled_entry(application_id: str) -> Column:
    """The entry in the style that the document's number names: built once an application, as it is some thousand nodes."""
    raw = None
    for i, style in enumerate(_ORDER):
        shown = render.render(style, C("ordinal") + 1)
        raw = F.when(C("doc_id") % 10 == i, shown) if raw is None else raw.when(C("doc_id") % 10 == i, shown)
    return raw


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the style that the document's number names."""
    raw = _styled_entry(spark.sparkContext.applicationId)
    return records(spark, sf_dir).withColumn("raw", raw)


@query(
    f"""SELECT doc_id, count(*) AS n_entries, {sql_pick(_ORDER, "doc_id % 10")} AS style, {sql_pick(tuple(parse.STYLE_LABELS[s] for s in _ORDER), "doc_id % 10")} AS style_label
    FROM ({RECORDS_SQL}) GROUP BY doc_id"""
)
def style_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.style_vote(_styled(spark, sf_dir).select("doc_id", text.fold_text(C("raw")).alias("raw"))).select("doc_id", "n_entries", "style", "style_label")


def documents_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a body, a heading, and entries separated by blank lines, wrapped at the first blank after 90 characters."""
    wrapped = F.regexp_replace("raw", r"^(.{90}\S*) (?=.{25})", "$1\n")
    lists = _styled(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", wrapped.alias("raw")))).alias("l"))
    return lists.select("doc_id", F.concat(F.lit("A body of text.\n\nReferences\n\n"), F.array_join(F.transform("l", lambda x: x["raw"]), "\n\n"), F.lit("\n\nAcknowledgements\n\nThanks.")).alias("text"))


@query(
    f"""SELECT doc_id, ordinal + 1 AS entry_no, 'ref-' || (ordinal + 1) AS id, {sql_pick(_ORDER, "doc_id % 10")} AS style, TRUE AS section_found, year, title, page
    FROM (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS INTEGER) AS ordinal) FROM ({RECORDS_SQL}))"""
)
def parse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = parse.parse_text(documents_with_references(spark, sf_dir))
    return refs.select("doc_id", "entry_no", "id", "style", "section_found", "year", "title", "page")


@query(f"SELECT year, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({RECORDS_SQL}) GROUP BY year")
def references_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = parse.parse_text(documents_with_references(spark, sf_dir))
    return refs.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(f"""SELECT doc_id, TRUE AS section_found, {sql_pick(tuple(parse.STYLE_LABELS[s] for s in _ORDER), "doc_id % 10")} AS style_label, count(*) AS n_refs, 1.0::DOUBLE AS mean_confidence FROM ({RECORDS_SQL}) GROUP BY doc_id""")
def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_with_references(spark, sf_dir)
    return parse.document_results(docs, parse.parse_text(docs)).drop("warnings")


@query(
    f"""SELECT id, (100 - CASE WHEN id % 4 = 0 THEN 20 ELSE 0 END - CASE WHEN id % 5 = 0 THEN 25 ELSE 0 END - CASE WHEN id % 7 = 0 THEN 15 ELSE 0 END - CASE WHEN id % 3 = 0 THEN 10 ELSE 0 END) / 100.0::DOUBLE AS confidence,
    concat_ws('; ', CASE WHEN id % 4 = 0 THEN 'no authors found' END, CASE WHEN id % 5 = 0 THEN 'no year found' END, CASE WHEN id % 7 = 0 THEN 'no title found' END) AS issues FROM ({RECORDS_SQL})"""
)
def confidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("id")
    lost = records(spark, sf_dir).withColumns({c: F.when(k % m != 0, C(c)) for c, m in (("author", 4), ("year", 5), ("title", 7), ("container", 3))})
    return lost.withColumns(parse.confidence_and_issues()).select("id", "confidence", F.array_join("issues", "; ").alias("issues"))


_AUTHORS_JSON = [f"""'{{"family":"' || {f} || '","given":"' || {g} || '"}}'""" for f, g in _PEOPLE]


@query(
    f"""SELECT id, '{{"id":"' || id || '","type":"article-journal","title":"' || title || '","author":[' || CASE n_authors WHEN 1 THEN {_AUTHORS_JSON[0]} WHEN 2 THEN {_AUTHORS_JSON[0]} || ',' || {_AUTHORS_JSON[1]}
    ELSE {_AUTHORS_JSON[0]} || ',' || {_AUTHORS_JSON[1]} || ',' || {_AUTHORS_JSON[2]} END || '],"editor":[],"container-title":"' || container || '","volume":"' || volume || '","issue":"' || issue || '","page":"' || page || '","issued":{{"date-parts":[[' || year || ']]}},"DOI":"' || doi || '"}}' AS csl FROM ({RECORDS_SQL})"""
)
def csl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = records(spark, sf_dir).withColumns({"isbn": none, "arxiv": none, "chapter": none})
    return rows.withColumn("key", C("id")).withColumn("id", C("id").cast("string")).select(C("key").alias("id"), parse.csl_json(rows).alias("csl"))


@query(
    f"""WITH r AS (SELECT doc_id, id, year, title, CASE n_authors WHEN 1 THEN {_FAM[0]} WHEN 2 THEN {_FAM[0]} || {_FAM[1]} ELSE {_FAM[0]} || {_FAM[1]} || {_FAM[2]} END AS who FROM (SELECT * REPLACE (year - year % 4 AS year, doc_id // 20 AS doc_id) FROM ({RECORDS_SQL})))
    SELECT doc_id, id, CASE WHEN count(*) OVER w > 1 THEN chr(CAST(96 + row_number() OVER (PARTITION BY doc_id, who, year ORDER BY title) AS INTEGER)) END AS year_suffix FROM r WINDOW w AS (PARTITION BY doc_id, who, year)"""
)
def year_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("year", C("year") - C("year") % 4).withColumn("doc_id", F.floor(C("doc_id") / 20).cast("long"))
    return render.year_suffixes(rows).select("doc_id", "id", "year_suffix")


@query(
    f"""WITH n AS (SELECT DISTINCT doc_id, ordinal AS n FROM ({RECORDS_SQL}) WHERE id % 7 <> 3), g AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM n),
    r AS (SELECT doc_id, min(n) AS a, max(n) AS b FROM g GROUP BY doc_id, g)
    SELECT doc_id, string_agg(CASE WHEN b - a >= 2 THEN a || '–' || b WHEN b > a THEN a || ',' || b ELSE a || '' END, ',' ORDER BY a) AS cited FROM r GROUP BY doc_id"""
)
def collapse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = records(spark, sf_dir).filter("id % 7 <> 3").groupBy("doc_id").agg(F.collect_list("ordinal").alias("numbers"))
    return cited.select("doc_id", render.collapse_numbers(C("numbers")).alias("cited"))


# --- matching and scores --------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM benchmark)
 SELECT a.item_id AS item_id, b.item_id AS other_id, round(CASE WHEN len(a.t) + len(b.t) = 0 THEN 1 ELSE len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END, 9) AS similarity
 FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select("item_id", match.tokens(C("text")).alias("t"))
    b = a.select(C("item_id").alias("other_id"), C("t").alias("o"), (C("item_id") - 1).alias("item_id"))
    return a.join(b, "item_id").select("item_id", "other_id", F.round(match.token_similarity(C("t"), C("o")), 9).alias("similarity"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, expected): every fifth reference isn't parsed, every seventh has lost its year."""
    expected = records(spark, sf_dir)
    parsed = expected.filter("id % 5 <> 0").withColumn("year", F.when(C("id") % 7 != 0, C("year")))
    return parsed, expected


_SIDES_SQL = f"""e AS (SELECT doc_id, ordinal AS j, title, year, list_distinct(string_split(lower(title), ' ')) AS t FROM ({RECORDS_SQL})),
 p AS (SELECT doc_id, ordinal AS i, title, CASE WHEN id % 7 <> 0 THEN year END AS year, list_distinct(string_split(lower(title), ' ')) AS t FROM ({RECORDS_SQL}) WHERE id % 5 <> 0)"""
_SIM = "len(list_intersect(p.t, e.t))::DOUBLE / (len(p.t) + len(e.t) - len(list_intersect(p.t, e.t)))"


@query(
    f"""WITH {_SIDES_SQL}, s AS (SELECT e.doc_id, e.j, min(p.i) AS i FROM e JOIN p ON e.doc_id = p.doc_id AND e.year = p.year GROUP BY e.doc_id, e.j),
    f AS (SELECT e.doc_id, e.j, p.i, row_number() OVER (PARTITION BY e.doc_id, e.j ORDER BY {_SIM} DESC, p.i) AS r FROM e ANTI JOIN s ON e.doc_id = s.doc_id AND e.j = s.j JOIN p ON e.doc_id = p.doc_id WHERE {_SIM} >= 0.6)
    SELECT doc_id, j, i FROM s UNION ALL SELECT doc_id, j, i FROM f WHERE r = 1""".replace("FROM e ANTI JOIN s ON e.doc_id = s.doc_id AND e.j = s.j JOIN", "FROM (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = e.doc_id AND s.j = e.j)) e JOIN")
)
def match_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_year_first(*sides(spark, sf_dir))


@query(
    f"""WITH {_SIDES_SQL} SELECT p.doc_id AS doc_id, p.i AS i, e.j AS j, round(2 * coalesce((p.year = e.year)::INT, 0) + {_SIM}, 9) AS s FROM p JOIN e ON p.doc_id = e.doc_id WHERE p.year = e.year OR {_SIM} >= 0.6"""
)
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.candidate_pairs(*sides(spark, sf_dir)).withColumn("s", F.round("s", 9))


_CANDIDATES_SQL = f"SELECT p.doc_id AS doc_id, p.i AS i, e.j AS j, round(2 * coalesce((p.year = e.year)::INT, 0) + {_SIM}, 9) AS s FROM p JOIN e ON p.doc_id = e.doc_id WHERE p.year = e.year OR {_SIM} >= 0.6"
#: Greedy matching as a walk over each document's pairs, best first; `m` has (doc_id, i, j, s).
_GREEDY_SQL = f"""{_SIDES_SQL}, c AS ({_CANDIDATES_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i, j) AS k FROM c),
    g AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::BIGINT[] AS used_i, []::BIGINT[] AS used_j FROM c UNION ALL
    SELECT g.doc_id, o.k, CASE WHEN list_contains(used_i, o.i) OR list_contains(used_j, o.j) THEN used_i ELSE list_append(used_i, o.i::BIGINT) END,
    CASE WHEN list_contains(used_i, o.i) OR list_contains(used_j, o.j) THEN used_j ELSE list_append(used_j, o.j::BIGINT) END FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1),
    t AS (SELECT doc_id, unnest(used_i) AS i, unnest(used_j) AS j FROM (SELECT doc_id, arg_max(used_i, k) AS used_i, arg_max(used_j, k) AS used_j FROM g GROUP BY doc_id)),
    m AS (SELECT c.* FROM c JOIN t ON c.doc_id = t.doc_id AND c.i = t.i AND c.j = t.j)"""


@query(f"WITH RECURSIVE {_GREEDY_SQL} SELECT doc_id, i, j, s FROM m")
def match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greedy(*sides(spark, sf_dir))


def _greedy(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    return match.greedy_one_to_one(match.candidate_pairs(parsed, expected).withColumn("s", F.round("s", 9)))


@query(
    f"""WITH {_SIDES_SQL}, c AS (SELECT p.doc_id AS doc_id, p.i AS i, e.j AS j, round(2 * coalesce((p.year = e.year)::INT, 0) + {_SIM}, 9) AS s FROM p JOIN e ON p.doc_id = e.doc_id WHERE p.year = e.year OR {_SIM} >= 0.6),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY s DESC, i, j) AS a, row_number() OVER (PARTITION BY doc_id, j ORDER BY s DESC, i, j) AS b FROM c) SELECT doc_id, i, j, s FROM r WHERE a = 1 AND b = 1"""
)
def match_mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.mutual_best(match.candidate_pairs(*sides(spark, sf_dir)).withColumn("s", F.round("s", 9)))


@query(f"WITH RECURSIVE {_GREEDY_SQL} SELECT doc_id, j AS ordinal, title, year FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = e.doc_id AND m.j = e.j)")
def missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, expected = sides(spark, sf_dir)
    return match.missed(expected, _greedy(parsed, expected)).select("doc_id", "ordinal", "title", "year")


@query(f"WITH RECURSIVE {_GREEDY_SQL} SELECT doc_id, i AS ordinal, title FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.i = p.i)")
def spurious(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, expected = sides(spark, sf_dir)
    return match.spurious(parsed, _greedy(parsed, expected)).select("doc_id", "ordinal", "title")


def _matches(parsed: DataFrame) -> DataFrame:
    """Matches that are given, for scores of their own."""
    return parsed.filter("id % 3 <> 0").select("doc_id", C("ordinal").alias("i"), C("ordinal").alias("j"))


@query(
    f"""SELECT doc_id, coalesce(sum((id % 5 <> 0)::INT), 0)::BIGINT AS found, count(*) AS expected, sum((id % 5 <> 0 AND id % 3 <> 0)::INT)::BIGINT AS matched, sum((id % 5 <> 0 AND id % 3 <> 0)::INT)::BIGINT AS auth, sum((id % 5 <> 0 AND id % 3 <> 0 AND id % 7 <> 0)::INT)::BIGINT AS yr,
    sum((id % 5 <> 0 AND id % 3 <> 0)::INT)::BIGINT AS doi, count(*) AS doi_total, sum((id % 5 <> 0 AND id % 3 <> 0)::INT)::BIGINT AS cont, count(*) AS cont_total,
    sum((id % 5 <> 0)::INT) = count(*) AND (sum((id % 5 <> 0 AND id % 3 <> 0)::INT) + sum((id % 5 <> 0 AND id % 3 <> 0 AND id % 7 <> 0)::INT)) * 100 >= 180 * count(*) AS passes FROM ({RECORDS_SQL}) GROUP BY doc_id"""
)
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, expected = sides(spark, sf_dir)
    columns = ["doc_id", "found", "expected", "matched", "auth", "yr", "doi", "doi_total", "cont", "cont_total", "passes"]
    return match.score(parsed, expected, _matches(parsed)).select(*columns)


@query(
    """SELECT coalesce(source, 'total') AS source, count(*) AS found, count(*) AS expected, count(quality) AS matched, sum((coalesce(quality, 0) = 1)::INT)::BIGINT AS auth, sum((coalesce(toxic, 1) = 0)::INT)::BIGINT AS yr,
    0::BIGINT AS doi, 0::BIGINT AS doi_total, 0::BIGINT AS cont, 0::BIGINT AS cont_total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)"""
)
def score_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    flags = {"found": one, "expected": one, "matched": C("quality").isNotNull().cast("long"), "auth": F.coalesce((C("quality") == 1).cast("long"), none), "yr": F.coalesce((C("toxic") == 0).cast("long"), none)}
    return match.totals(rows.select("source", *(v.alias(k) for k, v in flags.items()), *(none.alias(c) for c in ("doi", "doi_total", "cont", "cont_total"))), "source")


@query("SELECT lang AS style, sum((quality = 1)::INT)::BIGINT AS clean, sum((quality = 0)::INT)::BIGINT AS messy, (sum((quality = 0)::INT) - sum((quality = 1)::INT))::BIGINT AS delta FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def variant_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", C("lang").alias("style")).join(table(spark, sf_dir, "labels"), "doc_id")
    return match.variant_delta(rows.select("style", F.when(C("quality") == 1, "clean").otherwise("messy").alias("variant"), F.lit(1).cast("long").alias("n")), "style", "variant", "n")


@query(f"SELECT doc_id, id AS ref_id, id % 3 <> 0 AS found FROM ({RECORDS_SQL})")
def title_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(C("id") % 3 == 0, F.concat(F.lit("Nowhere printed "), C("title"))).otherwise(F.upper("title"))
    return match.title_probe(documents_with_references(spark, sf_dir), records(spark, sf_dir).select("doc_id", C("id").alias("ref_id"), title.alias("title")))


# --- citations ------------------------------------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): a page of a body for every five references; odd documents cite by number, even ones by name."""
    numbered = messy.numeric_cite(C("ordinal") + 1)
    cite = F.when(C("doc_id") % 2 == 1, numbered).otherwise(messy.author_year_cite(C("author"), C("year")))
    rows = records(spark, sf_dir).withColumn("page", F.floor(C("ordinal") / 5).cast("int")).withColumn("s", F.concat(F.lit("As shown before "), cite, F.lit(".")))
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "s"))).alias("l"))
    return pages.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("text"))


@query(f"SELECT doc_id, ordinal // 5 AS page, CASE WHEN doc_id % 2 = 1 THEN 'bracket' ELSE 'author_year' END AS kind, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY ALL".replace("ordinal // 5 AS page", "CAST(ordinal // 5 AS INTEGER) AS page"))
def citations_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.per_page(citations.citations(_bodies(spark, sf_dir)))


@query(f"SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'bracket' ELSE 'author_year' END AS kind FROM ({RECORDS_SQL})")
def citation_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.detect_kind(citations.per_page(citations.citations(_bodies(spark, sf_dir))))


@query(f"SELECT doc_id, page, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS running FROM (SELECT doc_id, CAST(ordinal // 5 AS INTEGER) AS page, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY ALL)")
def citation_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.cumulative(citations.per_page(citations.citations(_bodies(spark, sf_dir))).select("doc_id", "page", "n"))


@query("""SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS running FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)""")
def cumulative_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return citations.cumulative(days, "event_type", "day")


@query(
    f"""WITH c AS (SELECT doc_id, ordinal + 1 AS number, count(*) AS times FROM ({RECORDS_SQL}) WHERE doc_id % 2 = 1 GROUP BY ALL), r AS (SELECT DISTINCT doc_id, ordinal + 2 AS number FROM ({RECORDS_SQL}) WHERE doc_id % 2 = 1)
    SELECT coalesce(c.doc_id, r.doc_id) AS doc_id, coalesce(c.number, r.number) AS number, coalesce(times, 0) AS times, CASE WHEN r.doc_id IS NULL THEN 'not listed' WHEN c.doc_id IS NULL THEN 'not cited' ELSE 'ok' END AS status
    FROM c FULL JOIN r ON c.doc_id = r.doc_id AND c.number = r.number"""
)
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = citations.citations(_bodies(spark, sf_dir)).filter("kind = 'bracket'")
    cited = found.select("doc_id", F.explode(citations.cited_numbers(C("citation"))).alias("number"))
    listed = records(spark, sf_dir).filter("doc_id % 2 = 1").select("doc_id", (C("ordinal") + 2).alias("number"))
    return citations.cross_check(cited, listed, ["doc_id", "number"])


@query(
    f"""WITH a AS (SELECT doc_id, ordinal, first_family AS family, CAST(year AS VARCHAR) AS year FROM ({RECORDS_SQL}) WHERE doc_id % 2 = 0), c AS (SELECT doc_id, family, year, count(*) AS times FROM a GROUP BY ALL), r AS (SELECT DISTINCT doc_id, family, year FROM a WHERE ordinal > 0)
    SELECT coalesce(c.doc_id, r.doc_id) AS doc_id, coalesce(c.family, r.family) AS family, coalesce(c.year, r.year) AS year, coalesce(times, 0) AS times, CASE WHEN r.doc_id IS NULL THEN 'not listed' WHEN c.doc_id IS NULL THEN 'not cited' ELSE 'ok' END AS status
    FROM c FULL JOIN r ON c.doc_id = r.doc_id AND c.family = r.family AND c.year = r.year"""
)
def cross_check_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that cite by name, against lists that lack the first reference."""
    found = citations.citations(_bodies(spark, sf_dir)).filter("kind = 'author_year'")
    cited = found.select("doc_id", F.explode(citations.cited_names(C("citation"))).alias("c")).select("doc_id", "c.*")
    listed = records(spark, sf_dir).filter("doc_id % 2 = 0 and ordinal > 0").select("doc_id", F.get("author", F.lit(0))["family"].alias("family"), C("year").cast("string").alias("year"))
    return citations.cross_check(cited, listed, ["doc_id", "family", "year"])


@query(
    f"""SELECT doc_id, sum(3 + CASE WHEN doc_id % 2 = 1 THEN 1 WHEN n_authors = 1 THEN 2 ELSE 4 END)::BIGINT AS words, count(*) AS citations,
    round(1000.0 * count(*) / sum(3 + CASE WHEN doc_id % 2 = 1 THEN 1 WHEN n_authors = 1 THEN 2 ELSE 4 END), 4)::DOUBLE AS per_1000_words FROM ({RECORDS_SQL}) GROUP BY doc_id"""
)
def citation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _bodies(spark, sf_dir)
    return citations.density(bodies, citations.citations(bodies)).withColumn("per_1000_words", C("per_1000_words").cast("double"))


@query(f"SELECT year, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY year")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = records(spark, sf_dir).select("doc_id", (C("ordinal") + 1).alias("number"), "year")
    return citations.year_histogram(citations.citations(_bodies(spark, sf_dir)), refs)


# --- markup, geometry, catalogue ------------------------------------------------------------------------------------


@query(r"""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS plain FROM pages""")
def html_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(markup.plain_text(C("html"))).alias("plain"))


@query(r"""SELECT page_id, len(list_filter(string_split_regex(html, '<[^>]*>'), lambda x: x <> '')) AS n_runs FROM pages""")
def html_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(markup.runs(C("html"))).cast("long").alias("n_runs"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of ten lines, a page a document; each line is two items with a gap."""
    k = C("ordinal")
    left = F.when(k % 2 == 0, 50.0).otherwise(320.0)
    y = 700.0 - 12.0 * F.floor(k / 2) + (C("id") % 2) * 0.4
    item = lambda word, x: F.struct(word.alias("str"), x.alias("x"), F.lit(60.0).alias("width"))
    rows = records(spark, sf_dir).withColumn("i", F.explode(F.array(item(F.lit("Entry"), left), item(C("id").cast("string"), left + 66.0))))
    return rows.select("doc_id", F.lit(1).alias("page"), C("i.str").alias("str"), C("i.x").alias("x"), y.alias("y"), C("i.width").alias("width"), F.lit(10.0).alias("height"), F.lit(False).alias("italic"))


@query(
    f"""WITH r AS (SELECT doc_id, ordinal, id, ordinal // 2 AS row, ordinal % 2 AS c FROM ({RECORDS_SQL})), y AS (SELECT *, floor((700.0 - 12.0 * row + (id % 2) * 0.4) / 3 + 0.5) * 3 AS y FROM r)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y DESC) - 1 AS INTEGER) AS line_no, y::DOUBLE AS y, string_agg('Entry ' || id, ' ' ORDER BY c) AS text FROM y GROUP BY doc_id, y"""
)
def line_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.bucket_lines(_items(spark, sf_dir)).select("doc_id", "line_no", "y", "text")


@query(
    f"""WITH r AS (SELECT doc_id, ordinal, id, ordinal // 2 AS row, ordinal % 2 AS c, floor((700.0 - 12.0 * (ordinal // 2) + (id % 2) * 0.4) / 3 + 0.5) * 3 AS y FROM ({RECORDS_SQL})),
    n AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS nr, sum(1 - c) OVER (PARTITION BY doc_id) AS nl FROM r), k AS (SELECT *, CASE WHEN nr >= 5 AND nl >= 5 AND nr >= 0.25 * nl THEN c + 1 ELSE 1 END AS col FROM n)
    SELECT doc_id, 'Entry ' || id AS text, CAST(col AS INTEGER) AS col, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY col, y DESC, c) - 1 AS INTEGER) AS line_no FROM k"""
)
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.order_columns(geometry.flatten_lines(geometry.bucket_lines(_items(spark, sf_dir)))).select("doc_id", "text", "col", "line_no")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of bracketed entries, each on two lines with a hanging indent, under running heads and page counts.

    The lines go through one exchange, so that what reads them more than once has them made once.
    """
    entries = records(spark, sf_dir).select("doc_id", "ordinal", render.render("ieee", C("ordinal") + 1).alias("entry"))
    parts = F.split(F.regexp_replace("entry", r"^(.{50}\S*) ", "$1\n"), "\n")
    page, row = F.floor(C("ordinal") / 10).cast("int"), (C("ordinal") % 10) * 2
    item = lambda t, x: F.array(F.struct(t.alias("str"), F.lit(x).alias("x"), (F.length(t) * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit(False).alias("italic")))
    line = lambda n, t, x: F.struct(n.cast("int").alias("line_no"), (700.0 - 12.0 * n).alias("y"), t.alias("text"), item(t, x).alias("items"))
    rows = entries.select("doc_id", page.alias("page"), F.explode(F.array(line(row + 3, F.get(parts, F.lit(0)), 50.0), line(row + 4, F.get(parts, F.lit(1)), 70.0))).alias("l")).select("doc_id", "page", "l.*")
    each = records(spark, sf_dir).select("doc_id", page.alias("page")).distinct()  # no entry is printed for its page's number
    top = F.array(line(F.lit(0), F.lit("Annals of Worked Examples"), 200.0), line(F.lit(1), F.concat(F.lit("Page "), (C("page") + 1).cast("string"), F.lit(" of 2")), 250.0))
    heads = each.select("doc_id", "page", F.explode(top).alias("l")).select("doc_id", "page", "l.*").filter("page > 0 or line_no > 0")
    heading = each.filter("page = 0").select("doc_id", "page", line(F.lit(2), F.lit("REFERENCES"), 50.0).alias("l")).select("doc_id", "page", "l.*")
    return rows.unionByName(heads).unionByName(heading).repartition(2 * part_count(table(spark, sf_dir, "orders")), "doc_id")  # two lines an order


@query(
    f"""SELECT doc_id, count(*) AS n_refs, sum(year)::BIGINT AS years, min(title) AS first_title FROM ({RECORDS_SQL}) GROUP BY doc_id"""
)
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = geometry.parse_pages(page_lines(spark, sf_dir))
    return refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("year").cast("long").alias("years"), F.min("title").alias("first_title"))


def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.lower("p_brand"), F.concat(F.lit("size-"), (C("p_size") % 5).cast("string")))
    created = F.when(C("p_partkey") % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((C("p_partkey") % 28 + 1).cast("string"), 2, "0")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("entry-"), C("p_partkey").cast("string")).alias("slug"), C("p_name").alias("title"), C("p_type").alias("description"), created.alias("created"), tags.alias("tags"))


ENTRIES_SQL = """SELECT 'entry-' || p_partkey AS slug, p_name AS title, p_type AS description, CASE WHEN p_partkey % 3 <> 0 THEN '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS created, [lower(p_brand), 'size-' || (p_size % 5)] AS tags FROM part"""


@query(f"SELECT slug, title FROM ({ENTRIES_SQL}) WHERE contains(lower(concat_ws(' ', title, description, array_to_string(tags, ' '))), 'a') AND list_contains(tags, 'size-3')")
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(catalog_entries(spark, sf_dir), " A ", ("size-3",)).select("slug", "title")


@query(f"SELECT DISTINCT unnest(tags) AS tag FROM ({ENTRIES_SQL})")
def tag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tag_list(catalog_entries(spark, sf_dir))


@query(f"SELECT slug, created FROM ({ENTRIES_SQL}) ORDER BY coalesce(created, '') DESC, slug")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest_first(catalog_entries(spark, sf_dir)).select("slug", "created")


@query(f"SELECT slug, title FROM ({ENTRIES_SQL}) ORDER BY coalesce(created, '') DESC, slug LIMIT 1")
def entry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup(catalog_entries(spark, sf_dir), None).select("slug", "title")


@query(
    f"""SELECT slug, '<a href="' || slug || '/"><h2>' || title || '</h2><p>' || description || '</p><ul><li>' || tags[1] || '</li><li>' || tags[2] || '</li></ul></a>' AS html FROM (SELECT slug, {", ".join(f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS {c}" for c in ("title", "description"))}, list_transform(tags, lambda t: replace(t, '#', '#')) AS tags FROM ({ENTRIES_SQL}))"""
)
def index_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cards(catalog_entries(spark, sf_dir)).select("slug", "html")
