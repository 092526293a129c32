"""Registered queries of forms that the main queries don't reach: noise, odd geometry, long lists, dates, orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import identifiers, names, text
from scriptorium.operators import citations, geometry, markup, match, messy, parse, render
from scriptorium.plans.synthetic import FAMILIES, GIVEN, RECORDS_SQL, records, sql_pick, table
from scriptorium.sources import readers

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Surnames of the first three authors, for SQL.
_NAMES_SQL = [sql_pick(FAMILIES, f"(k + {5 * j}) % 12") for j in range(3)]
_GIVEN_SQL = [sql_pick(GIVEN, f"(k + {7 * j}) % 12") for j in range(3)]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _k() -> Column:
    return C("id")


# --- text and identifiers -------------------------------------------------------------------------------------------


@query(f"SELECT id, title || ' in ' || container AS plain, [title, container] AS italics FROM ({RECORDS_SQL})")
def italic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(F.lit("<i>"), "title", F.lit("</i> in <I> "), "container", F.lit("</I><i> </i>"))
    rows = records(spark, sf_dir).select("id", tagged.alias("t"))
    return rows.select("id", F.trim(F.regexp_replace(text.strip_italic_tags(C("t")), " +", " ")).alias("plain"), text.italic_segments(C("t")).alias("italics"))


@query(f"SELECT id, id % 5 IN (0, 1, 3) AS broken FROM ({RECORDS_SQL})")
def broken_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ("see https://", "see https://host.example/a/", "see https://host.example/a", "as in DOI:", "plain words")
    line = F.concat("title", F.lit(" "), F.get(F.array(*map(F.lit, ends)), (_k() % 5).cast("int")))
    return records(spark, sf_dir).select("id", text.ends_with_broken_url(line).alias("broken"))


@query("SELECT doc_id, md5(text || 'fi fl ff ffi ffl st st') AS folded FROM documents")
def fold_ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat(messy.ligaturize(C("text")), F.lit("ﬁ ﬂ ﬀ ﬃ ﬄ ﬅ ﬆ"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_ligatures(joined)).alias("folded"))


@query(f"SELECT id, '[' || id || ']' AS label, title || ' no. ' || issue AS plain, '<i>' || title || '</i> no. ' || issue AS annotated, title AS italic, issue AS bold, '2' AS sup FROM ({RECORDS_SQL})")
def html_run_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = F.concat(F.lit('<div class="csl-left-margin">['), "id", F.lit("]</div>"))
    styled = F.concat(F.lit("<em>"), "title", F.lit('</em> no. <span style="font-weight: bold">'), "issue", F.lit("</span>"))
    rows = records(spark, sf_dir).select("id", F.concat(margin, styled).alias("h"), F.concat(F.lit("<i>"), "title", F.lit("</i><b>"), "issue", F.lit("</b><sup>2</sup>")).alias("flat"))
    rows = rows.select("id", "h", markup.runs(markup.without_label(C("h"))).alias("runs"), markup.runs(C("flat")).alias("flat"))
    runs, flat = C("runs"), C("flat")
    of = lambda style: F.array_join(F.transform(F.filter(flat, lambda r: r[style]), lambda r: r["text"]), "")
    return rows.select("id", markup.label(C("h")).alias("label"), markup.plain(runs).alias("plain"), markup.annotated(runs).alias("annotated"), of("italic").alias("italic"), of("bold").alias("bold"), of("sup").alias("sup"))


@query(f"SELECT id, year FROM ({RECORDS_SQL})")
def access_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of access, which stand in brackets of more weight, are blanked first."""
    phrases = ("(accessed 1999-03-04)", "[cited 1999 Mar 4]", "Accessed: March 4, 1999;", "cited 1999 March 4")
    said = F.concat_ws(" ", "title", F.concat(F.lit("Journal, "), C("year").cast("string"), F.lit(".")), F.get(F.array(*map(F.lit, phrases)), (_k() % 4).cast("int")))
    return records(spark, sf_dir).select("id", identifiers.find_year(identifiers.strip_accessed_phrases(said))["year"].alias("year"))


@query(f"SELECT 'r' || id AS id, title, container, year, page, doi FROM ({RECORDS_SQL})")
def csl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as CSL-JSON text, read by the reader's schema, under the engine's names."""
    day = F.struct(F.array(F.array(C("year").cast("long"), F.lit(3).cast("long"))).alias("date-parts"))
    item = F.struct(F.concat(F.lit("r"), "id").alias("id"), "title", C("container").alias("container-title"), "page", C("doi").alias("DOI"), day.alias("issued"))
    items = records(spark, sf_dir).select(F.from_json(F.to_json(item), readers.CSL_ITEM).alias("item")).select("item.*")
    return readers.records(items).select("id", "title", "container", "year", "page", "doi")


# --- names ----------------------------------------------------------------------------------------------------------


@query(f"SELECT id, id % 4 IN (0, 3) AS is_org FROM ({RECORDS_SQL})")
def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = C("author")[0]["family"]
    forms = F.array(F.concat(F.lit("Institute of "), family), F.concat(family, F.lit(", A. B.")), F.concat(F.lit("A. B. "), family), F.concat(family, F.lit(" Board for Studies")))
    return records(spark, sf_dir).select("id", F.get(forms, (_k() % 4).cast("int")).alias("b")).select("id", F.expr(names.looks_like_org_sql("b")).alias("is_org"))


@query(f"SELECT id, {_NAMES_SQL[0]} || ' ' || {_GIVEN_SQL[0]} AS block, title || '. ' || container AS after FROM ({RECORDS_SQL})")
def author_block_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(C("author")[0]["family"], F.lit(" "), C("author")[0]["given"], F.lit(". "), "title", F.lit(". "), "container")
    return records(spark, sf_dir).select("id", parse.author_block_end(entry).alias("p")).select("id", C("p.block").alias("block"), C("p.after").alias("after"))


@query(
    f"""SELECT id, CASE WHEN n_authors >= 3 THEN {_NAMES_SQL[0]} || ' et al.' WHEN n_authors = 2 THEN {_NAMES_SQL[0]} || ' & ' || {_NAMES_SQL[1]} ELSE {_NAMES_SQL[0]} END AS names,
    left({_GIVEN_SQL[0]}, 1) || '.-' || left({_GIVEN_SQL[1]}, 1) || '.' AS hyphened, left({_GIVEN_SQL[0]}, 1) || left({_GIVEN_SQL[1]}, 1) AS closed FROM ({RECORDS_SQL})"""
)
def long_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists cut by `et al.`, and initials of hyphenated names."""
    families = F.transform("author", lambda a: a["family"])
    person = lambda j: F.get(F.array(*map(F.lit, GIVEN)), ((_k() + 7 * j) % 12).cast("int"))
    given = F.concat(person(0), F.lit("-"), person(1))
    return records(spark, sf_dir).select(
        "id", render.name_list(families, last=" & ", least=3).alias("names"), render.initials(given).alias("hyphened"), render.initials(given, dot="", gap="", hyphen=False).alias("closed"),
    )


# --- types ----------------------------------------------------------------------------------------------------------

TYPES = ("article-journal", "book", "chapter", "paper-conference", "thesis", "webpage", "article")
STYLES = tuple(sorted(render.RENDERERS))


def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of seven types, with the style that each is printed in."""
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.floor(_k() / 10) % 7).cast("int"))
    style = F.get(F.array(*map(F.lit, STYLES)), (_k() % 10).cast("int"))
    of = lambda *kinds: C("type").isin(*kinds)
    home = F.when(of("chapter"), "Handbook of Coasts").when(of("paper-conference"), "Proceedings of the Coast Meeting").when(of("webpage"), "Port Authority").when(of("article"), "arXiv").when(of("article-journal"), C("container"))
    link = F.when(of("webpage"), F.concat(F.lit("https://example.org/site/"), "id")).when(of("article"), F.concat(F.lit("https://arxiv.org/abs/2101."), F.lpad((_k() % 100000).cast("string"), 5, "0")))
    editor = F.struct(F.lit("Orr").alias("family"), F.lit("Cy").alias("given"), F.lit(None).cast("string").alias("literal"))
    press = F.when(of("book", "chapter"), "Example Press").when(of("thesis"), "University of Graz").when(of("paper-conference"), "Coast Society")
    rows = records(spark, sf_dir).withColumns({"type": kind, "style": style})
    return rows.withColumns({
        "container": home, "url": link, "doi": F.when(of("article-journal"), C("doi")), "volume": F.when(of("article-journal"), C("volume")), "issue": F.when(of("article-journal"), C("issue")),
        "page": F.when(of("article-journal", "chapter", "paper-conference"), C("page")), "editor": F.when(of("chapter"), F.array(editor)).otherwise(C("editor")), "genre": F.when(of("thesis"), "PhD thesis"),
        "publisher": press, "place": F.when(of("book", "chapter", "thesis", "paper-conference"), "Graz"), "edition": F.when(of("book"), "2"),
    })


@query(
    f"""WITH t AS (SELECT id, title, year, {sql_pick(STYLES, "k % 10")} AS style, {sql_pick(TYPES, "(k // 10) % 7")} AS type, {_NAMES_SQL[0]} AS family FROM ({RECORDS_SQL}))
    SELECT id, style, type, title, CASE WHEN NOT (type = 'webpage' AND style IN ('ieee', 'acs')) THEN year END AS year, family FROM t"""
)
def types_of_all_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of seven types, printed in ten styles and read back. Two styles print no year of a site."""
    rows = typed_records(spark, sf_dir)
    text_of = F.coalesce(*(F.when(C("style") == s, render.render(s)) for s in STYLES))
    refs = parse.extract_fields(rows.select("id", "style", text.fold_text(text_of).alias("raw")))
    return refs.select("id", "style", "type", "title", "year", F.coalesce(C("author")[0]["family"], C("author")[0]["literal"]).alias("family"))


# --- numbers, dates, orders -----------------------------------------------------------------------------------------

_FIRST, _LAST = "(k % 800 + 100)", "(k % 800 + 100 + k % 13 + 1)"


@query(
    f"""WITH p AS (SELECT id, {_FIRST} AS a, {_LAST} AS b, CAST({_FIRST} AS VARCHAR) AS s, CAST({_LAST} AS VARCHAR) AS t FROM ({RECORDS_SQL})),
    c AS (SELECT *, CASE WHEN a // 100 <> b // 100 THEN t WHEN a // 10 <> b // 10 THEN right(t, 2) ELSE right(t, 1) END AS short, CASE WHEN a // 100 <> b // 100 THEN t ELSE right(t, 2) END AS two FROM p)
    SELECT id, s || '–' || t AS expanded, s || '–' || short AS minimal, s || '–' || two AS minimal_two, s || '–' || CASE WHEN a % 100 = 0 THEN t WHEN a % 100 < 10 THEN short ELSE two END AS chicago,
    CASE WHEN id % 2 = 0 THEN 'pp.' ELSE 'p.' END AS label FROM c"""
)
def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = _k() % 800 + 100, _k() % 800 + 101 + _k() % 13
    rows = records(spark, sf_dir).select("id", F.concat_ws("-", first.cast("string"), last.cast("string")).alias("page"))
    styles = {"expanded": "expanded", "minimal": "minimal", "minimal_two": "minimal-two", "chicago": "chicago"}
    shown = F.when(_k() % 2 == 0, C("page")).otherwise(F.split("page", "-")[0])
    return rows.select("id", *(render.pages(C("page"), v).alias(k) for k, v in styles.items()), render.page_label(shown).alias("label"))


@query("""SELECT o_orderkey AS id, day(o_orderdate) || CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd' WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END AS day,
    monthname(o_orderdate) AS month, CASE WHEN month(o_orderdate) IN (5, 6, 7) THEN monthname(o_orderdate) ELSE left(monthname(o_orderdate), 3) || '.' END AS short FROM orders""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), F.dayofmonth("o_orderdate").alias("d"), F.month("o_orderdate").alias("m"))
    return rows.select("id", render.ordinal(C("d")).alias("day"), render.month(C("m")).alias("month"), render.month(C("m"), True).alias("short"))


@query(
    f"""WITH r AS (SELECT *, lower({_NAMES_SQL[0]}) || CASE WHEN n_authors > 1 THEN ' ' || lower({_NAMES_SQL[1]}) ELSE '' END || CASE WHEN n_authors > 2 THEN ' ' || lower({_NAMES_SQL[2]}) ELSE '' END AS who, id % 2 + 2000 AS y FROM ({RECORDS_SQL})),
    n AS (SELECT doc_id, title, y, row_number() OVER (PARTITION BY doc_id ORDER BY who, y, title) AS entry_no, count(*) OVER (PARTITION BY doc_id, who, y) AS n, row_number() OVER (PARTITION BY doc_id, who, y ORDER BY title) AS k FROM r)
    SELECT doc_id, entry_no, '(' || y || CASE WHEN n > 1 THEN chr(CAST(96 + k AS INTEGER)) ELSE '' END || '). ' || title AS head FROM n"""
)
def bibliography_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = render.bibliography(records(spark, sf_dir).withColumn("year", (_k() % 2 + 2000).cast("int")), "apa")
    return out.select("doc_id", "entry_no", F.regexp_extract("text", r"(\(\d{4}[a-z]?\)\. Study \d+ Into \w+ Across \w+)", 1).alias("head"))


@query(f"SELECT doc_id, ordinal AS entry_no, CASE WHEN ordinal > 0 AND ordinal % 3 <> 0 THEN '---' ELSE 'A' || (ordinal // 3) END AS author_text FROM ({RECORDS_SQL})")
def repeated_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = records(spark, sf_dir).select("doc_id", C("ordinal").alias("entry_no"), F.concat(F.lit("A"), F.floor(C("ordinal") / 3).cast("string")).alias("author_text"))
    return render.repeated_authors(entries)


@query("SELECT lang, printf('%-34s', lang) || '  good ' || sum(quality) || '/' || count(*) || ' (' || CAST(round(100.0 * sum(quality) / count(*)) AS INTEGER) || '%)' AS line FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("long").alias("good"), F.count(F.lit(1)).alias("all"))
    return match.report_rows(rows, "lang", [("good", "good", "all")])


# --- noise and citations --------------------------------------------------------------------------------------------


@query(f"SELECT id, left(doi, CAST(floor(length(doi) * 0.6) AS INTEGER)) || '-' || chr(10) || substr(doi, CAST(floor(length(doi) * 0.6) AS INTEGER) + 1) AS broken, doi AS mended FROM ({RECORDS_SQL})")
def break_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier broken over two lines. Where it was broken at a letter or digit, the wrap keeps the hyphen."""
    broken = messy.break_doi(C("doi"))
    return records(spark, sf_dir).select("id", "doi", broken.alias("broken")).select("id", "broken", F.replace("broken", F.lit("-\n"), F.lit("")).alias("mended"))


@query(
    f"""WITH t AS (SELECT doc_id, ordinal + 1 AS entry_no, title || ' of fine flora. ' || doi AS raw FROM ({RECORDS_SQL})),
    b AS (SELECT *, entry_no = min(entry_no) OVER (PARTITION BY doc_id) AS cut, entry_no % 3 = 1 AND regexp_matches(raw, '[A-Za-z]{{10,}}') AS wrapped FROM t)
    SELECT doc_id, entry_no, length(raw) + 2 * (cut::INT + wrapped::INT) AS n, cut OR wrapped AS split FROM b"""
)
def messy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry's identifier and every third entry's first long word are broken over two lines; ligatures fold back."""
    entries = records(spark, sf_dir).select("doc_id", (C("ordinal") + 1).alias("entry_no"), F.concat("title", F.lit(" of fine flora. "), "doi").alias("raw"))
    out = messy.messy(entries)
    return out.select("doc_id", "entry_no", F.length(text.fold_ligatures(C("raw"))).alias("n"), C("raw").contains("-\n").alias("split"))


@query(f"WITH p AS (SELECT doc_id, ordinal // 5 + 1 AS page, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY ALL) SELECT doc_id, page, n + CASE WHEN page > 1 THEN 2 ELSE 0 END AS lines, CASE WHEN page > 1 THEN 'Annals' END AS first, CASE WHEN page > 1 THEN 'Page ' || page || ' of 4' END AS last FROM p")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.floor(C("ordinal") / 5) + 1).cast("long")
    lines = records(spark, sf_dir).select("doc_id", page.alias("page"), C("ordinal").alias("line_no"), C("title").alias("line"), F.lit(4).alias("pages"))
    out = messy.with_running_heads(lines, "Annals")
    first, last = F.min_by("line", "line_no"), F.max_by("line", "line_no")
    return out.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.when(C("page") > 1, first).alias("first"), F.when(C("page") > 1, last).alias("last"))


@query(f"""SELECT id, '(' || CASE WHEN n_authors >= 3 THEN {_NAMES_SQL[0]} || ' et al.' WHEN n_authors = 2 THEN {_NAMES_SQL[0]} || ' and ' || {_NAMES_SQL[1]} ELSE {_NAMES_SQL[0]} END || ' ' || string_split(page, '-')[1] || ')' AS cite,
    'One. Two. Three (x). One. Two. Three (y).' AS body FROM ({RECORDS_SQL})""")
def mla_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences, cites = F.array(*map(F.lit, ("One", "Two", "Three", "One", "Two", "Three"))), F.array(F.lit("(x)"), F.lit("(y)"))
    return records(spark, sf_dir).select("id", messy.mla_cite(C("author"), C("page")).alias("cite"), messy.body(sentences, cites).alias("body"))


@query(f"SELECT doc_id, unnest(['bracket', 'narrative', 'paren_number', 'superscript']) AS kind, unnest([count(*), count(*), count(*), count(*)]) AS n FROM ({RECORDS_SQL}) GROUP BY doc_id")
def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in brackets, in parentheses, raised, and as part of the sentence."""
    number = C("ordinal") + 1
    said = F.concat_ws(" ", F.lit("Shown"), messy.numeric_cite(number), F.lit("and"), messy.numeric_cite(number, "paren_number"), F.lit("or word"), messy.numeric_cite(number, "superscript"), F.lit("by"), F.concat(C("author")[0]["family"], F.lit(" (2004).")))
    pages = records(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), said.alias("text"))
    return citations.per_page(citations.citations(pages)).select("doc_id", "kind", "n")


@query(f"SELECT doc_id, ordinal AS line_no FROM ({RECORDS_SQL}) WHERE ordinal < 12 UNION ALL SELECT -1 - doc_id, ordinal FROM ({RECORDS_SQL})")
def before_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before the last heading; all lines of documents without one."""
    line = F.when((C("ordinal") == 12) & (C("doc_id") >= 0), "R E F E R E N C E S").otherwise(C("title"))
    rows = records(spark, sf_dir).select("doc_id", C("ordinal"), "title")
    both = rows.union(rows.select(-1 - C("doc_id"), "ordinal", "title"))
    return citations.before_references(both.select("doc_id", C("ordinal").alias("line_no"), line.alias("line"))).select("doc_id", "line_no")


@query(f"SELECT doc_id, ordinal AS line_no FROM ({RECORDS_SQL}) WHERE ordinal > 7")
def own_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(C("ordinal") == 7, "  sources [all] ").when(C("ordinal") == 3, "References").otherwise(C("title"))
    lines = records(spark, sf_dir).select("doc_id", C("ordinal").alias("line_no"), line.alias("line"))
    return parse.locate_section(lines, heading="Sources [all]").select("doc_id", "line_no")


# --- geometry -------------------------------------------------------------------------------------------------------


def _item(t: Column, x: Column | float, height: float = 10.0) -> Column:
    x = x if isinstance(x, Column) else F.lit(x)
    return F.struct(t.alias("str"), x.cast("double").alias("x"), (F.length(t) * 5.0).alias("width"), F.lit(height).alias("height"), F.lit(False).alias("italic"))


def _lines(rows: DataFrame, items: Column, said: Column) -> DataFrame:
    y = 700.0 - 12.0 * C("ordinal")
    return rows.select("doc_id", F.lit(0).alias("page"), C("ordinal").alias("line_no"), y.alias("y"), said.alias("text"), items.cast(f"array<{geometry.ITEM}>").alias("items"))


@query(f"SELECT doc_id, title AS text, CAST(1 AS INTEGER) AS n_items FROM ({RECORDS_SQL})")
def margin_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers in the left margin: glued to a line's text, or a line of their own."""
    rows = records(spark, sf_dir)
    number = (C("ordinal") + 1).cast("string")
    numbered = _lines(rows, F.array(_item(number, 20.0), _item(C("title"), 80.0)), F.concat(number, F.lit(" "), C("title")))
    alone = _lines(rows.withColumn("ordinal", C("ordinal") + 100), F.array(_item(C("ordinal").cast("string"), 20.0)), C("ordinal").cast("string"))
    out = geometry.strip_margin_numbers(geometry.flatten_lines(numbered.union(alone)))
    return out.select("doc_id", "text", C("ni").cast("int").alias("n_items"))


@query(f"SELECT doc_id, title AS text, CAST(1 AS INTEGER) AS n_items FROM ({RECORDS_SQL}) WHERE ordinal % 4 <> 3")
def blank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of white space don't count; a line of such items alone has its own text or none."""
    rows = records(spark, sf_dir)
    blank = _item(F.lit(" \t"), 300.0)
    items = F.when(C("ordinal") % 4 == 3, F.array(blank)).otherwise(F.array(blank, _item(C("title"), 50.0), blank))
    out = geometry.flatten_lines(_lines(rows, items, F.when(C("ordinal") % 4 != 3, C("title")).otherwise(F.lit(" "))))
    return out.select("doc_id", "text", C("ni").cast("int").alias("n_items"))


@query(f"SELECT doc_id, ordinal AS line_no, ordinal % 3 = 0 AS is_label FROM ({RECORDS_SQL})")
def superscript_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small number before a line's text is a label; one of the text's size, or a small word, is none."""
    rows = records(spark, sf_dir)
    head = F.when(C("ordinal") % 3 == 2, F.lit("ab")).otherwise((C("ordinal") + 1).cast("string"))
    small, large = _item(head, 50.0, 6.0), _item(head, 50.0, 10.0)
    items = F.array(F.when(C("ordinal") % 3 == 1, large).otherwise(small), _item(C("title"), 65.0))
    flat = geometry.flatten_lines(_lines(rows, items, C("title")))
    return flat.select("doc_id", (C("seq") - 1).alias("line_no"), geometry.is_sup_label(F.lit(10.0), F.lit(False)).alias("is_label"))


@query(f"SELECT doc_id, ordinal AS line_no FROM ({RECORDS_SQL}) WHERE ordinal > 5 AND NOT (ordinal >= 10 AND ordinal < 15)")
def later_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that stands above the heading in a later column of its page belongs to what is before the heading."""
    heading = C("ordinal") == 5
    col = F.when(C("ordinal") < 10, 1).otherwise(2)
    lines = records(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), col.alias("col"), (700.0 - 12.0 * (C("ordinal") % 10)).alias("y"), C("ordinal").alias("line_no"), F.when(heading, "REFERENCES").otherwise(C("title")).alias("text"))
    return geometry.locate_geo_section(lines).select("doc_id", "line_no")


@query(f"SELECT doc_id, count(*) AS n_refs, sum(year)::BIGINT AS years FROM ({RECORDS_SQL}) GROUP BY doc_id")
def pages_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pages have text and no geometry are parsed as text."""
    entry = F.concat(F.lit("["), (C("ordinal") + 1).cast("string"), F.lit("] "), render.render("ieee"))
    rows = records(spark, sf_dir).select("doc_id", (C("ordinal") * 2).alias("line_no"), entry.alias("text"))
    gaps = rows.select("doc_id", (C("line_no") + 1).alias("line_no"), F.lit("").alias("text"))
    lines = rows.union(gaps).select("doc_id", F.lit(0).alias("page"), "line_no", F.lit(0.0).alias("y"), "text", F.lit(None).cast(f"array<{geometry.ITEM}>").alias("items"))
    return geometry.parse_pages(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("year").cast("long").alias("years"))


@query(
    f"""SELECT doc_id, ordinal + 1 AS entry_no, CASE WHEN ordinal < 4 THEN 'A' || ordinal || ' ' || container || ' grew (' || year || ').' ELSE 'B' || ordinal || ' ' || container || ' (' || year || ').' END AS raw FROM ({RECORDS_SQL})"""
)
def crushed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that lack their year get the lines without an entry, one each, in order."""
    done = C("ordinal") >= 4
    head = F.concat(F.when(done, "B").otherwise("A"), C("ordinal").cast("string"), F.lit(" "), C("container"))
    year = F.concat(F.lit("("), C("year").cast("string"), F.lit(")."))
    base = records(spark, sf_dir).withColumn("head", F.when(done, F.concat_ws(" ", head, year)).otherwise(head)).withColumn("tail", F.concat(F.lit("grew "), year))
    row = lambda n, t, start: (C("doc_id"), n.alias("line_no"), t.alias("_t"), F.lit(10.0).alias("h"), F.lit(start).alias("_start"), F.lit(True).alias("section_found"))
    rows = base.select(*row(C("ordinal"), C("head"), True)).union(base.filter(~done).select(*row(C("ordinal") + 100, C("tail"), False)))
    mended = geometry.assembled(rows.withColumns({"_block": F.lit(0), "_deg": F.lit(True)}))
    return mended.select("doc_id", (C("_nth") + 1).alias("entry_no"), F.array_join("texts", " ").alias("raw"))
