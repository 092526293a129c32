"""Registered queries of styled text: entries as runs, and what of them is italic, bold or raised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import dates
from scriptorium.operators import geometry, markup, render
from scriptorium.plans.edge_queries import STYLES, TYPES, typed_records
from scriptorium.plans.queries import STYLE_SQL
from scriptorium.plans.synthetic import RECORDS_SQL, part_count, pick, records, sql_pick, table

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _marked(style: str = "style"):
    return F.coalesce(*(F.when(C(style) == s, render.render_marked(s)) for s in STYLES))


def _tagged_sql(style: str) -> str:
    """A style's entry with tags around what it prints italic or bold."""
    sql, tag = STYLE_SQL[style], lambda name, x: f"'<{name}>' || {x} || '</{name}>'"
    if style == "apa":
        return sql.replace("container || ', ' || volume", tag("i", "container || ', ' || volume"))
    if style == "nature":
        sql = sql.replace("|| volume ||", f"|| {tag('b', 'volume')} ||")
    if style == "acs":
        sql = sql.replace("|| volume ||", f"|| {tag('i', 'volume')} ||").replace("|| year ||", f"|| {tag('b', 'year')} ||")
    return sql if style == "vancouver" else sql.replace("|| container ||", f"|| {tag('i', 'container')} ||")


def _by_style_sql(of: Callable[[str], str]) -> str:
    return "CASE id % 10 " + " ".join(f"WHEN {i} THEN {of(s)}" for i, s in enumerate(STYLES)) + " END"


@query(f"SELECT id, replace({_by_style_sql(_tagged_sql)}, '&', '&amp;') AS html, {_by_style_sql(STYLE_SQL.__getitem__)} AS plain, TRUE AS read_back FROM ({RECORDS_SQL})")
def styled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of ten styles as runs: written as HTML, without their tags, and whether reading the HTML gives the same runs."""
    style = F.get(F.array(*map(F.lit, STYLES)), (C("id") % 10).cast("int"))
    runs = records(spark, sf_dir).withColumn("style", style).select("id", render.to_runs(_marked()).alias("runs")).withColumn("html", markup.html(C("runs")))
    return runs.select("id", "html", markup.plain(C("runs")).alias("plain"), (markup.runs(C("html")) == C("runs")).alias("read_back"))


@query(
    f"""WITH t AS (SELECT id, title, container, volume, {sql_pick(STYLES, "k % 10")} AS style, {sql_pick(TYPES, "(k // 10) % 7")} AS type FROM ({RECORDS_SQL}))
    SELECT id, style, type, CASE WHEN style = 'vancouver' THEN []
        WHEN type = 'article-journal' THEN CASE style WHEN 'apa' THEN [container || ', ' || volume] WHEN 'acs' THEN [container, volume] ELSE [container] END
        WHEN type = 'article' THEN ['arXiv'] WHEN type = 'book' THEN [title] WHEN type = 'chapter' THEN ['Handbook of Coasts'] WHEN type = 'paper-conference' THEN ['Proceedings of the Coast Meeting']
        WHEN style IN ('apa', 'harvard') OR (style = 'mla' AND type = 'thesis') THEN [title] WHEN style = 'mla' THEN ['Port Authority'] ELSE [] END AS italics,
    CASE WHEN style = 'nature' AND type = 'article-journal' THEN [volume] WHEN style = 'acs' AND type IN ('article-journal', 'article') THEN [CAST(year AS VARCHAR)] ELSE [] END AS bold FROM (SELECT t.*, year FROM t JOIN (SELECT id, year FROM ({RECORDS_SQL})) USING (id))"""
)
def styled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is italic and what is bold in items of seven types and ten styles."""
    runs = typed_records(spark, sf_dir).select("id", "style", "type", render.to_runs(_marked()).alias("runs"))
    texts = lambda kind: F.transform(F.filter("runs", lambda r: r[kind]), lambda r: r["text"])
    return runs.select("id", "style", "type", texts("italic").alias("italics"), texts("bold").alias("bold"))


_MARKED_NAMES = ("Öberg", "obel", "Šimek", "Simon", "Écija", "Eck", "de Boer", "Deborah", "Çelik", "Celan", "Obrian", "Óbidos")
_LETTERED = ("apa", "chicagoAD", "harvard")


def _sorted_sql(style: str) -> str:
    order = "who, y, t" if style in _LETTERED else "who, t, y"
    return f"""SELECT '{style}' AS style, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, ordinal) AS entry_no, id,
    {"n = 1 AND coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY " + order + ", ordinal) = 1 AND lag(name) OVER (PARTITION BY doc_id ORDER BY " + order + ", ordinal) = name, FALSE)" if style == "mla" else "FALSE"} AS repeated FROM s"""


@query(
    f"""WITH r AS (SELECT doc_id, ordinal, id, title, {sql_pick(_MARKED_NAMES, "(k // 3) % 12")} AS name, (k % 7 > 0)::INT AS n, 2000 + k % 3 AS y FROM ({RECORDS_SQL})),
    s AS (SELECT *, strip_accents(lower(CASE WHEN n = 1 THEN name || ' Ada' ELSE title END)) AS who, strip_accents(lower(title)) AS t FROM r)
    {" UNION ALL ".join(map(_sorted_sql, ("apa", "harvard", "chicagoAD", "chicagoFull", "mla")))}"""
)
def bibliography_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of five styles with accents, small letters, items without authors, and authors who follow themselves."""
    k, none = C("id"), F.lit(None).cast("string")
    author = F.struct(pick(_MARKED_NAMES, F.floor(k / 3) % 12).alias("family"), F.lit("Ada").alias("given"), none.alias("literal"))
    rows = records(spark, sf_dir).withColumn("author", F.when(k % 7 > 0, F.array(author)).otherwise(F.slice(F.array(author), 1, 0))).withColumn("year", (2000 + k % 3).cast("int"))
    out = None
    for style in render.SORT_KEYS:
        listed = render.bibliography(rows, style).select(
            F.lit(style).alias("style"), "doc_id", "entry_no", F.regexp_extract("text", r"Study (\d+) Into", 1).cast("long").alias("id"), F.startswith("text", F.lit("———")).alias("repeated"),
        )
        out = listed if out is None else out.union(listed)
    return out


def _shown_sql(form: str) -> str:
    """A date or range from the parts that SQL has: n of them, a the first day, b the last or null."""
    year, month, day = "year({0})::VARCHAR", "monthname({0})", "day({0})::VARCHAR"
    part = {2: month, 3: f"{day} || ' ' || {month}" if form == "dmy" else f"{month} || ' ' || {day}"}
    comma = {2: "' '", 3: "', '" if form == "mdy" else "' '"}
    framed = lambda n, x: f"year(a)::VARCHAR || ', ' || {x}" if form == "ymd" else f"{x} || {comma[n]} || year(a)::VARCHAR"
    whole = lambda n, d: year.format(d) if n == 1 else framed(n, part[n].format(d)).replace("year(a)", f"year({d})")
    days = "day(a)::VARCHAR || '–' || day(b)::VARCHAR"
    in_month = f"{days} || ' ' || monthname(a)" if form == "dmy" else f"monthname(a) || ' ' || {days}"
    each = []
    for n in (1, 2, 3):
        same = {1: "year(a) = year(b)", 2: "year(a) = year(b) AND month(a) = month(b)", 3: "a = b"}[n]
        within = f"WHEN n = {n} AND year(a) = year(b) THEN {framed(n, part[n].format('a') + " || '–' || " + part[n].format('b'))} " if n > 1 else ""
        if n == 3:
            within = f"WHEN n = 3 AND year(a) = year(b) AND month(a) = month(b) THEN {framed(3, in_month)} {within}"
        each.append(f"WHEN n = {n} AND (b IS NULL OR {same}) THEN {whole(n, 'a')} {within}WHEN n = {n} THEN {whole(n, 'a')} || '–' || {whole(n, 'b')}")
    return f"CASE {' '.join(each)} END"


@query(
    f"""WITH d AS (SELECT o_orderkey AS id, o_orderkey % 3 + 1 AS n, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) + CAST([0, 3, 40, 500][1 + o_orderkey % 4] AS INTEGER) END AS b FROM orders)
    SELECT id, {", ".join(f"{_shown_sql(form)} AS {form}" for form in dates.FORMS)}, TRUE AS read_back, strftime(a, '%Y-%m-%d') AS accessed FROM d"""
)
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of one to three parts and ranges in three forms, whether each is read back, and days of access found in entries."""
    key, day = C("id"), F.col("o_orderdate").cast("date")
    later = F.when(key % 4 > 0, F.date_add(day, F.get(F.array(*map(F.lit, (0, 3, 40, 500))), (key % 4).cast("int"))))
    parts = lambda d: F.slice(F.array(F.year(d), F.month(d), F.day(d)), F.lit(1), (key % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), "o_orderdate").withColumn("d", dates.of_parts(F.array(parts(day), F.when(later.isNotNull(), parts(later)))))
    shown = rows.select("id", "d", *(dates.show(C("d"), form).alias(form) for form in dates.FORMS), F.concat(F.lit("A site. [cited "), F.date_format(day, "yyyy MMM d"), F.lit("]")).alias("entry"))
    # a range within one part is printed, and read, as a single date
    single = F.when(C("d.from") == C("d.to"), F.struct(C("d.from").alias("from"), F.lit(None).cast("array<int>").alias("to")).cast(dates.DATE)).otherwise(C("d"))
    same = None
    for form in dates.FORMS:
        equal = dates.read(C(form)).eqNullSafe(single)
        same = equal if same is None else same & equal
    found = F.concat_ws("-", *(F.lpad(F.get(dates.accessed(C("entry"))["from"], F.lit(i)).cast("string"), n, "0") for i, n in ((0, 4), (1, 2), (2, 2))))
    return shown.select("id", *dates.FORMS, same.alias("read_back"), found.alias("accessed"))


def _nobody_sql(style: str) -> str:
    """A style's entry without authors."""
    rest = STYLE_SQL[style].split("END", 1)[1].removeprefix(" || ")
    if style == "apa":
        return "title || '. (' || year || '). " + rest.split("title || '. ", 1)[1]
    if style == "harvard":
        return "container || ' (' || year || ') “' || title || ',” " + rest.split("container || ', ", 1)[1]
    if style == "chicagoAD":
        return "'“' || title || '.” ' || year || '. ' || container" + rest.split("container", 1)[1]
    for lead in ("'. “'", "', “'"):
        if rest.startswith(lead):
            return "'“'" + rest[len(lead) :]
    return rest.split(" || ", 1)[1]


@query(f"SELECT id, {_by_style_sql(_nobody_sql)} AS entry FROM ({RECORDS_SQL})".replace("',” || volume", "',” ' || volume"))
def entries_without_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of ten styles of which nobody is known to be the author: what substitutes the names isn't said again."""
    style = F.get(F.array(*map(F.lit, STYLES)), (C("id") % 10).cast("int"))
    rows = records(spark, sf_dir).withColumns({"style": style, "author": F.slice("author", 1, 0)})
    return rows.select("id", F.coalesce(*(F.when(C("style") == s, render.render(s)) for s in STYLES)).alias("entry"))


_PAGE_KINDS = (("bracket", "ieee"), ("paren", "acs"), ("dot", "vancouver"), ("raised", "apa"), ("indent", "harvard"), ("crushed", "vancouver"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of entries on two lines each: documents whose entries begin with `[n]`, `(n)`, `n.`, a raised number or a hanging indent, and
    documents whose entries' two lines lie over each other.

    The lines go through one exchange, so that what reads them more than once has them made once."""
    kind = C("doc_id") % len(_PAGE_KINDS)
    label, number = F.lit(""), (C("ordinal") + 1).cast("string")
    text = F.coalesce(*(F.when(kind == i, render.render(style)) for i, (_, style) in enumerate(_PAGE_KINDS)))
    for i, (left, right) in enumerate((("[", "] "), ("(", ") "), ("", ". "))):
        label = F.when(kind == i, F.concat(F.lit(left), number, F.lit(right))).otherwise(label)
    cut = lambda n: F.split(F.regexp_replace(F.concat(label, text), rf"^(.{{{n}}}\S*) ", "$1\n"), "\n")
    parts = F.when(kind == 5, cut(70)).otherwise(cut(50))
    item = lambda t, x, h=10.0: F.struct(t.alias("str"), F.lit(x).alias("x"), (F.length(t) * 5.0).alias("width"), F.lit(h).alias("height"), F.lit(False).alias("italic"))
    entries = records(spark, sf_dir).select("doc_id", "ordinal", parts.alias("parts"))
    one, two = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    line = lambda n, t, *items: F.struct(n.cast("int").alias("line_no"), (700.0 - 12.0 * n).cast("double").alias("y"), t.alias("text"), F.array(*items).alias("items"))
    row = C("ordinal") * 2 + 1
    usual = F.array(line(row, one, item(one, 50.0)), line(row + 1, two, item(two, 70.0)))
    raised = F.array(line(row, F.concat(number, one), item(number, 50.0, 6.0), item(one, 60.0)), line(row + 1, two, item(two, 60.0)))
    crushed = F.array(line(row, F.concat(one, two), item(one, 50.0), item(two, 50.0)))
    lines = F.when(kind == 3, raised).when(kind == 5, crushed).otherwise(usual)
    rows = entries.select("doc_id", F.lit(1).alias("page"), F.explode(lines).alias("l")).select("doc_id", "page", "l.*")
    pages = records(spark, sf_dir).select("doc_id", F.lit(1).alias("page")).distinct()  # no entry is printed for its page's number
    heading = pages.select("doc_id", "page", line(F.lit(0), F.lit("REFERENCES"), item(F.lit("REFERENCES"), 50.0)).alias("l")).select("doc_id", "page", "l.*")
    return rows.unionByName(heading).repartition(2 * part_count(table(spark, sf_dir, "orders")), "doc_id")  # two lines an order


@query(
    f"""SELECT doc_id, count(*) AS n_refs, sum(year)::BIGINT AS years, min(title) AS first_title, CASE WHEN doc_id % 6 = 5 THEN ['{geometry.OVERLAP}'] ELSE [] END AS warnings
    FROM ({RECORDS_SQL}) GROUP BY doc_id"""
)
def pages_of_all_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = marked_pages(spark, sf_dir)
    refs = geometry.parse_pages(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("year").cast("long").alias("years"), F.min("title").alias("first_title"))
    return refs.join(geometry.page_warnings(lines), "doc_id")
