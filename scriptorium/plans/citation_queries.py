"""Registered queries of citations in text: labels that tell references apart, clusters, their reading and resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import citations, cite, lookup
from scriptorium.plans.synthetic import RECORDS_SQL, pick, records, sql_pick, table

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Names of which families, initials and later authors collide.
_FAMILIES = ("Orr", "Ray", "Lee")
_GIVEN = ("Ada", "Alma", "Bruno", "Berta Maria", "Jean-Luc")
_INITIALS = ("A.", "A.", "B.", "B. M.", "J.-L.")
_BODY = "Port Authority"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def colliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of up to five authors; some have an organisation, some nobody."""
    k, none = C("id"), F.lit(None).cast("string")
    person = lambda j: F.struct(pick(_FAMILIES, (F.floor(k / 2) + j * F.floor(k / 6)) % 3).alias("family"), pick(_GIVEN, (F.floor(k / 3) + j * F.floor(k / 10)) % 5).alias("given"), none.alias("literal"))
    people = F.slice(F.array(*map(person, range(5))), F.lit(1), (k % 5 + 1).cast("int"))
    body = F.array(F.struct(none.alias("family"), none.alias("given"), F.lit(_BODY).alias("literal")))
    rows = records(spark, sf_dir).withColumn("year", (2000 + F.floor(k / 5) % 2).cast("int"))
    return rows.withColumn("author", F.when(k % 11 == 0, F.slice(people, 1, 0)).when(k % 13 == 0, body).otherwise(people))


def _lists_sql() -> str:
    """r: a record's names as families (f), with initials (i) and with given names (g)."""
    family = sql_pick(_FAMILIES, "(k // 2 + j * (k // 6)) % 3")
    of = lambda words: f"list_transform(range(n), lambda j: {sql_pick(words, '(k // 3 + j * (k // 10)) % 5')} || ' ' || {family})"
    whole = lambda some: f"CASE WHEN k % 11 = 0 THEN [title] WHEN k % 13 = 0 THEN ['{_BODY}'] ELSE {some} END"
    return f"""k AS (SELECT *, k % 5 + 1 AS n FROM (SELECT * REPLACE (2000 + (k // 5) % 2 AS year) FROM ({RECORDS_SQL}))),
    r AS (SELECT doc_id, ordinal, id, title, CAST(year AS INTEGER) AS year, {whole(f"list_transform(range(n), lambda j: {family})")} AS f, {whole(of(_INITIALS))} AS i, {whole(of(_GIVEN))} AS g FROM k)"""


def _label_sql(names: str, shown: str, how: cite.CiteStyle) -> str:
    return f"""CASE WHEN {shown} < len({names}) AND {shown} = 1 THEN {names}[1] || ' et al.' WHEN {shown} < len({names}) THEN array_to_string({names}[1:{shown}], ', ') || ', et al.'
        WHEN len({names}) = 1 THEN {names}[1] WHEN len({names}) = 2 THEN {names}[1] || '{how.two}' || {names}[2] ELSE array_to_string({names}[1:len({names}) - 1], ', ') || '{how.last}' || {names}[len({names})] END"""


def labels_sql(style: str) -> str:
    """Common table expressions that end in `labelled`: who, year and letter_no of every record, by comparing each with all that are cited alike."""
    how = cite.CITE_STYLES[style]
    other = "coalesce(list_position(list_transform(range(1, greatest(len(a.{0}), len(o.{0})) + 1), lambda q: a.{0}[q] IS DISTINCT FROM o.{0}[q]), true), 0)"

    def needed(name: str, of: str, lists: str, alike: str) -> str:
        return f"{name} AS (SELECT a.id, max({other.format(lists)}) AS need FROM {of} a JOIN {of} o ON a.doc_id = o.doc_id AND a.year = o.year AND a.base = o.base AND a.{alike} = o.{alike} AND a.{lists} <> o.{lists} GROUP BY a.id)"

    if how.given == "first":
        long = "g" if how.full else "i"
        names = f"CASE WHEN min({long}[1]) OVER (PARTITION BY doc_id, f[1]) <> max({long}[1]) OVER (PARTITION BY doc_id, f[1]) THEN [{long}[1]] || f[2:] ELSE f END"
    else:
        names = "f"
    shown = f"CASE WHEN len(names) < {how.least} THEN len(names) ELSE {how.shown} END"
    out = f"""{_lists_sql()},
    n0 AS (SELECT *, {names} AS names FROM r), b AS (SELECT *, {_label_sql("names", "shown", how)} AS base FROM (SELECT *, {shown} AS shown FROM n0)),
    {needed("d0", "b", "names", "base")},
    w0 AS (SELECT * EXCLUDE (need), {_label_sql("names", "shown", how)} AS who FROM (SELECT b.* REPLACE (greatest(shown, least(coalesce(need, 0), len(names))) AS shown), need FROM b LEFT JOIN d0 USING (id)))"""
    last = "w0"
    for step, lists in enumerate(("i", "g") if how.given == "any" else (), 1):
        out += f""", {needed(f"d{step}", last, lists, "who")},
    w{step} AS (SELECT * EXCLUDE (need) REPLACE ({_label_sql("names", "shown", how)} AS who) FROM (SELECT w.* REPLACE ({lists}[1:coalesce(need, 0)] || names[coalesce(need, 0) + 1:] AS names, greatest(shown, least(coalesce(need, 0), len(names))) AS shown), need
        FROM {last} w LEFT JOIN d{step} USING (id)))"""
        last = f"w{step}"
    return f"""{out},
    labelled AS (SELECT doc_id, ordinal, id, title, year, who, CASE WHEN count(*) OVER (PARTITION BY doc_id, year, who) > 1 THEN row_number() OVER (PARTITION BY doc_id, year, who ORDER BY title, ordinal) END::INTEGER AS letter_no FROM {last})"""


_LETTER = "coalesce(chr(96 + letter_no), '')"


def _labelled(style: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cite.label_references(colliding(spark, sf_dir), style).select("doc_id", "ordinal", "who", "year", "letter")

    run.__name__ = f"disambiguate_{style}"
    return query(f"WITH {labels_sql(style)} SELECT doc_id, ordinal, who, year, nullif({_LETTER}, '') AS letter FROM labelled")(run)


for _style in cite.CITE_STYLES:
    _labelled(_style)


def _clustered(labelled: DataFrame, style: str, collapse: str, size: int) -> DataFrame:
    """Clusters of `size` references; every third is cited twice in its cluster."""
    rows = labelled.withColumn("cluster", F.floor(C("ordinal") / size).cast("int"))
    twice = rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.when(C("ordinal") % 3 == 0, 2).otherwise(1)))).drop("_time")
    return cite.clusters(twice, style, collapse=collapse)


@query(
    f"""WITH {labels_sql("apa")}, g AS (SELECT doc_id, ordinal // 4 AS cluster, who, who || ', ' || string_agg(year || {_LETTER}, ', ' ORDER BY year, letter_no) AS said FROM labelled GROUP BY doc_id, ordinal // 4, who)
    SELECT doc_id, cluster::INTEGER AS cluster, '(' || string_agg(said, '; ' ORDER BY who) || ')' AS text FROM g GROUP BY doc_id, cluster"""
)
def clusters_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(cite.label_references(colliding(spark, sf_dir), "apa"), "apa", "year", 4)


@query(
    f"""WITH {labels_sql("harvard")}, y AS (SELECT doc_id, ordinal // 4 AS cluster, who, year, min(letter_no) AS first, year || string_agg({_LETTER}, ', ' ORDER BY letter_no) AS said FROM labelled GROUP BY doc_id, ordinal // 4, who, year),
    g AS (SELECT doc_id, cluster, who, min(year) AS first_year, first(first ORDER BY year) AS first, who || ', ' || string_agg(said, ', ' ORDER BY year) AS said FROM y GROUP BY doc_id, cluster, who)
    SELECT doc_id, cluster::INTEGER AS cluster, '(' || string_agg(said, '; ' ORDER BY first_year, who) || ')' AS text FROM g GROUP BY doc_id, cluster"""
)
def clusters_by_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(cite.label_references(colliding(spark, sf_dir), "harvard"), "harvard", "suffix", 4)


@query(
    f"""WITH {labels_sql("chicagoAD")}, m AS (SELECT * REPLACE (doc_id // 8 AS doc_id, 20 * (doc_id % 8) + ordinal AS ordinal, 'Orr' AS who) FROM labelled),
    x AS (SELECT doc_id, ordinal, year, row_number() OVER (PARTITION BY doc_id, year ORDER BY title, ordinal) AS n FROM m), s AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, year ORDER BY n) AS g FROM x WHERE ordinal % 7 > 1),
    letter AS (SELECT n, CASE WHEN n <= 26 THEN chr((96 + n)::INTEGER) ELSE chr((96 + (n - 1) // 26)::INTEGER) || chr((97 + (n - 1) % 26)::INTEGER) END AS letter FROM range(1, 200) t(n)),
    i AS (SELECT doc_id, year, min(n) AS a, max(n) AS b FROM s GROUP BY doc_id, year, g),
    t AS (SELECT doc_id, year, a, CASE WHEN b - a >= 2 THEN x.letter || '–' || y.letter WHEN b > a THEN x.letter || ', ' || y.letter ELSE x.letter END AS said FROM i JOIN letter x ON x.n = a JOIN letter y ON y.n = b),
    y AS (SELECT doc_id, year, year || string_agg(said, ', ' ORDER BY a) AS said FROM t GROUP BY doc_id, year)
    SELECT doc_id, '(Orr ' || string_agg(said, ', ' ORDER BY year) || ')' AS text FROM y GROUP BY doc_id"""
)
def clusters_by_letter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents of one author, so that letters go beyond z; all references but a few are cited together."""
    none = F.lit(None).cast("string")
    rows = colliding(spark, sf_dir).withColumn("author", F.array(F.struct(F.lit("Orr").alias("family"), F.lit("Ada").alias("given"), none.alias("literal"))))
    rows = rows.withColumn("ordinal", (20 * (C("doc_id") % 8) + C("ordinal")).cast("int")).withColumn("doc_id", F.floor(C("doc_id") / 8).cast("long"))
    return cite.clusters(cite.label_references(rows, "chicagoAD").filter("ordinal % 7 > 1"), "chicagoAD", ("doc_id",), "range")


def _mentions(bodies: DataFrame, kinds: tuple[str, ...] = ("author_year", "narrative")) -> DataFrame:
    """(doc_id, mention_id, names, et_al, year, letter) of all that the citations of bodies(doc_id, text) mean."""
    found = citations.citations(bodies, ("doc_id",), kinds=kinds)
    each = found.select("doc_id", F.explode(cite.mentions(C("citation"))).alias("m")).select("doc_id", "m.*")
    return each.withColumn("mention_id", F.monotonically_increasing_id())


def _listed(labelled: DataFrame) -> DataFrame:
    """References as a reader of the list knows them; the title stands for authors where there are none."""
    none = F.lit(None).cast("string")
    title = F.array(F.struct(none.alias("family"), none.alias("given"), C("title").alias("literal")))
    return labelled.select("doc_id", "ordinal", F.when(F.size("author") > 0, C("author")).otherwise(title).alias("author"), "year", "letter")


@query(f"SELECT doc_id, ordinal, style, 'ok' AS status, 1::BIGINT AS times FROM ({RECORDS_SQL}), (SELECT unnest({list(cite.CITE_STYLES)}) AS style)")
def clusters_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference is cited once, in clusters of three styles; reading them resolves to each reference once."""
    out = None
    for style, collapse in zip(cite.CITE_STYLES, ("year", "suffix", "range"), strict=True):
        labelled = cite.label_references(colliding(spark, sf_dir), style)
        resolved = cite.resolve(_mentions(_clustered(labelled, style, collapse, 5)), _listed(labelled), least=cite.CITE_STYLES[style].least)
        rows = cite.cross_check_names(resolved, _listed(labelled)).withColumn("style", F.lit(style))
        out = rows if out is None else out.unionByName(rows)
    return out


def _sentence(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(
    f"""WITH {labels_sql("apa")}, cited AS (SELECT *, ordinal <> 7 AS named, count(*) OVER (PARTITION BY doc_id, year, who) AS alike FROM labelled)
    SELECT doc_id, ordinal, 'names' AS kind, CASE WHEN named THEN 'ok' ELSE 'not cited' END AS status, (named::INT + (named AND letter_no IS NULL)::INT)::BIGINT AS times FROM cited
    UNION ALL SELECT doc_id, NULL, 'names', 'ambiguous', count(*) FROM cited WHERE named AND letter_no IS NOT NULL GROUP BY doc_id
    UNION ALL SELECT doc_id, NULL, 'names', 'not listed', 2 * count(*) FROM cited WHERE named GROUP BY doc_id
    UNION ALL SELECT doc_id, coalesce(c.n, r.n), 'numbers', CASE WHEN r.n IS NULL THEN 'not listed' WHEN c.n IS NULL THEN 'not cited' ELSE 'ok' END, (c.n IS NOT NULL)::BIGINT
    FROM (SELECT doc_id, ordinal + 1 AS n FROM cited) c FULL JOIN (SELECT doc_id, ordinal + 2 AS n FROM cited) r USING (doc_id, n)"""
)
def cross_check_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cites by numbers and by names: with its label, without its letter, and with two years that aren't listed. The list lacks the first number,
    and one reference is never named."""
    labelled = cite.label_references(colliding(spark, sf_dir), "apa")
    named = _sentence("Shown before (see ", C("who"), ", ", C("year").cast("string"), F.coalesce("letter", F.lit("")), ") and (", C("who"), ", ", C("year").cast("string"), ") but not (", C("who"), ", 1950, 1951b).")
    text = F.concat_ws(" ", F.when(C("ordinal") != 7, named), _sentence("Counted [", (C("ordinal") + 1).cast("string"), "]."))
    bodies = labelled.select("doc_id", "ordinal", text.alias("text")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ").alias("text"))
    bodies = bodies.repartition("doc_id")  # one exchange, read for names and for numbers
    resolved = cite.resolve(_mentions(bodies), _listed(labelled), least=cite.CITE_STYLES["apa"].least)
    names = cite.cross_check_names(resolved, _listed(labelled)).select("doc_id", "ordinal", F.lit("names").alias("kind"), "status", "times")
    found = citations.citations(bodies, ("doc_id",), kinds=("bracket",)).select("doc_id", F.explode(citations.cited_numbers(C("citation"))).alias("number"))
    numbers = citations.cross_check(found, labelled.select("doc_id", (C("ordinal") + 2).alias("number")), ["doc_id", "number"])
    return names.union(numbers.select("doc_id", C("number").alias("ordinal"), F.lit("numbers").alias("kind"), "status", "times"))


@query(f"SELECT doc_id, id % 40 + 1970 AS year, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY ALL UNION ALL SELECT doc_id, id % 40 + 2011 AS year, count(*) FROM ({RECORDS_SQL}) GROUP BY ALL".replace("SELECT doc_id", "SELECT CAST(doc_id % 50 AS INTEGER) AS grp"))
def years_of_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrative citations of two years each, counted by year in fifty groups of documents."""
    year = C("id") % 40 + 1970
    body = _sentence("As ", C("author")[0]["family"], " et al. (", year.cast("string"), "a, ", (year + 41).cast("string"), ") show, it holds.")
    bodies = records(spark, sf_dir).select((C("doc_id") % 50).cast("int").alias("doc_id"), body.alias("text"))
    return _mentions(bodies, ("narrative",)).groupBy(C("doc_id").alias("grp"), C("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH c AS (SELECT CASE WHEN l_linenumber % 3 = 1 THEN 1 WHEN l_linenumber = 6 THEN NULL ELSE l_orderkey + l_linenumber % 2 END AS ref, l_linenumber FROM lineitem)
    SELECT c.ref, any_value(r.title) AS title, any_value(r.year) AS year, count(*) AS times FROM c LEFT JOIN ({RECORDS_SQL}) r ON r.id = c.ref GROUP BY c.ref"""
)
def cited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys cited by the rows of lineitem, one of them in a third of all, looked up in the records without a broadcast of the index."""
    line = C("l_linenumber")
    key = F.when(line % 3 == 1, F.lit(1)).when(line != 6, C("l_orderkey") + line % 2).cast("long")
    cited = table(spark, sf_dir, "lineitem").select(key.alias("ref"), "l_linenumber")
    items = records(spark, sf_dir).select("id", "title", "year")
    found = lookup.by_key(cited, items, small=0)
    return found.groupBy("ref").agg(F.first("title").alias("title"), F.first("year").alias("year"), F.count(F.lit(1)).alias("times"))
