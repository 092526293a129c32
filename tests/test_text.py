from pyspark.sql import functions as F

from scriptorium.functions import identifiers, names, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_fold(spark):
    odd = "ﬁ ﬀ ‘a’ “b” «c» d e f­g h‐i j–k…"
    assert one(spark, text.fold_text(F.col("s")), s=odd) == "fi ff 'a' \"b\" \"c\" d e fg h-i j–k..."


def test_wrapped_lines(spark):
    cases = [
        (["a hy-", "phen word"], "a hyphen word"),
        (["Reyes-", "García wrote"], "Reyes-García wrote"),
        (["doi 10.1000/ab-", "cd-", "ef next"], "doi 10.1000/ab-cd-ef next"),
        (["see https://", "example.org/x and"], "see https://example.org/x and"),
        (["one", "two", "three"], "one two three"),
        (["range 3-", "4"], "range 3- 4"),
        ([], ""),
    ]
    for lines, want in cases:
        lines_col = F.array(*map(F.lit, lines)).cast("array<string>")
        assert one(spark, text.join_wrapped_lines(lines_col)) == want


def test_fuzzy(spark):
    assert one(spark, text.fuzzy_norm(F.col("s")), s=" Éa—Ñ b! Łó ") == "ea n b o"
    assert one(spark, text.fuzzy_norm(F.col("s"), False), s="De La Cruz-É") == "delacruze"


def test_entities(spark):
    assert one(spark, text.decode_entities(F.col("s")), s="a &amp;lt; &lt;b&gt; &#233;&#x20AC;") == "a &lt; <b> é€"


def test_identifiers(spark):
    s = "T. 10. 1000/x.1). https://arxiv.org/abs/2001.01234v2, 978-3-16-148410-0."
    x = one(spark, identifiers.extract_identifiers(F.col("s")), s=s)
    assert (x.doi, x.url, x.arxiv, x.isbn) == ("10.1000/x.1", "https://arxiv.org/abs/2001.01234v2", "2001.01234", "978-3-16-148410-0")
    x = one(spark, identifiers.extract_identifiers(F.col("s")), s="https://doi.org/10.1000/a_b")
    assert (x.doi, x.url) == ("10.1000/a_b", None)


def test_years(spark):
    for s, want in [("1990-1995, 12005, (2003)", 2003), ("no year", None), ("1999; 2001.", 1999), ("a 2007", 2007), ("2001–02", 2001)]:
        found = one(spark, identifiers.find_year(F.col("s")), s=s)
        assert (found and found.year) == want


def people(spark, style, block):
    found = one(spark, names.people(f"'{style}'", "b"), b=block)
    return [(a.family, a.given) if a.literal is None else a.literal for a in found]


def test_people(spark):
    assert people(spark, "apa", "Silva, J. P., Park, J.-H., & Ng, P. L.") == [("Silva", "J. P"), ("Park", "J.-H"), ("Ng", "P. L")]
    assert people(spark, "apa", "World Health Organization.") == ["World Health Organization"]
    assert people(spark, "harvard", "Fernandez, R.M. and Silva, J.P. et al.") == [("Fernandez", "R.M."), ("Silva", "J.P")]
    assert people(spark, "chicagoAD", "Ashworth, Priya, Finn Lindgren, and Ana de Sousa") == [("Ashworth", "Priya"), ("Lindgren", "Finn"), ("Sousa", "Ana de")]
    assert people(spark, "mla", "Kaminski, Yara, et al.") == [("Kaminski", "Yara")]
    assert people(spark, "vancouver", "Hartwell DC, Ng PL") == [("Hartwell", "DC"), ("Ng", "PL")]
    assert people(spark, "nature", "Hartwell, D. C., Park, J.-H. & Ng, P. L.") == [("Hartwell", "D. C."), ("Park", "J.-H."), ("Ng", "P. L.")]
    assert people(spark, "ieee", "D. C. Hartwell, E. Moe, and P. L. Ng") == [("Hartwell", "D. C."), ("Moe", "E."), ("Ng", "P. L.")]
    assert people(spark, "acs", "Hartwell, D. C.; Ng, P. L.") == [("Hartwell", "D. C."), ("Ng", "P. L.")]
    assert people(spark, "acm", "Ada Mae Moss, Bo Ek Jr., and NASA") == [("Moss", "Ada Mae"), ("Ek Jr", "Bo"), "NASA"]


def test_trims_any_white_space(spark):
    for c in text.WHITE:
        got = spark.createDataFrame([(c + c + "a" + c + "b" + c,)], ["s"]).select(text.trim_all(F.col("s")).alias("t"), text.trim_right(F.col("s")).alias("r"), F.regexp_replace("s", r"(?U)^\s+|\s+\z", "").alias("w")).first()
        assert got.t == got.w == "a" + c + "b" and got.r == c + c + "a" + c + "b"
    assert one(spark, text.trim_all(F.col("s")), s=" ​ ") == "​"
