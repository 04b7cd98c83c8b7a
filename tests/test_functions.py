import datetime

import pytest
from pyspark.sql import functions as F

from quernel.functions import text as T
from quernel.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("  Phạm  Hùng ", "pham hung"), ("ĐƯỜNG Láng", "duong lang"), ("Straße", "strasse"), ("", ""), (None, None)])
def test_normalize_text(spark, text, want):
    assert one(spark, T.normalize_text(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("needle, hay, want", [("", "a", 0.0), ("a b", "a b", 1.0), ("a b", "x a b y", 0.92), ("a b", "b c", 0.45), ("zz", "ab", 0.0)])
def test_similarity(spark, needle, hay, want):
    assert one(spark, T.similarity(F.lit(needle), F.lit(hay))) == want


@pytest.mark.parametrize("name, want", [("hasOffer", "HAS_OFFER"), ("Offer", "OFFER"), ("aBC", "A_B_C")])
def test_upper_snake(spark, name, want):
    assert one(spark, T.upper_snake(F.lit(name))) == want


@pytest.mark.parametrize("iri, want", [("http://e/x#A/", "A"), ("http://e/x/Y", "Y"), ("http://e/x/Y#", "Y")])
def test_local_name(spark, iri, want):
    assert one(spark, T.local_name(F.lit(iri))) == want


def test_humanize(spark):
    assert one(spark, T.humanize(F.lit("LoanSpecific_account-Type"))) == "loan specific account type"


@pytest.mark.parametrize("text, want", [("PT30M", 30), ("P1DT2H3M", 1563), ("PT", 0), ("P1D", None), ("PT5S", None), ("P1W", None), ("30M", None)])
def test_duration(spark, text, want):
    assert one(spark, V.duration_minutes(F.lit(text))) == want


def _is_date(text):
    try:
        datetime.date.fromisoformat(text)
        return True
    except ValueError:
        return False


DATES = ["2026-08-01", "20260801", "2026-W31-6", "2026W316", "2026-W31", "2026-W53-1", "2020-W53-1", "2026", "2026-08", "2026-8-1", "2026-02-30", "10:00", "2026-08-01x", "", "2024-02-29"]


@pytest.mark.parametrize("text", DATES)
def test_iso_date(spark, text):
    assert one(spark, V.is_iso_date(F.lit(text))) == _is_date(text)


@pytest.mark.parametrize("text, want", [("2026-08-01", True), ("2026-08-01T10:00:00", True), ("2026-08-01 10:00", True), ("2026-08-01T25:00", False), ("2026-08-01T10:00:00Z", True), ("2026-08-01T10:00:00+07:00", True), ("10:00", False)])
def test_iso_datetime(spark, text, want):
    assert one(spark, V.is_iso_datetime(F.lit(text))) is want


@pytest.mark.parametrize("doc, rng, want", [("true", "xsd:integer", False), ("1", "xsd:decimal", True), ("1.5", "xsd:integer", False), ("null", "xsd:date", True), ('"a"', "xsd:string", True), ("true", "xsd:boolean", True), ("3", "xsd:nonNegativeInteger", False), ('"2026-08-01"', "xsd:date", True)])
def test_fits_range(spark, doc, rng, want):
    v = F.parse_json(F.lit(doc))
    assert one(spark, V.fits_range(v.cast("string"), F.schema_of_variant(v), F.lit(rng))) is want


def test_arithmetic(spark):
    assert one(spark, V.arithmetic("2 ** 3 + -(4 - 1) * 2 / 4")) == 6.5
    assert one(spark, V.arithmetic("1 / 0")) is None
    assert one(spark, V.arithmetic("(-8) ** (1/3)")) is None
    with pytest.raises(ValueError):
        V.arithmetic("__import__('os')")


@pytest.mark.parametrize("text, codes, rest", [("/a /b hello /c", ["a", "b"], "hello /c"), ("hello", [], "hello"), ("/a", ["a"], "")])
def test_skill_codes(spark, text, codes, rest):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(T.skill_codes(F.lit(text)), "ab")]).first()
    assert (row["a"], row["b"]) == (codes, rest)


@pytest.mark.parametrize("template", ["$a and $$a ${b} $ab", "", "no marks", "$a", "$a$b$$", "${a}x${b}y", "$", "$1 ${ } $-", "$$$a", "${ab}$a_b", "$A $é${é}", "$a\n$b\\$a"])
def test_templates_are_rendered_in_one_pass(spark, template):
    from string import Template

    values = {"a": "$b", "b": "B$$\\1", "a_b": "${a}"}
    row = spark.createDataFrame([(template, *values.values())], ["t", *values])
    columns = {k: F.col(k) for k in values}
    assert row.select(T.render_template(F.col("t"), columns)).first()[0] == Template(template).safe_substitute(values)
    try:
        expected = Template(template).substitute(values)
    except (KeyError, ValueError):
        with pytest.raises(Exception, match="template"):
            row.select(T.render_template(F.col("t"), columns, strict=True)).collect()
    else:
        assert row.select(T.render_template(F.col("t"), columns, strict=True)).first()[0] == expected


def test_texts_are_folded_one_by_one():
    """Only one text is in words at a time."""
    import tracemalloc

    import pandas as pd

    from quernel.functions import text

    values = pd.Series(["Ünd đa  x " * 200, None] * 2000, dtype=object)
    tracemalloc.start()
    found = text.folded(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == " ".join(["und da x"] * 200) and found[1] is None
    assert peak < 3 * found.str.len().sum()
