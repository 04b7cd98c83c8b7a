"""Value checks and arithmetic on columns."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION = r"\AP(?:(\d+)D)?T(?:(\d+)H)?(?:(\d+)M)?\z"  # fixed values: the T is needed; no seconds or weeks
ISO_DATE = r"\A(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(-?\d)?)\z"
ISO_TIME = r"(\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,})?)?)?)(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?"


def duration_minutes(text: Column) -> Column:
    """Minutes of an ISO duration of days, hours and minutes; null if it is none."""
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, DURATION, i), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    return F.when(text.rlike(DURATION), part(1) * 1440 + part(2) * 60 + part(3))


def is_iso_date(text: Column) -> Column:
    """Whether a string is a calendar or week date in ISO form."""
    plain = F.regexp_replace(text, "-", "")
    week = F.regexp_extract(plain, r"\A\d{4}W(\d{2})", 1).cast("int")
    day = F.coalesce(F.nullif(F.regexp_extract(plain, r"W\d{2}(\d)\z", 1), F.lit("")), F.lit("1")).cast("int")
    # a year has 53 weeks if it starts or ends on a Thursday
    year = F.substring(plain, 1, 4)
    thursday = lambda day_: F.dayofweek(F.try_to_date(F.concat(year, F.lit(day_)))) == 5
    long_year = thursday("-01-01") | thursday("-12-31")
    calendar = F.try_to_date(plain, "yyyyMMdd").isNotNull()
    weekly = (week >= 1) & (day >= 1) & (day <= 7) & ((week <= 52) | ((week == 53) & long_year))
    return F.coalesce(text.rlike(ISO_DATE) & F.when(F.contains(text, F.lit("W")), weekly).otherwise(calendar), F.lit(False))


def is_iso_datetime(text: Column) -> Column:
    """A date, or a date and a time after one separating character."""
    date = F.regexp_extract(text, r"\A(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}-?\d)", 1)
    rest = F.substring(text, F.length(date) + 1, F.length(text))
    hour = F.try_to_number(F.nullif(F.regexp_extract(rest, r"\A.(\d{2})", 1), F.lit("")), F.lit("99"))
    minute = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(rest, r"\A.\d{2}:?(\d{2})", 1), F.lit("")), F.lit("99")), F.lit(0))
    second = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(rest, r"\A.\d{2}:?\d{2}:?(\d{2})", 1), F.lit("")), F.lit("99")), F.lit(0))
    timed = rest.rlike(rf"\A.{ISO_TIME}\z") & (hour <= 23) & (minute <= 59) & (second <= 59)
    return F.coalesce(is_iso_date(text) | (is_iso_date(date) & timed), F.lit(False))


def fits_range(value: Column, kind: Column, rng: Column) -> Column:
    """Whether a scalar of a VARIANT fits an XSD range. ``value``: its text, ``kind``: its variant type. Null fits everything;
    a boolean is no number; a range that is not listed fits nothing."""
    kind = F.upper(kind)
    integer = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "LONG")
    number = integer | kind.isin("DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    string = kind == "STRING"
    return (
        F.when(kind == "VOID", F.lit(True))
        .when(rng.isin("xsd:string", "xsd:anyURI"), string)
        .when(rng == "xsd:integer", integer)
        .when(rng == "xsd:decimal", number)
        .when(rng == "xsd:boolean", kind == "BOOLEAN")
        .when(rng == "xsd:date", string & is_iso_date(value))
        .when(rng == "xsd:dateTime", string & is_iso_datetime(value))
        .otherwise(F.lit(False))
    )


OPERATORS = {  # fixed values
    "add": "+", "subtract": "-", "multiply": "*", "divide": "/", "power": "**",
}


def binary_result(left: Column, operator: Column, right: Column) -> Column:
    """Apply an operator column; null for an unknown operator or a division by zero."""
    left, right = left.cast("double"), right.cast("double")
    return (
        F.when(operator.isin("add", "+"), left + right)
        .when(operator.isin("subtract", "-"), left - right)
        .when(operator.isin("multiply", "*"), left * right)
        .when(operator.isin("divide", "/"), F.try_divide(left, right))
        .when(operator.isin("power", "**"), F.pow(left, right))
    )


def binary_expression(left: Column, operator: Column, right: Column) -> Column:
    """The expression as text; null for an unknown operator."""
    sign = F.coalesce(*[F.when(operator.isin(name, sign), F.lit(sign)) for name, sign in OPERATORS.items()])
    return F.when(sign.isNotNull(), F.concat_ws(" ", left.cast("string"), sign, right.cast("string")))


def arithmetic(expression: str, columns: dict[str, Column] | None = None) -> Column:
    """A column from + - * / ** and parentheses over numbers and named columns; anything else is refused.

    A division by zero is null, as is the root of a negative number.
    """
    signs = {
        ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
        ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), ast.Pow: F.pow,
    }
    columns = columns or {}

    def column(node) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in signs:
            return signs[type(node.op)](column(node.left), column(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            inner = column(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        raise ValueError(f"unsupported expression: {ast.dump(node)[:80]}")

    result = column(ast.parse(expression.strip(), mode="eval").body)
    return F.when(~F.isnan(result.cast("double")), result)
