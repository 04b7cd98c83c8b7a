"""Schema checks of JSON documents held as VARIANT: the place and message of everything that doesn't fit.

A schema is a small tree of Text, Number, Object, Items and Model. It is walked once, when the plan is made, and gives one expression
that opens the document level by level, so that a document is checked in its row, in the order of its fields.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "array<struct<place: string, message: string>>"
NUMBER = r"^\s*[+-]?(?:(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?\s*$|(?i)^\s*[+-]?(?:inf|infinity|nan)\s*$"


@dataclass
class Text:
    nullable: bool = False


@dataclass
class Number:
    least: float | None = None
    most: float | None = None


@dataclass
class Object:
    """An object with any fields."""


@dataclass
class Items:
    of: object


@dataclass
class Model:
    name: str
    fields: dict[str, object]
    optional: list[str] = field(default_factory=list)


def none() -> Column:
    return F.array().cast(ERROR)


def error(place: Column, message: Column | str) -> Column:
    return F.array(F.struct(place.alias("place"), (F.lit(message) if isinstance(message, str) else message).alias("message"))).cast(ERROR)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def violations(value: Column, schema, place: Column | None = None) -> Column:
    """An array of (place, message) for a VARIANT; places are dotted, without one for the document itself. Messages are fixed wording."""
    kind = F.schema_of_variant(value)  # null if there is no value, VOID for a JSON null
    here = F.lit("") if place is None else place
    inside = lambda name: F.concat(here, F.lit("" if place is None else "."), name)
    if isinstance(schema, Text):
        fits = (kind == "STRING") | (kind == "VOID") if schema.nullable else kind == "STRING"
        return F.when(fits, none()).otherwise(error(here, "Input should be a valid string"))
    if isinstance(schema, Object):
        return F.when(F.startswith(kind, F.lit("OBJECT")), none()).otherwise(error(here, "Input should be a valid dictionary"))
    if isinstance(schema, Number):
        text = value.cast("string")
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | F.startswith(kind, F.lit("DECIMAL"))
        parsed = F.when(kind == "BOOLEAN", value.cast("boolean").cast("double")).otherwise(F.regexp_replace(F.trim(text), "_", "").try_cast("double"))
        found = F.when(~numeric & (kind == "STRING") & ~text.rlike(NUMBER), error(here, "Input should be a valid number, unable to parse string as a number"))
        found = found.when(~numeric & (kind != "STRING"), error(here, "Input should be a valid number"))
        if schema.most is not None:
            found = found.when((parsed > schema.most) & ~F.isnan(parsed), error(here, f"Input should be less than or equal to {schema.most:g}"))
        if schema.least is not None:
            found = found.when(parsed < schema.least, error(here, f"Input should be greater than or equal to {schema.least:g}"))
        return found.otherwise(none())
    if isinstance(schema, Items):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: violations(v, schema.of, inside(i.cast("string"))))
        return F.when(F.startswith(kind, F.lit("ARRAY")), F.flatten(each)).otherwise(error(here, "Input should be a valid list"))
    parts = []
    for name, kept in schema.fields.items():
        found = F.try_variant_get(value, f"$.{name}", "variant")
        missing = none() if name in schema.optional else error(inside(F.lit(name)), "Field required")
        parts.append(once(found, lambda v: F.when(F.schema_of_variant(v).isNull(), missing).otherwise(violations(v, kept, inside(F.lit(name))))))
    return F.when(F.startswith(kind, F.lit("OBJECT")), F.concat(*parts)).otherwise(error(here, f"Input should be a valid dictionary or instance of {schema.name}"))
