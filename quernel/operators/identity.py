"""Identities of graph nodes: a natural key where the class has one, else a hash of content within its source."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernel.functions.text import normalize_identity

NATURAL_KEYS = {  # fixed values: class and its identifying property
    "pskg:BankingProduct": "pskg:productCode", "pskg:ProductCategory": "pskg:categoryCode", "pskg:CustomerSegment": "pskg:segmentCode",
    "pskg:CustomerNeed": "pskg:needCode", "pskg:ProductBundle": "pskg:bundleCode", "pskg:ApprovalTask": "pskg:approvalTaskId", "pskg:Customer": "pskg:customerIdentifier",
}


LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"(:?)')  # a string of compact JSON; a key is followed by a colon


def _plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def _normal_literal(found: re.Match) -> str:
    return found[0] if found[1] else json.dumps(_plain(json.loads(found[0])), ensure_ascii=False)


def _compact(document: str) -> str:
    """JSON with sorted keys and without white space, the strings among its values normalised."""
    return LITERAL.sub(_normal_literal, json.dumps(json.loads(document), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


@F.pandas_udf(StringType())
def canonical_json(documents: pd.Series) -> pd.Series:
    return documents.map(_compact, na_action="ignore")


def _value_text(document: str, key: str) -> str | None:
    value = json.loads(document).get(key)
    return None if value is None else str(value)


@F.pandas_udf(StringType())
def value_text(documents: pd.Series, keys: pd.Series) -> pd.Series:
    """The value of a top-level key as text: a number as it is written in its shortest form, True and False; null if there is none."""
    return pd.Series([None if d is None or k is None else _value_text(d, k) for d, k in zip(documents, keys)], dtype=object)


def source_scoped_key(source: Column, class_name: Column, properties: Column) -> Column:
    """SHA-256 of the compact JSON of class, properties (JSON text) and source, in this order of keys; null if any is null."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = F.concat(F.lit('{"class":'), quoted(class_name), F.lit(',"properties":'), canonical_json(properties), F.lit(',"source":'), quoted(normalize_identity(source)), F.lit("}"))
    return F.sha2(text, 256)


def source_scope(evidence: Column) -> Column:
    """Distinct stripped sources of evidence structs, sorted and joined by |; null if there are none."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(evidence, lambda e: F.trim(e["source"])), lambda s: s.isNotNull() & (s != ""))))
    return F.nullif(F.array_join(names, "|"), F.lit(""))


def resolve(nodes: DataFrame, natural_keys: dict[str, str] = NATURAL_KEYS, classes: DataFrame | None = None) -> DataFrame:
    """``nodes`` (class_name, properties VARIANT, source_scope, ...) with strategy, key_name, key_value and reason.

    Where ``nodes`` have ``properties_json``, the JSON text of the properties, identities are made of it: a VARIANT doesn't tell 1.0 from 1.

    natural_key, or source_scoped for classes without one; unresolved without a source; error if the class is not among
    ``classes`` (technical_name), or the natural key is missing or empty.
    """
    keys = F.create_map(*[F.lit(x) for pair in natural_keys.items() for x in pair])[F.col("class_name")]
    as_json = F.col("properties_json") if "properties_json" in nodes.columns else F.to_json("properties")
    given = value_text(F.when(keys.isNotNull(), as_json), keys)
    rows = nodes.withColumn("key_name", keys).withColumn("given", given).withColumn("natural", normalize_identity("given"))
    if classes is None:
        rows = rows.withColumn("is_known", F.lit(True))
    else:
        known = classes.select(F.col("technical_name").alias("class_name"), F.lit(True).alias("is_known")).distinct()
        rows = rows.join(known, "class_name", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    scoped = source_scoped_key(F.col("source_scope"), F.col("class_name"), F.when(keys.isNull(), as_json))
    has_natural = F.col("key_name").isNotNull()
    name, class_name = F.col("key_name"), F.col("class_name")
    reason = (  # fixed wording
        F.when(~F.col("is_known"), F.concat(F.lit("Unknown ontology class: "), class_name))
        .when(has_natural & F.col("given").isNull(), F.concat(F.lit("Missing identity property "), name, F.lit(" for class "), class_name))
        .when(has_natural & (F.col("natural") == ""), F.concat(F.lit("Identity property "), name, F.lit(" is empty for class "), class_name))
        .when(~has_natural & (F.coalesce("source_scope", F.lit("")) == ""), F.concat(F.lit("No natural identity policy and no source scope available for class "), class_name))
    )
    strategy = F.when(F.col("reason").isNull(), F.when(has_natural, "natural_key").otherwise("source_scoped")).when(
        F.col("is_known") & ~has_natural, "unresolved"
    ).otherwise("error")
    rows = rows.withColumn("reason", reason).withColumn("strategy", strategy)
    value = F.when(F.col("strategy") == "natural_key", F.col("natural")).when(F.col("strategy") == "source_scoped", scoped)
    return rows.withColumn("key_value", value).withColumn(
        "key_name", F.when(F.col("strategy") == "source_scoped", F.lit("_ingestionKey")).when(F.col("strategy") != "unresolved", name)
    ).drop("natural", "given", "is_known")


def policy_violations(classes: DataFrame, properties: DataFrame, natural_keys: dict[str, str] = NATURAL_KEYS) -> DataFrame:
    """Natural keys that the ontology doesn't have, one message each."""
    spark = classes.sparkSession
    policy = spark.createDataFrame(list(natural_keys.items()), "class_name string, property string")
    known = classes.select(F.col("technical_name").alias("class_name"), F.col("name").alias("label"))
    attributes = properties.filter("kind = 'property'").select(F.col("technical_name").alias("property"), "domain")
    rows = policy.join(known, "class_name", "left").join(attributes, "property", "left")
    message = (
        F.when(F.col("label").isNull(), F.concat(F.lit("Identity policy references unknown class: "), "class_name"))
        .when(F.col("domain").isNull(), F.concat(F.lit("Identity policy references unknown property: "), "property"))
        .when(~F.array_contains("domain", F.col("label")), F.concat(F.lit("Identity property "), "property", F.lit(" does not belong to class "), "class_name"))
    )
    return rows.select(message.alias("message")).filter("message IS NOT NULL")
