"""Python functions of the library under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quernel.functions import text
from quernel.operators import identity


def register(spark: SparkSession) -> list[str]:
    """Register the Arrow functions for use in SQL, and source_scoped_key on top of them; returns their names."""
    functions = {"normalize_text": text.normalize_text, "normalize_identity": text.normalize_identity, "sequence_ratio": text.sequence_ratio, "canonical_json": identity.canonical_json}
    for name, function in functions.items():
        spark.udf.register(name, function)
    quoted = lambda c: f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"
    parts = f"""'{{"class":', {quoted("class_name")}, ',"properties":', canonical_json(properties), ',"source":', {quoted("normalize_identity(source)")}, '}}'"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION source_scoped_key(source STRING, class_name STRING, properties STRING) RETURNS STRING RETURN sha2(concat({parts}), 256)")
    return sorted([*functions, "source_scoped_key"])
