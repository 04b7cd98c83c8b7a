"""Ordered deduplication and roll-ups along folder paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity_key(*columns: str) -> Column:
    """(which column, value) of the first non-empty column; null if all are empty."""
    return F.coalesce(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(F.lit(i).alias("which"), F.col(c).cast("string").alias("value"))) for i, c in enumerate(columns)])


def first_per_key(rows: DataFrame, keys: list, order: list, key: Column) -> DataFrame:
    """The first row in ``order`` for each ``keys`` and ``key``; rows without a key all stay."""
    rows = rows.withColumn("__key", key)
    keyed = rows.filter("__key IS NOT NULL").withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__key").orderBy(*order)))
    return keyed.filter("__n = 1").drop("__n", "__key").unionByName(rows.filter("__key IS NULL").drop("__key"))


def ancestors(path: Column) -> Column:
    """All folders of a slash path, the root '' first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def merge_folders(items: DataFrame) -> DataFrame:
    """Merge ontology items (folder, file, kind, pos, iri, technical_name, name, ...) into every folder above them, in one job:
    each item goes to all its ancestors, where the first per (kind, key) in order of depth, file and position stays."""
    spread = items.withColumn("into", F.explode(ancestors(F.col("folder")))).withColumn("own", (F.col("into") != F.col("folder")).cast("int"))
    return first_per_key(spread, ["into", "kind"], ["own", "file", "pos"], identity_key("iri", "technical_name", "name"))


def merged_summary(merged: DataFrame, items: DataFrame) -> DataFrame:
    """(into, source_files, and counts of classes, edges and attributes) of merged folders."""
    files = items.withColumn("into", F.explode(ancestors(F.col("folder")))).groupBy("into").agg(F.countDistinct("folder", "file").alias("source_files"))
    kinds = merged.groupBy("into").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("class", "classes"), ("edge", "edges"), ("property", "attributes"))])
    return files.join(kinds, "into", "left")


def last_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key, at the place of its first."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, order).alias("row"), F.min(order).alias("place")).select("row.*", "place")
