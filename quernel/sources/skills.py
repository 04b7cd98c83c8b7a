"""Skill files with front matter as a catalog, and the catalog as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_skills(spark: SparkSession, path: str, glob: str = "SKILL.md") -> DataFrame:
    """(code, name, description, path): the folder's name and two fields of the front matter; files without one are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    front = F.regexp_extract("value", r"(?s)\A﻿?---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1), "^[\"']|[\"']\\s*$", "")), F.lit(""))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("code"), field("name").alias("name"), field("description").alias("description"), "path").filter("name IS NOT NULL")


def catalog_text(skills: DataFrame) -> DataFrame:
    """One row: the catalog as a list of codes, names and descriptions in the order of codes."""
    line = F.concat(F.lit("- /"), "code", F.lit(" ("), "name", F.lit("): "), F.coalesce("description", F.lit("")))
    return skills.agg(F.array_join(F.array_sort(F.collect_list(F.struct("code", line.alias("line")))).getField("line"), "\n").alias("catalog"))
