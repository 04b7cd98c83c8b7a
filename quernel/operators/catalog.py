"""Ontology tables as a catalog: lookups, membership joins, storage names, extraction context.

``classes``: name, technical_name, definition, parents, rules; ``properties``: kind ('edge' or 'property'), name,
technical_name, definition, domain, range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.text import is_identifier, upper_snake

ITEM = "name: string, technicalName: string, localName: string, iri: string, label: string, definition: string"
RULE = "array<struct<property: string, operator: string, value: string, qualifier: string>>"
CLASSES = f"array<struct<{ITEM}, parents: array<string>, rules: {RULE}>>"
PROPERTIES = f"array<struct<kind: string, {ITEM}, domain: array<string>, range: array<string>>>"
SCHEMA = f"file string, sourceDir string, ontologyBase string, imports array<string>, sourceFiles array<string>, classes {CLASSES}, edges {PROPERTIES}, attributes {PROPERTIES}"


def read_ontologies(spark: SparkSession, path: str, generated: bool | None = False) -> DataFrame:
    """Ontology JSON documents below a path, one row for each file. ``generated``: whether to take merged files (all_*, all)."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.ontology.json").json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    name = F.substring_index("path", "/", -1)
    merged = F.startswith(name, F.lit("all_")) | (name == "all.ontology.json")
    return rows if generated is None else rows.filter(merged if generated else ~merged)


def explode_items(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class rows and property rows of ontology documents, with their file and position."""
    classes = documents.select("path", F.posexplode("classes").alias("pos", "c")).select("path", "pos", "c.*").withColumnRenamed("technicalName", "technical_name").withColumnRenamed("localName", "local_name")
    both = documents.select("path", F.posexplode(F.concat(F.coalesce("edges", F.array()), F.coalesce("attributes", F.array()))).alias("pos", "p")).select("path", "pos", "p.*")
    return classes, both.withColumnRenamed("technicalName", "technical_name").withColumnRenamed("localName", "local_name")


def properties_of_classes(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, kind, technical_name): what each class may have, its name being in the property's domain."""
    spread = properties.select("kind", F.col("technical_name").alias("property"), F.explode("domain").alias("name"))
    return classes.select("name", F.col("technical_name").alias("class")).join(spread, "name").select("class", "kind", "property").distinct()


def exists(terms: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """``terms`` (term) with is_class, is_attribute and is_edge."""
    known = classes.select(F.col("technical_name").alias("term"), F.lit("class").alias("kind")).union(properties.select("technical_name", "kind")).distinct()
    found = known.groupBy("term").agg(F.collect_set("kind").alias("kinds"))
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    return terms.join(found, "term", "left").select(
        *terms.columns, F.array_contains(kinds, "class").alias("is_class"), F.array_contains(kinds, "property").alias("is_attribute"), F.array_contains(kinds, "edge").alias("is_edge")
    )


def storage_names(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(kind, technical_name, stored, error): the local part as label or key, edges in upper snake case; unsafe names are errors."""
    local = F.substring_index("technical_name", ":", -1)
    rows = classes.select(F.lit("class").alias("kind"), "technical_name").union(properties.select("kind", "technical_name"))
    stored = F.when(F.col("kind") == "edge", upper_snake(local)).otherwise(local)
    return rows.select("kind", "technical_name", stored.alias("stored")).withColumn("error", F.when(~is_identifier(F.col("stored")), F.concat(F.lit("Unsafe identifier: "), "stored")))


def shown(value: Column) -> Column:
    """A string in quotes: single ones unless it holds these alone."""
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def shown_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), shown), ", "), F.lit("]"))


def class_context(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, context): a block of text for each class with its properties, outgoing edges and rules, for extraction.

    Properties and edges stand in the order of ``pos`` if ``properties`` have it, else of their names. Blocks of an ontology
    are joined by a line feed, each ending with one; they stay rows here.
    """
    none = lambda c: F.coalesce(c, F.lit("None"))
    place = F.struct("path", "pos", "technical_name") if {"path", "pos"} <= set(properties.columns) else F.struct("pos", "technical_name") if "pos" in properties.columns else F.struct("technical_name")
    is_edge = F.col("kind") == "edge"
    line = F.concat(F.lit("  - "), "technical_name", F.when(is_edge, F.concat(F.lit(" | domain="), shown_list(F.col("domain")))).otherwise(""), F.lit(" | range="), shown_list(F.col("range")))
    spread = properties.select("kind", place.alias("place"), line.alias("line"), F.explode(F.array_distinct("domain")).alias("name"))
    linked = classes.select("name", F.col("technical_name").alias("class")).distinct().join(spread, "name")
    ordered = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "line")))).getField("line")
    linked = linked.groupBy("class").agg(ordered("property").alias("attribute_lines"), ordered("edge").alias("edge_lines"))
    rule_lines = F.transform("rules", lambda r: F.concat(F.lit("  - "), none(r.property), F.lit(" | operator="), none(r.operator), F.lit(" | value="), none(r.value), F.lit(" | qualifier="), none(r.qualifier)))
    part = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines)).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("CLASS: "), "class"), F.concat(F.lit("NAME: "), none(F.col("name"))), F.concat(F.lit("DEFINITION: "), none(F.col("definition"))))
    rows = classes.select(F.col("technical_name").alias("class"), "name", "definition", rule_lines.alias("rule_lines")).join(linked, "class", "left")
    lines = F.concat(head, part("PROPERTIES:", F.col("attribute_lines")), part("OUTGOING EDGES:", F.col("edge_lines")), part("RULES:", F.col("rule_lines")), F.array(F.lit("")))
    return rows.select("class", F.array_join(lines, "\n").alias("context"))
