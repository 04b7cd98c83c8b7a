"""Ontology tables as nested JSON documents: one for each file, and one for each folder of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.text import folder_file_name
from quernel.operators.merge import ancestors, first_per_key, identity_key, merge_folders
from quernel.session import materialize
from quernel.sources import rdf
from quernel.sources.json_files import field_rows, write_files

CLASS = ["name", "technicalName", "localName", "iri", "label", "definition", "parents", "rules"]
PROPERTY = ["kind", "name", "technicalName", "localName", "iri", "label", "definition", "domain", "range"]


def output_path(file: Column, input_dir: str, output_dir: str) -> Column:
    """The path of a file's export: the same folders below the output folder, with the suffix .ontology.json."""
    inside = F.regexp_replace(F.regexp_replace(file, r"^file:(//)?", ""), r"\.[^./]*$", "")
    return F.concat(F.lit(output_dir.rstrip("/")), F.substring(inside, F.lit(len(input_dir.rstrip("/")) + 1), F.length(inside)), F.lit(".ontology.json"))


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"technical_name": "technicalName", "local_name": "localName"})


def _listed(rows: DataFrame, keys: list[str], fields: list[str], name: str, order: list[str]) -> DataFrame:
    item = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in fields]).alias("item"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item), lambda a, b: _compare(a, b, order)).getField("item").alias(name))


def _compare(a: Column, b: Column, order: list[str]) -> Column:
    out = F.lit(0)
    for name in reversed(order):
        out = F.when(a[name] < b[name], F.lit(-1)).when(a[name] > b[name], F.lit(1)).otherwise(out)
    return out


def file_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested row for each parsed file; classes and properties in the order of their IRIs."""
    classes, properties = _renamed(tables["classes"]), _renamed(tables["properties"])
    documents = tables["files"].select("file", F.col("base").alias("ontologyBase"), F.struct("nodes", "edges", "properties", "triples").alias("summary"), "imports")
    documents = documents.join(_listed(classes, ["file"], CLASS, "classes", ["iri"]), "file", "left")
    for kind, name in (("edge", "edges"), ("property", "attributes")):
        documents = documents.join(_listed(properties.filter(F.col("kind") == kind), ["file"], PROPERTY, name, ["iri"]), "file", "left")
    return documents


def export_rows(tables: dict[str, DataFrame], path: Column) -> DataFrame:
    """Rows for json_files of each parsed file's document: (path, kind, field, json, at, ord); ``path`` is made of ``file``."""
    own = F.regexp_replace("file", r"^file:(//)?", "")
    header = tables["files"].select("file", own.alias("own"), F.col("base").alias("ontologyBase"), F.struct("nodes", "edges", "properties", "triples").alias("summary"), "imports")
    rows = field_rows(header, [("file", "own"), ("ontologyBase", "ontologyBase"), ("summary", "summary"), ("imports", "imports")], ["file"]).withColumn("ord", F.lit(None).cast("string"))
    classes, properties = _renamed(tables["classes"]), _renamed(tables["properties"])
    for at, (name, items, fields) in enumerate((("classes", classes, CLASS), ("edges", properties.filter("kind = 'edge'"), PROPERTY), ("attributes", properties.filter("kind = 'property'"), PROPERTY)), 4):
        start = header.select("file", F.lit(at).alias("at"), F.lit("array").alias("kind"), F.lit(name).alias("field"), F.lit(None).cast("string").alias("json"), F.lit(None).cast("string").alias("ord"))
        text = F.to_json(F.struct(*[F.col(c) for c in fields]), {"ignoreNullFields": "false"})
        rows = rows.unionByName(start).unionByName(items.select("file", F.lit(at).alias("at"), F.lit("item").alias("kind"), F.lit(name).alias("field"), text.alias("json"), F.col("iri").alias("ord")))
    return rows.select(path.alias("path"), "kind", "field", "json", "at", "ord")


def write_exports(tables: dict[str, DataFrame], input_dir: str, output_dir: str) -> DataFrame:
    """Write each parsed file's document to its mirrored path below ``output_dir``; returns (input, output, summary) of the files."""
    output = output_path(F.col("file"), input_dir, output_dir)
    write_files(export_rows(tables, output), output_dir, ["at", F.col("ord").asc_nulls_first()])
    return tables["files"].select(F.regexp_replace("file", r"^file:(//)?", "").alias("input"), output.alias("output"), F.struct("nodes", "edges", "properties", "triples").alias("summary"))


def export_folder(spark: SparkSession, input_dir: str, output_dir: str, explicit: str | None = None, include_all: bool = False, lang: str = "en", skip_metadata: bool = True) -> dict:
    """Export every RDF file of a folder tree; the report has counts and the tables of exported (input, output, summary) and skipped (path) files."""
    input_dir = rdf.resolve_input(spark, input_dir, folder=True)
    scanned = rdf.scan_files(spark, input_dir, skip_metadata=False)
    files = rdf.scan_files(spark, input_dir, skip_metadata=skip_metadata)
    exported = write_exports(rdf.ontology(rdf.read_rdf(files, explicit), lang, include_all), input_dir, output_dir)
    skipped = scanned.select("file").join(files.select("file"), "file", "left_anti").select(F.regexp_replace("file", r"^file:(//)?", "").alias("path"))
    return {"inputDir": input_dir, "outputDir": output_dir, "exportedCount": exported.count(), "skippedCount": skipped.count(), "exported": exported, "skipped": skipped}


def merge_folder_files(spark: SparkSession, root: str) -> DataFrame:
    """Write the merged document of every folder below ``root`` that holds ontology files, itself or below, into that folder.

    Items come from the files that aren't generated. In a folder its own files come first, then its child folders by name, each of them
    in the same order; the first item of each identity stays. All folders are merged in one job: an item goes to all its ancestors,
    which gives what merging from the bottom up gives. Returns (folder, output, summary).
    """
    root = root.rstrip("/")
    documents = spark.read.schema("classes array<string>, edges array<string>, attributes array<string>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.ontology.json").json(root)
    inside = F.expr(f"substring(regexp_replace(_metadata.file_path, '^file:(//)?', ''), {len(root) + 2})")
    documents = documents.withColumn("file", F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))).withColumn("parts", F.split("file", "/"))
    name = F.element_at("parts", -1)
    documents = documents.filter(~(F.startswith(name, F.lit("all_")) | (name == "all.ontology.json")))
    folders = F.slice("parts", F.lit(1), F.size("parts") - 1)
    # files before folders at every level
    order = F.concat(F.transform(folders, lambda f: F.concat(F.lit("1"), f)), F.array(F.concat(F.lit("0"), name)))
    documents = documents.withColumn("folder", F.array_join(folders, "/")).withColumn("order", order)
    sections = ("classes", "edges", "attributes")
    spread = None
    for kind in sections:
        rows = documents.select("folder", "order", F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "json"))
        spread = rows if spread is None else spread.unionByName(rows)
    for field in ("iri", "technicalName", "name"):
        spread = spread.withColumn(field, F.get_json_object("json", f"$.{field}"))
    spread = spread.withColumn("into", F.explode(ancestors(F.col("folder"))))
    merged = materialize(first_per_key(spread, ["into", "kind"], ["order", "pos"], identity_key("iri", "technicalName", "name")).select("into", "kind", "order", "pos", "json"), "merged")

    def output(folder: Column) -> Column:
        inner = F.concat(folder, F.lit("/"), folder_file_name(F.substring_index(folder, "/", -1)))
        return F.concat(F.lit(f"{root}/"), F.when(folder == "", "all.ontology.json").otherwise(inner))

    own = documents.select(F.col("folder").alias("into"), "order", F.concat(F.lit(f"{root}/"), "file").alias("source"))
    below = documents.select(F.explode(ancestors(F.col("folder"))).alias("child")).filter("child <> ''").distinct()
    parent = F.when(F.contains("child", F.lit("/")), F.regexp_replace("child", "/[^/]*$", "")).otherwise("")
    sources = own.unionByName(below.select(parent.alias("into"), F.array(F.concat(F.lit("1"), "child")).alias("order"), output(F.col("child")).alias("source")))
    # a folder's own files differ in their last part alone
    sources = sources.withColumn("order", F.array(F.element_at("order", -1)))
    counts = merged.groupBy("into").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in sections])
    headers = sources.groupBy("into").agg(F.count("*").alias("sourceFiles")).join(counts, "into", "left").na.fill(0, list(sections))
    headers = headers.select("into", F.concat_ws("/", F.lit(root), F.nullif("into", F.lit(""))).alias("sourceDir"), F.struct("sourceFiles", *sections).alias("summary"))
    none = F.lit(None).cast("string")
    rows = field_rows(headers, [("sourceDir", "sourceDir")], ["into"]).unionByName(field_rows(headers, [("summary", "summary")], ["into"]).withColumn("at", F.lit(2)))
    rows = rows.withColumn("order", F.lit(None).cast("array<string>")).withColumn("pos", F.lit(None).cast("int"))
    places = {"sourceFiles": 1} | {kind: 3 + i for i, kind in enumerate(sections)}
    for field, at in places.items():
        rows = rows.unionByName(headers.select("into", F.lit(at).alias("at"), F.lit("array").alias("kind"), F.lit(field).alias("field"), none.alias("json"), F.lit(None).cast("array<string>").alias("order"), F.lit(None).cast("int").alias("pos")))
    source = F.to_json(F.struct(F.col("source").alias("v")))
    rows = rows.unionByName(sources.select("into", F.lit(1).alias("at"), F.lit("item").alias("kind"), F.lit("sourceFiles").alias("field"), F.substring(source, F.lit(6), F.length(source) - 6).alias("json"), "order", F.lit(0).alias("pos")))
    at = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col("kind")]
    rows = rows.unionByName(merged.select("into", at.alias("at"), F.lit("item").alias("kind"), F.col("kind").alias("field"), "json", "order", "pos"))
    write_files(rows.withColumn("path", output(F.col("into"))).drop("into"), root, ["at", F.col("order").asc_nulls_first(), F.col("pos").asc_nulls_first()])
    return headers.select(F.col("sourceDir").alias("folder"), output(F.col("into")).alias("output"), "summary")


def folder_documents(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Merged documents of every folder: items with (folder, file, pos), the first of each identity staying."""
    parts = {}
    for kind, rows in (("classes", classes.withColumn("kind", F.lit("class"))), ("edges", properties.filter("kind = 'edge'")), ("attributes", properties.filter("kind = 'property'"))):
        merged = merge_folders(rows.withColumn("place", F.struct("file", "pos")))
        fields = [c for c in (CLASS if kind == "classes" else PROPERTY) if c in _renamed(merged).columns]
        parts[kind] = _listed(_renamed(merged), ["into"], fields, kind, ["own", "place"])
    spread = [r.select("folder", "file", F.explode(ancestors(F.col("folder"))).alias("into")) for r in (classes, properties)]
    files = spread[0].unionByName(spread[1]).select("into", F.concat_ws("/", F.nullif("folder", F.lit("")), "file").alias("source")).groupBy("into").agg(F.array_sort(F.collect_set("source")).alias("sourceFiles"))
    documents = files
    for rows in parts.values():
        documents = documents.join(rows, "into", "left")
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    summary = F.struct(F.size("sourceFiles").cast("long").alias("sourceFiles"), *[size(k).alias(k) for k in parts])
    name = F.when(F.col("into") == "", F.lit("all.ontology.json")).otherwise(folder_file_name(F.substring_index("into", "/", -1)))
    return documents.select(F.col("into").alias("sourceDir"), name.alias("fileName"), "sourceFiles", summary.alias("summary"), *parts)
