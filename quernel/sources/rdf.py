"""RDF files (RDF/XML, Turtle, N3, N-Triples, JSON-LD) as triples, and triples as ontology tables.

One row per file is parsed by a small streaming helper; everything after that (labels, definitions, compact names, restriction
rules, counts) is joins and aggregates keyed by file, so many files of any mix of sizes run in parallel.
"""

from __future__ import annotations

import itertools
import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.text import humanize, local_name
from quernel.session import materialize
from quernel.sources.jsonld import jsonld_triples
from quernel.sources.turtle import turtle_triples

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XML = "http://www.w3.org/XML/1998/namespace"
FORMATS = {"rdf": "xml", "owl": "xml", "xml": "xml", "ttl": "turtle", "nt": "nt", "n3": "n3", "jsonld": "json-ld"}  # fixed values
RESTRICTIONS = [  # fixed values: predicate and operator, first match wins
    ("someValuesFrom", "some"), ("allValuesFrom", "only"), ("hasValue", "value"), ("minCardinality", "min"), ("maxCardinality", "max"),
    ("cardinality", "exactly"), ("minQualifiedCardinality", "minQualified"), ("maxQualifiedCardinality", "maxQualified"), ("qualifiedCardinality", "exactlyQualified"),
]
TRIPLE = "file string, ord long, s string, s_kind string, p string, o string, o_kind string, lang string, datatype string"
RULES_TYPE = "array<struct<property: string, operator: string, value: string, qualifier: string>>"
PREFIX = "@prefix"  # rows of declared namespaces: s is the prefix, o the namespace


def rdf_format(path: Column, explicit: str | None = None) -> Column:
    """Format by suffix unless one is given; xml by default."""
    if explicit:
        return F.lit(explicit)
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("xml"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def scan_files(spark: SparkSession, path: str, glob: str = "*.rdf", skip_metadata: bool = True) -> DataFrame:
    """(file, content) of all files below ``path``; names with 'metadata' are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    files = files.select(F.col("path").alias("file"), "content")
    return files.filter(~F.contains(F.lower(file_stem(F.col("file"))), F.lit("metadata"))) if skip_metadata else files


def resolve_input(spark: SparkSession, path: str, data_dir: str | None = None, folder: bool = False) -> str:
    """The full path of an input: a relative path is looked up in ``data_dir`` first. Raises FileNotFoundError if there is nothing, ValueError if it is
    no file (with ``folder``: no folder). Any store that Spark reads will do."""
    place, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    found = place(path)
    if data_dir and not found.isAbsolute():
        inside = place(data_dir, path)
        found = inside if inside.getFileSystem(conf).exists(inside) else found
    files = found.getFileSystem(conf)
    full = files.makeQualified(found)
    shown = re.sub(r"^file:/*", "/", full.toString())
    if not files.exists(full):
        raise FileNotFoundError(f"RDF input {'directory' if folder else 'file'} not found: {shown}")  # fixed wording
    if files.getFileStatus(full).isDirectory() != folder:
        raise ValueError(f"RDF input path must be a {'directory' if folder else 'file'}: {shown}")
    return shown


def read_file(spark: SparkSession, path: str, data_dir: str | None = None, explicit: str | None = None) -> DataFrame:
    """Triples and prefixes of one file."""
    files = spark.read.format("binaryFile").load(resolve_input(spark, path, data_dir)).select(F.col("path").alias("file"), "content")
    return read_rdf(files, explicit)


def _clark(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def xml_triples(content: bytes):
    """(s, s_kind, p, o, o_kind, lang, datatype) of one RDF/XML document, declared prefixes first met first."""
    parser, names, root = ET.XMLPullParser(["start", "start-ns"]), {}, None
    parser.feed(content)
    parser.close()
    for event, item in parser.read_events():
        if event == "start-ns":
            names.setdefault(item[0], item[1])
        elif root is None:
            root = item
    for prefix, namespace in names.items():
        yield prefix, "literal", PREFIX, namespace, "iri", None, None
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"b{count}"

    def subject(node, base):
        for name in ("about", "ID", "nodeID"):
            value = node.get(f"{{{RDF}}}{name}")
            if value is not None:
                if name == "nodeID":
                    return f"n{value}", "bnode"
                return urljoin(base, "#" + value if name == "ID" else value), "iri"
        return fresh(), "bnode"

    def node_triples(node, base, lang, known=None):
        base, lang = node.get(f"{{{XML}}}base", base), node.get(f"{{{XML}}}lang", lang)
        s, kind = known or subject(node, base)
        if _clark(node.tag) != RDF + "Description":
            yield s, kind, RDF + "type", _clark(node.tag), "iri", None, None
        for name, value in node.attrib.items():
            name = _clark(name)
            if not name.startswith((RDF, XML)):
                yield s, kind, name, value, "literal", lang, None
            elif name == RDF + "type":
                yield s, kind, name, urljoin(base, value), "iri", None, None
        for child in node:
            yield from property_triples(s, kind, child, base, lang)

    def property_triples(s, kind, child, base, lang):
        base, lang = child.get(f"{{{XML}}}base", base), child.get(f"{{{XML}}}lang", lang)
        p, how = _clark(child.tag), child.get(f"{{{RDF}}}parseType")
        resource, node_id, datatype = (child.get(f"{{{RDF}}}{n}") for n in ("resource", "nodeID", "datatype"))
        if resource is not None:
            yield s, kind, p, urljoin(base, resource), "iri", None, None
        elif node_id is not None:
            yield s, kind, p, f"n{node_id}", "bnode", None, None
        elif how == "Collection":
            at, at_kind, link = s, kind, p
            for item in child:
                cell, known = fresh(), subject(item, item.get(f"{{{XML}}}base", base))
                yield at, at_kind, link, cell, "bnode", None, None
                yield cell, "bnode", RDF + "first", *known, None, None
                yield from node_triples(item, base, lang, known)
                at, at_kind, link = cell, "bnode", RDF + "rest"
            yield at, at_kind, link, RDF + "nil", "iri", None, None
        elif how == "Resource":
            inner = fresh()
            yield s, kind, p, inner, "bnode", None, None
            for item in child:
                yield from property_triples(inner, "bnode", item, base, lang)
        elif how == "Literal":
            text = (child.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in child)
            yield s, kind, p, text, "literal", None, RDF + "XMLLiteral"
        elif len(child):
            for item in child:
                known = subject(item, item.get(f"{{{XML}}}base", base))
                yield s, kind, p, *known, None, None
                yield from node_triples(item, base, lang, known)
        else:
            yield s, kind, p, child.text or "", "literal", None if datatype else lang, datatype

    if root is not None:
        base = root.get(f"{{{XML}}}base", "")
        for node in root if _clark(root.tag) == RDF + "RDF" else [root]:
            yield from node_triples(node, base, root.get(f"{{{XML}}}lang"))


PARSERS = {"xml": xml_triples, "turtle": turtle_triples, "nt": turtle_triples, "n3": lambda content: turtle_triples(content, n3=True), "json-ld": jsonld_triples}


def _parse(frames):
    columns = [c.split()[0] for c in TRIPLE.split(", ")]
    for frame in frames:
        for file, content, form in zip(frame["file"], frame["content"], frame["format"]):
            try:
                found = enumerate(PARSERS[form](bytes(content)))
                while rows := [(file, ord_, *triple) for ord_, triple in itertools.islice(found, 20_000)]:
                    yield pd.DataFrame(rows, columns=columns)
            except (ValueError, ET.ParseError) as error:
                raise ValueError(f"{file} is no {form} document: {error}") from error


def read_rdf(files: DataFrame, explicit: str | None = None) -> DataFrame:
    """Triples and prefixes of RDF files (file, content), each in the format of its suffix unless one is given. A file is one task's work."""
    return files.select("file", "content", rdf_format(F.col("file"), explicit).alias("format")).mapInPandas(_parse, TRIPLE)


def read_xml(files: DataFrame) -> DataFrame:
    """Triples and prefixes of RDF/XML files (file, content)."""
    return read_rdf(files, "xml")


def read_ntriples(lines: DataFrame) -> DataFrame:
    """Triples of N-Triples lines (file, ord, value)."""
    term = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
    pattern = rf"^\s*{term}\s+<([^>]*)>\s+{term}\s*\."
    rows = lines.filter(F.col("value").rlike(pattern))
    s, p, o = (F.regexp_extract("value", pattern, i) for i in (1, 2, 3))

    def kind(t: Column) -> Column:
        return F.when(F.startswith(t, F.lit("<")), "iri").when(F.startswith(t, F.lit("_:")), "bnode").otherwise("literal")

    def value(t: Column) -> Column:
        literal = F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1)
        for mark, sign in (('\\\\"', '"'), ("\\\\n", "\n"), ("\\\\t", "\t"), ("\\\\\\\\", "\\\\")):
            literal = F.regexp_replace(literal, mark, sign)
        return F.when(kind(t) == "iri", F.regexp_replace(t, "^<|>$", "")).when(kind(t) == "bnode", F.substring(t, F.lit(3), F.length(t))).otherwise(literal)

    none = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        "file", "ord", value(s).alias("s"), kind(s).alias("s_kind"), p.alias("p"), value(o).alias("o"), kind(o).alias("o_kind"),
        none(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)).alias("lang"), none(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1)).alias("datatype"),
    )


def distinct_triples(rows: DataFrame) -> DataFrame:
    """Set semantics: the first of equal triples of a file."""
    keys = ["file", "s", "s_kind", "p", "o", "o_kind", "lang", "datatype"]
    return rows.filter(F.col("p") != PREFIX).groupBy(*keys).agg(F.min("ord").alias("ord"))


def prefixes(rows: DataFrame) -> DataFrame:
    found = rows.filter(F.col("p") == PREFIX).select("file", F.col("s").alias("prefix"), F.col("o").alias("namespace"), "ord")
    return found.groupBy("file", "namespace").agg(F.min_by("prefix", "ord").alias("prefix"))


def labels(triples: DataFrame, lang: str = "en") -> DataFrame:
    """(file, s, label): the label in the language, else one without a language, else the first."""
    rank = F.when(F.col("lang") == lang, 0).when(F.col("lang").isNull(), 1).otherwise(2)
    found = triples.filter((F.col("p") == RDFS + "label") & (F.col("o_kind") == "literal"))
    return found.groupBy("file", "s").agg(F.min_by("o", F.struct(rank, "ord")).alias("label"))


def definitions(triples: DataFrame, lang: str = "en") -> DataFrame:
    """(file, s, definition): SKOS definitions before comments; in the language, else the first."""
    found = triples.filter(F.col("p").isin(SKOS + "definition", RDFS + "comment") & (F.col("o_kind") == "literal"))
    rank = F.struct((F.col("p") != SKOS + "definition").cast("int"), F.when((F.col("lang") == lang) & (F.col("o") != ""), 0).otherwise(1), "ord")
    return found.groupBy("file", "s").agg(F.min_by("o", rank).alias("definition"))


def bases(triples: DataFrame) -> DataFrame:
    found = triples.filter((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Ontology") & (F.col("s_kind") == "iri"))
    return found.groupBy("file").agg(F.min_by("s", "ord").alias("base"))


def compact(terms: DataFrame, names: DataFrame, iri: str = "iri") -> DataFrame:
    """``terms`` (file, iri, ...) with ``curie``: prefix:local for a declared namespace, else <iri>."""
    split = r"(?U)^(.*[^\w.\-])([\w.\-]*)$"
    joined = terms.withColumn("namespace", F.regexp_extract(iri, split, 1)).join(names, ["file", "namespace"], "left")
    local = F.regexp_extract(iri, split, 2)
    curie = F.when(F.col("prefix").isNotNull() & (local != ""), F.concat("prefix", F.lit(":"), local)).otherwise(F.concat(F.lit("<"), F.col(iri), F.lit(">")))
    return joined.withColumn("curie", curie).drop("namespace", "prefix")


def term_names(terms: DataFrame, triples: DataFrame, names: DataFrame, lang: str = "en") -> DataFrame:
    """(file, iri, curie, label, name, shown) of distinct IRIs: ``name`` prefers labels, ``shown`` prefers default-prefix names."""
    iris = compact(terms.select("file", "iri").distinct(), names).join(labels(triples, lang).withColumnRenamed("s", "iri"), ["file", "iri"], "left")
    plain = F.coalesce(humanize(local_name(F.col("iri"))), F.col("iri"))
    own = F.startswith("curie", F.lit(":"))
    some = F.nullif("label", F.lit(""))
    return iris.select(
        "file", "iri", "curie", "label", F.coalesce(some, F.when(own, plain), F.col("curie")).alias("name"),
        F.when(own, plain).otherwise(F.coalesce(some, F.col("curie"))).alias("shown"),
    )


def is_local(iri: Column, base: Column) -> Column:
    root = F.regexp_replace(base, "[/#]+$", "")
    return F.coalesce((iri == base) | F.startswith(iri, F.concat(root, F.lit("/"))) | F.startswith(iri, F.concat(root, F.lit("#"))), F.lit(False))


def declared(triples: DataFrame, kind: str, include_all: bool = False) -> DataFrame:
    """(file, iri) of URIs of an OWL type, local to their file's base unless ``include_all``."""
    found = triples.filter((F.col("p") == RDF + "type") & (F.col("o") == OWL + kind) & (F.col("s_kind") == "iri")).select("file", F.col("s").alias("iri")).distinct()
    return found if include_all else found.join(bases(triples), "file").filter(is_local(F.col("iri"), F.col("base"))).drop("base")


def restrictions(triples: DataFrame) -> DataFrame:
    """(file, iri, node): blank nodes reached from a class's superclasses and equivalent classes through blank nodes, at any depth."""
    roots = triples.filter(F.col("p").isin(RDFS + "subClassOf", OWL + "equivalentClass") & (F.col("o_kind") == "bnode") & (F.col("s_kind") == "iri"))
    frontier = roots.select("file", F.col("s").alias("iri"), F.col("o").alias("node")).distinct()
    steps = triples.filter((F.col("s_kind") == "bnode") & (F.col("o_kind") == "bnode")).select("file", F.col("s").alias("node"), F.col("o").alias("next")).distinct()
    reached = frontier = materialize(frontier, "reached")
    for depth in itertools.count(1):
        frontier = materialize(frontier.join(steps, ["file", "node"]).select("file", "iri", F.col("next").alias("node")).distinct().join(reached, ["file", "iri", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % 32 == 0:
            reached = materialize(reached, "reached")  # a short plan
    return reached


def rules(triples: DataFrame, names: DataFrame, lang: str = "en") -> DataFrame:
    """(file, iri, property, operator, value, qualifier) of restriction nodes; the first predicate that a node has decides."""
    nodes = triples.filter(F.col("s_kind") == "bnode").groupBy("file", F.col("s").alias("node")).agg(
        F.max((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Restriction")).alias("is_restriction"),
        *[F.min_by(F.struct("o", "o_kind"), F.when(F.col("p") == OWL + n, F.col("ord"))).alias(n) for n in ["onProperty", "onClass", "onDataRange", *[r for r, _ in RESTRICTIONS]]],
    ).filter("is_restriction")
    operator = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(op)) for n, op in RESTRICTIONS])
    value = F.coalesce(*[F.col(n) for n, _ in RESTRICTIONS])
    found = restrictions(triples).join(nodes, ["file", "node"]).withColumn("operator", operator).withColumn("value", value).filter("operator IS NOT NULL")
    found = found.withColumn("qualifier", F.coalesce("onClass", "onDataRange"))
    iris = triples.filter((F.col("s_kind") == "bnode") & (F.col("o_kind") == "iri")).select("file", F.col("o").alias("iri"))
    shown = term_names(iris, triples, names, lang)

    def text(rows: DataFrame, column: str, form: str) -> DataFrame:
        table = shown.select("file", F.col("iri").alias(f"{column}_iri"), F.col(form).alias(f"{column}_name"))
        rows = rows.withColumn(f"{column}_iri", F.when(F.col(f"{column}.o_kind") == "iri", F.col(f"{column}.o")))
        rows = rows.join(table, ["file", f"{column}_iri"], "left")
        kind = F.col(f"{column}.o_kind")
        return rows.withColumn(f"{column}_text", F.when(kind == "iri", F.col(f"{column}_name")).when(kind == "bnode", F.lit("anonymous restriction")).otherwise(F.col(f"{column}.o")))

    found = text(text(text(found, "onProperty", "name"), "value", "shown"), "qualifier", "shown")
    return found.select("file", "iri", F.coalesce("onProperty_text", F.lit("-")).alias("property"), "operator", F.col("value_text").alias("value"), F.col("qualifier_text").alias("qualifier"))


def ontology(rows: DataFrame, lang: str = "en", include_all: bool = False) -> dict[str, DataFrame]:
    """Tables of parsed files: files, classes and properties (edges and attributes by ``kind``)."""
    triples = materialize(distinct_triples(rows), "triples")
    names = materialize(prefixes(rows), "prefixes")
    kinds = {"class": "Class", "edge": "ObjectProperty", "property": "DatatypeProperty"}
    terms = None
    for kind, owl in kinds.items():
        part = declared(triples, owl, include_all).withColumn("kind", F.lit(kind))
        terms = part if terms is None else terms.unionByName(part)
    related = triples.filter(F.col("p").isin(RDFS + "subClassOf", RDFS + "domain", RDFS + "range") & (F.col("o_kind") == "iri"))
    named = term_names(terms.select("file", "iri").union(related.select("file", F.col("o").alias("iri"))), triples, names, lang)

    def listed(predicate: str, column: str, anonymous: bool) -> DataFrame:
        links = triples.filter(F.col("p") == RDFS + predicate)
        links = links if anonymous else links.filter(F.col("o_kind") == "iri")
        links = links.select("file", F.col("s").alias("iri"), F.col("o").alias("target"), "o_kind", "ord")
        target = named.select("file", F.col("iri").alias("target"), F.col("name").alias("target_name"))
        shown = F.when(F.col("o_kind") == "bnode", F.lit("anonymous restriction")).otherwise(F.coalesce("target_name", "target"))
        joined = links.join(target, ["file", "target"], "left").withColumn("shown", shown)
        return joined.groupBy("file", "iri").agg(F.array_sort(F.collect_list(F.struct("ord", "shown"))).getField("shown").alias(column))

    described = terms.join(named, ["file", "iri"]).join(definitions(triples, lang).withColumnRenamed("s", "iri"), ["file", "iri"], "left")
    described = described.select("kind", "file", "iri", "name", F.col("curie").alias("technical_name"), local_name(F.col("iri")).alias("local_name"), "label", "definition")
    rule_rows = rules(triples, names, lang).groupBy("file", "iri").agg(F.array_sort(F.collect_list(F.struct("property", "operator", "value", "qualifier"))).alias("rules"))
    empty = F.array().cast("array<string>")
    classes = described.filter("kind = 'class'").drop("kind").join(listed("subClassOf", "parents", False), ["file", "iri"], "left").join(rule_rows, ["file", "iri"], "left")
    classes = classes.withColumn("parents", F.coalesce("parents", empty)).withColumn("rules", F.coalesce("rules", F.array().cast(RULES_TYPE)))
    properties = described.filter("kind <> 'class'").join(listed("domain", "domain", True), ["file", "iri"], "left").join(listed("range", "range", True), ["file", "iri"], "left")
    properties = properties.withColumn("domain", F.coalesce("domain", empty)).withColumn("range", F.coalesce("range", empty))
    counts = terms.groupBy("file").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("class", "nodes"), ("edge", "edges"), ("property", "properties"))])
    imports = triples.filter(F.col("p") == OWL + "imports").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "o"))).getField("o").alias("imports"))
    files = triples.groupBy("file").agg(F.count("*").alias("triples")).join(bases(triples), "file", "left").join(counts, "file", "left").join(imports, "file", "left")
    files = files.na.fill(0, ["nodes", "edges", "properties"]).withColumn("imports", F.coalesce("imports", empty))
    return {"files": files, "classes": classes, "properties": properties}
