"""Constraint checks of property-graph patches against an ontology, as violation rows.

Patches: ``nodes`` (patch_id, ord, temp_id, class_name, properties VARIANT) and ``edges`` (patch_id, ord, edge_name, source_temp_id,
target_temp_id). Catalog: ``classes`` (technical_name, name, rules) and ``properties`` (kind, technical_name, domain, range).
Every check is a join with the catalog. Violations come unordered: their order is (phase, ord, step, message), for who shows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.values import fits_range
from quernel.operators.schema import Items, Model, Number, Object, Text, error, once, violations
from quernel.session import materialize

RULE_TYPES = {"pskg:hasEligibilityRule": "ELIGIBILITY", "pskg:hasSalesConditionRule": "SALES_CONDITION", "pskg:governedByPolicy": "POLICY"}  # fixed values
COLUMNS = ["patch_id", "phase", "ord", "step", "subject", "code", "message"]
PYTHON_TYPES = {"STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "VOID": "NoneType", "OBJECT": "dict"}  # fixed values


def exploded_properties(nodes: DataFrame) -> DataFrame:
    """(patch_id, ord, temp_id, class_name, step, property, value, kind, text)"""
    opened = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode_outer(F.col("properties").outer()), how="inner")
    rows = opened.select("patch_id", "ord", "temp_id", "class_name", F.col("pos").alias("step"), F.col("key").alias("property"), "value").filter("property IS NOT NULL")
    return rows.withColumn("kind", F.schema_of_variant("value")).withColumn("text", F.col("value").cast("string"))


def items(value: Column) -> Column:
    """Elements of a list value, or the scalar alone, as variants."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def occurrences(value: Column) -> Column:
    """0 for null, the length of a list, else 1."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | (kind == "VOID"), 0).when(F.startswith(kind, F.lit("ARRAY")), F.size(F.try_variant_get(value, "$", "array<variant>"))).otherwise(1)


def fits_any(value: Column, ranges: Column) -> Column:
    """Whether a value, or each element of a list, fits one of the ranges."""
    return F.forall(items(value), lambda v: F.exists(ranges, lambda r: fits_range(v.cast("string"), F.schema_of_variant(v), r)))


def _violation(rows: DataFrame, phase: int, code: str, subject: Column, message: Column, step: Column | None = None) -> DataFrame:
    return rows.select("patch_id", F.lit(phase).alias("phase"), "ord", (F.lit(0) if step is None else step).cast("int").alias("step"), subject.alias("subject"), F.lit(code).alias("code"), message.alias("message"))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def node_violations(nodes: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    known = classes.select(F.col("technical_name").alias("class_name"), F.col("name").alias("class_label"))
    attributes = properties.filter("kind = 'property'").select(F.col("technical_name").alias("property"), "domain", F.col("range").alias("ranges"))
    subject = F.col("temp_id")
    unknown_class = _violation(nodes.join(known, "class_name", "left_anti"), 1, "unknown_class", subject, _say("Unknown ontology class: ", F.col("class_name")))
    given = exploded_properties(nodes).join(known, "class_name").join(attributes, "property", "left")
    inside = F.coalesce(F.array_contains("domain", F.col("class_label")), F.lit(False))
    names = F.create_map(*[F.lit(x) for pair in PYTHON_TYPES.items() for x in pair])
    kind = F.when(F.startswith("kind", F.lit("ARRAY")), "list").when(F.startswith("kind", F.lit("OBJECT")), "dict").when(F.startswith("kind", F.lit("DECIMAL")), "float").otherwise(names[F.col("kind")])
    shown = F.concat(F.lit("["), F.array_join(F.transform("ranges", lambda r: F.concat(F.lit("'"), r, F.lit("'"))), ", "), F.lit("]"))
    # a property has one of three faults at most: one pass over the opened properties
    fault = (
        F.when(F.col("domain").isNull(), F.struct(F.lit("unknown_property").alias("code"), _say("Unknown ontology property: ", F.col("property")).alias("message")))
        .when(~inside, F.struct(F.lit("property_domain").alias("code"), _say("Property ", F.col("property"), " does not belong to class ", F.col("class_name")).alias("message")))
        .when(~fits_any(F.col("value"), F.col("ranges")), F.struct(F.lit("datatype").alias("code"), _say("Invalid datatype for ", F.col("property"), ": expected ", shown, ", got ", kind).alias("message")))
    )
    faults = given.withColumn("fault", fault).filter("fault IS NOT NULL")
    faults = faults.select("patch_id", F.lit(1).alias("phase"), "ord", F.col("step").cast("int").alias("step"), subject.alias("subject"), "fault.code", "fault.message")
    return unknown_class.unionByName(faults).unionByName(_attribute_rules(nodes, classes, attributes))


def _rules(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("technical_name").alias("class_name"), F.posexplode("rules").alias("rule_no", "rule")).select("class_name", "rule_no", F.col("rule.property").alias("property"), F.col("rule.operator").alias("operator"), F.col("rule.value").alias("wanted"))


def _cardinality(count: Column, required: Column, exact: Column, least: Column) -> Column:
    """Message of an exactlyQualified or minQualified rule that is not met."""
    number = F.expr("try_cast(wanted AS BIGINT)")
    by_exact = F.when((count == 0) & (number == 1), required).when(count != number, exact)
    by_least = F.when((count == 0) & (number > 0), required).when(count < number, least)
    return F.when(F.col("operator") == "exactlyQualified", by_exact).when(F.col("operator") == "minQualified", by_least)


def _attribute_rules(nodes: DataFrame, classes: DataFrame, attributes: DataFrame) -> DataFrame:
    rules = _rules(classes).join(attributes.select("property"), "property", "left_semi")
    due = nodes.select("patch_id", "ord", "temp_id", "class_name").join(rules, "class_name")
    values = exploded_properties(nodes).select("patch_id", "ord", "property", "value")
    rows = due.join(values, ["patch_id", "ord", "property"], "left").withColumn("n", occurrences(F.col("value")))
    missing = _say("Missing required property: ", F.col("property"))
    number = F.expr("try_cast(wanted AS BIGINT)")
    times = lambda how: _say("Property ", F.col("property"), f" must occur {how} ", number, " time(s); got ", F.col("n"))
    is_null = F.col("value").isNull() | (F.schema_of_variant("value") == "VOID")
    typed = F.startswith("wanted", F.lit("xsd:"))
    holds = F.exists(items(F.col("value")), lambda v: (F.schema_of_variant(v) == "STRING") & (v.cast("string") == F.col("wanted")))
    some = (
        F.when(is_null, missing)
        .when(typed & ~fits_any(F.col("value"), F.array("wanted")), _say("Property ", F.col("property"), " must satisfy ", F.col("wanted")))
        .when(~typed & ~holds, _say("Property ", F.col("property"), " must contain value ", F.col("wanted")))
    )
    message = F.coalesce(_cardinality(F.col("n"), missing, times("exactly"), times("at least")), F.when(F.col("operator") == "some", some))
    rows = rows.withColumn("message", message).filter("message IS NOT NULL")
    return _violation(rows, 1, "attribute_rule", F.col("temp_id"), F.col("message"), F.col("rule_no") + 100_000)


def last_nodes(nodes: DataFrame) -> DataFrame:
    """The last node of each temp id of a patch."""
    kept = F.max_by(F.struct("class_name", F.try_variant_get("properties", "$['pskg:ruleType']", "string").alias("rule_type")), "ord")
    return nodes.groupBy("patch_id", "temp_id").agg(kept.alias("n")).select("patch_id", "temp_id", "n.*")


def edge_violations(nodes: DataFrame, edges: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    ends = last_nodes(nodes)
    source = ends.select("patch_id", F.col("temp_id").alias("source_temp_id"), F.col("class_name").alias("source_class"))
    target = ends.select("patch_id", F.col("temp_id").alias("target_temp_id"), F.col("class_name").alias("target_class"), "rule_type")
    known = properties.filter("kind = 'edge'").select(F.col("technical_name").alias("edge_name"), "domain", F.col("range").alias("ranges"))
    label = classes.select(F.col("technical_name").alias("c"), F.col("name").alias("l"))
    rows = edges.join(source, ["patch_id", "source_temp_id"], "left").join(target, ["patch_id", "target_temp_id"], "left").join(known, "edge_name", "left")
    rows = rows.join(label.select(F.col("c").alias("source_class"), F.col("l").alias("source_label")), "source_class", "left")
    rows = rows.join(label.select(F.col("c").alias("target_class"), F.col("l").alias("target_label")), "target_class", "left")
    name = F.col("edge_name")
    no_source, no_target = F.col("source_class").isNull(), F.col("source_class").isNotNull() & F.col("target_class").isNull()
    linked = F.col("source_class").isNotNull() & F.col("target_class").isNotNull()
    no_edge = linked & F.col("domain").isNull()
    both_known = linked & F.col("domain").isNotNull() & F.col("source_label").isNotNull() & F.col("target_label").isNotNull()
    wanted = F.create_map(*[F.lit(x) for pair in RULE_TYPES.items() for x in pair])[name]
    checks = [
        (no_source, "dangling", _say("sourceTempId ", F.col("source_temp_id"), " does not exist")),
        (no_target, "dangling", _say("targetTempId ", F.col("target_temp_id"), " does not exist")),
        (no_edge, "unknown_edge", _say("Unknown ontology edge: ", name)),
        (linked & ~no_edge & F.col("source_label").isNull(), "unknown_source_class", _say("Unknown source class: ", F.col("source_class"))),
        (linked & ~no_edge & F.col("target_label").isNull(), "unknown_target_class", _say("Unknown target class: ", F.col("target_class"))),
        (both_known & ~F.array_contains("domain", F.col("source_label")), "edge_domain", _say("Invalid edge domain for ", name, ": ", F.col("source_class"), " is not allowed")),
        (both_known & ~F.array_contains("ranges", F.col("target_label")), "edge_range", _say("Invalid edge range for ", name, ": ", F.col("target_class"), " is not allowed")),
        (both_known & wanted.isNotNull() & ~wanted.eqNullSafe(F.col("rule_type")), "edge_semantics", _say("Edge ", name, " requires target pskg:ruleType=", wanted, "; got ", F.coalesce("rule_type", F.lit("None")))),
    ]
    # all checks of an edge in one pass over the joined rows
    hits = F.array(*[F.when(where, F.struct(F.lit(step).alias("step"), F.lit(code).alias("code"), message.alias("message"))) for step, (where, code, message) in enumerate(checks)])
    found = rows.select("patch_id", "ord", name.alias("subject"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return found.select("patch_id", F.lit(2).alias("phase"), "ord", "h.step", "subject", "h.code", "h.message")


def cardinality_violations(nodes: DataFrame, edges: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Edge rules of each node's class against its outgoing edges, zero included."""
    rules = _rules(classes).join(properties.filter("kind = 'edge'").select(F.col("technical_name").alias("property")), "property", "left_semi")
    counts = edges.groupBy("patch_id", F.col("source_temp_id").alias("temp_id"), F.col("edge_name").alias("property")).agg(F.count("*").alias("n"))
    rows = nodes.select("patch_id", "ord", "temp_id", "class_name").join(rules, "class_name").join(counts, ["patch_id", "temp_id", "property"], "left").na.fill(0, ["n"])
    number = F.expr("try_cast(wanted AS BIGINT)")
    times = lambda how: _say("edge ", F.col("property"), f" must occur {how} ", number, " time(s); got ", F.col("n"))
    message = (
        F.when((F.col("operator") == "exactlyQualified") & (F.col("n") != number), times("exactly"))
        .when((F.col("operator") == "minQualified") & (F.col("n") < number), times("at least"))
        .when((F.col("operator") == "some") & (F.col("n") < 1), _say("edge ", F.col("property"), " is required"))
    )
    rows = rows.withColumn("message", message).filter("message IS NOT NULL")
    return _violation(rows, 3, "edge_cardinality", F.col("temp_id"), F.col("message"), F.col("rule_no"))


def validate_patches(nodes: DataFrame, edges: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """All violations with their prefixes, nodes before edges before cardinalities; a node's repeated messages count once."""
    of_nodes = node_violations(nodes, classes, properties)
    first = of_nodes.groupBy("patch_id", "phase", "ord", "subject", "message").agg(F.min("step").alias("step"), F.min_by("code", "step").alias("code")).select(COLUMNS)
    rest = edge_violations(nodes, edges, classes, properties).unionByName(cardinality_violations(nodes, edges, classes, properties))
    prefix = F.when(F.col("phase") == 2, F.concat(F.lit("Edge "), "subject", F.lit(": "))).otherwise(F.concat(F.lit("Node "), "subject", F.lit(": ")))
    return first.unionByName(rest).withColumn("message", F.concat(prefix, "message"))


def patch_reports(nodes: DataFrame, edges: DataFrame, violations: DataFrame) -> DataFrame:
    """(patch_id, valid, errors, node_count, edge_count); ``errors`` is the number of violations, whose messages stay rows."""
    counts = nodes.groupBy("patch_id").agg(F.count("*").alias("node_count")).join(edges.groupBy("patch_id").agg(F.count("*").alias("edge_count")), "patch_id", "full")
    rows = counts.join(violations.groupBy("patch_id").agg(F.count("*").alias("errors")), "patch_id", "left").na.fill(0, ["node_count", "edge_count", "errors"])
    return rows.select("patch_id", (F.col("errors") == 0).alias("valid"), "errors", "node_count", "edge_count")


EVIDENCE = "array<struct<source: string, section: string, text: string>>"
PATCH = (
    f"nodes array<struct<tempId: string, className: string, properties: string, evidence: {EVIDENCE}, confidence: double>>, "
    f"edges array<struct<edgeName: string, sourceTempId: string, targetTempId: string, evidence: {EVIDENCE}, confidence: double>>, warnings array<string>"
)
_EVIDENCE = Items(Model("Evidence", {"source": Text(), "section": Text(nullable=True), "text": Text()}, ["section"]))
_PARTS = {"evidence": _EVIDENCE, "confidence": Number(0, 1)}
SCHEMA = Model("GraphPatch", {
    "nodes": Items(Model("ExtractedNode", {"tempId": Text(), "className": Text(), "properties": Object(), **_PARTS})),
    "edges": Items(Model("ExtractedEdge", {"edgeName": Text(), "sourceTempId": Text(), "targetTempId": Text(), **_PARTS})),
    "warnings": Items(Text()),
}, ["warnings"])  # fixed values


def _misfits(document: Column) -> Column:
    """Array of (place, message) of what doesn't fit the schema of patches."""
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    return once(F.try_parse_json(document), lambda v: F.when(is_object(v), violations(v, SCHEMA)).otherwise(error(F.lit(""), "not a JSON object")))


def schema_errors(documents: DataFrame) -> DataFrame:
    """(patch_id, ord, place, message) of what doesn't fit the schema of patches given as JSON text (patch_id, document)."""
    return documents.select("patch_id", F.posexplode(_misfits(F.col("document"))).alias("ord", "e")).select("patch_id", "ord", "e.place", "e.message")


def _opened(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed patches (patch_id, p)."""
    parts = {kind: rows.select("patch_id", F.posexplode(f"p.{kind}").alias("ord", "item")) for kind in ("nodes", "edges")}
    nodes = parts["nodes"].select("patch_id", F.col("ord").cast("long").alias("ord"), F.col("item.tempId").alias("temp_id"), F.col("item.className").alias("class_name"), F.try_parse_json(F.coalesce("item.properties", F.lit("{}"))).alias("properties"), F.coalesce("item.properties", F.lit("{}")).alias("properties_json"), F.col("item.evidence").alias("evidence"))
    edges = parts["edges"].select("patch_id", F.col("ord").cast("long").alias("ord"), F.col("item.edgeName").alias("edge_name"), F.col("item.sourceTempId").alias("source_temp_id"), F.col("item.targetTempId").alias("target_temp_id"))
    return nodes, edges


def parse_patches(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and schema errors (patch_id, ord, place, message) of patches given as JSON text (patch_id, document)."""
    nodes, edges = _opened(documents.select("patch_id", F.from_json("document", PATCH).alias("p")))
    return nodes, edges, schema_errors(documents)


def patch_envelopes(documents: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(patch_id, valid, errors, nodeCount, edgeCount, warningCount) of patches given as JSON text (patch_id, document).

    A patch that doesn't fit the schema has its "place: message" errors and counts of 0; others are checked against the ontology, errors in the
    order of nodes, edges and cardinalities. A patch is one row already, so its errors are one too; for patches that are tables
    take validate_patches, whose violations stay rows. Documents are parsed and held against the schema once, in their rows, and what comes of it
    is written: the checks read it several times.
    """
    said = F.transform(_misfits(F.col("document")), lambda e: F.concat_ws(": ", F.nullif(e["place"], F.lit("")), e["message"]))
    parsed = materialize(documents.select("patch_id", said.alias("schema_errors"), F.from_json("document", PATCH).alias("p")), "patches")
    fits = F.size("schema_errors") == 0
    nodes, edges = _opened(parsed.filter(fits))
    found = validate_patches(nodes, edges, classes, properties).groupBy("patch_id")
    found = found.agg(F.array_sort(F.collect_list(F.struct("phase", "ord", "step", "message"))).getField("message").alias("found"))
    count = lambda part: F.when(fits, F.greatest(F.coalesce(F.size(f"p.{part}"), F.lit(0)), F.lit(0))).otherwise(0).cast("long")
    rows = parsed.select("patch_id", "schema_errors", count("nodes").alias("nodeCount"), count("edges").alias("edgeCount"), count("warnings").alias("warningCount"))
    errors = F.when(F.size("schema_errors") > 0, F.col("schema_errors")).otherwise(F.coalesce("found", F.array().cast("array<string>")))
    rows = rows.join(found, "patch_id", "left").withColumn("errors", errors)
    return rows.select("patch_id", (F.size("errors") == 0).alias("valid"), "errors", "nodeCount", "edgeCount", "warningCount")
