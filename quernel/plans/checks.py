"""Queries of rules, names, scans and joins that other queries leave out, over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import catalog, merge, routes, state, upsert, validate
from quernel.session import table
from quernel.sources import rdf

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def rule_patch(spark, sf):
    """Parts with attribute rules, suppliers as rules, and edges between them with domains, ranges and a required rule type."""
    key = F.col("p_partkey")
    code = F.when(key % 3 == 1, F.lit('"e:code":"A",')).when(key % 3 == 2, F.lit('"e:code":["A","B"],')).otherwise(F.lit(""))
    since = F.when(key % 5 == 0, F.lit('"e:from":"soon",')).when(key % 5 == 1, F.lit("")).otherwise(F.lit('"e:from":"2026-08-01",'))
    status = F.when(key % 2 == 0, F.lit('"e:status":"Published"')).otherwise(F.lit('"e:status":"Draft"'))
    nodes = table(spark, sf, "part").select(
        F.lit(1).alias("patch_id"), key.cast("long").alias("ord"), F.concat(F.lit("p"), key.cast("string")).alias("temp_id"), F.lit("e:Part").alias("class_name"),
        F.parse_json(F.concat(F.lit("{"), code, since, status, F.lit("}"))).alias("properties"),
    )
    kind = F.col("s_suppkey") % 3
    rules = table(spark, sf, "supplier").select(
        F.lit(1).alias("patch_id"), (F.col("s_suppkey") + 10_000_000_000).alias("ord"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("temp_id"), F.lit("e:Rule").alias("class_name"),
        F.parse_json(F.when(kind == 0, '{"pskg:ruleType":"ELIGIBILITY"}').when(kind == 1, '{"pskg:ruleType":"POLICY"}').otherwise("{}")).alias("properties"),
    )
    edges = table(spark, sf, "part").select(
        F.lit(1).alias("patch_id"), key.cast("long").alias("ord"), F.when(key % 4 < 2, "pskg:hasEligibilityRule").when(key % 4 == 2, "e:near").otherwise("e:made").alias("edge_name"),
        F.concat(F.lit("p"), key.cast("string")).alias("source_temp_id"), F.concat(F.lit("s"), (key % 7).cast("string")).alias("target_temp_id"),
    )
    rule = "named_struct('property', '{}', 'operator', '{}', 'value', '{}', 'qualifier', CAST(NULL AS STRING))"
    wanted = ", ".join(rule.format(*r) for r in (("e:code", "exactlyQualified", "1"), ("e:status", "some", "Published"), ("e:from", "some", "xsd:date")))
    classes = spark.sql(f"SELECT 'e:Part' AS technical_name, 'Part' AS name, array({wanted}) AS rules UNION ALL SELECT 'e:Rule', 'Rule', slice(array({wanted}), 1, 0)")
    properties = spark.sql(
        "SELECT * FROM VALUES ('property', 'e:code', array('Part'), array('xsd:string')), ('property', 'e:status', array('Part'), array('xsd:string')), ('property', 'e:from', array('Part'), array('xsd:string')), "
        "('property', 'pskg:ruleType', array('Rule'), array('xsd:string')), ('edge', 'pskg:hasEligibilityRule', array('Part'), array('Rule')), ('edge', 'e:near', array('Rule'), array('Rule')), "
        "('edge', 'e:made', array('Part'), array('Part')) AS t(kind, technical_name, domain, `range`)"
    )
    return nodes.unionByName(rules), edges, classes, properties


@query("""
WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey AS t FROM part),
e AS (SELECT k, k % 7 AS s FROM p WHERE k % 7 IN (SELECT s_suppkey FROM supplier))
SELECT 'attribute_rule' AS code, t AS subject, 'Node ' || t || ': Missing required property: e:code' AS message FROM p WHERE k % 3 = 0
UNION ALL SELECT 'attribute_rule', t, 'Node ' || t || ': Property e:code must occur exactly 1 time(s); got 2' FROM p WHERE k % 3 = 2
UNION ALL SELECT 'attribute_rule', t, 'Node ' || t || ': Property e:status must contain value Published' FROM p WHERE k % 2 = 1
UNION ALL SELECT 'attribute_rule', t, 'Node ' || t || ': Property e:from must satisfy xsd:date' FROM p WHERE k % 5 = 0
UNION ALL SELECT 'attribute_rule', t, 'Node ' || t || ': Missing required property: e:from' FROM p WHERE k % 5 = 1
UNION ALL SELECT 'dangling', CASE WHEN k % 4 < 2 THEN 'pskg:hasEligibilityRule' WHEN k % 4 = 2 THEN 'e:near' ELSE 'e:made' END,
  'Edge ' || CASE WHEN k % 4 < 2 THEN 'pskg:hasEligibilityRule' WHEN k % 4 = 2 THEN 'e:near' ELSE 'e:made' END || ': targetTempId s' || (k % 7) || ' does not exist' FROM p WHERE k % 7 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'edge_domain', 'e:near', 'Edge e:near: Invalid edge domain for e:near: e:Part is not allowed' FROM e WHERE k % 4 = 2
UNION ALL SELECT 'edge_range', 'e:made', 'Edge e:made: Invalid edge range for e:made: e:Rule is not allowed' FROM e WHERE k % 4 = 3
UNION ALL SELECT 'edge_semantics', 'pskg:hasEligibilityRule', 'Edge pskg:hasEligibilityRule: Edge pskg:hasEligibilityRule requires target pskg:ruleType=ELIGIBILITY; got ' || CASE WHEN s % 3 = 1 THEN 'POLICY' ELSE 'None' END FROM e WHERE k % 4 < 2 AND s % 3 <> 0
""")
def validate_rules(spark, sf):
    """Exact counts, fixed values and datatypes of attributes; domains, ranges and rule types of edges."""
    return validate.validate_patches(*rule_patch(spark, sf)).select("code", "subject", "message")


def _stored(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.lit(1).alias("patch_id"), F.lit("e:placedBy").alias("edge_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_temp_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target_temp_id")
    )
    ids = table(spark, sf, "orders").select(F.lit(1).alias("patch_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("temp_id"), F.col("o_orderkey").alias("k")).unionByName(
        table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.lit(1).alias("patch_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("temp_id"), F.col("c_custkey").alias("k"))
    )
    return upsert.stored_edges(orders, ids.select("patch_id", "temp_id", F.concat(F.lit("id:"), "temp_id").alias("stored_id")))


@query("SELECT 'id:o' || o_orderkey AS source, 'e:placedBy' AS type, 'id:c' || o_custkey AS target FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def edges_by_stored_id(spark, sf):
    """Edges of a patch between stored ids: two equi-joins of temporary with stored ids."""
    return _stored(spark, sf)[0]


@query("SELECT 'o' || o_orderkey AS temp_id, 'Missing target node: c' || o_custkey AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def edges_missing_ends(spark, sf):
    """Messages of edges without a stored end, which abort the write."""
    return upsert.missing_ends(_stored(spark, sf)[1])


@query(r"""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'xml' WHEN 1 THEN 'xml' WHEN 2 THEN 'turtle' WHEN 3 THEN 'nt' WHEN 4 THEN 'n3' WHEN 5 THEN 'json-ld' ELSE 'xml' END AS format FROM documents WHERE doc_id % 3 <> 0 OR lang <> 'en'
""")
def rdf_scan(spark, sf):
    """Formats by suffix of the files that a scan takes; files whose name has 'metadata' are left out."""
    k = F.col("doc_id") % 7
    suffix = F.when(k == 0, "OWL").when(k == 1, "rdf").when(k == 2, "ttl").when(k == 3, "NT").when(k == 4, "n3").when(k == 5, "jsonld").otherwise("unknown")
    stem = F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") == "en"), "MetaData-of-it").otherwise("a.b")
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("file:/x/metadata/"), stem, F.lit("."), suffix).alias("file"))
    files = files.filter(~F.contains(F.lower(rdf.file_stem(F.col("file"))), F.lit("metadata")))
    return files.select("doc_id", rdf.rdf_format(F.col("file")).alias("format"))


@query("SELECT source, arg_min(text, {'p': CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END, 'r': CASE WHEN lang = 'fr' AND text <> '' THEN 0 ELSE 1 END, 'd': doc_id}) AS definition FROM documents GROUP BY source")
def definition_pick(spark, sf):
    """A definition of each subject: SKOS before comments, then the language asked for, then the first."""
    predicate = F.when(F.col("doc_id") % 2 == 1, rdf.RDFS + "comment").otherwise(rdf.SKOS + "definition")
    triples = table(spark, sf, "documents").select(F.lit("f").alias("file"), F.col("source").alias("s"), predicate.alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), "lang", F.col("doc_id").alias("ord"))
    return rdf.definitions(triples, "fr").select(F.col("s").alias("source"), "definition")


@query("SELECT l_orderkey, arg_max(l_partkey, {'n': l_linenumber, 'p': l_partkey}) AS l_partkey, min({'n': l_linenumber, 'p': l_partkey}).n AS first_line FROM lineitem GROUP BY l_orderkey")
def last_wins(spark, sf):
    """The last line of each order, at the place of its first."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    kept = merge.last_per_key(lines, "l_orderkey", F.struct("l_linenumber", "l_partkey"))
    return kept.select("l_orderkey", "l_partkey", F.col("place.l_linenumber").alias("first_line"))


@query("""
SELECT DISTINCT 'class' AS kind, 't:' || p_brand AS technical_name, p_brand AS stored, 'Unsafe identifier: ' || p_brand AS error FROM part
UNION ALL SELECT DISTINCT 'edge', 't:soldBy' || p_type, 'SOLD_BY' || regexp_replace(p_type, '([A-Z])', '_\\1', 'g'), NULL FROM part
UNION ALL SELECT DISTINCT 'property', 't:size' || p_size, 'size' || p_size, NULL FROM part
""")
def storage_names(spark, sf):
    """Labels, keys and relation types of catalog terms; unsafe ones with their error."""
    parts = table(spark, sf, "part")
    classes = parts.select(F.concat(F.lit("t:"), "p_brand").alias("technical_name")).distinct()
    edges = parts.select(F.lit("edge").alias("kind"), F.concat(F.lit("t:soldBy"), "p_type").alias("technical_name")).distinct()
    properties = parts.select(F.lit("property").alias("kind"), F.concat(F.lit("t:size"), F.col("p_size").cast("string")).alias("technical_name")).distinct()
    return catalog.storage_names(classes, edges.unionByName(properties))


@query("SELECT s_suppkey, s_nationkey < 10 AS is_class, s_nationkey BETWEEN 8 AND 15 AS is_attribute, s_nationkey % 5 = 0 AS is_edge FROM supplier")
def catalog_exists(spark, sf):
    """Whether each supplier's term is a class, an attribute or an edge of the catalog."""
    term = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("technical_name")
    nations = table(spark, sf, "nation")
    properties = nations.filter("n_nationkey BETWEEN 8 AND 15").select(F.lit("property").alias("kind"), term).unionByName(nations.filter("n_nationkey % 5 = 0").select(F.lit("edge").alias("kind"), term))
    terms = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("term"))
    return catalog.exists(terms, nations.filter("n_nationkey < 10").select(term), properties).drop("term")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN lower(c_name) || ' duong' ELSE lower(c_name) END AS road FROM customer")
def road_names(spark, sf):
    """Road names without the word for street, lane or alley before them."""
    name = F.lower("c_name")
    given = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("tuyen duong  "), name)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("pho "), name)).otherwise(F.concat(name, F.lit(" duong")))
    return table(spark, sf, "customer").select("c_custkey", text.road_name(given).alias("road"))


@query("SELECT p_partkey, 'all_' || CASE p_partkey % 4 WHEN 0 THEN 'rdf_files' WHEN 1 THEN 'loans_general' WHEN 2 THEN 'be' ELSE 'part_' || p_partkey END || '.ontology.json' AS file_name FROM part")
def folder_files(spark, sf):
    """File names of merged folders, from the words of the folder's name."""
    k = F.col("p_partkey") % 4
    folder = F.when(k == 0, "RDFFiles").when(k == 1, "LoansGeneral").when(k == 2, "BE").otherwise(F.concat(F.lit("Part-"), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", text.folder_file_name(folder).alias("file_name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_name, p_brand] ELSE [p_brand] END AS names FROM part")
def clean_lists(spark, sf):
    """Lists of strings, trimmed and without empty ones."""
    first = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.lit("   "))
    return table(spark, sf, "part").select("p_partkey", text.clean_strings(F.array(first, F.lit(""), F.concat("p_brand", F.lit(" ")))).alias("names"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN source END AS section FROM documents")
def headings(spark, sf):
    """Titles of Markdown headings of levels 1 to 6; a line without white space after the marks is none."""
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, "# ").when(k == 1, "######\t  ").when(k == 2, "##\u3000").otherwise("####### ")
    line = F.concat(mark, "source", F.lit(" \u00a0"))
    found = F.regexp_replace(F.regexp_extract(line, text.HEADING, 2), r"(?U:\s)+$", "")
    return table(spark, sf, "documents").select("doc_id", F.when(line.rlike(text.HEADING), found).alias("section"))


@query("SELECT DISTINCT 'u' || user_id AS session, 'Session not found: u' || user_id AS message FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def sessions_required(spark, sf):
    """Sessions of events that are not among the known ones."""
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("session")
    known = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(name("c_custkey"))
    return state.required(table(spark, sf, "events").select(name("user_id")).distinct(), known)


@query("""
SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id
""")
def state_vocabulary(spark, sf):
    """The fold of patches whose status is in the vocabulary; one with another status is refused as a whole."""
    patch = F.parse_json(F.concat(F.lit('{"status":"'), "event_type", F.lit('"}')))
    events = table(spark, sf, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), patch.alias("delta"))
    folded = state.fold_valid(events, {"status": state.in_vocabulary(F.col("delta"), "status", ["click", "view", "purchase"])})
    return folded.select(F.col("session").alias("user_id"), F.from_json(F.concat(F.lit("["), "value.json", F.lit("]")), "array<string>")[0].alias("status"))


@query("""
SELECT o_orderkey, o_custkey, c.c_name AS from_name, n.n_name AS to_name
FROM orders LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN nation n ON n_nationkey = o_orderkey % 30
""")
def route_step_nodes(spark, sf):
    """Steps with the fields of both their nodes, from one table of nodes; unknown nodes stay empty."""
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_name").alias("name")).unionByName(
        table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_name").alias("name"))
    )
    steps = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("o_orderkey") % 30).cast("string")).alias("target"))
    return routes.with_nodes(steps, nodes).select("o_orderkey", "o_custkey", F.col("from_node.name").alias("from_name"), F.col("to_node.name").alias("to_name"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS fits FROM part
""")
def datatype_lists(spark, sf):
    """Whether a value, or every element of a list, fits a datatype."""
    k = F.col("p_partkey") % 4
    doc = F.when(k == 0, "[1, 2, 30]").when(k == 1, '[1, "x"]').when(k == 2, F.col("p_partkey").cast("string")).otherwise('"text"')
    return table(spark, sf, "part").select("p_partkey", validate.fits_any(F.parse_json(doc), F.array(F.lit("xsd:integer"))).alias("fits"))


@query("""
WITH d AS (SELECT c_custkey AS patch_id, c_custkey % 5 AS k, 'p' || c_custkey AS t FROM customer)
SELECT patch_id, k IN (0, 4) AS valid, CASE k
  WHEN 1 THEN ['nodes: Input should be a valid list', 'edges: Field required']
  WHEN 2 THEN ['nodes.0.tempId: Input should be a valid string', 'nodes.0.properties: Input should be a valid dictionary', 'nodes.0.evidence.1.text: Field required',
    'nodes.0.confidence: Input should be a valid number, unable to parse string as a number', 'nodes.1: Input should be a valid dictionary or instance of ExtractedNode', 'edges.0.confidence: Input should be less than or equal to 1', 'warnings.0: Input should be a valid string']
  WHEN 3 THEN ['Node ' || t || ': Unknown ontology property: e:no', 'Node g' || t || ': Unknown ontology class: e:Ghost', 'Edge e:near: sourceTempId ' || t || 'x does not exist'] ELSE [] END AS errors,
  CAST(CASE k WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS "nodeCount", CAST(CASE k WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS "edgeCount", CAST(CASE k WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS "warningCount" FROM d
""")
def patch_envelopes(spark, sf):
    """Patches given as documents: schema errors with their places, else errors against the ontology, and counts."""
    k, name = F.col("c_custkey") % 5, F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    shared = '"evidence": [{"source": "s", "text": "t"}], "confidence": 0.5'
    texts = {
        0: '{"nodes": [{"tempId": "{t}", "className": "e:Part", "properties": {"e:code": "A"}, ' + shared + '}], "edges": [], "warnings": ["a", "b"]}',
        1: '{"nodes": 5}',
        2: '{"nodes": [{"tempId": 7, "className": "e:Part", "properties": [], "evidence": [{"source": "s", "text": "t", "section": null}, {"source": "s"}], "confidence": "high"}, 3], '
        '"edges": [{"edgeName": "e", "sourceTempId": "a", "targetTempId": "b", "evidence": [], "confidence": 2}], "warnings": [1]}',
        3: '{"nodes": [{"tempId": "{t}", "className": "e:Part", "properties": {"e:code": "A", "e:no": 1}, ' + shared + '}, {"tempId": "g{t}", "className": "e:Ghost", "properties": {}, ' + shared + "}], "
        '"edges": [{"edgeName": "e:near", "sourceTempId": "{t}x", "targetTempId": "{t}", ' + shared + "}]}",
        4: '{"nodes": [], "edges": [], "more": true}',
    }
    document = F.lit(None).cast("string")
    for number, text_ in texts.items():
        document = F.when(k == number, F.replace(F.lit(text_), F.lit("{t}"), name)).otherwise(document)
    # keys are small and the checks of a document are not: spread before the texts are made
    keys = table(spark, sf, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    documents = keys.select(F.col("c_custkey").alias("patch_id"), document.alias("document"))
    item = "technical_name string, name string"
    classes = spark.createDataFrame([("e:Part", "part", [])], f"{item}, rules array<struct<property: string, operator: string, value: string, qualifier: string>>")
    properties = spark.createDataFrame([("property", "e:code", "code", ["part"], ["xsd:string"]), ("edge", "e:near", "near", ["part"], ["part"])], f"kind string, {item}, domain array<string>, range array<string>")
    return validate.patch_envelopes(documents, classes, properties)
