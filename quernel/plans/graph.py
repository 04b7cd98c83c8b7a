"""Graph, merge, validation, identity and upsert queries over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel import api
from quernel.operators import catalog, identity, merge, routes, upsert, validate
from quernel.session import materialize, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def part_graph(spark, sf, cost: str = "quantity"):
    """Supplier-part graph of open line items, both ways: suppliers are odd nodes, parts are even."""
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 2 + 1).alias("s"), (F.col("l_partkey") * 2).alias("p"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_linenumber") * 7).cast("long").alias("time"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("status"), F.array("l_returnflag").alias("access"),
    )
    usable = routes.usable_edges(lines, "N")
    least = usable.groupBy("s", "p").agg(F.min(cost).alias("cost"))
    edge = F.concat_ws("-", "s", "p")
    ends = F.array(F.struct(F.col("s").alias("source"), F.col("p").alias("target")), F.struct(F.col("p").alias("source"), F.col("s").alias("target")))
    return least.select(edge.alias("edge_id"), F.inline(ends), "cost")


SSSP_SQL = """
WITH RECURSIVE l AS MATERIALIZED (SELECT l_suppkey * 2 + 1 AS s, l_partkey * 2 AS p, min({cost}) AS cost FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY ALL),
e AS MATERIALIZED (SELECT s AS source, p AS target, CAST(cost AS BIGINT) AS cost FROM l UNION ALL SELECT p, s, CAST(cost AS BIGINT) FROM l),
r(node, cost) USING KEY (node) AS (SELECT 1::BIGINT, 0::BIGINT
  UNION SELECT n.node, n.cost FROM (SELECT e.target AS node, min(r.cost + e.cost) AS cost FROM r JOIN e ON e.source = r.node GROUP BY e.target) n
  LEFT JOIN recurring.r AS old ON old.node = n.node WHERE old.cost IS NULL OR n.cost < old.cost)
"""


@query(SSSP_SQL.format(cost="CAST(l_quantity AS BIGINT)") + "SELECT node, cost FROM r")
def sssp_distance(spark, sf):
    """Cheapest distance from supplier 0 over open edges of one access mode."""
    return routes.shortest_paths(part_graph(spark, sf), spark.sql("SELECT CAST(1 AS BIGINT) AS node")).select("node", "cost")


@query(SSSP_SQL.format(cost="l_linenumber * 7") + "SELECT node, cost FROM r")
def sssp_time(spark, sf):
    """The same by time."""
    return routes.shortest_paths(part_graph(spark, sf, "time"), spark.sql("SELECT CAST(1 AS BIGINT) AS node")).select("node", "cost")


@query(SSSP_SQL.format(cost="CAST(l_quantity AS BIGINT)") + ", t AS (SELECT node, min(i) AS i FROM (SELECT p_partkey * 2 AS node, CAST(p_partkey AS INTEGER) AS i FROM part WHERE p_partkey % 50 = 7) GROUP BY node) SELECT r.node, r.cost, t.i AS \"index\" FROM r JOIN t ON t.node = r.node ORDER BY r.cost, t.i LIMIT 1")
def nearest_target(spark, sf):
    """The cheapest of many target nodes."""
    targets = table(spark, sf, "part").filter("p_partkey % 50 = 7").select((F.col("p_partkey") * 2).alias("node"), F.col("p_partkey").cast("int").alias("index"))
    paths = routes.shortest_paths(part_graph(spark, sf), spark.sql("SELECT CAST(1 AS BIGINT) AS node"), targets)
    return routes.nearest_target(paths, targets)


@query("""
SELECT event_id, user_id, CASE WHEN p IS NULL THEN 'start' WHEN d <= 30 OR d >= 330 THEN 'straight' WHEN d < 180 THEN 'right' ELSE 'left' END AS turn
FROM (SELECT *, (((h - p) % 360) + 360) % 360 AS d FROM (SELECT event_id, user_id, event_id * 37 % 360 AS h, lag(event_id * 37 % 360) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events))
""")
def route_turns(spark, sf):
    """Turns between consecutive headings of each user."""
    steps = table(spark, sf, "events").withColumn("heading", F.col("event_id") * 37 % 360)
    return routes.with_turns(steps, "user_id", "event_id").select("event_id", "user_id", "turn")


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_distance, CAST(sum(l_linenumber) AS BIGINT) AS total_time FROM lineitem GROUP BY l_orderkey")
def route_totals(spark, sf):
    """Total distance and time of each route."""
    steps = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("distance"), F.col("l_linenumber").alias("time"))
    return routes.route_totals(steps, "l_orderkey")


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) AS first FROM lineitem GROUP BY ALL)
SELECT l_orderkey, array_to_string(list(l_returnflag ORDER BY first, l_returnflag), ',') AS warnings FROM f GROUP BY l_orderkey
""")
def route_warnings(spark, sf):
    """Distinct flags of each route in the order they are first met."""
    steps = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), "l_returnflag")
    return routes.first_seen(steps, "l_orderkey", "place", "l_returnflag").select("l_orderkey", F.array_join("values", ",").alias("warnings"))


@query("""
SELECT 'missing_key' AS "check", CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT 'unknown_key', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'repeated_edge', k FROM (SELECT l_orderkey || '/' || l_linenumber AS k FROM lineitem) GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'unknown_target', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)
""")
def graph_integrity(spark, sf):
    """Missing and unknown keys, repeated edge ids, edges to unknown nodes."""
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("node")).distinct()
    edges = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_partkey").alias("target"))
    return routes.integrity_violations(nodes, keys, edges)


@query("""
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1
""")
def merge_dedup_first(spark, sf):
    """The first document of each text by source and id."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return merge.first_per_key(docs, [], ["source", "doc_id"], merge.identity_key("text")).select("doc_id", "source", "lang")


@query(r"""
WITH p AS (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS parts FROM pages),
q AS (SELECT page_id, list_filter(parts, lambda x: x <> '') AS parts FROM p),
f AS (SELECT page_id, unnest([array_to_string(parts[1:i], '/') FOR i IN range(0, len(parts) + 1)]) AS folder FROM q)
SELECT folder, CAST(count(DISTINCT page_id) AS BIGINT) AS pages FROM f GROUP BY folder
""")
def path_rollup(spark, sf):
    """Distinct pages under every host and path prefix."""
    pages = table(spark, sf, "pages").select("page_id", F.explode(merge.ancestors(F.regexp_extract("url", "://([^?#]*)", 1))).alias("folder"))
    return pages.groupBy("folder").agg(F.countDistinct("page_id").alias("pages"))


@query("""
WITH i AS (SELECT s_suppkey, n_regionkey || '/' || s_nationkey AS folder, lpad(CAST(s_suppkey % 3 AS VARCHAR), 2, '0') AS file, s_suppkey AS pos, 'class' AS kind,
   CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 'k' || (s_suppkey % 40) END AS iri FROM supplier JOIN nation ON n_nationkey = s_nationkey),
s AS (SELECT i.*, unnest(['', string_split(folder, '/')[1], folder]) AS into_ FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY into_, kind, iri ORDER BY into_ <> folder, file, pos) AS n FROM s)
SELECT into_ AS folder, CAST(count(*) AS BIGINT) AS items, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM r WHERE n = 1 OR iri IS NULL GROUP BY into_
""")
def folder_merge(spark, sf):
    """Ordered dedup of items in every folder of a tree: an item's own folder comes before folders below it, keyless items stay."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.expr("n_nationkey = s_nationkey"))
    items = rows.select(
        "s_suppkey", F.concat_ws("/", "n_regionkey", "s_nationkey").alias("folder"), F.lpad((F.col("s_suppkey") % 3).cast("string"), 2, "0").alias("file"), F.col("s_suppkey").alias("pos"), F.lit("class").alias("kind"),
        F.when(F.col("s_suppkey") % 10 != 9, F.concat(F.lit("k"), (F.col("s_suppkey") % 40).cast("string"))).alias("iri"), F.lit(None).cast("string").alias("technical_name"), F.lit(None).cast("string").alias("name"),
    )
    return merge.merge_folders(items).groupBy(F.col("into").alias("folder")).agg(F.count("*").alias("items"), F.sum("s_suppkey").alias("keys"))


TYPES = ["STANDARD", "MEDIUM", "PROMO", "LARGE", "SMALL", "ECONOMY"]


def part_catalog(spark):
    """A small catalog over part types."""
    classes = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('t:{t}', '{t}')" for t in TYPES) + " AS t(technical_name, name)")
    properties = spark.sql(
        "SELECT * FROM VALUES ('property', 't:size', array('STANDARD', 'PROMO')), ('property', 't:brand', array('STANDARD', 'SMALL', 'LARGE')), ('edge', 't:soldBy', array('PROMO', 'ECONOMY')) AS t(kind, technical_name, domain)"
    )
    return classes, properties


@query("""
WITH d(kind, property, name) AS (SELECT kind, property, unnest(domain) FROM (VALUES ('property', 't:size', ['STANDARD', 'PROMO']), ('property', 't:brand', ['STANDARD', 'SMALL', 'LARGE']), ('edge', 't:soldBy', ['PROMO', 'ECONOMY'])) v(kind, property, domain))
SELECT p_partkey, kind, property FROM part JOIN d ON d.name = p_type
""")
def catalog_domain_join(spark, sf):
    """What each part may have by its class: an array-membership join as explode and equi-join."""
    classes, properties = part_catalog(spark)
    allowed = catalog.properties_of_classes(classes, properties)
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("t:"), "p_type").alias("class"))
    return parts.join(allowed, "class").select("p_partkey", "kind", "property")


def order_patch(spark, sf):
    """Orders and customers as one graph patch."""
    orders = table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus"))
    doc = F.when(F.col("o_orderkey") % 7 == 0, F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("e:orderKey"), status.alias("e:status"), F.lit("x").alias("e:color")))).when(
        F.col("o_orderkey") % 5 == 0, F.to_json(F.struct(F.col("o_orderkey").alias("e:orderKey"), status.alias("e:status"), F.lit(5).alias("e:segment")))
    ).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("e:orderKey"), status.alias("e:status"))))
    nodes = orders.select(
        F.lit(1).alias("patch_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("temp_id"),
        F.when(F.col("o_orderkey") % 13 == 0, "e:Thing").otherwise("e:Order").alias("class_name"), F.parse_json(doc).alias("properties"),
    )
    customers = table(spark, sf, "customer").select(
        F.lit(1).alias("patch_id"), (F.col("c_custkey") + 10_000_000_000).alias("ord"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("temp_id"), F.lit("e:Customer").alias("class_name"), F.parse_json(F.lit("{}")).alias("properties"),
    )
    edges = orders.select(
        F.lit(1).alias("patch_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 17 == 0, "e:lostBy").otherwise("e:placedBy").alias("edge_name"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_temp_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target_temp_id"),
    ).filter("ord % 19 <> 0")
    rule = "named_struct('property', '{}', 'operator', '{}', 'value', '{}', 'qualifier', CAST(NULL AS STRING))"
    classes = spark.sql(
        f"SELECT 'e:Order' AS technical_name, 'Order' AS name, array({rule.format('e:status', 'minQualified', '1')}, {rule.format('e:placedBy', 'exactlyQualified', '1')}) AS rules "
        f"UNION ALL SELECT 'e:Customer', 'Customer', array_except(array({rule.format('x', 'x', 'x')}), array({rule.format('x', 'x', 'x')}))"
    )
    properties = spark.sql(
        "SELECT * FROM VALUES ('property', 'e:orderKey', array('Order'), array('xsd:integer')), ('property', 'e:status', array('Order'), array('xsd:string')), "
        "('property', 'e:segment', array('Customer'), array('xsd:string')), ('edge', 'e:placedBy', array('Order'), array('Customer')) AS t(kind, technical_name, domain, `range`)"
    )
    return nodes.unionByName(customers), edges, classes, properties


ORDER_SQL = """
WITH o AS (SELECT *, 'o' || o_orderkey AS t, o_orderkey % 13 <> 0 AS known, o_orderkey % 7 = 0 AS seven, o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AS five, o_orderkey % 19 <> 0 AS has_edge, o_orderkey % 17 = 0 AS lost FROM orders),
m AS (
  SELECT 'unknown_class' AS code, t AS subject, 'Node ' || t || ': Unknown ontology class: e:Thing' AS message FROM o WHERE NOT known
  UNION ALL SELECT 'unknown_property', t, 'Node ' || t || ': Unknown ontology property: e:color' FROM o WHERE known AND seven
  UNION ALL SELECT 'property_domain', t, 'Node ' || t || ': Property e:segment does not belong to class e:Order' FROM o WHERE known AND five
  UNION ALL SELECT 'datatype', t, 'Node ' || t || ': Invalid datatype for e:orderKey: expected [''xsd:integer''], got str' FROM o WHERE known AND seven
  UNION ALL SELECT 'attribute_rule', t, 'Node ' || t || ': Missing required property: e:status' FROM o WHERE known AND o_orderkey % 11 = 0
  UNION ALL SELECT 'dangling', 'e:placedBy', 'Edge e:placedBy: targetTempId c' || o_custkey || ' does not exist' FROM o WHERE has_edge AND NOT lost AND o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'dangling', 'e:lostBy', 'Edge e:lostBy: targetTempId c' || o_custkey || ' does not exist' FROM o WHERE has_edge AND lost AND o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'unknown_edge', 'e:lostBy', 'Edge e:lostBy: Unknown ontology edge: e:lostBy' FROM o WHERE has_edge AND lost AND o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'unknown_source_class', 'e:placedBy', 'Edge e:placedBy: Unknown source class: e:Thing' FROM o WHERE has_edge AND NOT lost AND NOT known AND o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'edge_cardinality', t, 'Node ' || t || ': edge e:placedBy must occur exactly 1 time(s); got 0' FROM o WHERE known AND (lost OR NOT has_edge))
"""


@query(ORDER_SQL + "SELECT code, subject, message FROM m")
def violations_all(spark, sf):
    """All violations of a large graph patch: classes, properties, domains, datatypes, required values, edges, cardinalities."""
    return validate.validate_patches(*order_patch(spark, sf)).select("code", "subject", "message")


@query(ORDER_SQL + "SELECT code, subject, message FROM m WHERE code = 'datatype'")
def validate_datatype(spark, sf):
    """Datatype violations."""
    return validate.validate_patches(*order_patch(spark, sf)).filter("code = 'datatype'").select("code", "subject", "message")


@query(ORDER_SQL + "SELECT code, subject, message FROM m WHERE code = 'attribute_rule'")
def validate_required(spark, sf):
    """Missing required properties."""
    return validate.validate_patches(*order_patch(spark, sf)).filter("code = 'attribute_rule'").select("code", "subject", "message")


@query(ORDER_SQL + "SELECT code, subject, message FROM m WHERE code IN ('property_domain', 'unknown_property')")
def validate_domain(spark, sf):
    """Unknown properties and properties of other classes."""
    return validate.validate_patches(*order_patch(spark, sf)).filter("code IN ('property_domain', 'unknown_property')").select("code", "subject", "message")


@query(ORDER_SQL + "SELECT code, subject, message FROM m WHERE code = 'edge_cardinality'")
def validate_edge_card(spark, sf):
    """Edge cardinalities of each node, zero included."""
    return validate.validate_patches(*order_patch(spark, sf)).filter("code = 'edge_cardinality'").select("code", "subject", "message")


@query(ORDER_SQL + """SELECT count(*) = 0 AS valid, CAST(count(*) AS BIGINT) AS errors, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS node_count,
 CAST((SELECT count(*) FROM o WHERE has_edge) AS BIGINT) AS edge_count FROM m""")
def patch_report(spark, sf):
    """Validity, number of errors, nodes and edges of the patch."""
    nodes, edges, classes, properties = order_patch(spark, sf)
    report = validate.patch_reports(nodes, edges, validate.validate_patches(nodes, edges, classes, properties))
    return report.select("valid", "errors", "node_count", "edge_count")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 9 IN (0, 2, 3) THEN 'error' WHEN c_custkey % 9 = 1 THEN 'unresolved' ELSE 'natural_key' END AS strategy,
  CASE WHEN c_custkey % 9 > 3 THEN c_name || ' x' END AS key_value, CASE c_custkey % 9 WHEN 0 THEN 'Identity property pskg:customerIdentifier is empty for class pskg:Customer'
   WHEN 1 THEN 'No natural identity policy and no source scope available for class pskg:Note' WHEN 2 THEN 'Missing identity property pskg:customerIdentifier for class pskg:Customer' WHEN 3 THEN 'Unknown ontology class: pskg:Ghost' END AS reason,
  CASE WHEN c_custkey % 9 NOT IN (1, 3) THEN 'pskg:customerIdentifier' END AS key_name FROM customer
""")
def identity_natural(spark, sf):
    """Natural keys: normalised values; missing and empty ones and unknown classes as errors; no key and no source as unresolved."""
    k = F.col("c_custkey") % 9
    doc = F.when(k == 0, F.to_json(F.struct(F.lit("  ").alias("pskg:customerIdentifier")))).otherwise(F.to_json(F.struct(F.concat(F.lit("  "), "c_name", F.lit(" \t x ")).alias("pskg:customerIdentifier"))))
    doc = F.when(k == 2, F.lit("{}")).otherwise(doc)
    nodes = table(spark, sf, "customer").select("c_custkey", F.when(k == 1, "pskg:Note").when(k == 3, "pskg:Ghost").otherwise("pskg:Customer").alias("class_name"), F.parse_json(doc).alias("properties"), F.lit(None).cast("string").alias("source_scope"))
    classes = spark.sql("SELECT * FROM VALUES ('pskg:Note'), ('pskg:Customer') AS t(technical_name)")
    return identity.resolve(nodes, classes=classes).select("c_custkey", "strategy", "key_value", "reason", "key_name")


@query("""
SELECT s_suppkey, sha256('{"class":"e:Supplier","properties":{"name":"' || s_name || '","nation":' || s_nationkey || '},"source":"file ' || (s_suppkey % 3) || '"}') AS key_value FROM supplier
""")
def identity_hash(spark, sf):
    """Source-scoped keys: SHA-256 of canonical JSON, whatever the order of keys or the padding."""
    doc = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.concat(F.lit(" "), "s_name").alias("name")))).otherwise(F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))))
    nodes = table(spark, sf, "supplier").select("s_suppkey", F.lit("e:Supplier").alias("class_name"), F.parse_json(doc).alias("properties"), F.concat(F.lit(" file  "), (F.col("s_suppkey") % 3).cast("string")).alias("source_scope"))
    return identity.resolve(nodes).select("s_suppkey", "key_value")


@query("""
SELECT s_suppkey, sha256('{"class":"e:Rate","properties":{"big":1e+22,"cap":100.0,"id":' || s_suppkey || '.0,"list":[1.5,"a b",{"a":true,"z":null},[' || s_nationkey || ']],"rate":1.0},"source":"file ' || (s_suppkey % 3) || '"}') AS key_value,
  CASE s_suppkey % 4 WHEN 0 THEN s_suppkey || '.5' WHEN 1 THEN 'True' WHEN 2 THEN '1e+16' ELSE 'x y' END AS natural FROM supplier
""")
def identity_numbers(spark, sf):
    """Keys of properties given as JSON text: numbers keep whether they are whole, nested lists and objects are canonical; natural keys that aren't strings."""
    k = F.col("s_suppkey").cast("string")
    doc = F.concat(F.lit('{"rate": 1.0, "list": [1.50, " a  b ", {"z": null, "a": true}, ['), F.col("s_nationkey").cast("string"), F.lit(']], "cap": 100.00, "id": '), k, F.lit('.0, "big": 1e22}'))
    source = F.concat(F.lit(" file  "), (F.col("s_suppkey") % 3).cast("string"))
    which = F.col("s_suppkey") % 4
    code = F.when(which == 0, F.concat(k, F.lit(".50"))).when(which == 1, F.lit("true")).when(which == 2, F.lit("1E16")).otherwise(F.lit('" x  y "'))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(
        F.struct(F.lit("e:Rate").alias("class_name"), doc.alias("properties_json"), source.alias("source_scope")),
        F.struct(F.lit("pskg:Customer").alias("class_name"), F.concat(F.lit('{"pskg:customerIdentifier": '), code, F.lit("}")).alias("properties_json"), F.lit(None).cast("string").alias("source_scope")),
    )).alias("n")).select("s_suppkey", "n.*").withColumn("properties", F.parse_json("properties_json"))
    found = identity.resolve(rows).groupBy("s_suppkey").agg(F.max(F.when(F.col("strategy") == "source_scoped", F.col("key_value"))).alias("key_value"), F.max(F.when(F.col("strategy") == "natural_key", F.col("key_value"))).alias("natural"))
    return found


@query("""
WITH s AS (SELECT user_id, event_type AS property, 'old' AS value FROM (SELECT DISTINCT user_id, event_type FROM events)),
c AS (SELECT user_id, event_type AS property, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS value, event_id FROM events),
l AS (SELECT user_id, property, arg_max_null(value, event_id) AS value FROM (SELECT user_id, property, value, event_id FROM c UNION ALL SELECT user_id, property, value, -1 FROM s) GROUP BY ALL)
SELECT user_id, property, value FROM l WHERE value IS NOT NULL
""")
def upsert_nodes(spark, sf):
    """Property merge: the last change wins, a null removes, what isn't mentioned stays."""
    events = table(spark, sf, "events")
    stored = events.select("user_id", F.col("event_type").alias("property")).distinct().withColumn("value", F.lit("old"))
    changes = events.select("user_id", F.col("event_type").alias("property"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("value"), F.col("event_id").alias("ord"))
    return upsert.merge_properties(stored, changes, ["user_id"])


@query("SELECT DISTINCT user_id AS source, event_type AS type, CAST(floor(value) AS BIGINT) AS target FROM events")
def upsert_edges(spark, sf):
    """Edge merge: each source, type and target once."""
    edges = table(spark, sf, "events").select("event_id", F.col("user_id").alias("source"), F.col("event_type").alias("type"), F.floor("value").cast("long").alias("target"))
    return upsert.merge_edges(edges.filter("event_id % 2 = 0"), edges.filter("event_id % 2 = 1"))


@query("SELECT lang, string_agg(DISTINCT source, '|' ORDER BY source) AS scope FROM documents GROUP BY lang")
def source_scope(spark, sf):
    """Distinct stripped sources of each language, sorted and joined."""
    evidence = table(spark, sf, "documents").groupBy("lang").agg(F.collect_set(F.struct(F.concat(F.lit(" "), "source").alias("source"))).alias("evidence"))
    return evidence.select("lang", identity.source_scope(F.col("evidence")).alias("scope"))


@query(SSSP_SQL.format(cost="CAST(l_quantity AS BIGINT)") + """, t AS (SELECT p_partkey * 2 AS node FROM part),
far AS (SELECT r.node, r.cost FROM r JOIN t ON t.node = r.node ORDER BY r.cost DESC, r.node LIMIT 1)
SELECT 'found' AS answer, CAST(cost AS BIGINT) AS total, true AS ends_meet, true AS adds_up FROM far
UNION ALL SELECT 'same', CAST(0 AS BIGINT), true, true UNION ALL SELECT 'NODE_NOT_FOUND', NULL, NULL, NULL UNION ALL SELECT 'INVALID_ACCESS', NULL, NULL, NULL
UNION ALL SELECT 'recovered', CAST((SELECT min(r.cost) FROM r JOIN t ON t.node = r.node) AS BIGINT), true, true
""")
def route_answers(spark, sf):
    """Routes from supplier 0 by the service entry points: to the part that is farthest away, to itself, to an unknown node, by no access mode,
    and back to the nearest part. Steps have to follow each other from start to end and add up to the total."""
    lines = part_graph(spark, sf).select(F.concat_ws(">", "source", "target").alias("edge_id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("cost").alias("distance"), F.lit(1).cast("long").alias("time"))
    lines = routes.by_source(lines.withColumns({"status": F.lit("open"), "access": F.array(F.lit("car")), "heading": F.lit(90), "toll": F.lit(False), "road_name": F.lit("r")}))
    suppliers = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2 + 1).cast("string").alias("node_id"))
    parts = table(spark, sf, "part").select((F.col("p_partkey") * 2).cast("string").alias("node_id"))
    nodes = materialize(suppliers.unionByName(parts).withColumn("name", F.concat(F.lit("n"), "node_id")), "nodes")
    usable = routes.usable_edges(lines, "car").withColumn("cost", F.col("distance"))
    paths = materialize(routes.shortest_paths(usable, spark.sql("SELECT '1' AS node"), placed=True), "paths")  # answers all routes from there
    to_parts = materialize(paths.join(parts.withColumnRenamed("node_id", "node").hint("merge"), "node").select("node", "cost"), "to_parts")
    far = to_parts.orderBy(F.desc("cost"), F.col("node").cast("long")).first()["node"]
    near = [r["node"] for r in to_parts.orderBy("cost", F.col("node").cast("long")).limit(20).collect()]  # the rest of a route

    def row(answer: str, found: dict):
        if not found["success"]:
            return (found["errorCode"], None, None, None)
        steps = materialize(found["steps"], "answer")
        count = steps.count()
        before = steps.select((F.col("index") + 1).alias("index"), F.col("target").alias("left"))
        begins = F.col("source") == F.when(F.col("index") == 0, F.lit(found["start"])).otherwise(F.col("left"))
        arrives = (F.col("index") < count - 1) | ((F.col("index") == count - 1) & (F.col("target") == found["end"]))
        meets = F.min(F.coalesce(begins & arrives & (F.col("to_node.id") == F.col("target")), F.lit(False)))
        seen = steps.join(routes.sized(before, count), "index", "left").agg(meets.alias("meets"), F.coalesce(F.sum("distance"), F.lit(0)).alias("distance")).first()
        return (answer, found["total_distance"], seen["meets"] if count else found["start"] == found["end"], seen["distance"] == found["total_distance"])

    ask = lambda end, access="car": api.find_route(nodes, lines, "1", end, access, "shortest_distance", True, paths)
    back = api.find_recovery_route(nodes, lines, "1", ["3", *near], 1, "car", "shortest_distance", True)
    out = [row("found", ask(far)), row("same", ask("1")), row("", ask("x")), row("", ask(far, "boat")), row("recovered", back)]
    return spark.createDataFrame(out, "answer string, total long, ends_meet boolean, adds_up boolean")
