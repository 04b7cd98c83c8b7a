"""Queries over files that a run has written and reads back: mirrored exports and merged folders, byte by byte."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import catalog, chunks, identity, recipes, state, state_store, upsert
from quernel.session import materialize, new_folder, table
from quernel.sources import export, navigation, skills
from quernel.sources.json_files import read_folders, write_files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def files_below(spark, folder: str, glob: str = "*"):
    """(path below the folder, n_bytes, sha256) of files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    inside = F.url_decode(F.replace(F.substring_index("path", f"{folder.rsplit('/', 1)[-1]}/", -1), F.lit("+"), F.lit("%2B")))
    return found.select(inside.alias("path"), F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("""
WITH items AS (SELECT replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '_') AS file, 'http://e.org/o/P' || p_partkey AS iri, '    {
      "name": "' || p_name || ' ' || p_partkey || '",
      "technicalName": "e:P' || p_partkey || '",
      "localName": "P' || p_partkey || '",
      "iri": "http://e.org/o/P' || p_partkey || '",
      "label": "' || p_name || '",
      "definition": null,
      "parents": [
        "' || p_type || '"
      ],
      "rules": [
        {
          "property": "đo",
          "operator": "min",
          "value": "' || p_size || '",
          "qualifier": null
        }
      ]
    }' AS item FROM part),
f AS (SELECT file, '{
  "file": "/in/' || file || '.rdf",
  "ontologyBase": "http://e.org/o/",
  "summary": {
    "nodes": ' || count(*) || ',
    "edges": 0,
    "properties": 0,
    "triples": ' || 7 * count(*) || '
  },
  "imports": [],
  "classes": [
' || string_agg(item, ',
' ORDER BY iri) || '
  ],
  "edges": [],
  "attributes": []
}' AS content FROM items GROUP BY file)
SELECT file || '.ontology.json' AS path, strlen(content)::BIGINT AS n_bytes, sha256(content) AS sha256 FROM f
""")
def export_files(spark, sf):
    """Parts as classes of one file for each brand and type, exported to mirrored JSON files."""
    return files_below(spark, export_parts(spark, sf))


def export_parts(spark, sf) -> str:
    """The folder with the files of export_files."""
    key = F.col("p_partkey").cast("string")
    file = F.concat(F.lit("file:///in/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".rdf"))
    none = F.lit(None).cast("string")
    rule = F.struct(F.lit("đo").alias("property"), F.lit("min").alias("operator"), F.col("p_size").cast("string").alias("value"), none.alias("qualifier"))
    classes = table(spark, sf, "part").select(
        file.alias("file"), F.concat_ws(" ", "p_name", key).alias("name"), F.concat(F.lit("e:P"), key).alias("technical_name"), F.concat(F.lit("P"), key).alias("local_name"),
        F.concat(F.lit("http://e.org/o/P"), key).alias("iri"), F.col("p_name").alias("label"), none.alias("definition"), F.array("p_type").alias("parents"), F.array(rule).alias("rules"),
    )
    zero = F.lit(0).cast("long")
    files = classes.groupBy("file").agg(F.count("*").alias("nodes")).select("file", F.lit("http://e.org/o/").alias("base"), "nodes", zero.alias("edges"), zero.alias("properties"), (7 * F.col("nodes")).alias("triples"), F.array().cast("array<string>").alias("imports"))
    properties = classes.select("file", F.lit("edge").alias("kind"), "name", "technical_name", "local_name", "iri", "label", "definition", F.col("parents").alias("domain"), F.col("parents").alias("range")).limit(0)
    folder = new_folder(spark)
    export.write_exports({"files": files, "classes": classes, "properties": properties}, "/in", folder)
    return folder


_MERGED = """
, m AS (SELECT k, order_key, iri, nation, row_number() OVER (PARTITION BY k, iri ORDER BY order_key, s_suppkey) AS r, s_suppkey FROM spread),
s AS (SELECT k, '    {
      "iri": "' || iri || '",
      "from": "' || nation || '"
    }' AS item, order_key, s_suppkey FROM m WHERE r = 1),
o AS (SELECT k, count(*) AS n, string_agg(item, ',
' ORDER BY order_key, s_suppkey) AS items FROM s GROUP BY k)
"""


@query("""
WITH base AS (SELECT n_regionkey AS region, n_nationkey AS nation, s_suppkey, 's' || (s_suppkey % 40) AS iri FROM supplier JOIN nation ON s_nationkey = n_nationkey),
spread AS (SELECT 'R' || region AS k, 'N' || nation AS order_key, iri, 'N' || nation AS nation, s_suppkey FROM base
    UNION ALL SELECT '', 'R' || region || '/N' || nation, iri, 'N' || nation, s_suppkey FROM base)
""" + _MERGED + """,
src AS (SELECT 'R' || region AS k, 'R' || region || '/N' || nation || '.ontology.json' AS path FROM base GROUP BY ALL
    UNION ALL SELECT '', 'R' || region || '/all_' || region || '.ontology.json' FROM base GROUP BY ALL),
g AS (SELECT k, count(*) AS n, string_agg('    "/root/' || path || '"', ',
' ORDER BY path) AS paths FROM src GROUP BY k),
t AS (SELECT k, '{
  "sourceDir": "/root' || CASE k WHEN '' THEN '' ELSE '/' || k END || '",
  "sourceFiles": [
' || g.paths || '
  ],
  "summary": {
    "sourceFiles": ' || g.n || ',
    "classes": ' || o.n || ',
    "edges": 0,
    "attributes": 0
  },
  "classes": [
' || o.items || '
  ],
  "edges": [],
  "attributes": []
}' AS content FROM g JOIN o USING (k))
SELECT CASE k WHEN '' THEN 'all.ontology.json' ELSE k || '/all_' || substr(k, 2) || '.ontology.json' END AS path, strlen(content)::BIGINT AS n_bytes, sha256(content) AS sha256 FROM t
""")
def merge_files(spark, sf):
    """Suppliers as classes of a file for each nation in a folder for each region, merged into a file for each folder."""
    folder = new_folder(spark)
    place = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit(f"{folder}/R"), F.col("n_regionkey").cast("string"), F.lit("/N"), F.col("n_nationkey").cast("string"), F.lit(".ontology.json"))
    item = F.struct(F.concat(F.lit("s"), (F.col("s_suppkey") % 40).cast("string")).alias("iri"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("from"))
    items = place.select(path.alias("path"), F.lit(1).alias("at"), F.lit("item").alias("kind"), F.lit("classes").alias("field"), F.to_json(item).alias("json"), F.col("s_suppkey").alias("ord"))
    starts = items.select("path").distinct().select("path", F.lit(0).alias("at"), F.lit("array").alias("kind"), F.lit("classes").alias("field"), F.lit(None).cast("string").alias("json"), F.lit(0).cast("long").alias("ord"))
    write_files(items.unionByName(starts), folder, ["at", "ord"])
    export.merge_folder_files(spark, folder)
    # paths in the files start with the run's own folder
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="all*").select("value", F.col("_metadata.file_path").alias("path"))
    text = F.replace("value", F.lit(folder), F.lit("/root"))
    return found.select(F.substring_index("path", f"{folder.rsplit('/', 1)[-1]}/", -1).alias("path"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
f AS (SELECT user_id, 'mode' AS field, '"m' || (k % 10) || '"' AS json, ts, event_id FROM e WHERE k % 2 = 0 AND k % 10 <> 4
      UNION ALL SELECT user_id, 'k' || (k % 3), CAST(k AS VARCHAR), ts, event_id FROM e WHERE k % 10 <> 4),
l AS (SELECT user_id, field, arg_max(json, {'b': event_id % 2, 't': ts, 'e': event_id}) AS json FROM f GROUP BY ALL)
SELECT user_id, '{"criteria":{' || string_agg('"' || field || '":' || json, ',' ORDER BY field) FILTER (field <> 'mode') || '}' || coalesce(',"mode":' || max(json) FILTER (field = 'mode'), '') || '}' AS state FROM l GROUP BY user_id
""")
def state_write_back(spark, sf):
    """Patches of all events, written back in two versions; those that break a check are refused, criteria merge one level deep."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    criteria = F.concat(F.lit('"criteria":{"k'), (k % 3).cast("string"), F.lit('":'), k.cast("string"), F.lit("}}"))
    document = F.concat(F.lit("{"), F.when(k % 2 == 0, F.concat(F.lit('"mode":"m'), (k % 10).cast("string"), F.lit('",'))).otherwise(""), criteria)
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), "ts", F.col("event_id").alias("seq"), F.parse_json(document).alias("delta"))
    store = state_store.StateStore(spark, f"{new_folder(spark)}/states")
    checks = {"mode": state.in_vocabulary(F.col("delta"), "mode", ["m0", "m2", "m6", "m8"])}
    for batch in (0, 1):
        state_store.update(store, events.filter(F.col("seq") % 2 == batch), checks, ("criteria",))
    return store.read().select(F.col("session").cast("long").alias("user_id"), "state")


def write_texts(rows, folder: str) -> None:
    """Write (path below the folder, content) as files."""
    full = rows.select(F.concat(F.lit(f"{folder}/"), "path").alias("path"), F.lit("text").alias("kind"), F.lit("").alias("field"), F.col("content").alias("json"))
    write_files(full, folder, ["field"])


@query("""
SELECT 'e' || s_suppkey AS edge_id, 's' || s_suppkey AS source, 's' || (s_suppkey * 7 % 100) AS target, 'Đường ' || n_name AS road_name, CAST(s_suppkey % 50 + 1 AS DOUBLE) AS distance,
  CASE WHEN s_suppkey % 9 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN ['car', 'bicycle'] ELSE ['car'] END AS access, s_name AS from_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def navigation_files(spark, sf):
    """Graph documents of a hundred suppliers each as node and edge tables, edges with the name of their node."""
    folder, key = new_folder(spark), F.col("s_suppkey").cast("string")
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("s"), key)
    node = F.struct(name.alias("key"), F.struct(F.col("s_name").alias("name"), F.lit("junction").alias("type"), F.lit(10.5).alias("lat"), F.lit(106.5).alias("lng")).alias("value"))
    edge = F.struct(
        F.concat(F.lit("e"), key).alias("id"), F.concat(F.lit("s"), (F.col("s_suppkey") * 7 % 100).cast("string")).alias("to"), F.concat(F.lit("Đường "), "n_name").alias("roadName"), (F.col("s_suppkey") % 50 + 1).alias("distance"), F.lit(1).alias("time"),
        F.lit(90).alias("heading"), F.when(F.col("s_suppkey") % 9 == 0, "closed").otherwise("open").alias("status"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("car"), F.lit("bicycle"))).otherwise(F.array(F.lit("car"))).alias("access"), F.lit(False).alias("toll"),
    )
    lists = F.struct(name.alias("key"), F.array(edge).alias("value"))
    content = F.to_json(F.struct(F.map_from_entries(F.collect_list(node)).alias("nodes"), F.map_from_entries(F.collect_list(lists)).alias("graph")))
    documents = rows.groupBy(F.floor(F.col("s_suppkey") / 100).alias("part")).agg(content.alias("content"))
    write_texts(documents.select(F.format_string("graph_%06d.json", "part").alias("path"), "content"), folder)
    nodes, _, edges = navigation.read_graph(spark, folder)
    edges = edges.select("edge_id", "source", "target", "road_name", "distance", "status", "access")
    return edges.join(nodes.select(F.col("node_id").alias("source"), F.col("name").alias("from_name")), "source")


@query("""
WITH d AS (SELECT 'd' || (p_partkey % 300) AS id, p_name AS name, p_partkey AS pos FROM part),
l AS (SELECT id, arg_max(name, pos) AS name FROM d GROUP BY id),
r AS (SELECT 'd' || n_nationkey AS id, n_name AS recipe, CAST(n_nationkey + 1 AS INTEGER) AS yields, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS items FROM nation)
SELECT l.id, l.name, r.recipe, r.yields, coalesce(r.items, 0)::BIGINT AS items, CASE WHEN r.id IS NULL THEN 'RECIPE_NOT_FOUND' END AS "errorCode" FROM l LEFT JOIN r ON r.id = l.id
""")
def dish_recipes(spark, sf):
    """Dish lists of 250 parts each, in which the last dish of an id wins, and recipe files, joined by id."""
    folder, none = new_folder(spark), F.lit(None).cast("string")
    dish = F.to_json(F.struct(F.concat(F.lit("d"), (F.col("p_partkey") % 300).cast("string")).alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("tags")))
    path = F.format_string(f"{folder}/list_%08d.json", F.floor(F.col("p_partkey") / 250))
    items = table(spark, sf, "part").select(path.alias("path"), F.lit(1).alias("at"), F.lit("item").alias("kind"), F.lit("data").alias("field"), dish.alias("json"), F.col("p_partkey").alias("ord"))
    starts = items.select("path").distinct().select("path", F.lit(0).alias("at"), F.lit("array").alias("kind"), F.lit("data").alias("field"), none.alias("json"), F.lit(0).cast("long").alias("ord"))
    write_files(items.unionByName(starts), folder, ["at", "ord"])
    item = F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("quantity"))))
    nations = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(item.alias("items"))
    recipe = F.struct(
        F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.struct((F.col("n_nationkey") + 1).alias("yield_count")).alias("meta"),
        F.array(F.struct(F.lit("all").alias("group_name"), "items")).alias("ingredients"),
    )
    write_texts(nations.select(F.concat(F.lower("n_name"), F.lit("_recipe.json")).alias("path"), F.to_json(recipe).alias("content")), folder)
    found = recipes.with_recipes(recipes.read_dishes(spark, folder).select("id", "name"), recipes.read_recipes(spark, folder))
    size = F.coalesce(F.size(F.col("recipe.ingredients")[0]["items"]), F.lit(0))
    return found.select("id", "name", F.col("recipe.name").alias("recipe"), F.col("recipe.meta.yield_count").alias("yields"), F.greatest(size, F.lit(0)).cast("long").alias("items"), "errorCode")


@query("""SELECT string_agg('- /n' || n_nationkey || ' (' || n_name || '): in "' || r_name, chr(10) ORDER BY 'n' || n_nationkey) AS catalog FROM nation JOIN region ON n_regionkey = r_regionkey""")
def skill_files(spark, sf):
    """Skill files with front matter as a catalog text; files without one are left out."""
    folder = new_folder(spark)
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit("---\nname: '"), "n_name", F.lit("'\ndescription:  in \""), "r_name", F.lit('" \nother: 1\n---\nname: not this\n'))
    code = F.col("n_nationkey").cast("string")
    plain = rows.select(F.concat(F.lit("x"), code, F.lit("/SKILL.md")).alias("path"), F.lit("no front matter").alias("content"))
    write_texts(rows.select(F.concat(F.lit("n"), code, F.lit("/SKILL.md")).alias("path"), body.alias("content")).unionByName(plain), folder)
    return skills.catalog_text(skills.read_skills(spark, folder))


@query(r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id || '.md' WHEN doc_id % 3 = 1 THEN 'd' || doc_id || '.TXT' ELSE 'd' || doc_id || '.pdf' END AS name, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') ELSE text END AS body FROM d),
t AS (SELECT *, regexp_replace(regexp_replace(body, '\A[\s\x{a0}\x{3000}]+', ''), '[\s\x{a0}\x{3000}]+\z', '') AS trimmed FROM l),
s AS (SELECT *, CASE WHEN doc_id % 3 = 2 THEN 'document_type' WHEN doc_id % 3 = 1 AND trimmed = '' THEN 'document_read' ELSE 'completed' END AS stage FROM t)
SELECT name AS document_name, stage, CASE stage WHEN 'document_type' THEN 'unsupported document type' WHEN 'document_read' THEN 'document is empty' END AS "errorMessage",
  CAST(CASE WHEN stage = 'completed' AND trimmed <> '' THEN 1 ELSE 0 END AS BIGINT) AS chunk_count,
  CASE WHEN stage = 'completed' AND trimmed <> '' THEN '[CHUNK 0]' || chr(10) || 'SOURCE: ' || name || chr(10) || 'SECTION: ' || CASE WHEN doc_id % 3 = 0 THEN 'Intro ' || doc_id ELSE 'N/A' END || chr(10) || trimmed END AS context FROM s
""")
def document_files(spark, sf):
    """All documents as Markdown, text or other files, read back as context texts or with the stage at which they fail."""
    folder, key = new_folder(spark), F.col("doc_id").cast("string")
    kind, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    inside = F.format_string("%06d", F.floor(F.col("doc_id") / 1000))  # folders of a thousand
    name = F.concat(inside, F.lit("/d"), key, F.when(kind == 0, ".md").when(kind == 1, ".TXT").otherwise(".pdf"))
    documents = table(spark, sf, "documents")
    write_texts(documents.select(name.alias("path"), F.when(kind == 0, F.concat(F.lit("## Intro "), key, F.lit("  \n"), text)).otherwise(text).alias("content")), folder)
    files = read_folders(documents.select(F.concat(F.lit(f"{folder}/"), inside).alias("folder")).distinct())
    files = materialize(files.select(F.substring_index("path", "/", -1).alias("source"), "content"), "files")  # read once by several steps
    return chunks.prepare_context(files).drop("source")


@query("""
WITH n AS (SELECT c_custkey % 9 AS k, c_custkey FROM customer)
SELECT 'c' || c_custkey AS temp_id, CASE k WHEN 0 THEN 'Identity property pskg:customerIdentifier is empty for class pskg:Customer' WHEN 1 THEN 'Cannot safely upsert pskg:Note: No natural identity policy and no source scope available for class pskg:Note'
  ELSE 'Missing identity property pskg:customerIdentifier for class pskg:Customer' END AS message FROM n WHERE k < 3
""")
def refused_nodes(spark, sf):
    """Messages of nodes that can't be written: no or an empty natural key, neither key nor source."""
    k = F.col("c_custkey") % 9
    doc = F.when(k == 0, F.lit('{"pskg:customerIdentifier": " "}')).when(k == 2, F.lit('{"pskg:customerIdentifier": null}')).otherwise(F.to_json(F.struct(F.col("c_name").alias("pskg:customerIdentifier"))))
    nodes = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("temp_id"), F.when(k == 1, "pskg:Note").otherwise("pskg:Customer").alias("class_name"), doc.alias("properties_json"), F.parse_json(doc).alias("properties"), F.lit(None).cast("string").alias("source_scope")
    )
    return upsert.refused(identity.resolve(nodes))


@query("""
SELECT 'violations' AS run, 'ontology_validation' AS stage, count(*) AS error_count, CAST(0 AS BIGINT) AS written FROM supplier
UNION ALL SELECT 'refusals', 'persistence', count(*), CAST(0 AS BIGINT) FROM customer UNION ALL SELECT 'sound', 'completed', CAST(0 AS BIGINT), count(*) FROM supplier
""")
def fill_stages(spark, sf):
    """Fills that stop at their stage and write nothing, and one that writes."""
    suppliers = table(spark, sf, "supplier")
    bad = suppliers.select(F.concat(F.lit("bad "), "s_name").alias("message"))
    refused = table(spark, sf, "customer").select(F.concat(F.lit("refused "), "c_name").alias("message"))
    none, out = bad.limit(0), []
    for run, violations, refusals in (("violations", bad, refused), ("refusals", none, refused), ("sound", none, none)):
        path = f"{new_folder(spark)}/graph"
        report = upsert.fill(violations, refusals, {"nodes": suppliers.select("s_suppkey")}, path)
        written = spark.read.parquet(f"{path}/nodes").count() if report["success"] else 0
        out.append((run, report["stage"], report.get("error_count", 0), written))
    return spark.createDataFrame(out, "run string, stage string, error_count long, written long")


@query("""
WITH c AS (SELECT DISTINCT p_type AS t, substr(p_type, 1, 1) AS name FROM part),
a AS (SELECT DISTINCT p_brand AS b, substr(p_type, 1, 1) AS name FROM part),
l AS (SELECT name, string_agg('  - e:' || b || ' | range=[''xsd:string'', "x''y"]', chr(10) ORDER BY 'e:' || b) AS p, string_agg('  - e:to' || b || ' | domain=[''' || name || '''] | range=[]', chr(10) ORDER BY 'e:to' || b) AS e FROM a GROUP BY name)
SELECT t AS class, 'CLASS: ' || t || chr(10) || 'NAME: ' || name || chr(10) || 'DEFINITION: None' || chr(10) || 'PROPERTIES:' || chr(10) || p || chr(10) || 'OUTGOING EDGES:' || chr(10) || e || chr(10)
  || 'RULES:' || chr(10) || '  - e:r | operator=min | value=1 | qualifier=None' || chr(10) AS context FROM c JOIN l USING (name)
""")
def extraction_context(spark, sf):
    """The text block of each class: properties with ranges, outgoing edges with domains and ranges, rules with qualifiers."""
    parts, none = table(spark, sf, "part"), F.lit(None).cast("string")
    rule = F.struct(F.lit("e:r").alias("property"), F.lit("min").alias("operator"), F.lit("1").alias("value"), none.alias("qualifier"))
    name = F.substring("p_type", 1, 1)
    classes = parts.select(F.col("p_type").alias("technical_name"), name.alias("name"), none.alias("definition"), F.array(rule).alias("rules")).distinct()
    brands = parts.select(F.col("p_brand").alias("b"), F.array(name).alias("domain")).distinct()
    attributes = brands.select(F.lit("property").alias("kind"), F.concat(F.lit("e:"), "b").alias("technical_name"), "domain", F.array(F.lit("xsd:string"), F.lit("x'y")).alias("range"))
    edges = brands.select(F.lit("edge").alias("kind"), F.concat(F.lit("e:to"), "b").alias("technical_name"), "domain", F.array().cast("array<string>").alias("range"))
    return catalog.class_context(classes, attributes.unionByName(edges))


@query("""
SELECT replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '_') || '.ontology.json' AS path, 'e:P' || p_partkey AS technical_name, 'P' || p_partkey AS local_name,
  CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY 'http://e.org/o/P' || p_partkey) - 1 AS INTEGER) AS pos, [p_type] AS parents, 'đo min ' || p_size AS rule FROM part
""")
def ontology_files(spark, sf):
    """The files of export_files read back as classes, in the order of their names, with parents and rules."""
    folder = export_parts(spark, sf)
    classes, _ = catalog.explode_items(catalog.read_ontologies(spark, folder))
    rule = F.col("rules")[0]
    path = F.url_decode(F.substring_index("path", f"{folder.rsplit('/', 1)[-1]}/", -1))
    return classes.select(path.alias("path"), "technical_name", "local_name", "pos", "parents", F.concat_ws(" ", rule["property"], rule["operator"], rule["value"]).alias("rule"))


@query("""
WITH c AS (SELECT n_nationkey, 'e:' || n_name AS cls, 'e:r' || r_name AS prop, CASE WHEN n_nationkey % 4 = 3 THEN 'other' ELSE n_name END AS domain FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Identity policy references unknown class: ' || cls WHEN 1 THEN 'Identity policy references unknown property: ' || prop || n_nationkey
  ELSE 'Identity property ' || prop || n_nationkey || ' does not belong to class ' || cls END AS message FROM c WHERE n_nationkey % 4 <> 2
""")
def identity_policy(spark, sf):
    """What a policy of natural keys, one for each nation, refers to and the ontology lacks."""
    k = F.col("n_nationkey") % 4
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(k.alias("k"), F.concat(F.lit("e:"), "n_name").alias("cls"), F.concat(F.lit("e:r"), "r_name", F.col("n_nationkey").cast("string")).alias("prop"), "n_name")
    classes = rows.filter("k <> 0").select(F.col("cls").alias("technical_name"), F.col("n_name").alias("name"))
    properties = rows.filter("k <> 1").select(F.lit("property").alias("kind"), F.col("prop").alias("technical_name"), F.array(F.when(F.col("k") == 3, F.lit("other")).otherwise(F.col("n_name"))).alias("domain"))
    policy = {r["cls"]: r["prop"] for r in rows.select("cls", "prop").collect()}  # a policy is a small table of the program
    return identity.policy_violations(classes, properties, policy)
