"""Document, state, streaming and RDF queries over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import chunks, state
from quernel.session import new_folder, table
from quernel.sources import rdf
from quernel.streaming import state_stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query(r"""
SELECT doc_id AS id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)
""")
def chunk_lines(spark, sf):
    """Lines of every whole document."""
    return chunks.lines(table(spark, sf, "documents"), "doc_id", "text")


@query(r"""
WITH l AS (SELECT doc_id AS id, i, lines[i] AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)),
m AS (SELECT *, length(line) <= 25 AND ends_with(line, '.') AS h FROM l),
s AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY id ORDER BY i) AS no FROM m),
c AS (SELECT id, no, max(line) FILTER (h) AS section, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), '') AS content FROM s GROUP BY id, no),
t AS (SELECT id, no, section, regexp_replace(regexp_replace(content, '\A[\s\x{a0}\x{3000}]+', ''), '[\s\x{a0}\x{3000}]+\z', '') AS content FROM c)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY no) - 1 AS INTEGER) AS "index", section, content FROM t WHERE content <> ''
""")
def chunk_sections(spark, sf):
    """Sections under short closing lines, numbered where they hold text."""
    line = F.col("line")
    return chunks.chunk(table(spark, sf, "documents"), "doc_id", "text", (F.length(line) <= 25) & F.endswith(line, F.lit(".")), line)


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a.md' WHEN doc_id % 3 = 1 THEN 'b.pdf' ELSE 'c.txt' END AS name FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'unsupported' WHEN doc_id % 6 = 2 THEN 'not_utf8' ELSE 'ok' END AS status FROM d
""")
def document_status(spark, sf):
    """Media type and encoding of documents given as bytes."""
    name = F.when(F.col("doc_id") % 3 == 0, "a.md").when(F.col("doc_id") % 3 == 1, "b.pdf").otherwise("c.txt")
    content = F.when(F.col("doc_id") % 6 == 2, F.unhex(F.lit("C328FF"))).otherwise(F.encode("text", "UTF-8"))
    docs = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("source"), content.alias("content"))
    return chunks.decode_documents(docs).select(F.substring_index("source", "/", 1).cast("long").alias("doc_id"), "status")


FIELDS = """c AS (SELECT user_id, event_type AS field, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value, ts, event_id FROM events)"""


@query(f"WITH {FIELDS} SELECT user_id, field, arg_max_null(value, {{'t': ts, 'e': event_id}}) AS value FROM c GROUP BY ALL")
def state_fold(spark, sf):
    """Last value of each field of a session: an explicit null overwrites, an absent field keeps."""
    events = table(spark, sf, "events")
    changes = events.select(F.col("user_id").alias("session"), F.col("event_type").alias("field"), F.struct(F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v")).alias("value"), "ts", F.col("event_id").alias("seq"))
    return state.fold(changes).select(F.col("session").alias("user_id"), "field", F.col("value.v").alias("value"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
f AS (SELECT user_id, 'mode' AS field, CASE WHEN k % 4 = 0 THEN 'null' ELSE '"m' || (k % 4) || '"' END AS json, ts, event_id FROM e WHERE k % 2 = 0
      UNION ALL SELECT user_id, 'criteria.k' || (k % 3), CAST(k AS VARCHAR), ts, event_id FROM e)
SELECT user_id, field, arg_max_null(json, {'t': ts, 'e': event_id}) AS json FROM f GROUP BY ALL
""")
def state_patches(spark, sf):
    """Patches given as documents: fields replace, criteria merge one level deep."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    mode = F.when(k % 4 == 0, F.lit("null")).otherwise(F.concat(F.lit('"m'), (k % 4).cast("string"), F.lit('"')))
    criteria = F.concat(F.lit('"criteria":{"k'), (k % 3).cast("string"), F.lit('":'), k.cast("string"), F.lit("}"))
    doc = F.when(k % 2 == 0, F.concat(F.lit('{"mode":'), mode, F.lit(","), criteria, F.lit("}"))).otherwise(F.concat(F.lit("{"), criteria, F.lit("}")))
    events = table(spark, sf, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.parse_json(doc).alias("delta"))
    folded = state.fold(state.nested_changes(state.field_changes(events), ["criteria"]))
    return folded.select(F.col("session").alias("user_id"), "field", F.coalesce("value.json", F.lit("null")).alias("json"))


@query(f"WITH {FIELDS} SELECT user_id, field, arg_max_null(value, {{'t': ts, 'e': event_id}}) AS value FROM c GROUP BY ALL")
def state_fold_stream(spark, sf):
    """The same fold by a stateful stream over the event files."""
    static = table(spark, sf, "events")
    folder = new_folder(spark)
    source = f"{folder}/source"
    static.select(
        "user_id", F.col("event_type").alias("field"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value")
    ).write.parquet(source)
    stream = spark.readStream.schema("user_id long, field string, ts_us long, seq long, value double").parquet(source)
    state_stream.run_to_end(state_stream.fold_stream(stream), f"{folder}/checkpoint", lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}"))
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("user_id", "field").agg(F.max_by(F.struct("value"), F.struct("ts_us", "seq")).alias("v")).select("user_id", "field", F.col("v.value").alias("value"))


@query("SELECT user_id, arg_max(event_type, event_id) <> 'error' AS active FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id")
def sessions_active(spark, sf):
    """Whether each session's last create or delete event is a create."""
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("create")
    events = table(spark, sf, "events").filter("event_type IN ('signup', 'error')")
    return state.sessions(events.select(F.col("user_id").alias("session"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))).withColumnRenamed("session", "user_id")


@query("SELECT source, arg_min(text, {'r': CASE WHEN lang = 'fr' THEN 0 WHEN lang IS NULL THEN 1 ELSE 2 END, 'd': doc_id}) AS label FROM documents GROUP BY source")
def label_pick(spark, sf):
    """A label of each subject: the language asked for, else one without a language, else the first."""
    docs = table(spark, sf, "documents")
    triples = docs.select(F.lit("f").alias("file"), F.col("source").alias("s"), F.lit(rdf.RDFS + "label").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), "lang", F.col("doc_id").alias("ord"))
    return rdf.labels(triples, "fr").select(F.col("s").alias("source"), "label")


def part_rdf(spark, sf):
    """An RDF/XML file for each part type: its parts as classes with labels and restrictions."""
    parts = table(spark, sf, "part").filter("p_partkey IS NOT NULL")
    key = F.col("p_partkey").cast("string")
    one = F.concat(
        F.lit('<owl:Class rdf:about="http://e.org/o/P'), key, F.lit('"><rdfs:label xml:lang="en">'), F.col("p_name"), F.lit(" "), key,
        F.lit('</rdfs:label><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://e.org/o/has"/><owl:minQualifiedCardinality rdf:datatype="http://www.w3.org/2001/XMLSchema#int">'),
        F.col("p_size").cast("string"), F.lit('</owl:minQualifiedCardinality><owl:onClass rdf:resource="http://e.org/o/P1"/></owl:Restriction></rdfs:subClassOf></owl:Class>'),
    )
    head = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" '
        'xmlns:e="http://e.org/o/"><owl:Ontology rdf:about="http://e.org/o/"/><owl:ObjectProperty rdf:about="http://e.org/o/has"><rdfs:label>has it</rdfs:label></owl:ObjectProperty>'
    )
    files = parts.groupBy("p_type", (F.col("p_partkey") % 8).alias("k")).agg(F.array_join(F.collect_list(one), "").alias("body"))
    return files.select(F.concat_ws("/", "p_type", "k").alias("file"), F.encode(F.concat(F.lit(head), "body", F.lit("</rdf:RDF>")), "UTF-8").alias("content"))


@query("""
SELECT p_type || '/' || (p_partkey % 8) AS file, 'e:P' || p_partkey AS technical_name, p_name || ' ' || p_partkey AS name, 'has it' AS property, 'minQualified' AS operator, CAST(p_size AS VARCHAR) AS value,
  CASE WHEN p_type || '/' || (p_partkey % 8) = (SELECT p_type || '/' || (p_partkey % 8) FROM part WHERE p_partkey = 1) THEN (SELECT p_name || ' 1' FROM part WHERE p_partkey = 1) ELSE 'e:P1' END AS qualifier FROM part
""")
def rdf_classes(spark, sf):
    """Classes of RDF/XML files with compact names, labels and decoded restriction rules."""
    classes = rdf.ontology(rdf.read_xml(part_rdf(spark, sf)))["classes"]
    return classes.select("file", "technical_name", "name", F.explode("rules").alias("r")).select("file", "technical_name", "name", "r.property", "r.operator", "r.value", "r.qualifier")


def part_rdf_text(spark, sf, suffix: str, head: str, one: str, between: str, tail: str):
    """part_rdf() in another format: ``one`` is a part, with its key, name and size for {key}, {name} and {size}."""
    parts = table(spark, sf, "part").filter("p_partkey IS NOT NULL")
    item = F.lit(one)
    for mark, value in (("{key}", F.col("p_partkey").cast("string")), ("{name}", F.col("p_name")), ("{size}", F.col("p_size").cast("string"))):
        item = F.replace(item, F.lit(mark), value)
    files = parts.groupBy("p_type", (F.col("p_partkey") % 8).alias("k")).agg(F.array_join(F.collect_list(item), between).alias("body"))
    return files.select(F.concat(F.concat_ws("/", "p_type", "k"), F.lit(suffix)).alias("file"), F.encode(F.concat(F.lit(head), "body", F.lit(tail)), "UTF-8").alias("content"))


def rules_of(rows):
    classes = rdf.ontology(rows)["classes"]
    classes = classes.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("file"), "technical_name", "name", F.explode("rules").alias("r"))
    return classes.select("file", "technical_name", "name", "r.property", "r.operator", "r.value", "r.qualifier")


@query(ORACLES["rdf_classes"])
def rdf_classes_turtle(spark, sf):
    """The classes of rdf_classes from Turtle files: prefixes, property lists in brackets, abbreviated numbers."""
    head = """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
PREFIX owl: <http://www.w3.org/2002/07/owl#>
@prefix e: <http://e.org/o/> . @base <http://e.org/> .
<o/> a owl:Ontology . # the base
e:has a owl:ObjectProperty ; rdfs:label "has it" .
"""
    one = """e:P{key} a owl:Class ; rdfs:label "{name} {key}"@en ;
  rdfs:subClassOf [ a owl:Restriction ; owl:onProperty <o/has> ; owl:minQualifiedCardinality {size} ; owl:onClass e:P1 ] .
"""
    return rules_of(rdf.read_rdf(part_rdf_text(spark, sf, ".ttl", head, one, "", "")))


@query(ORACLES["rdf_classes"])
def rdf_classes_n3(spark, sf):
    """The classes of rdf_classes from N3 files, with statements that only N3 has."""
    head = """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix e: <http://e.org/o/> .
owl:Ontology is a of e: . e:has has a owl:ObjectProperty ; rdfs:label '''has it''' .
"""
    one = """e:P{key} a owl:Class ; rdfs:label "{name} {key}"@en . _:r{key} a owl:Restriction .
_:r{key} owl:minQualifiedCardinality "{size}" ; owl:onProperty e:has ; owl:onClass e:P1 ; is rdfs:subClassOf of e:P{key} .
"""
    return rules_of(rdf.read_rdf(part_rdf_text(spark, sf, ".n3", head, one, "", "")))


@query(ORACLES["rdf_classes"])
def rdf_classes_jsonld(spark, sf):
    """The classes of rdf_classes from JSON-LD files: terms of a context, keyword aliases, coerced values, nodes without an id."""
    head = """{"@context": {"rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "e": "http://e.org/o/", "id": "@id", "a": "@type",
 "label": {"@id": "rdfs:label", "@language": "en"}, "sub": {"@id": "rdfs:subClassOf", "@type": "@id"}, "on": {"@id": "owl:onProperty", "@type": "@id"}, "class": {"@id": "owl:onClass", "@type": "@id"}},
"@graph": [{"id": "http://e.org/o/", "a": "owl:Ontology"}, {"id": "e:has", "a": "owl:ObjectProperty", "rdfs:label": "has it"},
"""
    one = """{"id": "e:P{key}", "a": "owl:Class", "label": "{name} {key}", "sub": {"a": "owl:Restriction", "on": "e:has", "owl:minQualifiedCardinality": {size}, "class": "e:P1"}}"""
    return rules_of(rdf.read_rdf(part_rdf_text(spark, sf, ".jsonld", head, one, ",\n", "]}")))


@query("""
SELECT p_type || '/' || (p_partkey % 8) AS file, 'http://e.org/o/' AS base, CAST(3 + 7 * count(*) AS BIGINT) AS triples, CAST(count(*) AS BIGINT) AS nodes, CAST(1 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS properties FROM part GROUP BY ALL
""")
def rdf_files(spark, sf):
    """Base, triples and counts of RDF/XML files."""
    return rdf.ontology(rdf.read_xml(part_rdf(spark, sf)))["files"].select("file", "base", "triples", "nodes", "edges", "properties")
