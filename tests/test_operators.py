import hashlib
import inspect
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import catalog, chunks, identity, merge, recipes, routes, search, state, upsert, validate
from quernel.session import bucketed
from quernel.sources import rdf
from quernel.streaming import state_stream


def edges(spark, rows, status="open", access=("car",)):
    schema = "edge_id string, source string, target string, distance long, time long, status string, access array<string>"
    return spark.createDataFrame([(*r, status, list(access)) if len(r) == 5 else r for r in rows], schema)


def start(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


COST = [("AB", "A", "B", 10, 2), ("AC", "A", "C", 2, 10), ("CB", "C", "B", 2, 10)]


@pytest.mark.parametrize("cost, path", [("distance", ["AC", "CB"]), ("time", ["AB"])])
def test_route_by_cost(spark, cost, path):
    usable = routes.usable_edges(edges(spark, COST), "car").withColumn("cost", F.col(cost))
    paths = routes.shortest_paths(usable, start(spark, "A"))
    assert [r["edge_id"] for r in routes.route(paths, "B").orderBy("index").collect()] == path
    assert routes.route(paths, "A").count() == 0
    assert paths.filter("node = 'A'").first()["cost"] == 0


def test_unusable_edges(spark):
    rows = [("AB", "A", "B", 1, 1, "closed", ["car"]), ("AC", "A", "C", 1, 1, "restricted", ["car"]), ("AD", "A", "D", 1, 1, "open", ["foot"])]
    paths = routes.shortest_paths(routes.usable_edges(edges(spark, rows), "car").withColumn("cost", F.col("distance")), start(spark, "A"))
    assert [r["node"] for r in paths.collect()] == ["A"]


@pytest.mark.parametrize("where, want", [("X", ("B", 1, 1)), ("B", ("B", 0, 1))])
def test_recovery(spark, where, want):
    rows = [("AB", "A", "B", 5, 5), ("BC", "B", "C", 5, 5), ("XB", "X", "B", 1, 1)]
    targets = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2), ("B", 3)], "node string, index int")
    paths = routes.shortest_paths(edges(spark, rows).withColumn("cost", F.col("time")), start(spark, where), targets)
    assert tuple(routes.nearest_target(paths, targets).first()) == want


def test_unreachable(spark):
    empty = edges(spark, []).withColumn("cost", F.col("time"))
    assert routes.shortest_paths(empty, start(spark, "X"), start(spark, "A")).count() == 1


def test_paths_never_end_early(spark):
    chain = edges(spark, [(f"e{i}", f"n{i}", f"n{i + 1}", 1, 1) for i in range(6)]).withColumn("cost", F.col("time"))
    assert inspect.signature(routes.shortest_paths).parameters["max_rounds"].default is None
    with pytest.raises(RuntimeError):
        routes.shortest_paths(chain, start(spark, "n0"), max_rounds=3)
    paths = routes.shortest_paths(chain, start(spark, "n0"))
    assert {r["node"]: r["cost"] for r in paths.collect()} == {f"n{i}": i for i in range(7)}
    assert [tuple(r) for r in routes.route(paths, "n3").orderBy("index").collect()] == [(i, f"e{i}", f"n{i}", f"n{i + 1}") for i in range(3)]


def test_route_of_many_steps(spark):
    n = 10_500
    paths = spark.range(n + 1).select(F.col("id").alias("node"), F.col("id").alias("cost"), F.col("id").cast("int").alias("hops"), F.when(F.col("id") > 0, F.concat(F.lit("e"), "id")).alias("via"), F.when(F.col("id") > 0, F.col("id") - 1).alias("prev"))
    steps = routes.route(paths, n).orderBy("index").collect()
    assert [tuple(r) for r in steps] == [(i, f"e{i + 1}", i, i + 1) for i in range(n)]
    assert routes.route(paths, n + 5).count() == 0
    with pytest.raises(RuntimeError):
        routes.route(paths.filter("node > 0").withColumn("prev", F.when(F.col("node") == 1, n).otherwise(F.col("prev"))).filter("node < 5 OR node = 10500").withColumn("prev", F.when(F.col("node") == n, 4).otherwise(F.col("prev"))), n)


def test_location_search(spark):
    nodes = spark.createDataFrame([("n1", "Hồ Gươm"), ("n2", "Chợ Mơ"), ("n3", "Ga")], "node_id string, name string")
    roads = spark.createDataFrame([("n1", "n2", "Đường Láng"), ("n3", "n2", "Phố Huế")], "source string, target string, road_name string")
    assert [r["node_id"] for r in search.search_locations(nodes, roads, "ho guom").collect()] == ["n1"]
    assert search.search_locations(nodes, roads, "ho guom", min_similarity=1.0).count() == 0
    found = search.search_locations(nodes, roads, "đường lang", "road").collect()
    assert [(r["node_id"], r["target_type"]) for r in found] == [("n1", "road"), ("n2", "road")]


def test_ranked_search_without_terms_keeps_all(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a")], "id int, name string")
    assert [r["id"] for r in search.ranked_search(rows, "id", F.col("name"), F.col("name")).collect()] == [2, 1]
    assert search.ranked_search(rows, "id", F.col("name"), F.col("name"), query="zz").count() == 0


def test_merge_folders(spark):
    files = {"BE": ["be-root", "shared"], "BE/Corporations": ["corporation", "shared"], "BE/Corporations/Nested": ["nested"], "LOAN": ["loan-root", "shared"]}
    rows = [(folder, folder, "class", i, iri, None, None) for folder, names in files.items() for i, iri in enumerate(names)]
    items = spark.createDataFrame(rows, "folder string, file string, kind string, pos int, iri string, technical_name string, name string")
    merged = merge.merge_folders(items)
    got = {r["into"]: r["classes"] for r in merge.merged_summary(merged, items).collect()}
    assert got == {"BE/Corporations/Nested": 1, "BE/Corporations": 3, "BE": 4, "LOAN": 2, "": 5}


def test_keyless_rows_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "id int, iri string")
    assert sorted(r["id"] for r in merge.first_per_key(rows, [], ["id"], merge.identity_key("iri")).collect()) == [1, 3, 4]


def test_chunks(spark):
    docs = spark.createDataFrame([("product.md", "# Product\n\nCode: CARD-001\n"), ("x.md", "intro\n## Empty\n## Two ##\n b\n\n"), ("e.md", "")], "id string, text string")
    got = [tuple(r) for r in chunks.chunk(docs, "id", "text").orderBy("id", "index").collect()]
    assert got == [("product.md", 0, "Product", "Code: CARD-001"), ("x.md", 0, None, "intro"), ("x.md", 1, "Two ##", "b")]


def test_document_status(spark, tmp_path):
    for name, content in {"a.md": b"x", "b.txt": b"  ", "c.md": b"\xff\xfe", "d.bin": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["source"].rsplit("/", 1)[-1]: r["status"] for r in chunks.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "ok", "b.txt": "empty", "c.md": "not_utf8", "d.bin": "unsupported"}


def mini(spark):
    rule = "struct<property: string, operator: string, value: string, qualifier: string>"
    need = [("pskg:productCode", "exactlyQualified", "1", None), ("pskg:status", "some", "Active", None), ("pskg:hasOffer", "some", "x", None)]
    classes = spark.createDataFrame([("pskg:Product", "Product", need), ("pskg:Rule", "Rule", [])], f"technical_name string, name string, rules array<{rule}>")
    rows = [
        ("property", "pskg:productCode", ["Product"], ["xsd:string"]), ("property", "pskg:status", ["Product"], ["xsd:string"]), ("property", "pskg:from", ["Product"], ["xsd:date"]),
        ("property", "pskg:ruleType", ["Rule"], ["xsd:string"]), ("edge", "pskg:hasOffer", ["Product"], ["Rule"]), ("edge", "pskg:hasEligibilityRule", ["Product"], ["Rule"]),
    ]
    return classes, spark.createDataFrame(rows, "kind string, technical_name string, domain array<string>, `range` array<string>")


def patch(spark, nodes, links):
    rows = [(1, i, t, c, json.dumps(p)) for i, (t, c, p) in enumerate(nodes)]
    n = spark.createDataFrame(rows, "patch_id int, ord long, temp_id string, class_name string, p string").withColumn("properties", F.parse_json("p")).drop("p")
    e = spark.createDataFrame([(1, i, *x) for i, x in enumerate(links)], "patch_id int, ord long, edge_name string, source_temp_id string, target_temp_id string")
    return n, e


def test_valid_patch(spark):
    nodes = [("p", "pskg:Product", {"pskg:productCode": "C", "pskg:status": ["Active"], "pskg:from": "2026-08-01"}), ("r", "pskg:Rule", {"pskg:ruleType": "ELIGIBILITY"})]
    n, e = patch(spark, nodes, [("pskg:hasOffer", "p", "r"), ("pskg:hasEligibilityRule", "p", "r")])
    found = validate.validate_patches(n, e, *mini(spark))
    assert found.count() == 0
    assert validate.patch_reports(n, e, found).first()["valid"]


def test_patch_violations(spark):
    nodes = [("p", "pskg:Product", {"pskg:productCode": [], "pskg:from": "2026-08", "pskg:ruleType": "x", "pskg:nope": 1}), ("q", "pskg:Nope", {}), ("r", "pskg:Rule", {"pskg:ruleType": 5})]
    n, e = patch(spark, nodes, [("pskg:hasEligibilityRule", "p", "r"), ("pskg:hasOffer", "r", "p"), ("pskg:hasOffer", "p", "zz"), ("pskg:what", "p", "r")])
    got = [r["message"] for r in validate.validate_patches(n, e, *mini(spark)).collect()]
    assert sorted(got[:8]) == sorted([
        "Node p: Invalid datatype for pskg:from: expected ['xsd:date'], got str", "Node p: Property pskg:ruleType does not belong to class pskg:Product", "Node p: Unknown ontology property: pskg:nope",
        "Node p: Missing required property: pskg:productCode", "Node p: Missing required property: pskg:status", "Node q: Unknown ontology class: pskg:Nope",
        "Node r: Invalid datatype for pskg:ruleType: expected ['xsd:string'], got int", "Edge pskg:hasEligibilityRule: Edge pskg:hasEligibilityRule requires target pskg:ruleType=ELIGIBILITY; got 5",
    ])
    assert got[8:] == [
        "Edge pskg:hasOffer: Invalid edge domain for pskg:hasOffer: pskg:Rule is not allowed", "Edge pskg:hasOffer: Invalid edge range for pskg:hasOffer: pskg:Product is not allowed",
        "Edge pskg:hasOffer: targetTempId zz does not exist", "Edge pskg:what: Unknown ontology edge: pskg:what",
    ]


def test_reports_count_violations(spark):
    n, e = patch(spark, [("p", "pskg:Product", {}), ("q", "pskg:Nope", {})], [])
    found = validate.validate_patches(n, e, *mini(spark))
    row = validate.patch_reports(n, e, found).first()
    assert (row["valid"], row["errors"], row["node_count"], row["edge_count"]) == (False, found.count(), 2, 0)


def test_fill_reports_every_violation(spark, tmp_path):
    bad = spark.range(1005).select(F.concat(F.lit("m"), "id").alias("message"))
    for violations, refusals, stage in ((bad, bad.limit(0), "ontology_validation"), (bad.limit(0), bad, "persistence")):
        got = upsert.fill(violations, refusals, {}, str(tmp_path / "out"))
        assert (got["success"], got["stage"], got["error_count"], got["errors_are_excerpt"]) == (False, stage, 1005, True)
        assert {r["message"] for r in got["error_table"].collect()} == {f"m{i}" for i in range(1005)}
    assert not upsert.fill(bad.limit(3), bad, {}, "-")["errors_are_excerpt"]


def test_identity(spark):
    rows = [("a", "pskg:BankingProduct", {"pskg:productCode": "  CARD-001  "}, "s"), ("b", "x:Note", {"b": 1, "a": " y  z "}, " f "), ("c", "x:Note", {"a": "y z", "b": 1}, "f"), ("d", "x:Note", {}, None), ("e", "pskg:BankingProduct", {}, "s")]
    nodes = spark.createDataFrame([(t, c, json.dumps(p), s) for t, c, p, s in rows], "temp_id string, class_name string, p string, source_scope string").withColumn("properties", F.parse_json("p"))
    got = {r["temp_id"]: (r["strategy"], r["key_value"]) for r in identity.resolve(nodes).collect()}
    assert got["a"] == ("natural_key", "CARD-001")
    assert got["b"] == got["c"] and got["b"][0] == "source_scoped"
    assert (got["d"], got["e"]) == (("unresolved", None), ("error", None))
    assert {r["temp_id"] for r in upsert.refused(identity.resolve(nodes)).collect()} == {"d", "e"}


def test_identity_policy(spark):
    classes, properties = mini(spark)
    got = [r["message"] for r in identity.policy_violations(classes, properties, {"pskg:Product": "pskg:ruleType", "pskg:No": "x", "pskg:Rule": "y"}).collect()]
    assert sorted(got) == ["Identity policy references unknown class: pskg:No", "Identity policy references unknown property: y", "Identity property pskg:ruleType does not belong to class pskg:Product"]


def test_fill_is_all_or_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "message string")
    bad = spark.createDataFrame([("m",)], "message string")
    tables = {"nodes": spark.range(3), "edges": spark.range(2)}
    path = str(tmp_path / "graph")
    assert upsert.fill(bad, none, tables, path)["stage"] == "ontology_validation"
    assert upsert.fill(none, bad, tables, path)["stage"] == "persistence"
    for _ in range(2):
        assert upsert.fill(none, none, tables, path) == {"success": True, "stage": "completed", "errors": []}
    assert spark.read.parquet(path + "/nodes").count() == 3


def test_dangling_edges_are_reported(spark):
    links = spark.createDataFrame([(1, "x:e", "a", "b"), (1, "x:e", "a", "z")], "patch_id int, edge_name string, source_temp_id string, target_temp_id string")
    ids = spark.createDataFrame([(1, "a", "A"), (1, "b", "B")], "patch_id int, temp_id string, stored_id string")
    good, dangling = upsert.stored_edges(links, ids)
    assert [tuple(r) for r in good.collect()] == [("A", "x:e", "B")] and dangling.count() == 1


def test_recipes(spark, tmp_path):
    (tmp_path / "list_1.json").write_text(json.dumps({"data": [{"id": "a", "name": "old"}, {"id": "b", "name": "b", "tags": ["x"], "meta": {"total_time": "PT5M"}}]}))
    (tmp_path / "list_2.json").write_text(json.dumps({"data": [{"id": "a", "name": "new"}]}))
    (tmp_path / "a_recipe.json").write_text(json.dumps({"id": "a", "meta": {"yield_count": 4}, "ingredients": [{"group_name": "g", "items": [{"name": "n", "quantity": 100, "unit": "g"}]}]}))
    assert [(r["id"], r["name"]) for r in recipes.read_dishes(spark, str(tmp_path)).collect()] == [("a", "new"), ("b", "b")]
    row = recipes.scale_recipe(recipes.read_recipes(spark, str(tmp_path)), 6).first()
    assert (row["scale_factor"], row["ingredients"][0]["items"][0]["quantity"], row["ingredients"][0]["items"][0]["unit"]) == (1.5, 150.0, "g")
    with pytest.raises(ValueError):
        recipes.scale_recipe(recipes.read_recipes(spark, str(tmp_path)), 0)


def test_state_fold(spark):
    rows = [("s", 1, 1, '{"mode": "a", "criteria": {"x": 1, "y": 2}}'), ("s", 2, 1, '{"mode": null}'), ("s", 3, 1, '{"criteria": {"x": 5}}')]
    events = spark.createDataFrame(rows, "session string, ts int, seq int, d string").withColumn("delta", F.parse_json("d"))
    folded = state.fold(state.nested_changes(state.field_changes(events), ["criteria"]))
    got = {r["field"]: r["value"]["json"] for r in folded.collect()}
    assert got == {"mode": "null", "criteria.x": "5", "criteria.y": "2"} or got == {"mode": None, "criteria.x": "5", "criteria.y": "2"}
    full = state.with_defaults(folded, events, {"mode": '"d"', "step": "0"})
    assert {r["field"]: r["value"]["json"] for r in full.collect()}["step"] == "0"


def test_late_events_in_the_stream_do_not_overwrite(spark, tmp_path):
    schema = "user_id long, field string, ts_us long, seq long, value double"
    for i, row in enumerate([(1, "f", 10, 1, 1.0), (1, "f", 5, 2, 2.0), (1, "f", 10, 3, None)]):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    state_stream.run_to_end(state_stream.fold_stream(stream), str(tmp_path / "cp"), lambda df, epoch: df.write.mode("overwrite").parquet(str(tmp_path / f"out/epoch={epoch}")))
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("ts_us"), F.desc("seq")).first()
    assert (last["ts_us"], last["seq"], last["value"]) == (10, 3, None)


def test_ntriples(spark):
    lines = ['<http://e/a> <http://e/p> "x \\"y\\""@en .', "_:b1 <http://e/p> <http://e/c> .", '<http://e/a> <http://e/q> "5"^^<http://www.w3.org/2001/XMLSchema#int> .', "# no"]
    rows = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, ord long, value string")
    got = [tuple(r) for r in rdf.read_ntriples(rows).orderBy("ord").select("s", "s_kind", "o", "o_kind", "lang").collect()]
    assert got == [("http://e/a", "iri", 'x "y"', "literal", "en"), ("b1", "bnode", "http://e/c", "iri", None), ("http://e/a", "iri", "5", "literal", None)]


def test_rdf_scan(spark, tmp_path):
    body = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns="http://e/o/">{}</rdf:RDF>'
    (tmp_path / "a.rdf").write_text(body.format('<owl:Ontology rdf:about="http://e/o/"/><owl:Class rdf:about="http://e/o/BigLoan"><owl:equivalentClass><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Restriction><owl:onProperty rdf:resource="http://e/o/hasIt"/><owl:someValuesFrom rdf:resource="http://e/o/BigLoan"/></owl:Restriction><rdf:Description rdf:about="http://e/o/X"/></owl:unionOf></owl:Class></owl:equivalentClass></owl:Class>'))
    (tmp_path / "MetadataA.rdf").write_text("broken")
    tables = rdf.ontology(rdf.read_xml(rdf.scan_files(spark, str(tmp_path))))
    row = tables["classes"].first()
    assert (row["name"], row["technical_name"]) == ("big loan", ":BigLoan")
    assert [tuple(r) for r in row["rules"]] == [("has it", "some", "big loan", None)]


def test_catalog(spark):
    classes, properties = mini(spark)
    classes = classes.withColumn("definition", F.lit(None).cast("string"))
    text = {r["class"]: r["context"] for r in catalog.class_context(classes, properties).collect()}
    block = text["pskg:Product"].split("\n")
    assert block[0] == "CLASS: pskg:Product" and block[2] == "DEFINITION: None" and block[-1] == "" and "PROPERTIES:" in block and "OUTGOING EDGES:" in block
    assert [line.split(" | ")[0] for line in block if line.startswith("  - pskg:from") or line.startswith("  - pskg:productCode | r")] == ["  - pskg:from", "  - pskg:productCode"]
    stored = {r["technical_name"]: r["stored"] for r in catalog.storage_names(classes, properties).collect()}
    assert (stored["pskg:hasOffer"], stored["pskg:from"], stored["pskg:Rule"]) == ("HAS_OFFER", "from", "Rule")
    terms = spark.createDataFrame([("pskg:Rule",), ("no",)], "term string")
    assert {r["term"]: r["is_class"] for r in catalog.exists(terms, classes, properties).collect()} == {"pskg:Rule": True, "no": False}


EVIDENCE = {"evidence": [{"source": "s", "text": "t"}], "confidence": 0.5}


def test_patch_documents(spark):
    good = {"nodes": [{"tempId": "p", "className": "pskg:Product", "properties": {"pskg:productCode": "C", "pskg:status": "Active"}, **EVIDENCE}, {"tempId": "r", "className": "pskg:Rule", "properties": {}, **EVIDENCE}], "edges": [{"edgeName": "pskg:hasOffer", "sourceTempId": "p", "targetTempId": "r", **EVIDENCE}]}
    bad = {"nodes": [{"className": "x", "confidence": 2.0}], "edges": [{"edgeName": "e", "sourceTempId": "p"}]}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "[1"), (4, None)], "patch_id int, document string")
    nodes, links, errors = validate.parse_patches(rows)
    assert [tuple(r) for r in errors.orderBy("patch_id", "ord").collect()] == [
        (2, 0, "nodes.0.tempId", "Field required"), (2, 1, "nodes.0.properties", "Field required"), (2, 2, "nodes.0.evidence", "Field required"), (2, 3, "nodes.0.confidence", "Input should be less than or equal to 1"),
        (2, 4, "edges.0.targetTempId", "Field required"), (2, 5, "edges.0.evidence", "Field required"), (2, 6, "edges.0.confidence", "Field required"), (3, 0, "", "not a JSON object"), (4, 0, "", "not a JSON object"),
    ]
    assert validate.validate_patches(nodes.filter("patch_id = 1"), links.filter("patch_id = 1"), *mini(spark)).count() == 0
    found = {r["patch_id"]: tuple(r)[1:] for r in validate.patch_envelopes(rows, *mini(spark)).collect()}
    assert found[1] == (True, [], 2, 1, 0) and found[4] == (False, ["not a JSON object"], 0, 0, 0)
    assert found[2][0] is False and found[2][1][0] == "nodes.0.tempId: Field required" and found[2][2:] == (0, 0, 0)


def test_patch_documents_are_parsed_once(spark):
    node = {"tempId": "p", "className": "pskg:Ghost", "properties": {}, **EVIDENCE}
    rows = [(1, json.dumps({"nodes": [node], "edges": []})), (2, json.dumps({"nodes": [], "edges": []})), (3, "{}"), (None, "[1")]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(document):
        read.add(1)
        return document

    documents = spark.createDataFrame(rows, "patch_id int, document string").withColumn("document", counted.asNondeterministic()("document"))
    found = {r["patch_id"]: tuple(r)[1:] for r in validate.patch_envelopes(documents, *mini(spark)).collect()}
    assert found[1] == (False, ["Node p: Unknown ontology class: pskg:Ghost"], 1, 0, 0) and found[2] == (True, [], 0, 0, 0)
    assert found[3] == (False, ["nodes: Field required", "edges: Field required"], 0, 0, 0) and found[None] == (False, ["not a JSON object"], 0, 0, 0)
    assert read.value == len(rows)


CASES = [  # (what is wrong, where, message)
    ({"tempId": 7}, "nodes.0.tempId", "Input should be a valid string"), ({"className": None}, "nodes.0.className", "Input should be a valid string"), ({"properties": []}, "nodes.0.properties", "Input should be a valid dictionary"),
    ({"evidence": {}}, "nodes.0.evidence", "Input should be a valid list"), ({"evidence": [1]}, "nodes.0.evidence.0", "Input should be a valid dictionary or instance of Evidence"),
    ({"evidence": [{"source": "s", "text": "t"}, {"source": "s", "text": "t", "section": 3}]}, "nodes.0.evidence.1.section", "Input should be a valid string"), ({"evidence": [{"source": "s", "text": "t", "section": None}]}, None, None),
    ({"evidence": [{"source": "s"}]}, "nodes.0.evidence.0.text", "Field required"), ({"confidence": "abc"}, "nodes.0.confidence", "Input should be a valid number, unable to parse string as a number"),
    ({"confidence": None}, "nodes.0.confidence", "Input should be a valid number"), ({"confidence": [1]}, "nodes.0.confidence", "Input should be a valid number"), ({"confidence": "0.5"}, None, None), ({"confidence": " 1e-1 "}, None, None), ({"confidence": True}, None, None),
    ({"confidence": "1d"}, "nodes.0.confidence", "Input should be a valid number, unable to parse string as a number"), ({"confidence": -0.5}, "nodes.0.confidence", "Input should be greater than or equal to 0"), ({"confidence": "2"}, "nodes.0.confidence", "Input should be less than or equal to 1"),
    ({"confidence": 1}, None, None), ({"confidence": 10**30}, "nodes.0.confidence", "Input should be less than or equal to 1"), ({"more": 1}, None, None), ({"evidence": []}, None, None),
]


def test_every_schema_error(spark):
    node = {"tempId": "p", "className": "c", "properties": {"a": 1}, **EVIDENCE}
    documents = [(i, json.dumps({"nodes": [{**node, **change}], "edges": []})) for i, (change, _, _) in enumerate(CASES)]
    documents += [(100, json.dumps({"nodes": ["x", node], "edges": None, "warnings": ["a", 1]})), (101, "{}"), (102, json.dumps({"nodes": 5, "edges": [], "warnings": None}))]
    found = {}
    for r in validate.schema_errors(spark.createDataFrame(documents, "patch_id int, document string")).orderBy("patch_id", "ord").collect():
        found.setdefault(r["patch_id"], []).append((r["place"], r["message"]))
    for i, (_, place, message) in enumerate(CASES):
        assert found.get(i, []) == ([(place, message)] if place else []), CASES[i]
    assert found[100] == [("nodes.0", "Input should be a valid dictionary or instance of ExtractedNode"), ("edges", "Input should be a valid list"), ("warnings.1", "Input should be a valid string")]
    assert found[101] == [("nodes", "Field required"), ("edges", "Field required")] and found[102] == [("nodes", "Input should be a valid list"), ("warnings", "Input should be a valid list")]


def test_identity_wording(spark):
    rows = [("a", "pskg:Ghost", "{}", "s"), ("b", "pskg:BankingProduct", "{}", "s"), ("c", "pskg:BankingProduct", '{"pskg:productCode": "  "}', "s"), ("d", "x:Note", "{}", None), ("e", "x:Note", '{"z": [" a  b ", {"k": "\\u00e9 "}], "a": 1}', " f ")]
    nodes = spark.createDataFrame(rows, "temp_id string, class_name string, p string, source_scope string").withColumn("properties", F.parse_json("p"))
    classes = spark.createDataFrame([("pskg:BankingProduct",), ("x:Note",)], "technical_name string")
    got = {r["temp_id"]: r for r in identity.resolve(nodes, classes=classes).collect()}
    assert got["a"]["reason"] == "Unknown ontology class: pskg:Ghost"
    assert got["b"]["reason"] == "Missing identity property pskg:productCode for class pskg:BankingProduct"
    assert got["c"]["reason"] == "Identity property pskg:productCode is empty for class pskg:BankingProduct"
    assert got["d"]["reason"] == "No natural identity policy and no source scope available for class x:Note"
    text = '{"class":"x:Note","properties":{"a":1,"z":["a b",{"k":"é"}]},"source":"f"}'
    assert (got["e"]["key_name"], got["e"]["key_value"]) == ("_ingestionKey", hashlib.sha256(text.encode()).hexdigest())
    assert "Cannot safely upsert x:Note: No natural identity policy and no source scope available for class x:Note" in {r["message"] for r in upsert.refused(identity.resolve(nodes, classes=classes)).collect()}


def test_text_files_are_one_chunk(spark):
    rows = [("a.txt", "intro\n# Head\nbody\n".encode()), ("b.MD", "intro\n# Head\nbody\n".encode()), ("c.txt", "\u00a0\n".encode()), ("d.txt", "\ufeffx".encode()), ("product.md", b"# Product\n\nCode: CARD-001\n")]
    files = chunks.decode_documents(spark.createDataFrame(rows, "source string, content binary"))
    assert {r["source"]: r["status"] for r in files.collect()} == {"a.txt": "ok", "b.MD": "ok", "c.txt": "empty", "d.txt": "ok", "product.md": "ok"}
    got = {(r["id"], r["index"], r["section"], r["content"]) for r in chunks.chunk_documents(files.filter("status = 'ok'")).collect()}
    assert got == {("a.txt", 0, None, "intro\n# Head\nbody"), ("b.MD", 0, None, "intro"), ("b.MD", 1, "Head", "body"), ("d.txt", 0, None, "\ufeffx"), ("product.md", 0, "Product", "Code: CARD-001")}
    context = {r["id"]: r["context"] for r in chunks.document_context(chunks.chunk_documents(files.filter("status = 'ok'"))).collect()}
    assert context["b.MD"] == "[CHUNK 0]\nSOURCE: b.MD\nSECTION: N/A\nintro\n\n[CHUNK 1]\nSOURCE: b.MD\nSECTION: Head\nbody"


@pytest.mark.parametrize("delta", [None, 3])
def test_shortest_paths_in_any_graph(spark, delta, monkeypatch):
    """Against a plain relaxation over random edges with zero costs, circles, parallel edges and unreachable nodes."""
    rng = np.random.default_rng(11)
    edges = [(f"e{i}", int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(0, 9, 150)))]
    edges += [(f"c{i}", 100 + i, 101 + i, 1) for i in range(8)] + [("in", 0, 100, 0), ("away", 200, 0, 1)]
    monkeypatch.setattr(routes, "COMPACT_AFTER", 3)
    best = {0: (0, 0, "")}
    changed = True
    while changed:
        changed = False
        for name, a, b, c in edges:
            if a in best:
                offer = (best[a][0] + c, best[a][1] + 1, name)
                if b not in best or offer < best[b]:
                    best[b], changed = offer, True
    table = spark.createDataFrame(edges, "edge_id string, source long, target long, cost long")
    starts = spark.createDataFrame([(0,), (0,)], "node long")
    found = {r["node"]: (r["cost"], r["hops"], r["via"] or "") for r in routes.shortest_paths(table, starts, delta=delta).collect()}
    assert found == best
    targets = spark.createDataFrame([(n,) for n in (105, 107, 999)], "node long")
    paths = routes.shortest_paths(table, starts, targets, delta=delta)
    assert paths.filter("node = 105").first()["cost"] == best[105][0]


def test_edges_are_shuffled_once(spark, capsys):
    links = bucketed(spark.range(1000).selectExpr("id AS source", "id + 1 AS target"), "source")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spark.range(100).withColumnRenamed("id", "node").join(links, F.col("node") == F.col("source")).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # of the nodes


def test_stream_folds_without_python(spark, tmp_path):
    stream = spark.readStream.schema("user_id long, field string, ts_us long, seq long, value double").parquet(str(tmp_path))
    from quernel.streaming import state_stream

    folded = state_stream.fold_stream(stream)
    assert folded.columns == ["user_id", "field", "ts_us", "seq", "value"]
    assert "Pandas" not in folded._jdf.queryExecution().analyzed().toString()
