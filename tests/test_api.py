from pyspark.sql import Row
from pyspark.sql import functions as F

from quernel import api
from quernel.operators.recipes import DISH
from quernel.session import materialize
from tests.test_operators import COST, edges


def dishes(spark):
    rows = [
        ("a", "Phở bò", "beef soup", "Soup", "Việt", "easy", ["hot", "Beef"], Row(active_time=None, passive_time=None, total_time="PT1H", overnight_required=None, yields=None, yield_count=4, serving_size_g=None), Row(flags=["gluten free"], not_suitable_for=None), None),
        ("b", "Salad", "cold", "Salad", "French", "easy", [], Row(active_time=None, passive_time=None, total_time="PT10M", overnight_required=None, yields=None, yield_count=2, serving_size_g=None), Row(flags=[], not_suitable_for=None), None),
    ]
    return spark.createDataFrame(rows, DISH)


def test_dish_search(spark):
    ids = lambda r: [x["id"] for x in r["dishes"].collect()]
    table = dishes(spark)
    assert ids(api.search_dishes(table, query="PHO beef")) == ["a"]
    assert ids(api.search_dishes(table, cuisine="viet", dietary=["Gluten Free"], tags=["beef"])) == ["a"]
    assert ids(api.search_dishes(table, difficulty="easy")) == ["a", "b"]
    assert ids(api.search_dishes(table, maximum_total_time=30)) == ["b"]
    for code, arguments in {"INVALID_TOP_K": {"top_k": 21, "query": "x"}, "INVALID_MAXIMUM_TIME": {"maximum_total_time": -1}, "INVALID_SEARCH": {"query": " "}}.items():
        assert api.search_dishes(table, **arguments)["errorCode"] == code


def test_recipe_errors(spark):
    table = spark.createDataFrame([("a", Row(total_time=None, yield_count=None), [])], "id string, meta struct<total_time: string, yield_count: int>, ingredients array<struct<group_name: string, items: array<struct<name: string, quantity: double>>>>")
    codes = [api.recipe_details(table, " ")["errorCode"], api.recipe_details(table, "z")["errorCode"], api.scale_recipe(table, "a", 0)["errorCode"], api.scale_recipe(table, "a", 2)["errorCode"]]
    assert codes == ["INVALID_DISH_ID", "RECIPE_NOT_FOUND", "INVALID_SERVINGS", "INVALID_RECIPE"]


def test_routes(spark):
    table = edges(spark, COST).selectExpr("*", "10 AS heading")
    nodes = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")], "node_id string, name string")
    found = api.find_route(nodes, table, "A", "B", optimization="shortest_distance")
    assert [(r["edge_id"], r["turn"]) for r in found["steps"].orderBy("index").collect()] == [("AC", "start"), ("CB", "straight")]
    assert api.find_route(nodes, table, "A", "A")["steps"].count() == 0
    assert api.find_route(nodes, table, "A", "D")["errorCode"] == "NO_ROUTE"
    assert api.find_route(nodes, table, "A", "Z")["errorCode"] == "NODE_NOT_FOUND"
    assert api.find_route(nodes, table, "A", "B", access="x")["errorCode"] == "INVALID_ACCESS"
    assert api.find_recovery_route(nodes, table, "A", ["D", "C", "B"], 1)["resume_index"] == 2
    assert api.find_recovery_route(nodes, table, "D", ["A", "B"], 0)["errorCode"] == "NO_RECOVERY_ROUTE"
    assert api.search_locations(nodes, table, " ")["errorCode"] == "INVALID_QUERY"


def test_route_answer(spark, tmp_path):
    """A navigation document as tables, and the whole answer for a route over it."""
    import json

    from quernel.sources import navigation

    edge = lambda i, to, heading, **more: {"id": i, "to": to, "roadName": f"road {i}", "distance": 5, "time": 5, "heading": heading, "status": "open", "access": ["car"], "toll": False} | more
    document = {"metadata": {"name": "x"}, "nodes": {n: {"name": n.lower(), "type": "t", "lat": 1.0, "lng": 2.0, "level": 0} for n in "ABC"}, "graph": {"A": [edge("AB", "B", 10, toll=True), edge("AC", "C", 0, status="closed")], "B": [edge("BC", "C", 100, toll=True)], "C": []}}
    (tmp_path / "graph.json").write_text(json.dumps(document))
    nodes, keys, edges = navigation.read_graph(spark, str(tmp_path / "graph.json"))
    assert {r["node"] for r in keys.collect()} == {"A", "B", "C"}
    got = api.find_route(nodes, edges, "A", "C")
    assert (got["success"], got["start"], got["end"], got["optimization"], got["total_distance"], got["total_time"]) == (True, "A", "C", "fastest_time", 10, 10)
    assert got["warnings"] == ["Có phí: road AB", "Có phí: road BC"] and len(got["route_id"]) == 36
    steps = sorted(got["steps"].collect(), key=lambda r: r["index"])
    assert [(r["from_node"]["id"], r["to_node"]["name"], r["edge_id"], r["turn"]) for r in steps] == [("A", "b", "AB", "start"), ("B", "c", "BC", "right")]
    same = api.find_route(nodes, edges, "A", "A")
    assert (same["success"], same["total_distance"], same["steps"].count(), same["warnings"]) == (True, 0, 0, [])


def test_searches_share_placed_edges_and_paths(spark, monkeypatch):
    from quernel.operators import routes

    written, searched = [], []
    write, search = routes.bucketed, routes.shortest_paths
    monkeypatch.setattr(routes, "bucketed", lambda df, key: written.append(key) or write(df, key))
    monkeypatch.setattr(routes, "shortest_paths", lambda *a, **k: searched.append(1) or search(*a, **k))
    table = routes.by_source(edges(spark, COST).selectExpr("*", "10 AS heading"))
    nodes = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")], "node_id string, name string")
    paths = routes.shortest_paths(routes.usable_edges(table, "car").withColumn("cost", table["distance"]), nodes.filter("node_id = 'A'").selectExpr("node_id AS node"), placed=True)
    found = api.find_route(nodes, table, "A", "B", "car", "shortest_distance", True, paths)
    assert [r["edge_id"] for r in found["steps"].orderBy("index").collect()] == ["AC", "CB"]
    assert api.find_route(nodes, table, "A", "D", "car", "shortest_distance", True, paths)["errorCode"] == "NO_ROUTE"
    back = api.find_recovery_route(nodes, table, "A", ["A", "B"], 1, "car", "shortest_distance", True)
    assert (back["end"], back["total_distance"], back["resume_index"]) == ("B", found["total_distance"], 1)
    assert (written, len(searched)) == (["source"], 2)


def listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def executions(spark) -> set[int]:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return {x.executionId() for x in listed(spark._jsparkSession.sharedState().statusStore().executionsList())}


def broadcast_rows(spark, ran_before: set[int]) -> list[int]:
    """Rows of what SQL executions broadcast, but for those that ``ran_before``."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), []
    for ran in executions(spark) - ran_before:
        values = store.executionMetrics(ran)
        for node in listed(store.planGraph(ran).allNodes()):
            if node.name() == "BroadcastExchange":
                found = [values.get(m.accumulatorId()) for m in listed(node.metrics()) if m.name() == "number of output rows"]
                rows += [int(v.get().replace(",", "")) for v in found if v.isDefined()]
    return rows


def test_no_table_of_nodes_is_broadcast(spark):
    """Ids in order are a few bytes each in files, below Spark's threshold, and far more where the driver builds a broadcast."""
    n = 60_000
    leaves = spark.range(n).select(F.concat(F.lit("L"), "id").alias("leaf"))
    more = {"distance": F.lit(1).cast("long"), "time": F.lit(1).cast("long"), "status": F.lit("open"), "access": F.array(F.lit("car")), "heading": F.lit(10)}
    table = leaves.select(F.col("leaf").alias("edge_id"), F.lit("A").alias("source"), F.col("leaf").alias("target")).union(spark.sql("SELECT 'last', 'L7', 'Z'")).withColumns(more)
    nodes = materialize(leaves.union(spark.sql("SELECT * FROM VALUES ('A'), ('Z')")).select(F.col("leaf").alias("node_id"), F.concat(F.lit("n"), "leaf").alias("name")))
    before = executions(spark)
    found = api.find_route(nodes, table, "A", "Z", "car", "shortest_distance")
    steps = found["steps"].orderBy("index").collect()
    assert [(r["edge_id"], r["from_node"]["name"], r["to_node"]["name"]) for r in steps] == [("L7", "nA", "nL7"), ("last", "nL7", "nZ")]
    assert found["total_distance"] == 2
    assert max(broadcast_rows(spark, before)) <= 50_000


def test_routes_without_broadcasts(spark, monkeypatch):
    from quernel.operators import routes

    monkeypatch.setattr(routes, "BROADCAST_ROWS", -1)
    table = edges(spark, COST).selectExpr("*", "10 AS heading")
    nodes = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "node_id string, name string")
    found = api.find_route(nodes, table, "A", "B", "car", "shortest_distance")
    steps = found["steps"].orderBy("index").collect()
    assert [(r["edge_id"], r["from_node"]["name"], r["to_node"]["name"], r["turn"]) for r in steps] == [("AC", "a", "c", "start"), ("CB", "c", "b", "straight")]
    assert api.find_recovery_route(nodes, table, "A", ["A", "C", "B"], 1, "car", "shortest_distance")["end"] == "C"
