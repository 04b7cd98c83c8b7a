"""Argument checks and result envelopes of the service-style entry points.

Each function returns ``{"success": True, ...}`` with a DataFrame, or ``{"success": False, "errorCode", "errorMessage"}``; checks
happen before a plan is built.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import normalize_text
from quernel.operators import recipes, routes, search
from quernel.session import materialize

ACCESS = ("car", "motorbike", "bicycle", "pedestrian", "service_vehicle")  # fixed values
OPTIMIZATION = {"shortest_distance": "distance", "fastest_time": "time"}  # fixed values


def _error(code: str, message: str) -> dict:
    return {"success": False, "errorCode": code, "errorMessage": message}


def search_dishes(
    dishes: DataFrame, query: str | None = None, ingredients: list[str] = (), category: str | None = None, cuisine: str | None = None, dietary: list[str] = (), difficulty: str | None = None,
    tags: list[str] = (), maximum_total_time: int | None = None, top_k: int = 5,
) -> dict:
    """Faceted, ranked dish search; at least one criterion is needed."""
    if not 1 <= top_k <= 20:
        return _error("INVALID_TOP_K", "top_k must be between 1 and 20")
    if maximum_total_time is not None and maximum_total_time <= 0:
        return _error("INVALID_MAXIMUM_TIME", "maximum_total_time must be positive")
    if not any([query and query.strip(), ingredients, category, cuisine, dietary, difficulty, tags, maximum_total_time]):
        return _error("INVALID_SEARCH", "at least one search criterion is needed")
    folded = dishes
    for name in ("category", "cuisine", "difficulty", "name", "description"):
        folded = folded.withColumn(f"{name}_key", normalize_text(name))
    lists = {"tags_key": F.col("tags"), "flags_key": F.col("dietary.flags")}
    for name, column in lists.items():  # normalised as one string, so that the UDF runs once for each row
        folded = folded.withColumn(name, F.split(normalize_text(F.array_join(F.coalesce(column, F.array().cast("array<string>")), " \ue000 ")), " ?\ue000 ?"))
    corpus = F.concat_ws(" ", "name_key", "description_key", F.array_join("tags_key", " "))
    found = search.ranked_search(
        folded, "id", F.col("name_key"), corpus, query, list(ingredients), [(F.col("category_key"), category), (F.col("cuisine_key"), cuisine), (F.col("difficulty_key"), difficulty)],
        [(F.col("flags_key"), list(dietary)), (F.col("tags_key"), list(tags))], F.col("meta.total_time"), maximum_total_time, top_k,
    )
    return {"success": True, "dishes": found.select(*dishes.columns, "score")}


def recipe_details(all_recipes: DataFrame, dish_id: str) -> dict:
    if not dish_id or not dish_id.strip():
        return _error("INVALID_DISH_ID", "dish id is empty")
    row = all_recipes.filter(F.col("id") == dish_id)
    return {"success": True, "recipe": row} if not row.isEmpty() else _error("RECIPE_NOT_FOUND", f"no recipe for {dish_id}")


def scale_recipe(all_recipes: DataFrame, dish_id: str, servings: int) -> dict:
    if servings <= 0:
        return _error("INVALID_SERVINGS", "servings must be positive")
    found = recipe_details(all_recipes, dish_id)
    if not found["success"]:
        return found
    row = found["recipe"].select("meta.yield_count").first()
    if not row["yield_count"]:
        return _error("INVALID_RECIPE", "the recipe has no yield")
    return {"success": True, "recipe": recipes.scale_recipe(found["recipe"], servings)}


def search_locations(nodes: DataFrame, edges: DataFrame, query: str, target_type: str = "auto", min_similarity: float = 0.8) -> dict:
    if not query or not query.strip():
        return _error("INVALID_QUERY", "query is empty")
    if target_type not in ("auto", "node", "road"):
        return _error("INVALID_TARGET_TYPE", f"unknown target type {target_type}")
    if not 0 <= min_similarity <= 1:
        return _error("INVALID_SIMILARITY", "similarity must be between 0 and 1")
    return {"success": True, "candidates": search.search_locations(nodes, edges, query, target_type, min_similarity)}


def _paths(nodes: DataFrame, edges: DataFrame, start: str, wanted: list[str], access: str, optimization: str, placed: bool, paths: DataFrame | None = None):
    if access not in ACCESS:
        return _error("INVALID_ACCESS", f"unknown access {access}")
    if optimization not in OPTIMIZATION:
        return _error("INVALID_OPTIMIZATION", f"unknown optimization {optimization}")
    asked = sorted({start, *wanted})
    known = {r["node_id"] for r in nodes.filter(F.col("node_id").isin(asked)).select("node_id").collect()}
    if unknown := [n for n in asked if n not in known]:
        return _error("NODE_NOT_FOUND", "unknown nodes: " + ", ".join(unknown))
    spark = nodes.sparkSession
    targets = spark.createDataFrame([(n, i) for i, n in enumerate(wanted)], "node string, index int")
    if paths is not None:
        return paths, targets
    usable = routes.usable_edges(edges, access).withColumn("cost", F.col(OPTIMIZATION[optimization]))
    return routes.shortest_paths(usable, spark.createDataFrame([(start,)], "node string"), targets, placed=placed), targets


def _route(paths: DataFrame, nodes: DataFrame, edges: DataFrame, start: str, end: str, optimization: str) -> dict:
    """The answer for a route: its id, ends, totals and toll warnings, and the steps with edges, turns and both nodes."""
    steps = routes.route(paths, end).drop("source", "target")
    steps = materialize(routes.with_turns(steps.join(edges, "edge_id").withColumn("route", F.lit(1)), "route", "index"), "steps")
    totals = routes.route_totals(steps, "route").first()
    warnings = []
    if "toll" in edges.columns and "road_name" in edges.columns:
        tolls = steps.withColumn("warning", F.when(F.col("toll"), F.concat(F.lit("Có phí: "), "road_name")))  # fixed wording
        warnings = (routes.first_seen(tolls, "route", "index", "warning").first() or {"values": []})["values"]
    return {
        "success": True, "route_id": str(uuid.uuid4()), "start": start, "end": end, "optimization": optimization, "total_distance": totals["total_distance"] if totals else 0,
        "total_time": totals["total_time"] if totals else 0, "warnings": warnings, "steps": routes.with_nodes(steps.drop("route"), nodes, count=steps.count()),
    }


def find_route(
    nodes: DataFrame, edges: DataFrame, start: str, end: str, access: str = "car", optimization: str = "fastest_time", placed: bool = False, paths: DataFrame | None = None,
) -> dict:
    """The cheapest route. For many requests: ``placed`` edges come from routes.by_source, ``paths`` from a search without targets from this start over
    the edges and costs that the request means."""
    found = _paths(nodes, edges, start, [end], access, optimization, placed, paths)
    if isinstance(found, dict):
        return found
    paths, _ = found
    if paths.filter(F.col("node") == end).isEmpty():
        return _error("NO_ROUTE", f"no route from {start} to {end}")
    return _route(paths, nodes, edges, start, end, optimization)


def find_recovery_route(nodes: DataFrame, edges: DataFrame, position: str, route_nodes: list[str], current_index: int, access: str = "car", optimization: str = "fastest_time", placed: bool = False) -> dict:
    """The cheapest way back to any node of the rest of a route; ``placed`` as in find_route."""
    if not route_nodes or not 0 <= current_index < len(route_nodes):
        return _error("INVALID_RECOVERY_INPUT", "current index is outside the route")
    found = _paths(nodes, edges, position, route_nodes[current_index:], access, optimization, placed)
    if isinstance(found, dict):
        return found
    paths, targets = found
    best = routes.nearest_target(paths, targets).first()
    if best is None:
        return _error("NO_RECOVERY_ROUTE", "no node of the route can be reached")
    return _route(paths, nodes, edges, position, best["node"], optimization) | {"resume_index": best["index"] + current_index}
