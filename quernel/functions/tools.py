"""The tools as SQL functions: scalar ones, and table functions over the caller's tables, so that queries can use them, also with LATERAL.

Table functions are SQL bodies that Catalyst inlines into the query; nothing of them runs outside the plan. Routes take rounds of joins and
fills write, so these stay Python entry points (quernel.api, quernel.operators.upsert).
"""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from quernel.functions.register import register

MOST_BITS = 4096  # of an integer power; a double holds far fewer
SIGNS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.UAdd: operator.pos, ast.USub: operator.neg}
DESCRIPTIONS = {  # fixed values
    "+": "Add the right operand to the left operand.",
    "-": "Subtract the right operand from the left operand.",
    "*": "Multiply the left operand by the right operand.",
    "/": "Divide the left operand by the right operand.",
    "**": "Raise the left operand to the power of the right operand.",
}
INVALID = "The arithmetic expression is invalid or unsupported."  # fixed values
BY_ZERO = "Division by zero is not allowed."


def _value(node):
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.UnaryOp) and type(node.op) in SIGNS:
        return SIGNS[type(node.op)](_value(node.operand))
    if isinstance(node, ast.BinOp):
        left, right = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow):
            if isinstance(left, int) and isinstance(right, int) and abs(left) > 1 and right * left.bit_length() > MOST_BITS:
                raise OverflowError
            return left**right
        if type(node.op) in SIGNS:
            return SIGNS[type(node.op)](left, right)
    raise ValueError


def evaluated(expression: str | None) -> tuple[bool, float | None, str | None]:
    """(success, result, error) of an arithmetic expression; complex results and ones beyond a double are errors."""
    try:
        result = _value(ast.parse(expression or "", mode="eval").body)
        return True, float(result), None
    except ZeroDivisionError:
        return False, None, BY_ZERO
    except (SyntaxError, TypeError, ValueError, OverflowError, RecursionError, MemoryError):
        return False, None, INVALID


@F.pandas_udf(StructType().add("success", BooleanType()).add("expression", StringType()).add("result", DoubleType()).add("error", StringType()))
def calculate(expressions: pd.Series) -> pd.DataFrame:
    found = [evaluated(e) for e in expressions]
    return pd.DataFrame({"success": [f[0] for f in found], "expression": expressions, "result": pd.Series([f[1] for f in found], dtype="float64"), "error": [f[2] for f in found]})


def _define(spark: SparkSession, head: str, body: str) -> str:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return head.split("(")[0]


def _share(needle: str, hay: str) -> str:
    return f"coalesce(try_divide(size(array_intersect({needle}, {hay})), size({needle})), 0.0D)"


def _tokens(text: str) -> str:
    return f"array_distinct(filter(split({text}, ' '), t -> t <> ''))"


def register_scalars(spark: SparkSession) -> list[str]:
    """calculate, prepare_calculation, text_similarity and what they build on."""
    names = register(spark)
    spark.udf.register("calculate", calculate)
    known = ", ".join(f"'{sign}', '{text}'" for sign, text in DESCRIPTIONS.items())
    kind = "STRUCT<success: BOOLEAN, expression: STRING, operator_description: STRING, error: STRING, supported_operators: ARRAY<STRING>>"
    found = f"try_element_at(map({known}), operator_symbol)"
    expression = "concat_ws(' ', CAST(left_operand AS STRING), operator_symbol, CAST(right_operand AS STRING))"
    body = (
        f"CASE WHEN {found} IS NOT NULL THEN CAST(named_struct('success', true, 'expression', {expression}, 'operator_description', {found}, 'error', NULL, 'supported_operators', NULL) AS {kind}) "
        f"ELSE CAST(named_struct('success', false, 'expression', NULL, 'operator_description', NULL, 'error', concat('Unsupported operator: ', coalesce(operator_symbol, 'None')), 'supported_operators', map_keys(map({known}))) AS {kind}) END"
    )
    names.append(_define(spark, f"prepare_calculation(left_operand DOUBLE, operator_symbol STRING, right_operand DOUBLE) RETURNS {kind}", body))
    share = _share(_tokens("needle"), _tokens("hay"))
    body = (
        "CASE WHEN coalesce(needle, '') = '' OR coalesce(hay, '') = '' THEN 0.0D WHEN needle = hay THEN 1.0D WHEN contains(hay, needle) OR contains(needle, hay) THEN 0.92D "
        f"ELSE greatest(0.9D * {share}, sequence_ratio(needle, hay)) END"
    )
    names.append(_define(spark, "text_similarity(needle STRING, hay STRING) RETURNS DOUBLE", body))
    return sorted([*names, "calculate"])


def register_dishes(spark: SparkSession, dishes: DataFrame) -> list[str]:
    """search_dishes(query, top_k) over dishes (id, name, description, tags)."""
    register(spark)
    dishes.select("id", "name", "description", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ").alias("tags")).createOrReplaceTempView("quernel_dishes")
    kind = dishes.schema["id"].dataType.simpleString()
    keyed = "SELECT id, name, normalize_text(name) AS name_key, normalize_text(concat_ws(' ', name, description, tags)) AS corpus FROM quernel_dishes"
    query = _tokens("normalize_text(search_dishes.query)")
    score = f"{_share(query, _tokens('corpus'))} + {_share(query, _tokens('name_key'))}"
    guard = "CASE WHEN search_dishes.top_k BETWEEN 1 AND 20 THEN true ELSE raise_error('INVALID_TOP_K') END"
    body = f"""
        SELECT id, name, score, place FROM (
            SELECT id, name, score, row_number() OVER (ORDER BY score DESC, name_key, id) AS place FROM (SELECT id, name, name_key, {score} AS score FROM ({keyed}) WHERE {guard}) WHERE score > 0
        ) WHERE place <= search_dishes.top_k"""
    return [_define(spark, f"search_dishes(query STRING, top_k INT DEFAULT 5) RETURNS TABLE(id {kind}, name STRING, score DOUBLE, place INT)", body)]


def register_recipes(spark: SparkSession, recipes: DataFrame) -> list[str]:
    """recipe_details(dish_id) and scale_recipe(dish_id, servings) over recipes (id, meta.yield_count, ingredients, ...).

    With LATERAL over many rows scale_recipe meets all recipes with each distinct number of servings; there take recipe_details and
    scale_ingredients(ingredients, scale_factor(servings, yield_count)), which is one join by id.
    """
    recipes.createOrReplaceTempView("quernel_recipes")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recipes.schema)
    fields = {f.name: f.dataType.simpleString() for f in recipes.schema}
    names = [_define(spark, f"recipe_details(dish_id {fields['id']}) RETURNS TABLE({columns})", "SELECT * FROM quernel_recipes WHERE id = recipe_details.dish_id")]
    group = [f.name for f in recipes.schema["ingredients"].dataType.elementType]
    item = [f.name for f in recipes.schema["ingredients"].dataType.elementType["items"].dataType.elementType]
    scaled = ", ".join(f"'{n}', " + ("bround(i.quantity * factor, 6)" if n == "quantity" else f"i.`{n}`") for n in item)
    groups = ", ".join(f"'{n}', " + (f"transform(g.items, i -> named_struct({scaled}))" if n == "items" else f"g.`{n}`") for n in group)
    kind = fields["ingredients"]
    names.append(_define(spark, "scale_factor(servings INT, yield_count DOUBLE) RETURNS DOUBLE", "CASE WHEN servings > 0 THEN servings / yield_count ELSE raise_error('INVALID_SERVINGS') END"))
    names.append(_define(spark, f"scale_ingredients(ingredients {kind}, factor DOUBLE) RETURNS {kind}", f"CAST(transform(ingredients, g -> named_struct({groups})) AS {kind})"))
    factor = "scale_recipe.servings / meta.yield_count"
    guard = "CASE WHEN scale_recipe.servings > 0 THEN true ELSE raise_error('INVALID_SERVINGS') END"
    body = f"SELECT id, {factor}, scale_ingredients(ingredients, {factor}) FROM quernel_recipes WHERE id = scale_recipe.dish_id AND {guard}"
    names.append(_define(spark, f"scale_recipe(dish_id {fields['id']}, servings INT) RETURNS TABLE(id {fields['id']}, scale_factor DOUBLE, ingredients {kind})", body))
    return names


def register_states(spark: SparkSession, states: DataFrame) -> list[str]:
    """session_state(session) over states (session, state); a state that is no JSON object has the error code INVALID_STATE."""
    states.select("session", "state").createOrReplaceTempView("quernel_states")
    broken = "NOT coalesce(startswith(schema_of_variant(try_parse_json(state)), 'OBJECT'), false)"
    body = f"SELECT session, CASE WHEN NOT ({broken}) THEN state END, CASE WHEN {broken} THEN 'INVALID_STATE' END FROM quernel_states WHERE session = session_state.wanted"
    return [_define(spark, "session_state(wanted STRING) RETURNS TABLE(session STRING, state STRING, errorCode STRING)", body)]


def register_locations(spark: SparkSession, nodes: DataFrame) -> list[str]:
    """search_locations(query, min_similarity) over nodes (node_id, name)."""
    register_scalars(spark)
    nodes.select("node_id", "name").createOrReplaceTempView("quernel_nodes")
    needle = "normalize_text(search_locations.query)"
    keyed = "SELECT node_id, name, normalize_text(CAST(node_id AS STRING)) AS id_key, normalize_text(name) AS name_key FROM quernel_nodes"
    kind = nodes.schema["node_id"].dataType.simpleString()
    body = f"SELECT node_id, name, similarity FROM (SELECT node_id, name, greatest(text_similarity({needle}, id_key), text_similarity({needle}, name_key)) AS similarity FROM ({keyed})) WHERE similarity > search_locations.min_similarity"
    return [_define(spark, f"search_locations(query STRING, min_similarity DOUBLE DEFAULT 0.8D) RETURNS TABLE(node_id {kind}, name STRING, similarity DOUBLE)", body)]
