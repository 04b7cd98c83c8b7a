"""The tools as SQL functions."""

import json

import pytest

from quernel.functions import tools


@pytest.mark.parametrize("expression, result", [
    ("8 + 5", 13.0), ("2 ** 3 ** 2", 512.0), ("-(2 - 5) * +4 / 8", 1.5), ("1e3", 1000.0), (" 1", None), ("(1", None), ("True", None), ("'a'", None), ("a", None), ("1 // 2", None), ("", None), (None, None),
    ("(-8) ** (1 / 3)", None), ("9 ** 9 ** 9", None), ("10.0 ** 400", None), ("2 ** -1", 0.5), ("0 ** 0", 1.0), ("__import__('os')", None),
])
def test_expressions(expression, result):
    success, found, error = tools.evaluated(expression)
    assert (success, found) == (result is not None, result) and (error is None) == success


def test_division_by_zero():
    assert tools.evaluated("1 / 0") == (False, None, tools.BY_ZERO) and tools.evaluated("0 ** -1") == (False, None, tools.BY_ZERO)


def test_scalars(spark):
    assert {"calculate", "prepare_calculation", "text_similarity", "source_scoped_key"} <= set(tools.register_scalars(spark))
    row = spark.sql("SELECT text_similarity('ho tay', 'tay ho') a, text_similarity('', 'x') b, text_similarity('lang', 'duong lang') c, source_scoped_key(' s ', 'c', '{\"b\": 1.0, \"a\": \" x  y \"}') d").first()
    assert row["a"] == pytest.approx(0.9) and (row["b"], row["c"]) == (0.0, 0.92)
    import hashlib

    assert row["d"] == hashlib.sha256(b'{"class":"c","properties":{"a":"x y","b":1.0},"source":"s"}').hexdigest()


def test_table_functions(spark):
    tools.register_locations(spark, spark.createDataFrame([("n1", "Hồ Gươm"), ("n2", "Phố Huế"), ("n3", None)], "node_id string, name string"))
    assert [r["node_id"] for r in spark.sql("SELECT * FROM search_locations('ho guom')").collect()] == ["n1"]
    assert spark.sql("SELECT * FROM search_locations('ho guom', 1.0)").count() == 0  # the threshold is strict
    assert sorted(r["node_id"] for r in spark.sql("SELECT s.* FROM VALUES ('n1'), ('pho') AS q(t), LATERAL search_locations(q.t, 0.9) s").collect()) == ["n1", "n2"]
    tools.register_dishes(spark, spark.createDataFrame([("a", "Phở bò", "noodle soup", ["soup"]), ("b", "Soup", None, None), ("c", None, None, [])], "id string, name string, description string, tags array<string>"))
    assert [(r["id"], r["score"], r["place"]) for r in spark.sql("SELECT * FROM search_dishes('SOUP') ORDER BY place").collect()] == [("b", 2.0, 1), ("a", 1.0, 2)]
    assert spark.sql("SELECT * FROM search_dishes(' ')").count() == 0
    with pytest.raises(Exception, match="INVALID_TOP_K"):
        spark.sql("SELECT * FROM search_dishes('soup', 21)").collect()
    recipe = spark.createDataFrame([("r", (4,), [("g", [("flour", 100.0)])])], "id string, meta struct<yield_count: int>, ingredients array<struct<group_name: string, items: array<struct<name: string, quantity: double>>>>")
    tools.register_recipes(spark, recipe)
    scaled = spark.sql("SELECT * FROM scale_recipe('r', 6)").first()
    assert scaled["scale_factor"] == 1.5 and scaled["ingredients"][0]["items"][0]["quantity"] == 150.0 and spark.sql("SELECT * FROM recipe_details('x')").count() == 0
    with pytest.raises(Exception, match="INVALID_SERVINGS"):
        spark.sql("SELECT * FROM scale_recipe('r', 0)").collect()
    tools.register_states(spark, spark.createDataFrame([("a", json.dumps({"n": 1})), ("b", "[")], "session string, state string"))
    assert [tuple(r) for r in spark.sql("SELECT s.* FROM VALUES ('a'), ('b'), ('c') AS q(x), LATERAL session_state(q.x) s ORDER BY s.session").collect()] == [("a", '{"n": 1}', None), ("b", None, "INVALID_STATE")]


def test_scaling_many_recipes_is_a_join_by_id(spark, sf):
    """Not all recipes with each number of servings."""
    from quernel.plans import sql_tools

    plan = sql_tools.sql_scale_recipe(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all(" = " in line for line in joins)
