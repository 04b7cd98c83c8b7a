"""Queries that call the tools from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import tools
from quernel.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, q % 5 < 3 AS success, CASE q % 5 WHEN 0 THEN (q + 3) * 2 - 1.5::DOUBLE WHEN 1 THEN -(q::DOUBLE) / 4 WHEN 2 THEN (2 * q * q * q)::DOUBLE END AS result,
  CASE q % 5 WHEN 3 THEN 'Division by zero is not allowed.' WHEN 4 THEN 'The arithmetic expression is invalid or unsupported.' END AS error FROM l
""")
def sql_calculate(spark, sf):
    """Expressions of every line item, evaluated by calculate() in SQL."""
    tools.register_scalars(spark)
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q")).createOrReplaceTempView("quernel_lines")
    return spark.sql("""
        SELECT l_orderkey, l_linenumber, l_partkey, c.success, c.result, c.error FROM (
            SELECT l_orderkey, l_linenumber, l_partkey, calculate(CASE q % 5 WHEN 0 THEN concat('(', q, ' + 3) * 2 - 1.5') WHEN 1 THEN concat('-', q, ' / 4') WHEN 2 THEN concat('2 * ', q, ' ** 3')
                WHEN 3 THEN concat(q, ' / (1 - 1)') ELSE concat('f(', q, ')') END) AS c FROM quernel_lines)
    """)


@query("""
WITH l AS (SELECT o_orderkey, o_custkey % 7 AS k, CASE o_custkey % 7 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '*' WHEN 3 THEN '/' WHEN 4 THEN '**' ELSE 'mod' END AS op FROM orders)
SELECT o_orderkey, k < 5 AS success, CASE WHEN k < 5 THEN '2.5 ' || op || ' ' || k || '.0' END AS expression, CASE k WHEN 0 THEN 'Add the right operand to the left operand.' WHEN 1 THEN 'Subtract the right operand from the left operand.'
  WHEN 2 THEN 'Multiply the left operand by the right operand.' WHEN 3 THEN 'Divide the left operand by the right operand.' WHEN 4 THEN 'Raise the left operand to the power of the right operand.' END AS operator_description,
  CASE WHEN k >= 5 THEN 'Unsupported operator: mod' END AS error, CASE WHEN k >= 5 THEN ['+', '-', '*', '/', '**'] END AS supported_operators FROM l
""")
def sql_prepare_calculation(spark, sf):
    """Binary expressions made by prepare_calculation() in SQL; an unknown operator is an error with the list of those there are."""
    tools.register_scalars(spark)
    table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("k")).createOrReplaceTempView("quernel_orders")
    return spark.sql("""
        SELECT o_orderkey, p.* FROM (SELECT o_orderkey, prepare_calculation(2.5, CASE k WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '*' WHEN 3 THEN '/' WHEN 4 THEN '**' ELSE 'mod' END, k) AS p FROM quernel_orders)
    """)


@query("""
WITH q(query, words) AS (VALUES ('Red  gear', ['red', 'gear']), ('blue', ['blue']), ('BÔLT small', ['bolt', 'small'])),
s AS (SELECT query, p_partkey AS id, p_name AS name, lower(p_name) AS k, 1.0::DOUBLE * len(list_intersect(words, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')))) / len(words)
  + 1.0::DOUBLE * len(list_intersect(words, list_distinct(string_split(lower(p_name), ' ')))) / len(words) AS score FROM q CROSS JOIN part),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, k, id) AS place FROM s WHERE score > 0)
SELECT query, id, name, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 7
""")
def sql_search_dishes(spark, sf):
    """Ranked search from SQL: the best parts for each of three queries."""
    dishes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("tags"))
    tools.register_dishes(spark, dishes)
    return spark.sql("SELECT q.query, d.* FROM VALUES ('Red  gear'), ('blue'), ('BÔLT small') AS q(query), LATERAL search_dishes(q.query, 7) AS d")


@query("""
WITH i AS (SELECT o_orderkey, o_custkey % 7 + 1 AS y, o_custkey % 3 + 1 AS s FROM orders)
SELECT i.o_orderkey, s / y::DOUBLE AS scale_factor, l_linenumber, l_partkey, CAST(round(l_quantity * 1000000 * s / y) AS BIGINT) AS micro FROM i JOIN lineitem ON l_orderkey = o_orderkey
""")
def sql_scale_recipe(spark, sf):
    """Orders as recipes with their lines as ingredients, scaled from SQL for as many servings as each order asks for."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lines"))  # names are made after the shuffle
    items = F.transform("lines", lambda i: F.struct(F.concat_ws("/", i["l_linenumber"], i["l_partkey"]).alias("name"), i["l_quantity"].alias("quantity"), F.lit("piece").alias("unit")))
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    orders = orders.select(F.col("o_orderkey").alias("id"), F.struct((F.col("o_custkey") % 7 + 1).cast("int").alias("yield_count")).alias("meta"), F.array(F.struct(F.lit("all").alias("group_name"), items.alias("items"))).alias("ingredients"))
    tools.register_recipes(spark, orders)
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3 + 1).cast("int").alias("servings")).createOrReplaceTempView("quernel_wanted")
    return spark.sql("""
        SELECT id AS o_orderkey, scale_factor, CAST(split(i.name, '/')[0] AS INT) AS l_linenumber, CAST(split(i.name, '/')[1] AS BIGINT) AS l_partkey, CAST(round(i.quantity * 1000000) AS BIGINT) AS micro
        FROM (SELECT id, scale_factor, explode(flatten(scaled.items)) AS i FROM (SELECT id, factor AS scale_factor, scale_ingredients(ingredients, factor) AS scaled
            FROM (SELECT r.id, r.ingredients, scale_factor(w.servings, r.meta.yield_count) AS factor FROM quernel_wanted w, LATERAL recipe_details(w.id) AS r)))
    """)


@query("""
WITH s AS (SELECT user_id, arg_max(props, event_id) AS last, count(*) AS n FROM events GROUP BY user_id)
SELECT c_custkey, CASE WHEN n % 2 = 0 THEN last END AS state, CASE WHEN n % 2 = 1 THEN 'INVALID_STATE' END AS "errorCode" FROM customer JOIN s ON user_id = c_custkey
""")
def sql_session_state(spark, sf):
    """States of the customers' sessions, looked up from SQL; corrupt ones have an error code."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("props", "event_id").alias("last"), F.count("*").alias("n"))
    tools.register_states(spark, last.select(F.col("user_id").cast("string").alias("session"), F.when(F.col("n") % 2 == 0, F.col("last")).otherwise(F.concat(F.lit("["), "last")).alias("state")))
    table(spark, sf, "customer").select("c_custkey").createOrReplaceTempView("quernel_customers")
    return spark.sql("SELECT c.c_custkey, s.state, s.errorCode FROM quernel_customers c, LATERAL session_state(CAST(c.c_custkey AS STRING)) AS s")
