"""Dish and recipe documents: scans, last-wins catalogs, scaling of nested quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.merge import last_per_key

DISH = (
    "id string, name string, description string, category string, cuisine string, difficulty string, tags array<string>, "
    "meta struct<active_time: string, passive_time: string, total_time: string, overnight_required: boolean, yields: string, yield_count: int, serving_size_g: int>, "
    "dietary struct<flags: array<string>, not_suitable_for: array<string>>, "
    "nutrition_summary struct<calories: double, protein_g: double, carbohydrates_g: double, fat_g: double>"
)
ITEM = "struct<name: string, quantity: double, unit: string, preparation: string, notes: string, substitutions: array<string>, ingredient_id: string, nutrition_source: string>"
RECIPE = f"id string, name string, meta struct<total_time: string, yield_count: int>, ingredients array<struct<group_name: string, items: array<{ITEM}>>>"


def read_dishes(spark: SparkSession, path: str) -> DataFrame:
    """Dishes of all list_*.json below a path: the last of an id wins, at the place of its first."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "list_*.json").option("recursiveFileLookup", True)
    rows = rows.schema(f"data array<struct<{_as_struct(DISH)}>>").json(path).withColumn("path", F.col("_metadata.file_path"))
    dishes = rows.select("path", F.posexplode("data").alias("pos", "d")).select(F.struct("path", "pos").alias("at"), "d.*")
    return last_per_key(dishes, "id", F.col("at")).orderBy("place").drop("at", "place")


def _as_struct(ddl: str) -> str:
    """Top-level fields of a DDL string in struct notation."""
    depth, out, word_done = 0, [], False
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if depth == 0 and c == " " and not word_done and out and out[-1] not in (",", " "):
            out.append(":")
            word_done = True
        if depth == 0 and c == ",":
            word_done = False
        out.append(c)
    return "".join(out)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes of all *_recipe.json below a path, by id; the last file wins."""
    rows = spark.read.schema(RECIPE).option("multiLine", True).option("pathGlobFilter", "*_recipe.json").option("recursiveFileLookup", True).json(path)
    return last_per_key(rows.withColumn("at", F.col("_metadata.file_path")), "id", F.col("at")).drop("at", "place")


def with_recipes(dishes: DataFrame, recipes: DataFrame) -> DataFrame:
    """``dishes`` with ``recipe``, the whole recipe of the same id, and ``errorCode`` RECIPE_NOT_FOUND where there is none."""
    found = recipes.select("id", F.struct(*[F.col(c) for c in recipes.columns]).alias("recipe"))
    return dishes.join(found, "id", "left").withColumn("errorCode", F.when(F.col("recipe").isNull(), F.lit("RECIPE_NOT_FOUND")))


def scale_items(items: Column, factor: Column, field: str = "quantity", digits: int = 6) -> Column:
    """Multiply one field of each struct of an array; the others stay."""
    return F.transform(items, lambda i: i.withField(field, F.bround(i[field] * factor, digits)))


def scale_recipe(recipes: DataFrame, servings: int) -> DataFrame:
    """(id, scale_factor, ingredients) for a number of servings."""
    if servings <= 0:
        raise ValueError("INVALID_SERVINGS")
    factor = F.lit(servings) / F.col("meta.yield_count")
    groups = F.transform("ingredients", lambda g: g.withField("items", scale_items(g["items"], factor)))
    return recipes.select("id", factor.alias("scale_factor"), groups.alias("ingredients"))
