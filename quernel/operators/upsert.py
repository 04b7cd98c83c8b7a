"""Graph upserts as keyed merges, and the all-or-nothing write of a validated patch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import materialize

EXCERPT = 1000  # messages that fill() brings to the driver; all of them are in its table


def merge_properties(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Properties as rows (keys, property, value, ord): the last change of a property wins over the stored value, a property
    without a change stays, a null value removes it."""
    rows = stored.select(*keys, "property", "value", F.lit(-1).cast("long").alias("ord")).unionByName(changes.select(*keys, "property", "value", F.col("ord").cast("long").alias("ord")))
    return rows.groupBy(*keys, "property").agg(F.max_by("value", "ord").alias("value")).filter("value IS NOT NULL")


def merge_edges(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Distinct (source, type, target)."""
    return stored.select("source", "type", "target").unionByName(changes.select("source", "type", "target")).distinct()


def stored_edges(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by stored ids, and the edges of which an end has none. ``ids``: patch_id, temp_id, stored_id (the last of a temp id)."""
    source = ids.select("patch_id", F.col("temp_id").alias("source_temp_id"), F.col("stored_id").alias("source"))
    target = ids.select("patch_id", F.col("temp_id").alias("target_temp_id"), F.col("stored_id").alias("target"))
    rows = edges.join(source, ["patch_id", "source_temp_id"], "left").join(target, ["patch_id", "target_temp_id"], "left")
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    return rows.filter(whole).select("source", F.col("edge_name").alias("type"), "target"), rows.filter(~whole)


def refused(resolved: DataFrame) -> DataFrame:
    """Messages of nodes that can't be written safely: unresolved, in error, or resolved without a key."""
    no_key = F.col("key_name").isNull() | (F.coalesce("key_value", F.lit("")) == "")
    message = (  # fixed wording
        F.when(F.col("strategy") == "error", F.col("reason"))
        .when(F.col("strategy") == "unresolved", F.concat(F.lit("Cannot safely upsert "), "class_name", F.lit(": "), "reason"))
        .when(no_key, F.concat(F.lit("Resolved identity is incomplete for class "), "class_name"))
    )
    return resolved.select("temp_id", message.alias("message")).filter("message IS NOT NULL")


def missing_ends(dangling: DataFrame) -> DataFrame:
    """Messages of edges without a stored end, which abort the write of their patch: the source's first."""
    message = F.when(F.col("source").isNull(), F.concat(F.lit("Missing source node: "), "source_temp_id")).otherwise(F.concat(F.lit("Missing target node: "), "target_temp_id"))
    return dangling.select(F.col("source_temp_id").alias("temp_id"), message.alias("message"))


def write_all_or_nothing(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table below a staging folder, then swap it with ``path``. Until the first rename nothing changes."""
    frame = next(iter(tables.values()))
    jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(conf)
    staging, old = place(path + ".staging"), place(path + ".old")
    files.delete(staging, True)
    for name, table in tables.items():
        table.write.parquet(f"{path}.staging/{name}")
    files.delete(old, True)
    if files.exists(place(path)):
        files.rename(place(path), old)
    files.rename(staging, place(path))
    files.delete(old, True)


def fill(violations: DataFrame, refusals: DataFrame, tables: dict[str, DataFrame], path: str) -> dict:
    """Validate, then write; any violation or refusal blocks the write. Then ``error_table`` is a written table of all of them,
    ``error_count`` its number of rows and ``errors`` its first messages, cut where ``errors_are_excerpt``."""
    for stage, found in (("ontology_validation", violations), ("persistence", refusals)):
        table = materialize(found, "errors")
        if count := table.count():
            errors = [r["message"] for r in table.select("message").limit(EXCERPT).collect()]
            return {"success": False, "stage": stage, "errors": errors, "error_count": count, "errors_are_excerpt": len(errors) < count, "error_table": table}
    try:
        write_all_or_nothing(tables, path)
    except Exception as error:  # reported with its stage
        return {"success": False, "stage": "persistence", "errors": [str(error)]}
    return {"success": True, "stage": "completed", "errors": []}
