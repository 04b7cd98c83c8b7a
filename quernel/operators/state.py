"""Session state as a fold of ordered patch events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def field_changes(events: DataFrame, delta: str = "delta") -> DataFrame:
    """(session, ts, seq, field, value): one row for each field that a delta (VARIANT object) sets; an explicit null is a value."""
    opened = events.lateralJoin(events.sparkSession.tvf.variant_explode(F.col(delta).outer()))
    return opened.select("session", "ts", "seq", F.col("key").alias("field"), F.struct(F.to_json("value").alias("json")).alias("value"))


def nested_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that merge one level deep are spread into field.key rows."""
    whole = changes.filter(~F.col("field").isin(fields))
    spread = changes.filter(F.col("field").isin(fields)).select(
        "session", "ts", "seq", "field", F.explode(F.from_json("value.json", "map<string,string>")).alias("key", "text")
    )
    return whole.unionByName(spread.select("session", "ts", "seq", F.concat("field", F.lit("."), "key").alias("field"), F.struct(F.col("text").alias("json")).alias("value")))


def fold(changes: DataFrame, order: list[str] = ("ts", "seq")) -> DataFrame:
    """(session, field, value): the last value of each field; absent fields keep what they had."""
    return changes.groupBy("session", "field").agg(F.max_by("value", F.struct(*order)).alias("value"))


def with_defaults(state: DataFrame, sessions: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """Every session with all default fields, overlaid by its own."""
    spark = state.sparkSession
    base = spark.createDataFrame([(k, v) for k, v in defaults.items()], "field string, default_json string")
    every = sessions.select("session").distinct().join(F.broadcast(base), F.lit(True))
    joined = every.join(state, ["session", "field"], "left")
    return joined.select("session", "field", F.when(F.col("value").isNull(), F.struct(F.col("default_json").alias("json"))).otherwise(F.col("value")).alias("value"))


def sessions(events: DataFrame) -> DataFrame:
    """(session, active): whether the last create or delete event of a session is a create."""
    return events.groupBy("session").agg((F.max_by("kind", F.struct("ts", "seq")) != "delete").alias("active"))


def invalid(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(session, seq, check) of patches that break a check; a patch that breaks one is refused as a whole."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]), lambda n: n.isNotNull())
    return rows.select("session", "seq", F.explode(broken).alias("check"))


def fold_valid(rows: DataFrame, checks: dict[str, Column], delta: str = "delta") -> DataFrame:
    """The fold of the patches (session, ts, seq, delta) that pass every check; one that breaks any changes nothing at all."""
    fine = F.lit(True)
    for ok in checks.values():
        fine = fine & F.coalesce(ok, F.lit(True))
    return fold(field_changes(rows.filter(fine), delta))


def in_vocabulary(delta: Column, field: str, words: list[str]) -> Column:
    """Whether a text field of a delta is one of the words; an absent or null one is fine."""
    given = F.try_variant_get(delta, f"$.{field}", "string")
    return given.isNull() | given.isin(words)


def required(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions that are asked for but not known."""
    return wanted.join(known, "session", "left_anti").select("session", F.concat(F.lit("Session not found: "), "session").alias("message"))
