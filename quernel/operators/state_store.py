"""Session state that is written back: a versioned table with compare-and-set.

A version is a small commit file that names the data folders which make it up: a base, and what later versions changed. A writer
reads a version, stages what it changes in a folder of its own, and publishes the next commit file by a rename that fails if another
writer was first. Readers see a version whole or not at all; what a lost or failed writer has staged is never named. States that
don't change are not written again until there are COMPACT_AFTER folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.state import field_changes, nested_changes

COMPACT_AFTER = 16
STATE = "session string, state string, version long"


class StaleState(RuntimeError):
    """Another writer has published the version that this one was to become."""


class StateStore:
    """States (session, state) as JSON text below ``path``, which all writers and readers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.fs.Path(self.path).getFileSystem(self.conf)

    def version(self) -> int:
        """The newest version; 0 if nothing has been written."""
        folder = self.fs.Path(self.path)
        if not self.files.exists(folder):
            return 0
        names = [status.getPath().getName() for status in self.files.listStatus(folder)]
        return max((int(name.removeprefix("commit-")) for name in names if name.startswith("commit-")), default=0)

    def folders(self, version: int) -> list[str]:
        if not version:
            return []
        stream = self.files.open(self.fs.Path(f"{self.path}/commit-{version:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """(session, state) of a version, the newest by default."""
        folders = self.folders(self.version() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], STATE).drop("version")
        rows = self.spark.read.schema(STATE).parquet(*[f"{self.path}/{name}" for name in folders])
        return rows.groupBy("session").agg(F.max_by("state", "version").alias("state"))

    def commit(self, version: int, changed: DataFrame) -> int:
        """Publish ``changed`` (session, state) on top of ``version``; raises StaleState if that isn't the newest any more."""
        folders, name, following = self.folders(version), f"data-{uuid.uuid4().hex}", version + 1
        if len(folders) + 1 >= COMPACT_AFTER:
            kept = self.read(version).join(changed.select("session"), "session", "left_anti")
            changed, folders = kept.unionByName(changed.select("session", "state")), []
        changed.select("session", "state", F.lit(following).cast("long").alias("version")).write.parquet(f"{self.path}/{name}")
        staged = self.fs.Path(f"{self.path}/.{name}.commit")
        stream = self.files.create(staged, True)
        stream.write(bytearray(json.dumps([*folders, name]).encode("utf-8")))
        stream.close()
        try:
            self._publish(staged, self.fs.Path(f"{self.path}/commit-{following:020d}"))
        except Exception as error:
            self.files.delete(staged, False)
            self.files.delete(self.fs.Path(f"{self.path}/{name}"), True)
            if "FileAlreadyExists" in str(error):
                raise StaleState(f"version {following} of {self.path} is there already") from error
            raise
        return following

    def _publish(self, staged, final) -> None:
        """A rename that doesn't replace what is there."""
        options = self.spark.sparkContext._gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        self.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self.files.getUri(), self.conf).rename(staged, final, options)


def as_document(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): the JSON object of rows (keys, field, json), fields by name; a field ``outer.inner`` is a field of the object ``outer``."""
    text = lambda name, value: F.concat(F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(":"), value)
    outer, inner = F.substring_index("field", ".", 1), F.when(F.contains("field", F.lit(".")), F.substring_index("field", ".", -1))
    joined = lambda: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "part"))), lambda s: s["part"]), ","), F.lit("}"))
    rows = fields.withColumn("outer", outer).withColumn("inner", inner)
    nested = rows.filter("inner IS NOT NULL").select(*keys, F.col("outer"), F.col("inner").alias("field"), text(F.col("inner"), F.col("json")).alias("part"))
    nested = nested.groupBy(*keys, "outer").agg(joined().alias("json")).select(*keys, F.col("outer").alias("field"), "json")
    whole = rows.filter("inner IS NULL").select(*keys, "field", "json").unionByName(nested)
    return whole.select(*keys, "field", text(F.col("field"), F.col("json")).alias("part")).groupBy(*keys).agg(joined().alias("state"))


def fields_of(states: DataFrame, nested: list[str]) -> DataFrame:
    """(session, field, json) of states (session, state) as JSON text; fields in ``nested`` are opened one level."""
    rows = states.select("session", F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.try_parse_json("state").alias("delta"))
    return nested_changes(field_changes(rows), nested).select("session", "field", F.col("value.json").alias("json"))


def update(store: StateStore, patches: DataFrame, checks: dict[str, Column], nested: tuple[str, ...] = ()) -> tuple[int, DataFrame]:
    """Write back patches (session, ts, seq, delta VARIANT): the new version, and the errors (session, seq, code, message).

    A patch replaces the fields that it has, those in ``nested`` one level deep; one that breaks a check (a column of ``delta``) changes nothing. The
    patches of a session whose stored state is no JSON object are refused, and the state stays as it is. Nothing is written if nothing changes.
    """
    version = store.version()
    states = store.read(version)
    corrupt = states.filter(~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("state")), F.lit("OBJECT")), F.lit(False))).select("session", F.lit(True).alias("is_corrupt"))
    rows = patches.join(corrupt, "session", "left").withColumn("broken", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]), lambda n: n.isNotNull()))
    message = F.when(F.col("is_corrupt"), F.lit("stored state is not a JSON object")).when(F.size("broken") > 0, F.concat(F.lit("invalid: "), F.array_join("broken", ", ")))
    rows = rows.withColumn("message", message)
    errors = rows.filter("message IS NOT NULL").select("session", "seq", F.lit("INVALID_STATE").alias("code"), "message")
    changes = nested_changes(field_changes(rows.filter("message IS NULL").select("session", "ts", "seq", "delta")), list(nested))
    changes = changes.select("session", "field", F.lit(1).alias("layer"), "ts", "seq", F.coalesce("value.json", F.lit("null")).alias("json"))
    touched = changes.select("session").distinct()
    before = fields_of(states.join(touched, "session", "left_semi"), list(nested)).select("session", "field", F.lit(0).alias("layer"), F.lit(None).cast(changes.schema["ts"].dataType).alias("ts"), F.lit(-1).cast(changes.schema["seq"].dataType).alias("seq"), F.coalesce("json", F.lit("null")).alias("json"))
    last = before.unionByName(changes).groupBy("session", "field").agg(F.max_by("json", F.struct("layer", "ts", "seq")).alias("json"))
    if touched.isEmpty():
        return version, errors
    return store.commit(version, as_document(last, ["session"])), errors
