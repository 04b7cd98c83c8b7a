"""States that are written back, read again, raced for and found corrupt."""

import json

import pytest
from pyspark.sql import functions as F

from quernel.operators import state, state_store


def patches(spark, rows):
    made = [(s, i, json.dumps(d)) for i, (s, d) in enumerate(rows)]
    table = spark.createDataFrame(made, "session string, seq long, text string")
    return table.select("session", F.timestamp_seconds("seq").alias("ts"), "seq", F.parse_json("text").alias("delta"))


def checks():
    return {"status": state.in_vocabulary(F.col("delta"), "status", ["idle", "done"])}


def states(store):
    return {r["session"]: json.loads(r["state"]) for r in store.read().collect()}


def test_write_back(spark, tmp_path):
    store = state_store.StateStore(spark, str(tmp_path / "states"))
    assert store.version() == 0 and store.read().count() == 0
    first = [("a", {"status": "idle", "n": 1.0, "criteria": {"x": 1, "y": "q\"é"}}), ("b", {"n": None}), ("a", {"criteria": {"y": None, "z": [1, {"k": 2}]}}), ("a", {"status": "lost", "n": 9})]
    version, errors = state_store.update(store, patches(spark, first), checks(), ("criteria",))
    assert version == 1 and [tuple(r) for r in errors.collect()] == [("a", 3, "INVALID_STATE", "invalid: status")]
    assert states(store) == {"a": {"status": "idle", "n": 1, "criteria": {"x": 1, "y": None, "z": [1, {"k": 2}]}}, "b": {"n": None}}
    version, errors = state_store.update(store, patches(spark, [("b", {"n": 2}), ("c", {"criteria": {}, "t": True})]), checks(), ("criteria",))
    assert version == 2 and errors.count() == 0
    assert states(store)["b"] == {"n": 2} and states(store)["a"]["n"] == 1 and states(store)["c"]["t"] is True
    assert {r["session"] for r in store.read(1).collect()} == {"a", "b"}  # older versions stay whole


def test_a_lost_race_changes_nothing(spark, tmp_path):
    store = state_store.StateStore(spark, str(tmp_path / "states"))
    change = lambda n: spark.createDataFrame([("a", json.dumps({"n": n}))], "session string, state string")
    assert store.commit(0, change(1)) == 1
    with pytest.raises(state_store.StaleState):
        store.commit(0, change(2))
    assert states(store) == {"a": {"n": 1}} and store.version() == 1
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "states").iterdir() if not p.name.endswith(".crc")) == ["commit", "data"]  # the loser has left nothing


def test_corrupt_states_are_refused(spark, tmp_path):
    store = state_store.StateStore(spark, str(tmp_path / "states"))
    store.commit(0, spark.createDataFrame([("a", "{broken"), ("b", "[1]"), ("c", "{}")], "session string, state string"))
    version, errors = state_store.update(store, patches(spark, [(s, {"n": 1}) for s in "abc"]), checks())
    assert version == 2 and {(r["session"], r["code"], r["message"]) for r in errors.collect()} == {(s, "INVALID_STATE", "stored state is not a JSON object") for s in "ab"}
    assert {r["session"]: r["state"] for r in store.read().collect()} == {"a": "{broken", "b": "[1]", "c": '{"n":1}'}
    assert state_store.update(store, patches(spark, [("a", {"n": 1})]), checks())[0] == 2  # nothing to write


def test_folders_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_store, "COMPACT_AFTER", 3)
    store = state_store.StateStore(spark, str(tmp_path / "states"))
    for n in range(5):
        store.commit(n, spark.createDataFrame([(f"s{n}", "{}"), ("all", json.dumps({"n": n}))], "session string, state string"))
    assert states(store) == {"all": {"n": 4}} | {f"s{n}": {} for n in range(5)} and len(store.folders(5)) < 3
