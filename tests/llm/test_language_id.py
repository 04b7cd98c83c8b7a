import zlib

import pytest

from quernel.llm import language_id as L


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, model).withColumnRenamed("row_id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter(L.held_out_rows("doc_id"))
    rows = found.collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_held_out_rows_follow_the_checksum(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", L.held_out_rows("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_learning_never_sees_held_out_rows(spark, make_docs):
    rows = [(i, "der die das und " * 5 if zlib.crc32(str(i).encode()) % 4 != 2 else "the of and " * 5, "de" if zlib.crc32(str(i).encode()) % 4 != 2 else "en", "s") for i in range(80)]
    assert L.learn(make_docs(rows)).languages == ["de"]


def test_edge_rows(make_docs, model):
    long = "der und die nicht " * 60_000
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "123 !?", "en", "s"), (4, "der die das ist nicht und", None, None), (4, "der die das ist nicht und", None, None), (5, long, "en", "s"), (None, "que el la de los", "es", None)]
    docs = make_docs(rows)
    got = sorted(((str(r["row_id"]), r["lang_pred"]) for r in L.identify(docs, model).collect()))
    assert got[:3] == [("1", "und"), ("2", "und"), ("3", "und")] and got[3][1] == got[4][1] and ("5", "de") in got
    assert {r["row_id"]: r["score"] for r in L.identify(docs, model).collect()}[1] == 0.0
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_long_text_scores_as_in_one_piece(monkeypatch, model):
    import numpy as np

    data = np.frombuffer(("the of and to in é " * 3000).encode(), np.uint8)
    whole = L._logits(model, data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(L, "SCORE_SLICE", 1000)
    assert np.allclose(whole, L._long_logits(model, data))


def test_no_labels_and_no_rows(make_docs):
    assert L.learn(make_docs([(1, "abc", None, "s")])) is None
    assert L.identify(make_docs([(1, "abc", None, "s")]), None).first()["lang_pred"] == "und"
    assert L.identify(make_docs([]), None).count() == 0


def test_reruns_agree(spark, sf):
    a, b = (sorted(map(tuple, L.op6_language_id(spark, sf).collect())) for _ in range(2))
    assert a == b


def test_unknown_scripts_and_noise_are_rejected(make_docs, model):
    texts = ["Ελληνικά γλώσσα είναι " * 10, "これは日本語の文章です" * 5, "Привет мир как дела " * 5]
    rows = L.identify(make_docs([(i, t, None, None) for i, t in enumerate(texts)]), model).collect()
    assert all(r["rejected"] and r["score"] < 0.5 and r["lang_pred"] in model.languages for r in rows)


def test_scores_are_calibrated(spark, model):
    """The mean score of held-out rows is near the share that is right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs, model).withColumnRenamed("row_id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter(L.held_out_rows("doc_id")).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert abs(sum(r["score"] for r in rows) / len(rows) - right) < 0.05


def test_more_than_a_thousand_languages_are_learned(spark):
    """No language is left out for its rank; beyond the dimensions the two parts of the model stay apart."""
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3))
    rows = [(i, f"{word(i % 1001)}zq {word(i % 1001)}{word(i % 1001)} " * 4, f"l{i % 1001:04d}") for i in range(10010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs, per_language=1)
    seen = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(seen) > 1000 and set(model.languages) == seen and model.weights is not None
    assert L.identify(docs.limit(50), model).filter("score BETWEEN 0 AND 1").count() == 50


def test_folded_and_parted_models_agree(monkeypatch, model, spark, sf):
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert model.weights is None
    monkeypatch.setattr(L, "DIMENSION", 4)
    data = np.frombuffer(b"the of and to in", np.uint8)
    parted = L.learn(docs)
    assert parted.weights is not None  # as many classes as dimensions, or more
    whole = L.Model(parted.languages, parted.table @ parted.weights, None, parted.bias, parted.temperature, parted.threshold)
    assert np.allclose(L._logits(whole, data, np.array([0, len(data)])), L._logits(parted, data, np.array([0, len(data)])))


def test_fit_holds_eight_bytes_a_subword(spark, monkeypatch):
    """The driver's peak while it learns is that of the examples' buckets and counts."""
    import tracemalloc

    import numpy as np
    from pyspark.sql import Row

    from quernel.llm import language_id as L

    rng = np.random.default_rng(1)
    examples = [Row(lang="en", order=i, part=0, buckets=b, counts=b) for i, b in enumerate(rng.integers(1, 30_000, (600, 5_000)).astype(np.int32))]

    class Sample:
        def mapInArrow(self, *_):
            return self

        def toLocalIterator(self):
            return iter(examples)

    monkeypatch.setattr(L, "materialize", lambda df, name: df)
    tracemalloc.start()
    L.fit(Sample(), epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000 * 8 * 2
