"""The index of similar strings against a comparison of all pairs."""

from difflib import SequenceMatcher

import numpy as np
import pytest

from quernel.operators import search, similar


def score(query, text, ratio=True):
    if query == text:
        return 1.0
    if query in text or text in query:
        return 0.92
    tokens = set(query.split())
    share = 0.9 * (len(tokens & set(text.split())) / len(tokens)) if tokens else 0.0
    return max(share, SequenceMatcher(None, query, text).ratio()) if ratio else share


def strings(count, seed):
    rng = np.random.default_rng(seed)
    words = ["pho", "duong", "hue", "lang", "hang bai", "ho", "ba trieu", "x", "le", "ly", "thai", "to", "1", "12"]
    out = [" ".join(rng.choice(words, rng.integers(1, 5))) for _ in range(count // 2)]
    out += ["".join(rng.choice(list("abcde "), rng.integers(1, 12))) for _ in range(count // 2)]
    for i in range(0, count, 5):  # misspelt
        at = rng.integers(0, len(out[i]))
        out[i] = out[i][:at] + "q" + out[i][at + 1 :]
    return [" ".join(s.split()) or "a" for s in out] + ["a", "ab", "abc", "€", "zz " * 90 + "end"]


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.6, 0.8, 0.89, 0.9, 0.93, 1.0])
@pytest.mark.parametrize("ratio", [True, False])
def test_no_pair_is_lost(spark, threshold, ratio):
    left, right = strings(60, 1), strings(100, 2) + strings(60, 1)[:10]
    pairs = similar.similar_pairs(spark.createDataFrame([(s,) for s in [*left, "", None, left[0]]], "query string"), spark.createDataFrame([(s,) for s in [*right, "", None]], "text string"), threshold, ratio)
    found = {(r["query"], r["text"]): r["similarity"] for r in pairs.collect()}
    expected = {(q, t): score(q, t, ratio) for q in set(left) for t in set(right)}
    expected = {k: v for k, v in expected.items() if v > threshold}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - v) < 1e-12 for k, v in expected.items())


def test_negative_threshold(spark):
    with pytest.raises(ValueError):
        similar.similar_pairs(spark.createDataFrame([("a",)], "query string"), spark.createDataFrame([("a",)], "text string"), -0.1)


def test_plan_has_no_comparison_of_all_pairs(spark, capsys):
    queries = spark.range(100).selectExpr("id AS query_id", "concat('road ', id) AS query")
    texts = spark.range(1000).selectExpr("id", "concat('road ', id % 90) AS text")
    found = search.fuzzy_matches(queries, texts, 0.95)
    assert found.count() == 90 * 5
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
