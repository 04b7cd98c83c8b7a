"""Pairs of similar strings without comparing all of them.

Every way in which two strings can be more similar than the threshold leaves a common key on both sides, and only pairs with a common key
are scored: a token (share of tokens), a q-gram of the contained string (containment), or a character with its number of occurrence. For the last one:
a ratio above t means that the strings have at least t * (la + lb) / 2 characters in common, counted with repetition, and that
lb is at least la * t / (2 - t); so at least la * t / (2 - t) characters of each, and of the others and one more, sorted alike, both
sides have one in common (prefix filter).
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quernel.functions.text import ratio_above, similarity, token_set

GRAM = 3
CONTAINED, SHARE = 0.92, 0.9  # fixed values: scores of containment and of a full share of tokens
SLACK = 1e-9  # bounds are floats


def rare_characters(threshold: float):
    """An Arrow function: the characters of a string, numbered by occurrence, of which one is in every string that is more similar.
    Late occurrences and late letters come first, since fewer strings have them."""

    @F.pandas_udf(ArrayType(StringType()))
    def prefix(values: pd.Series) -> pd.Series:
        def of(text):
            if not text:
                return []
            found = [(n, c) for c, many in Counter(text).items() for n in range(1, many + 1)]
            least = max(1, math.ceil(len(text) * threshold / (2 - threshold) - SLACK))
            return [f"{c}{n}" for n, c in sorted(found, reverse=True)[: len(text) - least + 1]]

        return values.map(of)

    return prefix


def grams(text: Column) -> Column:
    """All distinct substrings of up to GRAM characters."""
    def of(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))

    return F.array_distinct(F.concat(*map(of, range(1, GRAM + 1))))


def own_gram(text: Column) -> Column:
    """One substring that every string with ``text`` in it has among its grams."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.array_max(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def tagged(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def similar_pairs(queries: DataFrame, texts: DataFrame, threshold: float, ratio: bool = True) -> DataFrame:
    """(query, text, similarity) of distinct strings of ``queries`` (query) and ``texts`` (text) that are more similar than ``threshold``."""
    if not 0 <= threshold:
        raise ValueError("the threshold must not be negative")
    left = queries.select("query").filter("query <> ''").distinct()
    right = texts.select("text").filter("text <> ''").distinct()
    query, text = F.col("query"), F.col("text")
    query_keys, text_keys = [tagged("=", F.array(query))], [tagged("=", F.array(text))]
    if threshold < SHARE:
        tokens = token_set(query)
        needed = F.greatest(F.lit(1), F.floor(F.size(tokens) * (threshold / SHARE) - SLACK).cast("int") + 1)
        longest_first = F.array_sort(tokens, lambda a, b: F.length(b) - F.length(a))
        query_keys.append(tagged("t", F.slice(longest_first, F.lit(1), F.greatest(F.size(tokens) - needed + 1, F.lit(0)))))
        text_keys.append(tagged("t", token_set(text)))
    if threshold < CONTAINED:
        query_keys += [tagged("g", F.array(own_gram(query))), tagged("h", grams(query))]
        text_keys += [tagged("g", grams(text)), tagged("h", F.array(own_gram(text)))]
    if ratio and threshold < 1:
        prefix = rare_characters(threshold)
        query_keys.append(tagged("c", prefix(query)))
        text_keys.append(tagged("c", prefix(text)))
    keyed = left.select("query", F.explode(F.concat(*query_keys)).alias("key")).join(right.select("text", F.explode(F.concat(*text_keys)).alias("key")), "key")
    near = 2 * F.least(F.length(query), F.length(text)) > threshold * (F.length(query) + F.length(text)) - SLACK
    pairs = keyed.filter(~F.startswith("key", F.lit("c")) | near).select("query", "text").distinct()
    score = similarity(query, text, ratio_above(query, text, threshold) if ratio else None)
    return pairs.withColumn("similarity", score).filter(F.col("similarity") > threshold)
