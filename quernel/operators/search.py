"""Relevance-ranked and fuzzy search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import fold_text, overlap_share, ratio_above, road_name, similarity, token_set
from quernel.functions.values import duration_minutes
from quernel.operators.similar import similar_pairs

def relevance(terms: list[str], corpus: Column, name: Column) -> Column:
    """For each term, the share of its tokens found in the corpus plus that found in the name. A term may hold many tokens."""
    score = F.lit(0.0)
    for term in terms:
        tokens = F.array(*[F.lit(t) for t in dict.fromkeys(term.split())])
        score = score + overlap_share(tokens, corpus) + overlap_share(tokens, name)
    return score


def equals_filter(column: Column, wanted: str | None) -> Column:
    """Equality of normalised texts; a blank request filters nothing. ``column`` is normalised."""
    return (column == F.lit(fold_text(wanted))) if wanted and fold_text(wanted) else F.lit(True)


def contains_all(have: Column, wanted: list[str]) -> Column:
    """Whether every wanted value is among ``have``, an array of normalised values."""
    wanted = [w for w in map(fold_text, wanted) if w]
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), have)) == 0 if wanted else F.lit(True)


def ranked_search(
    rows: DataFrame, id_col: str, name: Column, corpus: Column, query: str | None = None, ingredients: list[str] = (),
    equal: list[tuple[Column, str | None]] = (), subsets: list[tuple[Column, list[str]]] = (), total_time: Column | None = None,
    maximum_time: int | None = None, top_k: int = 5,
) -> DataFrame:
    """Faceted search: ``name`` and ``corpus`` are normalised texts. Rows without any hit go if there is a text term; the first
    ``top_k`` by falling score, name and id stay."""
    terms = [t for t in (fold_text(query or ""), *map(fold_text, ingredients)) if t]
    for column, wanted in equal:
        rows = rows.filter(equals_filter(column, wanted))
    for have, wanted in subsets:
        rows = rows.filter(contains_all(have, wanted))
    if maximum_time is not None:
        rows = rows.filter(duration_minutes(total_time) <= maximum_time)
    scored = rows.withColumn("score", relevance(terms, token_set(corpus), token_set(name)) if terms else F.lit(0.0)).withColumn("name_key", name)
    scored = scored.filter("score > 0") if terms else scored
    return scored.orderBy(F.desc("score"), "name_key", id_col).limit(top_k)


def fuzzy_matches(queries: DataFrame, candidates: DataFrame, threshold: float, limit: int = 5, ratio: bool = True) -> DataFrame:
    """The best ``limit`` candidates (id, text) for each query (query_id, query) whose similarity is strictly above the threshold.

    Texts are normalised. Strings are compared only if an index of tokens, q-grams and characters says that they may be similar enough; each
    distinct pair of strings is scored once.
    """
    pairs = similar_pairs(queries, candidates, threshold, ratio)
    scored = queries.select("query_id", "query").join(pairs, "query").join(candidates.select("id", "text"), "text")
    best = scored.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), F.max_by("text", "similarity").alias("text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def incident_labels(edges: DataFrame, source: str = "source", target: str = "target", label: str = "label") -> DataFrame:
    """(node, label): distinct labels of a node's incoming and outgoing edges."""
    out = edges.select(F.col(source).alias("node"), F.col(label).alias("label"))
    into = edges.select(F.col(target).alias("node"), F.col(label).alias("label"))
    return out.union(into).distinct()


def search_locations(nodes: DataFrame, edges: DataFrame, query: str, target_type: str = "auto", min_similarity: float = 0.8, limit: int = 5) -> DataFrame:
    """Nodes by their id, name and roads. ``nodes``: node_id, name; ``edges``: source, target, road_name. A road wins over the node
    only when it is strictly more similar."""
    from quernel.functions.text import normalize_text

    needle = F.lit(fold_text(query))
    road_needle = road_name(needle)
    folded = nodes.withColumn("id_key", normalize_text("node_id")).withColumn("name_key", normalize_text("name"))
    own = F.greatest(*[similarity(needle, F.col(c), ratio_above(needle, F.col(c), min_similarity)) for c in ("id_key", "name_key")])
    scored = folded.withColumn("own", own if target_type in ("auto", "node") else F.lit(0.0))
    if target_type in ("auto", "road"):
        roads = incident_labels(edges, label="road_name").withColumn("key", road_name(normalize_text("label")))
        roads = roads.withColumn("score", F.when(road_needle != "", similarity(road_needle, F.col("key"), ratio_above(road_needle, F.col("key"), min_similarity))).otherwise(0.0))
        best = roads.groupBy(F.col("node").alias("node_id")).agg(F.max(F.struct("score", F.lit(0))).getField("score").alias("road_score"), F.min_by("label", F.struct(-F.col("score"), "label")).alias("road"))
        scored = scored.join(best, "node_id", "left")
    else:
        scored = scored.withColumn("road_score", F.lit(0.0)).withColumn("road", F.lit(None).cast("string"))
    by_road = F.coalesce(F.col("road_score") > F.col("own"), F.lit(False))
    found = scored.select(
        "node_id", "name", F.when(by_road, "road").otherwise("node").alias("target_type"),
        F.when(by_road, F.col("road_score")).otherwise(F.col("own")).alias("similarity"), F.when(by_road, F.col("road")).alias("road_name"),
    )
    return found.filter(F.col("similarity") > min_similarity).orderBy(F.desc("similarity"), "node_id").limit(limit)


def catalog_search(catalog: DataFrame, query: str | None) -> DataFrame:
    """Entries (name, description) by the number of query tokens that name or description contain; all of them for a blank query."""
    tokens = list(dict.fromkeys((query or "").lower().split()))
    if not tokens:
        return catalog.withColumn("hits", F.lit(0))
    hay = F.lower(F.concat_ws(" ", "name", "description"))
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(hay, t)))
    return catalog.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "name")
