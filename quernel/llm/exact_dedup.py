"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty. The identity of a text is
the SHA-256 of its normalised UTF-8 bytes. Of equal texts the row with the largest id stays (a null id is smallest);
rows that share text *and* id are one row repeated, of which exactly one stays.

1. Each partition summarises its digests with Misra-Gries counters. Summaries are mergeable: summed over partitions, a
   digest with more than ``n / k`` rows keeps an estimate of at least ``n / 2k``, so at most ``2k`` candidates remain.
2. Candidates are verified by an exact count; at most ``k`` digests can hold more than ``n / k`` rows, so what is
   broadcast has a proven bound whatever the input.
3. Rows of verified winners are judged on the map side against that broadcast table. All other digests have at most
   ``n / k`` rows each and go through an ordinary shuffle and window.

Defined results: an empty table gives an empty result; null and empty texts form one group; extra columns are left alone.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm import bloom
from quernel.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY_SHARE = 1024  # a digest is heavy with more than 1/1024 of all rows


def text_digest(text: str | Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def misra_gries(batches, capacity: int):
    """One partition's summary: at most ``capacity`` (digest, estimate) rows, each estimate low by at most n/(capacity+1)."""
    counters: dict[str, int] = {}
    for batch in batches:
        for item in pc.value_counts(batch.column(0)).to_pylist():
            counters[item["values"]] = counters.get(item["values"], 0) + item["counts"]
        if len(counters) > capacity:
            cut = sorted(counters.values(), reverse=True)[capacity]
            counters = {k: v - cut for k, v in counters.items() if v > cut}
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counters), pa.string()), pa.array(list(counters.values()), pa.int64())], ["digest", "estimate"]
    )


def heavy_digests(keys: DataFrame, share: int = HEAVY_SHARE) -> tuple[DataFrame, int]:
    """Digests with more than ``1/share`` of the rows of ``keys(row_id, digest)``: (digest, keep_id, group_size)."""
    total = keys.count()
    merged = (
        keys.select("digest")
        .mapInArrow(lambda batches: misra_gries(batches, 2 * share), "digest string, estimate long")
        .groupBy("digest")
        .agg(F.sum("estimate").alias("estimate"))
        .filter(F.col("estimate") * (2 * share + 1) >= total)
    )
    verified = (
        keys.join(F.broadcast(merged.select("digest")), "digest")
        .groupBy("digest")
        .agg(F.max("row_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter(F.col("group_size") * share > total)
    )
    return materialize(verified, "heavy"), total


def label_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = HEAVY_SHARE) -> DataFrame:
    """One row per row of ``docs``: row_id, digest, keep_id, group_size, kept."""
    keys = materialize(docs.select(F.col(id_col).alias("row_id"), text_digest(text_col).alias("digest")), "digests")
    heavy, _ = heavy_digests(keys, share)
    joined = keys.join(F.broadcast(heavy), "digest", "left")
    order = Window.partitionBy("digest").orderBy(F.col("row_id").desc_nulls_last())
    whole = Window.partitionBy("digest")
    columns = ["row_id", "digest", "keep_id", "group_size", "kept"]
    is_top = F.col("row_id").eqNullSafe(F.col("keep_id"))
    of_winners = joined.filter(F.col("group_size").isNotNull())
    losers = of_winners.filter(~is_top).withColumn("kept", F.lit(False))
    tops = of_winners.filter(is_top).withColumn("kept", F.row_number().over(order) == 1)
    light = (
        joined.filter(F.col("group_size").isNull())
        .withColumn("keep_id", F.max("row_id").over(whole))
        .withColumn("group_size", F.count("*").over(whole))
        .withColumn("kept", F.row_number().over(order) == 1)
    )
    return losers.select(columns).unionByName(tops.select(columns)).unionByName(light.select(columns))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = HEAVY_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. Winners are found on narrow keys; only texts whose id may be a
    loser's are shuffled to be dropped. Rows that share id and text are told apart by nothing: any of them stays."""
    labels = materialize(label_duplicates(docs, id_col, text_col, share).filter("group_size > 1").select("row_id", "digest", "kept"), "labels")
    # by id and text: does one row stay, and are there more of them?
    keys = labels.groupBy("row_id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).filter("NOT stays OR rows > 1")
    keys = materialize(keys.select(F.coalesce(F.col("row_id").cast("string"), F.lit("")).alias("name"), F.col("row_id").isNull().alias("no_id"), "digest", "stays"), "losers")
    tag = lambda name, none: F.xxhash64(name, none)
    may_go = bloom.may_hold(materialize(keys.select(tag("name", "no_id").alias("tag")).distinct(), "tags"))
    row_id = F.col(f"`{id_col}`")
    name, none = F.coalesce(row_id.cast("string"), F.lit("")), row_id.isNull()
    marked = may_go(tag(name, none))
    rows = docs.filter(marked).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"), none.alias("no_id"), text_digest(F.col(f"`{text_col}`")).alias("digest")
    )
    at = ["name", "no_id", "digest"]
    once = keys.filter("stays").select(at)
    left = rows.join(keys.select(at), at, "left_anti").select("row")
    if not once.isEmpty():  # of rows that share id and text, one
        one = rows.join(once, at, "left_semi").groupBy(at).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        left = left.unionByName(one.select("row"))
    return docs.filter(~marked).unionByName(left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label_duplicates(docs).select(
        F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
