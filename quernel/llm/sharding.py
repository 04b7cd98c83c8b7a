"""Uniform shuffle into exactly sized shards through a hypergeometric communication matrix.

The rows are first dealt into blocks by a hash. How many rows of block b land in slot range c of a uniform random
permutation follows the multivariate hypergeometric law, so the whole block-by-range count matrix is drawn at once; its
row sums are the block sizes and its column sums the exact range sizes. Each block permutes its rows locally and deals
them by its matrix row; after the exchange each range permutes again. A shard is a run of consecutive ranges, so
shards differ by one row at most and slots are gapless. Law: ``rows``.

Bounds: a block or range holds about ``rows_per_task`` rows, so tasks don't grow with the table until there are MOST_PARTS of
them (two billion rows), and then by narrow rows only. The matrix has at most MOST_PARTS squared cells (32 MB); it is drawn
on the driver from the block counts alone, written as a table in parts of PLAN_BLOCKS blocks, so that no plan carries more
than that, and broadcast. Tables of any number of rows have a matrix: where counts are beyond numpy's sampler (a billion), blocks
are split in halves first, by draws from the hypergeometric law around its mode. Everything that touches rows is DataFrame
functions.

Defined results: a null text has size 8 and checksum 0; repeated rows each get a slot of their own; an empty table gives
an empty result; fewer rows than shards leave the last shards empty; extra columns are left out. Ties in the hash are broken by id and checksum, and
rows that agree in all three are interchangeable, so reruns agree.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import materialize

SHARDS = 24
ROWS_PER_TASK = 1_000_000
LEAST_BLOCKS, MOST_PARTS = 64, 2016  # of blocks, and of slot ranges: the matrix has at most MOST_PARTS ** 2 cells
PLAN_BLOCKS = 64
NUMPY_MOST = 10**9


def draw_split(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` rows, taken from ``good + bad``, are good: a hypergeometric draw for counts of any size.

    Chances follow from the mode by the ratio of neighbours; so far from it that they underflow, nothing is ever drawn.
    """
    total = good + bad
    least, most = max(0, draws - bad), min(draws, good)
    if total < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    mode = min(most, max(least, (draws + 1) * (good + 1) // (total + 2)))
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(40 * spread) + 40
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high, dtype=np.float64)  # ratio of the chances of k + 1 and k
    ratio = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    chance = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def draw_matrix(block_sizes: list[int], range_sizes: list[int], seed: int) -> np.ndarray:
    """Counts of a uniform random permutation between blocks (rows) and slot ranges (columns)."""
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(block_sizes), len(range_sizes)), dtype=np.int64)

    def fill(first: int, last: int, columns: np.ndarray) -> None:
        """The rows first .. last of the matrix, given their sum in each column."""
        if int(columns.sum()) < NUMPY_MOST:
            left = columns.copy()
            for i in range(first, last):
                size = block_sizes[i]
                matrix[i] = rng.multivariate_hypergeometric(left, size, method="marginals") if size else 0
                left -= matrix[i]
        elif last - first == 1:
            matrix[first] = columns
        else:
            middle = (first + last) // 2
            wanted, rest = sum(block_sizes[first:middle]), int(columns.sum())
            upper = np.zeros_like(columns)
            for c, size in enumerate(columns.tolist()):
                rest -= size
                upper[c] = draw_split(size, rest, wanted, rng)
                wanted -= int(upper[c])
            fill(first, middle, upper)
            fill(middle, last, columns - upper)

    fill(0, len(block_sizes), np.array(range_sizes, dtype=np.int64))
    return matrix


def even_parts(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_into_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = 7,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """row_id, size, text_crc32, shard, slot for every row of ``docs``."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("row_id"),
        (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).withColumn("ticket", F.xxhash64(F.lit(seed), "row_id", "text_crc32", "size"))
    rows = materialize(rows, "rows")
    total = rows.count()
    blocks = min(MOST_PARTS, max(LEAST_BLOCKS, -(-total // rows_per_task)))
    per_shard = min(max(1, MOST_PARTS // shards), max(1, -(-total // (shards * rows_per_task))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "ticket"), F.lit(blocks)).cast("int"))
    counts = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    ranges = [part for size in even_parts(total, shards) for part in even_parts(size, per_shard)]
    matrix = draw_matrix([counts.get(b, 0) for b in range(blocks)], ranges, seed)
    ends = np.cumsum(matrix, axis=1).tolist()
    # one row for each block: where its runs of rows for each range end
    plan = None
    for start in range(0, blocks, PLAN_BLOCKS):
        part = spark.range(1).select(F.posexplode(F.array(*[F.lit(json.dumps(e)) for e in ends[start : start + PLAN_BLOCKS]])).alias("at", "ends"))
        part = part.select((F.col("at") + F.lit(start)).alias("block"), F.from_json("ends", "array<long>").alias("ends"))
        part = materialize(part, "plan") if blocks > PLAN_BLOCKS else part
        plan = part if plan is None else plan.unionByName(part)
    plan = F.broadcast(plan)
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 2), "ticket"), "row_id", "text_crc32")
    ranked = rows.withColumn("rank", (F.row_number().over(local) - 1).cast("long")).join(plan, "block")
    dealt = ranked.withColumn("col", F.size(F.filter("ends", lambda e: e <= F.col("rank")))).drop("ends")
    within = Window.partitionBy("col").orderBy(F.xxhash64(F.lit(seed + 3), "ticket"), "row_id", "text_crc32")
    offsets = [sum(ranges[c // per_shard * per_shard : c]) for c in range(len(ranges))]
    first = F.from_json(F.lit(json.dumps(offsets)), "array<long>")
    return dealt.withColumn("slot", F.row_number().over(within) - 1 + F.element_at(first, F.col("col") + 1)).select(
        "row_id", "size", "text_crc32", F.floor(F.col("col") / F.lit(per_shard)).cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shuffle_into_shards(docs).select(
        F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
