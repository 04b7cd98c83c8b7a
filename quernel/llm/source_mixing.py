"""Mixing sources to target weights by a low-discrepancy schedule.

Size of a document: its number of words (runs of bytes other than space and 0x09-0x0D). Sources in code point order,
null last, weigh 3, 1, 2 and so on; together they share ``share`` times all words. A source's target stops at ``cap`` times
its own words and the excess is shared again by weight, which is a water level: sources are capped in order of
words / weight while the level of the rest exceeds their cap.

* Every source is a shuffled stream of its documents' words (order: MD5 of the id), cut into blocks of equal length.
  Going through the stream again is a second pass, so no document is taken more than ``cap`` times.
* The schedule maps the golden-ratio points ``frac(i * 0.618...)`` through the cumulative targets; each point is one slot
  of the source it falls in. Slots are ranked per source and the r-th slot takes the source's r-th block.
* The few slots by which a source falls short of its target (the discrepancy grows with the logarithm of the schedule)
  follow at the end; slots beyond the target are dropped. The last slot of a source is cut to the rounded target.

The order of the mix is the slot: each document has the slot at which its first word comes. Mixed documents are dealt to files by a
hash and stand there in the order of their slots, so that every file, read from its start, is an even sample of the mix so far.

Positions in the streams, ranks of slots and sums over sources are two-level prefix sums (totals of buckets or ranges first,
then within one), so no task holds a whole source or all sources. Sources are matched with schedule points through 4096 bins of
the unit interval: an equi-join, without a broadcast of unknown size.

Inside, a source is a key string that is never null and sorts as sources do.

Defined results: null texts and texts without words have size 0 and are never taken; null sources are one source, last in
order; repeated rows each have their own place in the stream; an empty table gives an empty result; extra columns stay with
their rows. Rows that are equal in every column are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BLOCK_WORDS = 4096
BUCKET_DIGITS = 3  # hex digits of the shuffle key that make a bucket of a source's stream
SLOT_CHUNK = 65536
BINS = 4096


def source_key(source: Column) -> Column:
    """Never null, in the order of sources with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_of(key: Column) -> Column:
    return F.when(F.startswith(key, F.lit("0")), F.substring(key, F.lit(2), F.length(key)))


def row_hash(docs: DataFrame, columns) -> Column:
    """A hash of the columns in which a null differs from every value and from a value of the next column."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def running(rows: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``rows`` with ``<value>_before``, the sum over all rows before in a total order: first by ranges, then within a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranged")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    starts = ranged.groupBy("range").agg(*[F.sum(v).alias(v) for v in values])
    starts = starts.select("range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_start") for v in values])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "range").select(
        *rows.columns, *[(F.col(f"{v}_start") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(f"{v}_before") for v in values]
    )


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """totals(source, source_size) with number in the order of sources, weight and target."""
    placed = running(totals.withColumn("one", F.lit(1).cast("long")), [F.col("source")], ["one"]).withColumnRenamed("one_before", "number")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    ranked = running(placed, [F.col("ratio"), F.col("source")], ["one", "source_size", "weight"])
    words, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    ranked = ranked.withColumn("open", F.lit(share * (words or 0)) - F.lit(float(cap)) * F.col("source_size_before")).withColumn(
        "open_weight", F.lit(weight_sum or 0).cast("long") - F.col("weight_before")
    ).withColumn("capped", F.col("open") * F.col("weight") / F.col("open_weight") > F.lit(float(cap)) * F.col("source_size"))
    # the level of the first source that stays below its cap holds for all of them
    level = ranked.filter("NOT capped").agg(F.min(F.struct("one_before", "open", "open_weight")).alias("first")).first()["first"]
    target = F.lit(float(cap)) * F.col("source_size")
    if level is not None:
        target = F.when(F.col("capped"), target).otherwise(F.lit(level["open"]) * F.col("weight") / F.lit(level["open_weight"]))
    return ranked.select("source", "source_size", "number", "weight", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def word_streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, hashed) -> tuple[DataFrame, DataFrame]:
    """Places of documents in their source's shuffled stream (row_id, source, size, row_hash, bucket, place, at), and totals."""
    rows = docs.select(
        F.col(id_col).alias("row_id"), source_key(F.col(source_col)).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash(docs, hashed).alias("row_hash"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    rows = materialize(rows, "sizes")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("source", "bucket").orderBy("key", F.col("row_id").asc_nulls_first(), "size", "row_hash")
    inner = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "*", F.row_number().over(order).alias("place"), F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("within")
    )
    return placed.join(starts, ["source", "bucket"]).select(
        "row_id", "source", "size", "row_hash", "bucket", "place", (F.col("start") + F.col("within")).alias("at")
    ), totals


def slots_needed(words, size, block):
    """Slots that ``words`` words of a stream of ``size`` words take: each pass ends with a shorter block."""
    per_pass = F.ceil(size / F.lit(block))
    passes = F.expr("words div greatest(source_size, 1)")
    return (passes * per_pass + F.ceil((words - passes * size) / F.lit(block))).cast("long")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix in order: (slot, source, rank)."""
    spark = targets.sparkSession
    needs = targets.withColumn("words", F.round("target").cast("long")).withColumn(
        "slots", slots_needed(F.col("words"), F.col("source_size"), block_words)
    ).filter("slots > 0")
    all_slots = F.lit(needs.agg(F.sum("slots")).first()[0] or 0)
    bounds = materialize(
        running(needs.select("source", "number", "slots"), [F.col("source")], ["slots"]).select(
            "source", "number", "slots", (F.col("slots_before") / all_slots).alias("lo"), ((F.col("slots_before") + F.col("slots")) / all_slots).alias("hi"),
        ),
        "bounds",
    )
    total, sources = (x or 0 for x in bounds.agg(F.sum("slots"), F.max("number") + 1).first())
    binned = bounds.withColumn("bin", F.explode(F.expr(f"sequence(cast(floor(lo * {BINS}) AS int), cast(least({BINS} - 1, floor(hi * {BINS})) AS int))")))
    golden = F.col("i") * F.lit(0.6180339887498949)
    points = spark.range(total).toDF("i").withColumn("u", golden - F.floor(golden)).withColumn("bin", F.floor(F.col("u") * BINS).cast("int"))
    hits = points.join(binned, "bin").filter("u >= lo AND (u < hi OR hi = 1.0 AND u <= 1.0)").select("i", "source", "slots", (F.col("i") / SLOT_CHUNK).cast("long").alias("chunk"))
    chunks = hits.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_starts = chunks.select("source", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "chunk").orderBy("i")
    ranked = hits.withColumn("inner", F.row_number().over(inner) - 1)
    ranked = ranked.join(chunk_starts, ["source", "chunk"]).select(
        F.col("i").alias("slot"), "source", (F.col("start") + F.col("inner")).alias("rank"), "slots"
    ).filter("rank < slots")
    got = chunks.groupBy("source").agg(F.sum("n").alias("got"))
    short = bounds.join(got, "source", "left").select(
        "source", "number", "slots", F.coalesce("got", F.lit(0)).alias("got")
    ).filter("got < slots")
    late = short.select("source", "number", "got", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank")).select(
        (F.lit(total) + (F.col("rank") - F.col("got")) * F.lit(sources) + F.col("number")).alias("slot"), "source", "rank"
    )
    return ranked.select("slot", "source", "rank").unionByName(late)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, hashed=None,
) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces (slot, row_id, source, size, row_hash, bucket, place, pass, first_word, n_words), and all documents with their targets."""
    streams, totals = word_streams(docs, id_col, text_col, source_col, hashed or [id_col, text_col, source_col])
    targets = materialize(source_targets(totals, weights, share, cap), "targets")
    placed = streams.join(targets, "source").select(*streams.columns, "source_size", "target", F.round("target").cast("long").alias("words"))
    placed = materialize(placed, "streams")
    slots = schedule(targets, block_words)
    block = F.lit(block_words)
    per_pass = F.ceil(F.col("source_size") / block)
    pieces = (
        placed.filter("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .filter("pass * source_size + at < words")
        .withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
        .withColumn("rank", (F.col("pass") * per_pass + F.col("block")).cast("long"))
        .withColumn("from_word", F.greatest(F.col("at"), F.col("block") * block))
        .withColumn("to_word", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block, F.col("words") - F.col("pass") * F.col("source_size")))
        .filter("from_word < to_word")
    )
    mixed = pieces.join(slots, ["source", "rank"]).select(
        "slot", "row_id", "source", "size", "row_hash", "bucket", "place", "pass",
        (F.col("from_word") - F.col("at")).alias("first_word"), (F.col("to_word") - F.col("from_word")).alias("n_words"),
    )
    return mixed, placed


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``: one for each pass that takes words of a document, in the order of the mix within each file. Where a pass
    ends inside a document, the words taken are joined by single spaces. Rows equal in every column are interchangeable."""
    pieces, _ = mix_sources(docs, id_col, text_col, source_col, hashed=docs.columns, **options)
    passes = pieces.groupBy("row_hash", "row_id", "source", "bucket", "place", "size", "pass").agg(
        F.min("slot").alias("slot"), F.min("first_word").alias("first_word"), F.sum("n_words").alias("n_words")
    )
    passes = passes.select("row_hash", F.coalesce(F.col("row_id").cast("string"), F.lit("")).alias("row_name"), "size", "slot", "first_word", "n_words")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(
        whole.alias("row"), row_hash(docs, docs.columns).alias("row_hash"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("row_name")
    ).dropDuplicates(["row_hash", "row_name"])
    text = F.col(f"row.`{text_col}`")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), " ")
    taken = F.when(F.col("n_words") < F.col("size"), cut).otherwise(text)
    joined = named.join(passes, ["row_hash", "row_name"])
    mixed = joined.select("slot", F.struct(*[taken.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("row"))
    return mixed.sortWithinPartitions("slot").select("row.*")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed, placed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mixed.groupBy("source", "bucket", "place").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, ["source", "bucket", "place"], "left").select(
        F.col("row_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER o AS rank,
        1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open,
        CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open_weight
      FROM t WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
c AS (SELECT *, open * weight / open_weight > 2.0::DOUBLE * source_size AS capped FROM r),
l AS (SELECT *, min_by({'o': open, 'w': open_weight}, rank) FILTER (NOT capped) OVER () AS level FROM c),
g AS (SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE level.o * weight / level.w END AS target FROM l),
p AS (SELECT d.*, g.source_size, g.target, CAST(round_even(target, 0) AS BIGINT) AS words,
        coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
        CAST((words // greatest(source_size, 1)) * ceil(source_size / 4096) + ceil((words - (words // greatest(source_size, 1)) * source_size) / 4096) AS BIGINT) AS slots
      FROM (SELECT DISTINCT source, source_size, words FROM p)),
b AS (SELECT *, CAST(sum(slots) OVER () AS BIGINT) AS total, count(*) OVER () AS places,
        CAST(sum(slots) OVER (ORDER BY place) AS BIGINT) AS upto FROM n WHERE slots > 0),
u AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u FROM range((SELECT max(total) FROM b)) t(i)),
h AS (SELECT source, slots, i AS slot, row_number() OVER (PARTITION BY place ORDER BY i) - 1 AS rank
      FROM b JOIN u ON u >= (upto - slots)::DOUBLE / total AND u < upto::DOUBLE / total),
w AS (SELECT source, slot, rank FROM h WHERE rank < slots),
late AS (SELECT b.source, total + (unnest(range(got, slots)) - got) * (SELECT max(place) + 1 FROM b) + place AS slot, unnest(range(got, slots)) AS rank
      FROM (SELECT b.*, (SELECT count(*) FROM h WHERE h.source IS NOT DISTINCT FROM b.source) AS got FROM b) b WHERE got < slots),
f AS (SELECT * FROM w UNION ALL SELECT * FROM late)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(pos + size, words) - pos) + greatest(0, least(source_size + pos + size, words) - source_size - pos) AS BIGINT) AS taken,
  CAST(f.slot AS BIGINT) AS first_slot
FROM p LEFT JOIN f ON f.source IS NOT DISTINCT FROM p.source AND f.rank = pos // 4096 AND size > 0 AND pos < words
"""
ORACLE = ORACLE.replace("round_even(target, 0)", "round(target)")
