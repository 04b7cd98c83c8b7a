"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts elsewhere in the corpus is removed.

The corpus is parsed prefix-free. A rolling hash over WINDOW bytes triggers where it is smallest within RADIUS bytes on both
sides (the leftmost of equals), so triggers depend on the content around them alone and equal strings are cut alike. Each
starting position belongs to the phrase that ends at its first trigger: a repeat that starts inside a phrase is the
phrase's suffix from there on plus the parse that follows. The corpus order of suffixes therefore comes from two
orders that are far smaller than the corpus: that of phrase suffixes (phrases sorted from their ends: the suffix array of
the dictionary) and that of what follows a phrase, to a depth of ``length`` bytes (the suffix array of the parse). Two
positions at the same distance from their triggers start equal strings exactly if both orders put them into one interval.

On Spark:

1. Every phrase is entered under a hash of the bytes that all its strings share. A key that occurs once in the corpus can't
   take part in any repeat. A fixed-size Bloom filter of repeated keys thins the second scan, an exact join decides.
2. Phrases with equal context (phrase and what follows) are counted as one; with two or more, all their strings repeat.
3. Contexts that share a key but differ are compared as above, in chunks of whole keys. A key with more than ``hot_contexts``
   contexts is not put into one task: each of its strings is counted under its own hash by an ordinary aggregation.
4. Positions more than MAX_GAP bytes from a trigger (runs of one byte, say) are entered one by one.

Only keys and contexts of repeated phrases are shuffled; the text of documents without a removed byte never is.

Defined results: a null text is empty; nothing is removed from texts shorter than ``length``; repeated rows are copies of each
other, so long ones lose everything; matches never cross documents; an empty table gives an empty result; extra columns are
left out. Contexts are compared byte by byte; counts of equal contexts and the identity of a row (its id and text) rest on
128-bit hashes, in both halves wherever rows are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import arrow_text as at
from quernel.llm import bloom as blooms
from quernel.session import materialize, small_batches

WINDOW, RADIUS, MAX_GAP = 8, 40, 200
CHUNK_CONTEXTS = 20_000
CUT_BYTES = 2_000_000  # of texts that are cut at a time
CONTEXT_ROWS = 5_000  # contexts with their bytes that are handed on at a time
HOT_CONTEXTS = 50_000
INVERSE = np.uint64(pow(int(at.BASE), -1, 2**64))
OTHER_VALUES = at.mix(at.BYTE_VALUES) | np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables["up"], _tables["down"] = at.powers(n), at.powers(n, INVERSE)
    return _tables["up"], _tables["down"]


class Hashed:
    """Prefix sums that give a 64-bit hash of any substring."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return at.mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def triggers(data: np.ndarray) -> np.ndarray:
    """Positions at which the rolling hash is smaller than at the RADIUS before and no larger than at the RADIUS after."""
    if len(data) < WINDOW + 2 * RADIUS:
        return np.zeros(0, np.int64)
    v = data.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    g = ((v * at.M1) >> np.uint64(32)).astype(np.uint32)
    low = g
    for step in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(low) - (RADIUS - 32)], low[RADIUS - 32 :])  # low[i]: smallest of g[i : i + RADIUS]
    middle = g[RADIUS : len(g) - RADIUS]
    return np.flatnonzero((middle < low[: len(middle)]) & (middle <= low[RADIUS + 1 : RADIUS + 1 + len(middle)])) + RADIUS


def phrases(data: np.ndarray, offsets: np.ndarray, length: int):
    """For each phrase: text, trigger, first and last start of its strings (all as positions in ``data``), key and context hash.

    A position far from any trigger is a phrase of its own with itself as the trigger.
    """
    all_triggers = triggers(data)
    text = np.searchsorted(offsets, all_triggers, "right") - 1
    begin, end = offsets[text], offsets[text + 1]
    inside = (all_triggers - begin >= RADIUS) & (all_triggers + WINDOW + RADIUS <= end)
    trig, text = all_triggers[inside], text[inside]
    # one closing entry for each text: positions after the last trigger
    long_texts = np.flatnonzero(np.diff(offsets) >= length)
    t = np.concatenate([text, long_texts])
    a = np.concatenate([trig, offsets[long_texts + 1]])
    closing = np.concatenate([np.zeros(len(trig), bool), np.ones(len(long_texts), bool)])
    order = np.lexsort((closing, a, t))
    t, a, closing = t[order], a[order], closing[order]
    begin, end = offsets[t], offsets[t + 1]
    first = np.empty(len(a), dtype=np.int64)
    if len(a):
        same = np.zeros(len(a), dtype=bool)
        same[1:] = t[1:] == t[:-1]
        first[:] = begin
        first[1:][same[1:]] = a[:-1][same[1:]] - RADIUS + 1
    first = np.maximum(first, begin)
    last = np.where(closing, end - length, np.minimum(a - RADIUS, end - length))
    near = np.where(closing, last + 1, np.maximum(first, a - RADIUS - MAX_GAP))
    far_end = np.minimum(near - 1, last)
    far = [np.arange(f, e + 1) for f, e in zip(first[far_end >= first].tolist(), far_end[far_end >= first].tolist())]
    far_text = np.repeat(t[far_end >= first], [len(x) for x in far]) if far else np.zeros(0, np.int64)
    far = np.concatenate(far) if far else np.zeros(0, np.int64)
    whole = near <= last
    t, a, near, last = t[whole], a[whole], near[whole], last[whole]
    one, two = Hashed(data, at.BYTE_VALUES), Hashed(data, OTHER_VALUES)
    key = one.of(a - RADIUS, a - RADIUS - MAX_GAP + length)
    shape = ((a - near) * 1024 + (a - last)).astype(np.uint64)
    full = at.mix(two.of(near, last + length) + shape * at.BASE)
    far_key, far_full = one.of(far, far + length), two.of(far, far + length)
    return (np.concatenate([t, far_text]), np.concatenate([a, far]), np.concatenate([near, far]), np.concatenate([last, far]),
            np.concatenate([key, at.mix(far_key + np.uint64(1))]).view(np.int64), np.concatenate([full, far_full]).view(np.int64))


def _parse(length: int, bloom=None, by: str = "key", contexts: bool = False):
    """Phrases of the texts of batches (rid, rid2, text): all, or those whose key or place may be in a Bloom filter."""
    fields = [("key", pa.int64()), ("full", pa.int64()), ("rid", pa.int64()), ("rid2", pa.int64()), ("trigger", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]
    schema = pa.schema(fields + ([("context", pa.binary())] if contexts else []))

    def run(batches):
        for batch in at.parts(batches):
            data, offsets = at.bytes_of(batch.column(2))
            ids, ids2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, last, part, bounds in at.slices(data, offsets):
                text, a, lo, hi, key, full = phrases(part, bounds, length)
                rid, rid2 = ids[first:last][text], ids2[first:last][text]
                base = bounds[text]
                if bloom is not None:
                    hit = bloom.value.may_hold(key if by == "key" else place(rid, a - base))
                    a, lo, hi, key, full, rid, rid2, base = (x[hit] for x in (a, lo, hi, key, full, rid, rid2, base))
                step = CONTEXT_ROWS if contexts else 500_000
                for k in range(0, len(a), step):
                    cut = slice(k, k + step)
                    columns = [key[cut], full[cut], rid[cut], rid2[cut], a[cut] - base[cut], lo[cut] - base[cut], hi[cut] - base[cut]]
                    arrays = [pa.array(c) for c in columns]
                    if contexts:
                        whole = part.tobytes() if k == 0 else whole
                        arrays.append(pa.array([whole[x:y] for x, y in zip(lo[cut].tolist(), (hi[cut] + length).tolist())], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def place(rid: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    return at.mix(rid.view(np.uint64) + at.mix(trigger.astype(np.uint64))).view(np.int64)


def _place_of(batches):
    for batch in batches:
        rid, trigger = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(place(rid, trigger))], ["place"])


def repeated_starts(contexts: list[bytes], before: np.ndarray, after: np.ndarray, length: int) -> np.ndarray:
    """For each context and distance x = RADIUS .. RADIUS + MAX_GAP before its trigger: does its string occur in another context?

    ``before`` and ``after``: bytes from the first and from the last start to the trigger.
    """
    n, left, right = len(contexts), RADIUS + MAX_GAP, length - RADIUS
    phrase, follow = np.zeros((n, left), np.uint8), np.zeros((n, right), np.uint8)
    for i, (c, b) in enumerate(zip(contexts, before.tolist())):
        row = np.frombuffer(c, np.uint8)
        phrase[i, :b] = row[:b][::-1]
        follow[i, : len(row) - b] = row[b:]

    def ordered(table):
        order = np.argsort(table.view(f"S{table.shape[1]}").ravel(), kind="stable")
        table = table[order]
        differ = table[1:] != table[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
        return order, common

    phrase_order, phrase_common = ordered(phrase)
    follow_order, follow_common = ordered(follow)
    found = np.zeros((n, MAX_GAP + 1), dtype=bool)
    interval, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for x in range(RADIUS, RADIUS + MAX_GAP + 1):
        rows = np.flatnonzero((before >= x) & (after <= x))
        if len(rows) < 2:
            continue
        interval[phrase_order[1:]] = np.cumsum(phrase_common < x)
        interval[phrase_order[0]] = 0
        other[follow_order[1:]] = np.cumsum(follow_common < length - x)
        other[follow_order[0]] = 0
        code = interval[rows] * n + other[rows]
        rank = np.argsort(code, kind="stable")
        ordered_code = code[rank]
        equal = ordered_code[1:] == ordered_code[:-1]
        twin = np.zeros(len(rows), dtype=bool)
        twin[1:] |= equal
        twin[:-1] |= equal
        found[rows[rank[twin]], x - RADIUS] = True
    return found


SPANS = pa.schema([("rid", pa.int64()), ("rid2", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _compare(length: int):
    """Removed spans of contexts (key, rid, rid2, trigger, lo, hi, copies, context) that come sorted by key."""

    def chunk(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        rid, rid2, trigger, lo, hi, copies = (table.column(i).to_numpy() for i in range(1, 7))
        found = repeated_starts(table.column(7).to_pylist(), trigger - lo, trigger - hi, length)
        found[copies > 1] = False  # these are removed already
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, close = np.nonzero(edge == -1)
        start = trigger[row] - (RADIUS + close - 1)  # larger distances start earlier
        end = trigger[row] - (RADIUS + begin) + length
        return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(rid2[row]), pa.array(start), pa.array(end)], schema=SPANS)

    def run(batches):
        held, rows, last = [], 0, None
        at.make_room()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            at_row = 0
            while at_row < batch.num_rows:
                if rows >= CHUNK_CONTEXTS:  # go on to the end of the key
                    stop = at_row + int(np.argmax(np.append(keys[at_row:] != last, True)))
                    if stop > at_row:
                        held.append(batch.slice(at_row, stop - at_row))
                    if stop == batch.num_rows:
                        at_row = stop
                        continue
                    yield chunk(held)
                    held, rows, at_row = [], 0, stop
                take = min(CHUNK_CONTEXTS - rows, batch.num_rows - at_row)
                held.append(batch.slice(at_row, take))
                rows, at_row = rows + take, at_row + take
                last = keys[at_row - 1]
        if held:
            yield chunk(held)
        del held
        at.make_room()

    return run


def _strings(length: int):
    """Every string of contexts (key, rid, rid2, trigger, lo, hi, copies, context): two hashes, rid, rid2 and start."""
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("rid", pa.int64()), ("rid2", pa.int64()), ("start", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(7)[i].as_py(), np.uint8)
                start = np.arange(len(data) - length + 1)
                rid, rid2, lo = (batch.column(k)[i].as_py() for k in (1, 2, 4))
                one, two = (Hashed(data, v).of(start, start + length).view(np.int64) for v in (at.BYTE_VALUES, OTHER_VALUES))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(start), rid)), pa.array(np.full(len(start), rid2)), pa.array(start + lo)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(rid, rid2, start, end): spans of bytes covered by repeated strings; they may overlap. ``docs``: rid, rid2, text."""
    spark = docs.sparkSession
    phrase_columns = "key long, full long, rid long, rid2 long, trigger long, lo long, hi long"
    texts = docs.filter(F.octet_length("text") >= length)
    keys = texts.mapInArrow(_parse(length), phrase_columns).select("key").groupBy("key").count().filter("count > 1").select("key")
    keys = materialize(keys, "keys")
    bloom = spark.sparkContext.broadcast(blooms.build(keys))
    repeated = texts.mapInArrow(_parse(length, bloom), phrase_columns).join(keys, "key", "left_semi")
    repeated = materialize(repeated, "repeated")
    contexts = materialize(
        repeated.groupBy("key", "full").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "rid2", "trigger", "lo", "hi")).alias("one")), "contexts"
    )
    equal = repeated.join(contexts.filter("copies > 1").select("key", "full"), ["key", "full"], "left_semi")
    spans = equal.select("rid", "rid2", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    mixed = contexts.groupBy("key").agg(F.count("*").alias("contexts"), F.min("copies").alias("least")).filter("contexts > 1 AND least = 1")
    unclear = materialize(
        contexts.join(mixed.select("key", "contexts"), "key").select("key", "one.rid", "one.rid2", "one.trigger", "copies", "contexts"), "unclear"
    )
    places = spark.sparkContext.broadcast(blooms.build(unclear.select("rid", "trigger").mapInArrow(_place_of, "place long")))
    found = texts.mapInArrow(_parse(length, places, "place", True), phrase_columns + ", context binary")
    at_place = ["rid", "rid2", "trigger", "key"]
    full = found.join(unclear.select(*at_place, "copies", "contexts"), at_place).dropDuplicates(at_place)
    full = materialize(full.select("key", "rid", "rid2", "trigger", "lo", "hi", "copies", "context", "contexts"), "context_bytes")
    cold = full.filter(F.col("contexts") <= hot_contexts).drop("contexts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-full.count() // CHUNK_CONTEXTS))
    compared = cold.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare(length), "rid long, rid2 long, start long, end long")
    hot = full.filter(F.col("contexts") > hot_contexts).drop("contexts")
    strings = hot.mapInArrow(_strings(length), "one long, two long, rid long, rid2 long, start long")
    often = strings.groupBy("one", "two").count().filter("count > 1").select("one", "two")
    hot_spans = strings.join(often, ["one", "two"], "left_semi").select("rid", "rid2", "start", (F.col("start") + length).alias("end"))
    return spans.unionByName(compared).unionByName(hot_spans)


def _cut(batches):
    """Bytes, bytes and spans removed, characters kept and the remaining text of rows (row_id, text, spans)."""
    schema = pa.schema([("row_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_kept_chars", pa.int64()), ("kept", pa.binary())])
    for batch in at.parts(batches):
        data, offsets = at.bytes_of(batch.column(1))
        for first, last, part, bounds in at.slices(data, offsets, CUT_BYTES):
            rows = [[], [], [], [], []]
            for i, found in enumerate(batch.column(2).slice(first, last - first).to_pylist()):
                raw = part[bounds[i] : bounds[i + 1]]
                edge = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(edge, [s["start"] for s in found or ()], 1)
                np.add.at(edge, [s["end"] for s in found or ()], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone]
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                for column, value in zip(rows, (len(raw), int(gone.sum()), spans, int(np.count_nonzero((kept & 0xC0) != 0x80)), kept.tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(r, pa.int64()) for r in rows[:4]), pa.array(rows[4], pa.binary())], schema=schema)


def _maybe(bloom):
    def run(batches):
        for batch in at.parts(batches):
            hit = bloom.value.may_hold(batch.column(0).to_numpy(zero_copy_only=False))
            yield batch.append_column("hit", pa.array(hit))

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """row_id, n_bytes, n_removed, n_spans, n_kept_chars (UTF-8 lead bytes that stay) and the kept bytes of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("row_id", "text")).withColumn("rid2", F.xxhash64(F.lit(2), "row_id", F.length("text"), "text"))
    found = repeated_spans(rows.select("rid", "rid2", "text"), length, hot_contexts)
    spans = materialize(found.groupBy("rid", "rid2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    bloom = spark.sparkContext.broadcast(blooms.build(spans.select("rid")))
    marked = rows.select("rid", "rid2", "row_id", "text").mapInArrow(_maybe(bloom), "rid long, rid2 long, row_id long, text string, hit boolean")
    none = F.lit(0).cast("long")
    whole = marked.filter("NOT hit").select(
        "row_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.length("text").cast("long").alias("n_kept_chars"), F.col("text").cast("binary").alias("kept"),
    )
    cut = marked.filter("hit").join(spans, ["rid", "rid2"], "left").select("row_id", "text", "spans")
    return whole.unionByName(cut.mapInArrow(_cut, "row_id long, n_bytes long, n_removed long, n_spans long, n_kept_chars long, kept binary"))


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(
        F.col("row_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept_bytes"), "n_kept_chars",
    )


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, md5_number(array_slice(b, i + 1, i + 400)) AS k FROM d, unnest(range(0, n - 399)) t(i)),
m AS MATERIALIZED (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM p SEMI JOIN m ON p.k = m.k),
g AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS no
      FROM (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, -1) AS new FROM r)),
s AS (SELECT doc_id, no, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, no),
c AS (SELECT s.doc_id, count(*) AS spans, sum(z - a) AS removed,
        string_agg(hex(array_slice(b, before + 1, a)), '' ORDER BY a) || hex(array_slice(any_value(b), max(z) + 1, any_value(n))) AS kept
      FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s) s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256, CAST(n - coalesce(removed, 0) AS BIGINT) AS n_kept_bytes,
  CAST(CASE WHEN kept IS NULL THEN length(decode(b)) ELSE length(regexp_replace(regexp_replace(kept, '([89AB][0-9A-F]|([0-7C-F][0-9A-F]))', '\2', 'g'), '..', 'x', 'g')) END AS BIGINT) AS n_kept_chars
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""
