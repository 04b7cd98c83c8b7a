"""N-gram Jaccard join of whole texts: a size-aware heavy-light join.

A document's set is its distinct ``k``-word shingles after lower-casing A-Z. Two documents link when
``100 * |intersection| >= percent * |union|``; sets of sizes a <= b then share at least
``o(a, b) = ceil(percent * (a + b) / (100 + percent))`` shingles and a >= percent% of b.

* Documents of equal sets are one class with one representative, so copies are never compared.
* Light classes (at most ``boundary`` shingles) enumerate all their subsets of the sizes o(a, b) that a partner may share.
  In one subset's group the smallest set links with every set that any other member links with, so linking all to it
  keeps connectivity without listing pairs.
* Heavy classes, and light ones large enough to link with them, are entered in inverted lists under the shingles of
  their prefix: the ``n - ceil(percent% n) + 1`` first in one global order. That order puts shingles that a counting
  sketch over all documents finds frequent last, so lists are short. Pairs must pass the length and the position filter.
* The boundary is where the subsets of all classes of a size cost more than their lists.
* A list is first compared with one hub, its most central member (whose other shingles stand in long lists too). Members that
  are connected by then are never compared with each other, so a large group of near copies costs pairs in proportion to
  its size. When few pairs across components are left in a list, or after ``hub_rounds``, all of them are compared, so that
  no link that would join two components is lost; a list with many gets another hub outside its largest component first. Lists
  of more than BLOCK_MEMBERS members are compared block by block: two blocks are a join key of their own, so that no task
  holds a long list. A pair whose entries in a list also have the token before in common is left to that token's list.
* Every candidate is verified: first by profiles (how many shingles fall into each of its hash ranges, one or two to a range, bounds the overlap
  from above), then on the two whole sets.

Broadcast are a counting sketch of a byte for each of ``2 ** 20`` to ``2 ** 24`` cells, more for more documents, and a Bloom filter of at
most 16 MB, which decide about cost only: a shingle that the sketch takes for usual is in a long list, which hubs and blocks handle.

Defined results: null texts and texts without words have an empty set (0 shingles) and are their own component; with
fewer than ``k`` words the whole sequence is the one shingle; rows without an id get no component and link with nothing;
repeated rows share a class; an empty table gives an empty result; extra columns stay with their rows. Shingles are compared by
64-bit hashes, sets by 128 bits: classes are named by the first half, and where two classes agree in that (to be expected from
some 10^10 of them on), both get names that follow from both halves.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import arrow_text as at
from quernel.llm import bloom as blooms
from quernel.llm.components import connected_components
from quernel.session import materialize

SKETCH_BITS, MOST_SKETCH_BITS, SKETCH_PART_BITS = 20, 24, 16
SKETCH_DOCUMENTS = 16  # a cell for so many of them
LEAST_RANGES, MOST_RANGES = 64, 16_384  # hash ranges of a set's profile: a power of two, one or two shingles in each
PROFILE_BYTES = 2_000_000  # of profiles that are compared at a time
COARSE = 16  # hash ranges of the coarser one that list entries are compared by
HEAVY_TOKENS = 65_536  # bound of the tokens whose list lengths are broadcast
VERIFY_COST = 8  # comparing along one list entry costs as much as so many subset rows
SHORT_LIST = 1024  # a list is compared in full when it has at most so many cross pairs per member, before the filters
BLOCK_MEMBERS = 32_768  # of a list, that are compared with as many others in a task; a member is sent once for each block of its list


def overlap_needed(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of ``n`` shingles shares with its light partners of other text."""
    partners = range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1)
    sizes = {c for p in partners if (c := overlap_needed(n, p, percent)) <= min(n, p)}
    return sorted(sizes) if len(partners) > 1 or sizes != {n} else []


def subsets_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, n, percent))


def choose_boundary(sizes: dict[int, int], percent: int, most: int = 24) -> int:
    """The size up to which enumerating subsets is cheaper than scanning lists, by the histogram of set sizes."""
    cost = {0: 0}
    for n in range(1, most + 1):
        light = subsets_count(n, percent)
        heavy = prefix_length(n, percent) * VERIFY_COST
        cost[n] = cost[n - 1] + sizes.get(n, 0) * (light - heavy)
    return min(cost, key=lambda n: (cost[n], n))


def _sets(batch: pa.RecordBatch, k: int):
    """(first row, last row, hashes, offsets) of the shingle sets of the batch's texts (its last column)."""
    data, offsets = at.bytes_of(batch.column(batch.num_columns - 1))
    for first, last, part, part_offsets in at.slices(data, offsets):
        starts, ends, text = at.words(part, part_offsets)
        hashes, bounds = at.shingles(at.word_hashes(part, starts, ends), text, last - first, k)
        yield first, last, hashes, bounds


@dataclass(frozen=True)
class Naming:
    """How classes are named: the bits used of the first half (fewer in tests), and the names that several classes would share."""

    bits: int = 64
    shared: np.ndarray | None = None


def sketch_bits(rows: int) -> int:
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, (rows // SKETCH_DOCUMENTS).bit_length()))


def _class_ids(hashes: np.ndarray, bounds: np.ndarray, naming: Naming) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shingles, class id, second half of the identity) of each set."""
    n = np.diff(bounds)
    out = []
    for salt in (3, 5):
        total = np.concatenate([[np.uint64(0)], np.cumsum(at.mix(hashes ^ at.mix(np.full(1, salt, np.uint64))), dtype=np.uint64)])
        out.append(at.mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)))
    one, two = out[0] >> np.uint64(64 - naming.bits), out[1]
    if naming.shared is not None:
        hit = np.isin(one.view(np.int64), naming.shared)
        one[hit] = at.mix(at.mix(two[hit]) + one[hit])
    return n, one.view(np.int64), two.view(np.int64)


def _describe(k: int, bits: int, naming: Naming):
    """Classes of all documents and, per partition, parts of the counting sketch."""
    schema = pa.schema([("row_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("cid2", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch, mask = np.zeros(1 << bits, dtype=np.uint32), np.uint64((1 << bits) - 1)
        for batch in at.parts(batches):
            for first, last, hashes, bounds in _sets(batch, k):
                n, one, two = _class_ids(hashes, bounds, naming)
                np.add.at(sketch, (hashes & mask).astype(np.int64), np.uint32(1))
                none = pa.nulls(last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n), pa.array(one), pa.array(two), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        size = 1 << SKETCH_PART_BITS
        parts = [np.minimum(sketch[i : i + size], 65535).astype(np.uint16).tobytes() for i in range(0, len(sketch), size)] if sketch.any() else []
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _add_parts(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
    rows = sorted(total)
    counts = [np.minimum(total[p], 2**32 - 1).astype(np.uint32).tobytes() for p in rows]
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(counts, pa.binary())], ["part", "counts"])


def shingle_frequency(described: DataFrame, bits: int) -> np.ndarray:
    """The sketch over all documents, as a rank of frequency for each cell: 0 for usual, then one for each doubling."""
    parts = described.filter("part IS NOT NULL").select("part", "counts").repartition(1 << (bits - SKETCH_PART_BITS), "part")
    total = np.zeros(1 << bits, dtype=np.int64)
    size = 1 << SKETCH_PART_BITS
    for row in parts.mapInArrow(_add_parts, "part int, counts binary").collect():  # as many rows as the sketch has parts
        total[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["counts"], np.uint32)
    usual = max(1.0, float(total.mean()))
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / (2 * usual))) + 1).astype(np.uint8)


def _profiles(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """How many shingles of each set fall into each of its hash ranges; null where a count could overflow. Half as many ranges
    are these counts added up in pairs, so profiles of different lengths compare."""
    n = np.diff(bounds)
    ranges = np.clip(1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64), LEAST_RANGES, MOST_RANGES)
    start = np.cumsum(ranges) - ranges
    cell = np.repeat(start, n) + ((hashes >> np.uint64(40)).astype(np.int64) & (np.repeat(ranges, n) - 1))
    counts = np.bincount(cell, minlength=int(ranges.sum()))
    most = np.maximum.reduceat(counts, start) if len(start) else start
    small = counts.astype(np.uint8)
    return [small[i : i + r].tobytes() if m < 256 else None for i, r, m in zip(start.tolist(), ranges.tolist(), most.tolist())]


def _may_link(percent: int):
    """Pairs (a, b, profile_a, profile_b) whose profiles allow the overlap that a link needs: two sets share no more
    shingles than the smaller count of each range."""

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            lengths = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in (2, 3)]
            for x, y in np.unique(np.stack(lengths, axis=1), axis=0).tolist():
                if not (x and y):
                    continue  # one of the profiles is unknown
                alike = np.flatnonzero((lengths[0] == x) & (lengths[1] == y))
                step = max(1, PROFILE_BYTES // max(x, y))
                for rows in (alike[i : i + step] for i in range(0, len(alike), step)):
                    left, right = (
                        np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1, min(x, y)).sum(axis=1, dtype=np.int32)
                        for c in (2, 3)
                    )
                    most, sizes = (t.sum(axis=1, dtype=np.int64) for t in (np.minimum(left, right), left + right))
                    keep[rows] = 100 * most >= percent * (sizes - most)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _coarse_profiles(batches):
    """Profiles added up to COARSE ranges, as arrays; an unknown profile is an empty array."""
    for batch in batches:
        rows = [[] if p is None else np.frombuffer(p, np.uint8).reshape(-1, COARSE).sum(axis=0).tolist() for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["cid", "ranges"])


def _overlapping(percent: int, x: str, y: str) -> str:
    """Whether the coarse profiles of two list entries allow a link."""
    most = f"aggregate(zip_with({x}.ranges, {y}.ranges, (a, b) -> least(a, b)), 0, (t, v) -> t + v)"
    return f"(size({x}.ranges) = 0 OR size({y}.ranges) = 0 OR {100 + percent} * {most} >= {percent} * ({x}.n + {y}.n))"


def heavy_tokens(shared: DataFrame, most: int = HEAVY_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose lists hold more than ``1 / most`` of all entries of ``shared(token, length)``, which fewer than ``most`` can,
    and the lengths of those lists."""
    total = shared.agg(F.sum("length")).first()[0] or 0
    found = shared.filter(F.col("length") * most > total).select("token", "length").toArrow().sort_by("token")
    return found["token"].to_numpy(), found["length"].to_numpy()


def _only_shared(bloom, heavy):
    """List entries: prefixes cut down to tokens that may be shared, each with the one before it (null for the first) and the
    support of its set: how many such tokens it has, heavy ones counted as often as their lists are long."""
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("token", pa.int64()), ("before", pa.int64()), ("support", pa.int64())])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            row = np.repeat(np.arange(batch.num_rows), size)
            hit = bloom.value.may_hold(tokens)
            row, tokens = row[hit], tokens[hit]
            first = np.diff(row, prepend=-1) != 0
            before = pa.array(np.roll(tokens, 1), mask=first)
            weights = np.ones(len(tokens))
            long_tokens, lengths = heavy.value
            if len(long_tokens):
                place = np.minimum(np.searchsorted(long_tokens, tokens), len(long_tokens) - 1)
                weights = np.where(long_tokens[place] == tokens, lengths[place], 1)
            support = np.bincount(row, weights, batch.num_rows).astype(np.int64)
            cid, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(cid[row]), pa.array(n[row]), pa.array(pos[hit].astype(np.int32)), pa.array(tokens), before, pa.array(support[row])], schema=schema)

    return run


def _enter(k: int, percent: int, boundary: int, rank, naming: Naming):
    """Keys of each document: subsets of light sets, prefix shingles of the others."""
    schema = pa.schema([("row_id", pa.int64()), ("cid", pa.int64()), ("cid2", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("subsets", pa.list_(pa.int64())), ("subset_sizes", pa.list_(pa.int32())), ("profile", pa.binary())])

    def subset_keys(items: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(items)
        mixed = at.mix(items)
        keys, sizes = [], []
        for c in subset_sizes(n, boundary, percent):
            gone = list(combinations(range(n), n - c))
            out = np.array(gone, dtype=np.int64).reshape(len(gone), n - c)
            left = mixed.sum(dtype=np.uint64) - mixed[out].sum(axis=1, dtype=np.uint64)
            keys += at.mix(left + np.uint64(c)).view(np.int64).tolist()
            sizes += [c] * len(out)
        return keys, sizes

    def run(batches):
        mask = np.uint64(len(rank.value) - 1)
        for batch in at.parts(batches):
            for first, last, hashes, bounds in _sets(batch, k):
                n, one, two = _class_ids(hashes, bounds, naming)
                order = rank.value[(hashes & mask).astype(np.int64)]
                prefix, subsets, sizes = [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    size, items = b - a, hashes[a:b]
                    keys, key_sizes = subset_keys(items) if 0 < size <= boundary else ([], [])
                    subsets.append(keys)
                    sizes.append(key_sizes)
                    if size and 100 * size >= percent * (boundary + 1):
                        want, late = prefix_length(size, percent), order[a:b]
                        if late.any():
                            items = items[np.argsort(late, kind="stable")]
                        prefix.append(items[:want].view(np.int64))
                    else:
                        prefix.append(np.zeros(0, np.int64))
                lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(one), pa.array(two), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
                     pa.array(subsets, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(_profiles(hashes, bounds), pa.binary())], schema=schema)

    return run


def _fetch(k: int, bloom, naming: Naming):
    schema = pa.schema([("cid", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for batch in at.parts(batches):
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = bloom.value.may_hold(ids)
            for first, last, hashes, bounds in _sets(batch.filter(pa.array(hit)), k) if hit.any() else ():
                _, one, _ = _class_ids(hashes, bounds, naming)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], schema=schema)

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    left = sets.select(F.col("cid").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("items").alias("items_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return joined.filter(both * 100 >= union * percent).select("a", "b")


def subset_candidates(keys: DataFrame, percent: int) -> DataFrame:
    """keys(key, size, cid, n): each group's members with its smallest member, where the shared subset suffices."""
    hubs = keys.groupBy("key", "size").agg(F.min(F.struct("n", "cid")).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    joined = keys.join(hubs, ["key", "size"]).filter(f"cid <> hub.cid AND {percent} * (n + hub.n) <= {100 + percent} * size")
    return joined.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b"))


def _feasible(percent: int, x: str, y: str) -> str:
    """Length and position filters on two list entries."""
    need = f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent}D)"
    return (
        f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) "
        f"AND least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {need}"
    )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, hub_rounds: int = 2,
    block_members: int = BLOCK_MEMBERS, naming: Naming = Naming(),
) -> DataFrame:
    """row_id, n_shingles, component_id for every row of ``docs``."""
    return _labels(docs, id_col, text_col, k, percent, hub_rounds, block_members, naming)[0].select("row_id", "n_shingles", "component_id")


def _labels(
    docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, hub_rounds: int = 2, block_members: int = BLOCK_MEMBERS, naming: Naming = Naming(),
) -> tuple[DataFrame, Naming]:
    """Components with the class (cid, cid2) of each row and the root of its component, which no other component shares; and
    how the classes are named."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    bits = sketch_bits(docs.count())
    while True:
        described = materialize(texts.mapInArrow(_describe(k, bits, naming), "row_id long, n long, cid long, cid2 long, part int, counts binary"), "described")
        rows = described.filter("part IS NULL").select("row_id", "n", "cid", "cid2")
        classes = materialize(rows.filter("n > 0 AND row_id IS NOT NULL").groupBy("cid", "cid2").agg(F.min("row_id").alias("rep"), F.first("n").alias("n")), "classes")
        shared = classes.groupBy("cid").agg(F.min("cid2").alias("low"), F.max("cid2").alias("high")).filter("low <> high").select("cid")
        if naming.shared is not None:  # the second round has names of both halves
            break
        shared = np.array([r["cid"] for r in shared.toLocalIterator()], dtype=np.int64)  # about (classes ** 2) / 2 ** 65 of them
        if not len(shared):
            break
        naming = Naming(naming.bits, shared)
    sizes = {r["n"]: r["count"] for r in classes.filter("n <= 24").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, percent)
    rank = spark.sparkContext.broadcast(shingle_frequency(described, bits))
    entered = texts.filter("row_id IS NOT NULL").mapInArrow(_enter(k, percent, boundary, rank, naming), "row_id long, cid long, cid2 long, n int, prefix array<long>, subsets array<long>, subset_sizes array<int>, profile binary")
    reps = classes.select(F.col("rep").alias("row_id"), "cid", "cid2")
    entered = entered.filter("n > 0").join(reps, ["row_id", "cid", "cid2"], "left_semi").dropDuplicates(["row_id", "cid", "cid2"])
    entered = materialize(entered, "keys")
    subset_keys = entered.filter("size(subsets) > 0").select("cid", "n", F.explode(F.arrays_zip("subsets", "subset_sizes")).alias("k")).select(
        F.col("k.subsets").alias("key"), F.col("k.subset_sizes").alias("size"), "cid", "n"
    )
    shared = materialize(entered.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("length")).filter("length > 1"), "shared")
    thin = spark.sparkContext.broadcast(blooms.build(shared.select("token")))
    entries = entered.filter("size(prefix) > 0").select("cid", "n", "prefix")
    # A class whose shingles stand in long lists is central to its group: the hub that most others link with.
    heavy = spark.sparkContext.broadcast(heavy_tokens(shared))
    members = entries.mapInArrow(_only_shared(thin, heavy), "cid long, n int, pos int, token long, before long, support long")
    if thin.value.full:  # else the few that the filter lets pass wrongly are lists of one entry, which give no pairs
        members = members.join(shared.select("token"), "token", "left_semi")
    members = materialize(members, "members")
    profiles = entered.select("cid", "profile")
    light = subset_candidates(subset_keys, percent)

    sets = None

    def linked(pairs: DataFrame) -> DataFrame:
        """Verified pairs: first by profiles, then on the whole sets, which are computed again from the texts of just the
        classes that the pairs name and that earlier rounds have not fetched."""
        nonlocal sets
        left, right = (profiles.select(F.col("cid").alias(c), F.col("profile").alias(f"profile_{c}")) for c in "ab")
        pairs = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "profile_a", "profile_b")
        pairs = materialize(pairs.mapInArrow(_may_link(percent), "a long, b long"), "pairs")
        named = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        missing = named if sets is None else named.join(sets.select("cid"), "cid", "left_anti")
        wanted = materialize(classes.join(missing, "cid", "left_semi").select("rep"), "wanted")
        bloom = blooms.build(wanted)
        if sets is None or not bloom.is_empty():  # a false positive of the filter is one set too many, no more
            fetched = texts.mapInArrow(_fetch(k, spark.sparkContext.broadcast(bloom), naming), "cid long, items array<long>")
            fetched = materialize(fetched.dropDuplicates(["cid"]), "sets")
            sets = fetched if sets is None else sets.unionByName(fetched.join(sets.select("cid"), "cid", "left_anti"))
        return materialize(verify(pairs, sets, percent), "links")

    hubs = members.groupBy("token").agg(F.max(F.struct("support", "cid", "n", "pos")).alias("one"))
    coarse = profiles.mapInArrow(_coarse_profiles, "cid long, ranges array<int>")
    links, extra, step = None, light, 0
    while True:
        to_hub = members.alias("x").join(hubs.alias("s"), F.expr("x.token = s.token AND x.cid <> s.one.cid AND " + _feasible(percent, "x", "s.one")))
        pairs = to_hub.select(F.least("x.cid", "s.one.cid").alias("a"), F.greatest("x.cid", "s.one.cid").alias("b"))
        found = linked(pairs if extra is None else pairs.union(extra))
        links = found if links is None else links.unionByName(found)
        roots = connected_components(links).select(F.col("node").alias("cid"), "root")
        members = members.drop("root").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        groups = members.groupBy("token", "root").agg(F.count("*").alias("c"))
        stats = groups.groupBy("token").agg(
            F.max(F.struct("c", "root")).alias("largest"), F.sum("c").alias("total"),
            ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("cross"),
        ).filter("cross > 0")
        step += 1
        stats = materialize(stats.withColumn("full", (F.col("cross") <= SHORT_LIST * F.col("total")) | F.lit(step >= hub_rounds)), "stats")
        members = materialize(members.join(stats.select("token", "full", F.col("largest.root").alias("largest"), F.ceil(F.col("total") / block_members).cast("int").alias("blocks")), "token"), "members")
        full = members.filter("full").join(coarse, "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        # a list of one block is joined with itself by its token, one of more by each two of its blocks: x in the lower one, y in the higher
        sent = ["cid", "n", "pos", "root", "before", "ranges"]
        apart = (
            "x.root <> y.root AND (x.before IS NULL OR y.before IS NULL OR x.before <> y.before) AND "
            + _feasible(percent, "x", "y") + " AND " + _overlapping(percent, "x", "y")
        )
        single, long = full.filter("blocks = 1").select("token", *sent), full.filter("blocks > 1")
        within = single.alias("x").join(single.alias("y"), F.expr("x.token = y.token AND x.cid < y.cid AND " + apart))
        cell = F.xxhash64("token", "low", "high").alias("cell")
        x = long.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence("block", F.col("blocks") - 1)))
        x = x.select(cell, (F.col("low") < F.col("high")).alias("across"), *sent).alias("x")
        y = long.withColumn("high", F.col("block")).withColumn("low", F.explode(F.sequence(F.lit(0), "block"))).select(cell, *sent).alias("y")
        across = x.join(y, F.expr("x.cell = y.cell AND (x.across OR x.cid < y.cid) AND " + apart))
        ends = [F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")]
        extra = within.select(*ends).unionByName(across.select(*ends))
        # the next hub of a long list: the most central member outside its largest component
        members = members.filter("NOT full").drop("full", "blocks")
        hubs = members.filter("root <> largest").groupBy("token").agg(F.max(F.struct("support", "cid", "n", "pos")).alias("one"))
        members = members.drop("largest")
        if stats.filter("NOT full").isEmpty():
            links = links.unionByName(linked(extra))
            break
    roots = connected_components(links)
    of_class = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("cid", "cid2", "rep", F.coalesce("root", "cid").alias("root"))
    lowest = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of_class.join(lowest, "root").select("cid", "cid2", "root", "component_id")
    return rows.join(named, ["cid", "cid2"], "left").select(
        "row_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("row_id").isNotNull(), F.col("component_id")).otherwise(F.col("row_id")).alias("component_id"),
        "cid", "cid2", "root",
    ), naming


def _judged(k: int, naming: Naming, bloom):
    """Of an id and a text: may the row go, and if so, the class (cid, cid2) of its text, computed as for the components. One
    function for both, so that a task needs one Python worker. Not to be evaluated twice, hence declared nondeterministic."""
    schema = pa.struct([("may_go", pa.bool_()), ("cid", pa.int64()), ("cid2", pa.int64())])

    @F.arrow_udf("struct<may_go: boolean, cid: bigint, cid2: bigint>")
    def judged(ids: pa.Array, texts: pa.Array) -> pa.Array:
        hit = bloom.value.may_hold(ids.fill_null(-1).to_numpy(zero_copy_only=False))
        one, two = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in at.parts([pa.RecordBatch.from_arrays([texts.filter(pa.array(hit))], ["text"])]):
            found += [_class_ids(hashes, bounds, naming)[1:] for _, _, hashes, bounds in _sets(batch, k)]
        one[hit], two[hit] = (np.concatenate(x) for x in zip(*found))
        return pa.StructArray.from_arrays([pa.array(hit), pa.array(one), pa.array(two)], fields=list(schema))

    return judged.asNondeterministic()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one stays for each component: one with the smallest id. Rows without an id stay. An id may
    repeat: each of its rows goes or stays by its own text."""
    labels, naming = _labels(docs, id_col, text_col, k, percent)
    labels = materialize(labels.filter("n_shingles > 0 AND row_id IS NOT NULL"), "labels")
    # where several texts of a component have its smallest id, those of one class stay
    firsts = labels.filter("row_id = component_id").groupBy("root").agg(F.min(F.struct("cid", "cid2")).alias("first"))
    stays = F.expr("row_id = component_id AND cid = first.cid AND cid2 = first.cid2")
    counts = labels.join(firsts, "root").groupBy("row_id", "cid", "cid2", stays.alias("stays")).agg(F.count("*").alias("rows"))
    counts = materialize(counts.filter("NOT stays OR rows > 1"), "gone")
    gone, twice = counts.filter("NOT stays").select("row_id", "cid", "cid2"), counts.filter("stays").select("row_id", "cid", "cid2")
    gone_ids = counts.select("row_id").distinct()
    may_go, bloom = blooms.may_hold(gone_ids), docs.sparkSession.sparkContext.broadcast(blooms.build(gone_ids))

    # only texts that may go are shuffled for the exact join
    row_id = F.col(f"`{id_col}`").cast("long")
    classed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_id.alias("row_id"), _judged(k, naming, bloom)(row_id, F.col(f"`{text_col}`")).alias("class"))
    classed = classed.filter("class.may_go")
    keys = ["row_id", "cid", "cid2"]
    left = classed.select("doc", "row_id", "class.cid", "class.cid2").join(gone, keys, "left_anti")
    if not twice.isEmpty():
        single = left.join(twice, keys, "left_semi").groupBy(*keys).agg(F.min_by("doc", F.col("doc").getField(text_col)).alias("doc"))
        left = left.join(twice, keys, "left_anti").select("doc").unionByName(single.select("doc"))
    return docs.filter(~may_go(row_id)).unionByName(left.select("doc.*"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).withColumnRenamed("row_id", "doc_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
       ELSE [array_to_string(ws[i:i+3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, hop) AS (SELECT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.hop),
m AS (SELECT doc_id, min(hop) AS lowest FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.lowest, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
