"""A Merkle manifest of a dataset: one digest for the whole table, and for each row the proof that it belongs to it.

Rows are leaves of one tree for each group; the roots of these trees are the leaves of a tree over the groups. For every parent the
concatenated digests of its children (its preimage) are stored. A leaf joins the preimages of its ancestors: without its own
64-character slot a preimage is the siblings' part of the proof, and with another digest spliced into the slot it is hashed to
fold a changed leaf up to the root.

Leaves are numbered within their group by one range partitioning and the counts of each partition, so that a group of any
size is spread over many tasks; a parent has at most ``fanout`` children. Ancestors are attached from the root down, level by level,
to the parents alone: leaves are shuffled once to make the lowest parents and once to join them.

Defined results: a null field is ``-``; an empty text is ``0:``; very long texts are hashed where they are read and not shuffled; rows
that repeat are leaves of their own; of leaves with the same or no order value the smaller digest comes first (no order value before
all others); a null group is a group; extra columns are left alone, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<preimage: string, slot: int>>"


def framed(value: Column) -> Column:
    """A field as it is hashed: its number of UTF-8 bytes, a colon and the value; ``-`` for a null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``idx``, the place within ``grp`` by ``order``, from 0, and ``size``, the number of nodes of the group.

    Equal rows are told apart by where they are read, so that ranges stay balanced however often a row is repeated.
    """
    keys = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("read_at")]
    sorted_rows = nodes.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(sorted_rows.drop("read_at").withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("run"), F.min("place").alias("first"))
    whole = Window.partitionBy("grp")
    runs = runs.select(
        F.col("grp").alias("run_grp"), F.col("part").alias("run_part"), "first",
        (F.sum("run").over(whole.orderBy("part")) - F.col("run")).alias("before"), F.sum("run").over(whole).alias("size"),
    )
    joined = placed.join(runs, placed.grp.eqNullSafe(runs.run_grp) & (placed.part == runs.run_part))
    return joined.select(*nodes.columns, (F.col("place") - F.col("first") + F.col("before")).alias("idx"), "size")


def parents(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels of parents (grp, idx, preimage, digest, size) over ``nodes`` (grp, idx, digest, size), the lowest one first. A tree ends at
    the level where ``size`` is 1; a group of one node has no parents."""
    levels = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    below = nodes
    while most > 1:
        level = (
            below.where("size > 1")
            .groupBy("grp", F.floor(F.col("idx") / fanout).alias("parent"), F.ceil(F.col("size") / fanout).alias("size"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("children"))
            .select("grp", F.col("parent").alias("idx"), F.array_join("children.digest", "").alias("preimage"), "size")
            .withColumn("digest", digest(F.col("preimage")))
        )
        below = materialize(level, "level")
        levels.append(below)
        most = -(-most // fanout)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, digest) of the root of each group's tree."""
    return reduce(DataFrame.unionByName, [level.where("size = 1").select("grp", "digest") for level in [nodes, *levels]])


def step_up(nodes: DataFrame, level: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``path``: the preimage of the parent with the node's slot in it, and the parent's own ``path``; other columns of the
    path (what ``level`` has besides) come along."""
    carried = [c for c in level.columns if c not in ("grp", "idx", "preimage", "digest", "size", "path")]
    above = level.select(F.col("grp").alias("up_grp"), F.col("idx").alias("up_idx"), F.col("preimage").alias("up_preimage"), F.col("path").alias("up_path"), *carried)
    joined = nodes.join(above, nodes.grp.eqNullSafe(above.up_grp) & (F.floor(nodes.idx / fanout) == above.up_idx))
    first = F.array(F.struct(F.col("up_preimage").alias("preimage"), F.pmod(nodes.idx, F.lit(fanout)).cast("int").alias("slot"))).cast(PATH)
    return joined.select(*nodes.columns, F.concat(first, "up_path").alias("path"), *carried)


def with_paths(nodes: DataFrame, levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with the ``path`` to the root and the other columns of ``roots`` (grp, path, ...), which has the path above each group."""

    def at_top(rows: DataFrame) -> DataFrame:  # one row for each group at most
        above = roots.withColumnRenamed("grp", "up_grp")
        rows = rows.where("size = 1")
        return rows.join(above, rows.grp.eqNullSafe(above.up_grp)).drop("up_grp")

    above = None
    for rows in [*reversed(levels), nodes]:
        found = at_top(rows)
        above = found if above is None else found.unionByName(step_up(rows.where("size > 1"), above, fanout))
    return above


def siblings(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.substr(p.preimage, F.lit(1), p.slot * 64), F.substr(p.preimage, p.slot * 64 + 65))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda low, p: digest(F.substr(p.preimage, F.lit(1), p.slot * 64), low, F.substr(p.preimage, p.slot * 64 + 65)))


def manifest(rows: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", claimed: Column | None = None, fanout: int = 16) -> DataFrame:
    """``order``, ``leaf``, ``subroot`` of the group, ``root``, ``path``, and ``claimed``: the digest to be verified (``leaf`` by default).

    ``leaf`` and ``claimed`` are digests made of the columns of ``rows``; only they, the group and the order value are kept.
    """
    claimed = leaf if claimed is None else claimed
    leaves = materialize(rows.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("ordinal"), leaf.alias("digest"), claimed.alias("claimed")), "leaves")
    leaves = numbered(leaves, ["ordinal", "digest"])
    levels = parents(leaves.select("grp", "idx", "digest", "size"), fanout)
    groups = tops(leaves.select("grp", "digest", "size"), levels)
    # the tree over the groups: one group of nodes, ordered by the group's name
    over = numbered(groups.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    over_levels = parents(over.select("grp", "idx", "digest", "size"), fanout)
    root = tops(over, over_levels).select("grp", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    roots = with_paths(over, over_levels, root, fanout).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    found = with_paths(leaves, levels, materialize(roots, "roots"), fanout)
    return found.select(F.col("ordinal").alias(order), F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path")


def verified(found: DataFrame) -> DataFrame:
    """A manifest's rows with ``proof_sha256`` (digest of the siblings), ``folded_root`` and whether it equals the root."""
    done = found.withColumn("proof_sha256", F.sha2(siblings(F.col("path")), 256)).withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return done.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "claimed")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = [framed(F.col(c)) for c in FIELDS[:-1]]
    lowered = F.translate("text", UPPER, LOWER)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered).otherwise(F.col("text"))
    rows = manifest(docs.select(*FIELDS), digest(*head, framed(F.col("text"))), claimed=digest(*head, framed(claimed)))
    return verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _framed(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR END"


_HEAD = " || ".join(_framed(c) for c in FIELDS[:-1])
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda a, step: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""

ORACLE = f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, source, sha256({_HEAD} || {_framed("text")}) AS leaf,
        sha256({_HEAD} || {_framed("changed")}) AS claimed
    FROM (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM documents)
), leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id
    FROM rows
), tree(source, level, idx, n, preimage, digest) AS (
    SELECT source, 0, idx, n, NULL::VARCHAR, leaf FROM leaves
    UNION ALL
    SELECT source, level + 1, parent, (n + 15) // 16, preimage, sha256(preimage)
    FROM (SELECT source, level, idx // 16 AS parent, n, string_agg(digest, '' ORDER BY idx) AS preimage FROM tree WHERE n > 1 GROUP BY source, level, idx // 16, n)
), subroots AS MATERIALIZED (
    SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, idx, n, preimage, digest) AS (
    SELECT 0, idx, n, NULL::VARCHAR, subroot FROM subroots
    UNION ALL
    SELECT level + 1, parent, (n + 15) // 16, preimage, sha256(preimage)
    FROM (SELECT level, idx // 16 AS parent, n, string_agg(digest, '' ORDER BY idx) AS preimage FROM top WHERE n > 1 GROUP BY level, idx // 16, n)
), climb(id, source, level, idx, n, low, proof) AS (
    SELECT id, source, 0, idx, n, claimed, '' FROM leaves
    UNION ALL
    SELECT c.id, c.source, c.level + 1, c.idx // 16, t.n,
        sha256(left(t.preimage, 64 * (c.idx % 16)) || c.low || substr(t.preimage, 64 * (c.idx % 16) + 65)),
        c.proof || left(t.preimage, 64 * (c.idx % 16)) || substr(t.preimage, 64 * (c.idx % 16) + 65)
    FROM climb c JOIN tree t ON t.source IS NOT DISTINCT FROM c.source AND t.level = c.level + 1 AND t.idx = c.idx // 16 WHERE c.n > 1
), over(id, subroot, level, idx, n, low, proof) AS (
    SELECT c.id, s.subroot, 0, s.idx, s.n, c.low, c.proof FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source WHERE c.n = 1
    UNION ALL
    SELECT c.id, c.subroot, c.level + 1, c.idx // 16, t.n,
        sha256(left(t.preimage, 64 * (c.idx % 16)) || c.low || substr(t.preimage, 64 * (c.idx % 16) + 65)),
        c.proof || left(t.preimage, 64 * (c.idx % 16)) || substr(t.preimage, 64 * (c.idx % 16) + 65)
    FROM over c JOIN top t ON t.level = c.level + 1 AND t.idx = c.idx // 16 WHERE c.n > 1
)
SELECT l.doc_id, l.leaf, o.subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.low AS folded_root, o.low = r.digest AS verified
FROM leaves l JOIN over o ON o.id = l.id AND o.n = 1 CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
"""
