"""Constrained shortest paths over an edge table, and what is derived from a route."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quernel.session import bucketed, materialize, new_folder


def usable_edges(edges: DataFrame, access: str) -> DataFrame:
    """Open edges that the access mode may use."""
    return edges.filter((F.col("status") == "open") & F.array_contains("access", access))


COMPACT_AFTER = 32  # rounds whose improvements are kept apart
BROADCAST_ROWS = 50_000  # about 8 MB of nodes or steps in the driver's memory


def sized(rows: DataFrame, count: int, otherwise: str = "merge") -> DataFrame:
    """``rows`` for a join with many others: broadcast by their known ``count``. Spark would judge by the bytes of files, but ids in order take
    3 bytes there and 150 on the driver, which builds what is broadcast."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows.hint(otherwise)


def by_source(edges: DataFrame) -> DataFrame:
    """``edges`` written in buckets by source, which several searches with ``placed`` read instead of writing their own."""
    return bucketed(edges, "source")


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame | None = None, max_rounds: int | None = None, delta: int | None = None, placed: bool = False) -> DataFrame:
    """(node, cost, hops, via, prev): cheapest cost from the nearest of ``starts`` (node) over ``edges`` (edge_id, source, target, cost >= 0).

    Edges are written once, in buckets by source, so that no round shuffles them; with ``placed`` they come from by_source, filtered at most. A round relaxes the edges of the open nodes, and
    one aggregate over what they offer and what is known gives the nodes that improve; only these are written (distances are the least
    of all rounds), in the shared folder, which keeps plans short and survives lost executors. With ``delta`` a round relaxes only open nodes that
    cost at most ``delta`` more than the cheapest open one, which saves detours over costs that don't last; without it all of them.
    Equal costs go to fewer hops, then to the smaller edge id. With ``targets`` (node) the loop ends once no open node is cheaper
    than the cheapest target reached. It goes on until no node is open; if ``max_rounds`` is given and runs out before, it raises.
    """
    fields = ["cost", "hops", "via", "prev"]
    kind = starts.schema["node"].dataType
    links = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "source", "target", F.col("cost").cast("long").alias("step"))
    first = starts.select("node", F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(None).cast(kind).alias("prev"), F.lit(True).alias("fresh")).distinct()
    if targets is not None:
        wanted = materialize(targets.select("node").distinct(), "wanted")
        wanted = sized(wanted, wanted.count())

    spark, folder, rounds = edges.sparkSession, new_folder(edges.sparkSession), []

    def written(rows: DataFrame) -> tuple[DataFrame, int, int | None]:
        """The rows of a round, their number and the least cost."""
        seen, path = Observation(), f"{folder}/round-{len(rounds)}-{done}"
        rows.observe(seen, F.count("*").alias("open"), F.min("cost").alias("least")).write.parquet(path)
        rounds.append(path)
        return spark.read.schema(rows.schema).parquet(path), seen.get["open"], seen.get["least"]

    def best(paths: list[str]) -> DataFrame:
        rows = spark.read.schema(first.schema).parquet(*paths).filter("fresh")
        return rows.groupBy("node").agg(F.min(F.struct(*fields)).alias("best")).select("node", "best.*")

    done = -1
    opened, count, least = written(first)
    for done in itertools.count():
        if not count:
            break
        if done == max_rounds:
            raise RuntimeError("paths did not settle")
        known = spark.read.schema(first.schema).parquet(*rounds).filter("fresh").select("node", *fields)
        bound = None if targets is None else known.join(wanted, "node", "left_semi").agg(F.min("cost")).first()[0]
        if bound is not None and least >= bound:
            break
        if not placed:
            links, placed = bucketed(links, "source"), True
        now, later = opened, None
        if delta is not None:
            now, later = opened.filter(F.col("cost") <= least + delta), opened.filter(F.col("cost") > least + delta)
        now = sized(now, count, "shuffle_hash")  # each node once, so the parts are even, and edges aren't sorted
        offers = now.join(links, now["node"] == links["source"]).select(
            F.col("target").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("edge_id").alias("via"), F.col("source").alias("prev"), F.lit("offer").alias("is")
        )
        if bound is not None:
            offers = offers.filter(F.col("cost") < bound)
        rows = known.withColumn("is", F.lit("known")).unionByName(offers)
        if later is not None:
            rows = rows.unionByName(later.select("node", *fields, F.lit("open").alias("is")))
        value = F.struct(*fields)
        merged = rows.groupBy("node").agg(F.min(value).alias("new"), F.min(F.when(F.col("is") == "known", value)).alias("old"), F.max(F.col("is") == "open").alias("was_open"))
        order = lambda s: F.struct(s["cost"], s["hops"], s["via"])
        fresh = F.col("old").isNull() | (order(F.col("new")) < order(F.col("old")))
        merged = merged.withColumn("fresh", fresh).filter("fresh OR was_open")
        opened, count, least = written(merged.select("node", *[f"new.{f}" for f in fields], "fresh"))
        if len(rounds) == COMPACT_AFTER:
            compact = f"{folder}/known-{done}"
            best(rounds).withColumn("fresh", F.lit(True)).write.parquet(compact)
            rounds[:] = [compact]
    return best(rounds)


def route(paths: DataFrame, target) -> DataFrame:
    """(index, edge_id, source, target) of the path to one node, walked back along ``prev``; nothing if it isn't reached.

    Pointers double: a round adds the nodes as far back again as the path is known, and squares the pointers, so a path of n edges
    takes log(n) rounds and no step passes through the driver.
    """
    nodes = paths.count()
    jumps = paths.filter("via IS NOT NULL").select("node", F.col("prev").alias("up"))
    on_path = materialize(paths.filter(F.col("node") == F.lit(target)).select("node", F.lit(0).cast("long").alias("back")), "on_path")
    count, length = on_path.count(), 1
    while True:
        more = materialize(sized(on_path, count).join(jumps, "node").select(F.col("up").alias("node"), (F.col("back") + length).alias("back")), "more")
        added = more.count()
        if not added:
            break
        count, length = count + added, length * 2
        if length > 2 * nodes:
            raise RuntimeError("the pointers of the paths run in a circle")
        on_path = materialize(on_path.unionByName(more), "on_path")
        further = jumps.select(F.col("node").alias("up"), F.col("up").alias("next")).hint("merge")
        jumps = materialize(jumps.join(further, "up").select("node", F.col("next").alias("up")), "jumps")
    steps = sized(on_path, count).join(paths.filter("via IS NOT NULL"), "node")  # all nodes of the path but the first
    steps = steps.select((count - 2 - F.col("back")).cast("int").alias("index"), F.col("via").alias("edge_id"), F.col("prev").alias("source"), F.col("node").alias("target"))
    return sized(materialize(steps, "route"), count)


def nearest_target(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """The cheapest of ``targets`` (node, index): one row (node, cost, index), the first index of a node that occurs often."""
    first = targets.groupBy("node").agg(F.min("index").alias("index")).hint("merge")
    return paths.join(first, "node").select("node", "cost", "index").orderBy("cost", "index").limit(1)


def turn(previous: Column, heading: Column) -> Column:
    """start, straight (within 30 degrees), right or left."""
    delta = F.pmod(heading - previous, F.lit(360))
    return F.when(previous.isNull(), "start").when((delta <= 30) | (delta >= 330), "straight").when(delta < 180, "right").otherwise("left")


def with_turns(steps: DataFrame, route_col: str, order_col: str, heading_col: str = "heading") -> DataFrame:
    before = F.lag(heading_col).over(Window.partitionBy(route_col).orderBy(order_col))
    return steps.withColumn("turn", turn(before, F.col(heading_col)))


def with_nodes(steps: DataFrame, nodes: DataFrame, id_col: str = "node_id", count: int | None = None) -> DataFrame:
    """``steps`` (source, target, ...) with ``from_node`` and ``to_node``: the id and all fields of both nodes. ``count``: the number of
    steps of a route, by which the join is chosen."""
    payload = nodes.select(F.col(id_col).alias("__id"), F.struct(F.col(id_col).alias("id"), *[F.col(c) for c in nodes.columns if c != id_col]).alias("__node"))
    if count is not None and 2 * count > BROADCAST_ROWS:
        payload = payload.hint("merge")
    elif count is not None:
        ends = steps.select(F.explode(F.array("source", "target")).alias("__id")).distinct()
        payload = F.broadcast(payload.join(F.broadcast(ends), "__id", "left_semi"))
    for end, name in (("source", "from_node"), ("target", "to_node")):
        steps = steps.join(payload.withColumnsRenamed({"__id": end, "__node": name}), end, "left")
    return steps


def route_totals(steps: DataFrame, route_col: str, distance: str = "distance", time: str = "time") -> DataFrame:
    return steps.groupBy(route_col).agg(F.sum(distance).alias("total_distance"), F.sum(time).alias("total_time"))


def first_seen(steps: DataFrame, route_col: str, order_col: str, value_col: str) -> DataFrame:
    """Distinct non-null values of each route in the order they are first met."""
    first = steps.filter(F.col(value_col).isNotNull()).groupBy(route_col, value_col).agg(F.min(order_col).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", value_col)))
    return first.groupBy(route_col).agg(listed.getField(value_col).alias("values"))


def integrity_violations(nodes: DataFrame, keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, subject): nodes without an adjacency key, unknown keys, repeated edge ids, edges to unknown nodes."""
    text = lambda c: F.col(c).cast("string").alias("subject")
    missing = nodes.join(keys, "node", "left_anti").select(F.lit("missing_key").alias("check"), text("node"))
    unknown = keys.join(nodes, "node", "left_anti").select(F.lit("unknown_key").alias("check"), text("node"))
    repeated = edges.groupBy("edge_id").count().filter("count > 1").select(F.lit("repeated_edge").alias("check"), text("edge_id"))
    dangling = edges.join(nodes.select(F.col("node").alias("target")), "target", "left_anti").select(F.lit("unknown_target").alias("check"), text("edge_id"))
    return missing.unionByName(unknown).unionByName(repeated).unionByName(dangling)
