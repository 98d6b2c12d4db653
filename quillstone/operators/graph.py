"""Graph queries over co-mentions, set at a time: one join for a hop, whatever the frontier's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import resolved_ids
from ..schema import TIERS
from ..session import checkpoint

MAX_DEPTH = 5
#: Neighbours of an entity in one block, when its pairs are sought, and of one whose neighbours have all of theirs with them.
HUB, WIDE = 64, 512
#: Neighbours, and their propositions, that an entity's row may have with it.
LIGHT, EVIDENCE = 64, 1024


def co_mentions(props: DataFrame, min_authority: str | None = None) -> DataFrame:
    """(a, b, p): p is an active proposition that mentions both, in both directions. No shuffle: the pairs lie inside a row.

    With a floor, propositions of a weaker tier (column ``authority``) give no edge.
    """
    rows = props.where("status = 'ACTIVE'")
    if min_authority is not None:
        rows = rows.where(F.col("authority").isin(*TIERS[: TIERS.index(min_authority) + 1]))
    ids = rows.select(F.col("id").alias("p"), resolved_ids(F.col("mentions")).alias("ids"))
    return ids.select("p", "ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b"), "p").where("a <> b")


def neighborhood(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(entity, distance, via): each entity within depth hops, and the propositions that reach it at its shortest distance."""
    edges = edges.where(F.col("b") != start)
    frontier = edges.sparkSession.createDataFrame([(start,)], "a string")
    seen, parts = frontier.select(F.col("a").alias("entity")), []
    for hop in range(1, min(max(depth, 1), MAX_DEPTH) + 1):
        reached = edges.join(frontier, "a").select(F.col("b").alias("entity"), "p").join(seen, "entity", "left_anti")
        found = checkpoint(reached.groupBy("entity").agg(F.sort_array(F.collect_set("p")).alias("via")).withColumn("distance", F.lit(hop)))
        if found.isEmpty():
            break
        parts.append(found)
        seen = seen.unionByName(found.select("entity"))
        frontier = found.select(F.col("entity").alias("a"))
    out = edges.sparkSession.createDataFrame([], "entity string, via array<string>, distance int")
    for part in parts:
        out = out.unionByName(part)
    return out.select("entity", "distance", "via")


def path_between(edges: DataFrame, start: str, end: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(nodes, via) of one shortest path, of several the one with the smallest list of propositions; no row if there is none."""
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([([start], [])], "nodes array<string>, via array<string>")
    # Of the propositions that join two entities only the smallest can be in the answer.
    edges = checkpoint(edges.groupBy("a", "b").agg(F.min("p").alias("p")))
    frontier = spark.createDataFrame([(start, [], [start])], "a string, via array<string>, nodes array<string>")
    seen = frontier.select(F.col("a").alias("b"))
    for _ in range(max_depth):
        step = edges.join(frontier, "a").join(seen, "b", "left_anti")
        grown = step.select("b", F.struct(F.concat("via", F.array("p")).alias("via"), F.concat("nodes", F.array("b")).alias("nodes")).alias("path"))
        best = checkpoint(grown.groupBy("b").agg(F.min("path").alias("path")))
        hit = best.where(F.col("b") == end)
        if not hit.isEmpty():
            return hit.select("path.nodes", "path.via")
        if best.isEmpty():
            break
        seen = seen.unionByName(best.select("b"))
        frontier = best.select(F.col("b").alias("a"), "path.via", "path.nodes")
    return spark.createDataFrame([], "nodes array<string>, via array<string>")


def two_hop_links(edges: DataFrame) -> DataFrame:
    """(source, target, connectors, evidence): pairs with shared neighbours and no edge of their own.

    A row of an entity of few neighbours (``LIGHT`` with ``EVIDENCE`` propositions) has all of them with it,
    so two such rows that meet at their smallest shared neighbour give the whole pair there, and no pair is
    shuffled. Pairs with any other entity, which are few for each of it, are brought together from all
    neighbours. A hub's neighbours are dealt into blocks, each of which meets all of them, so its pairs are
    spread over tasks; the joins keep their partitions, since few edges make many pairs.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    direct = checkpoint(edges.groupBy("a", "b").agg(F.sort_array(F.collect_set("p")).alias("ps")))
    sizes = direct.groupBy("a").agg(F.count("*").alias("_n"), F.sum(F.size("ps")).alias("_ps"))
    light = sizes.where((F.col("_n") <= LIGHT) & (F.col("_ps") <= EVIDENCE)).select("a")
    degree = sizes.select(F.col("a").alias("x"), "_n")
    keys = ["x", "_block"]

    def met(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
        """Rows (source, x, ...) with rows (target, x, ...) of the same x."""
        blocks = degree.select("x", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
        one = left.join(blocks, "x").withColumn("_block", F.pmod(F.xxhash64("source"), F.col("_blocks")).cast("int")).drop("_blocks")
        other = right.join(blocks, "x").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        return one.repartition(parts, *keys).hint("merge").join(other.repartition(parts, *keys), keys).where("source < target")

    own = direct.join(light, "a", "left_semi").groupBy("a").agg(F.sort_array(F.collect_list(F.struct(F.col("b").alias("x"), "ps"))).alias("own"))
    whole = lambda end, k: own.select(F.col("a").alias(end), F.col("own").alias(f"own{k}"), F.explode("own.x").alias("x"))
    both = met(whole("source", 1), whole("target", 2), WIDE).withColumn("connectors", F.array_intersect("own1.x", "own2.x"))
    both = both.where((F.col("x") == F.array_min("connectors")) & ~F.array_contains("own1.x", F.col("target")))
    shown = lambda c: F.flatten(F.transform(F.filter(c, lambda n: F.array_contains("connectors", n["x"])), lambda n: n["ps"]))
    both = both.select("source", "target", F.sort_array("connectors").alias("connectors"), F.sort_array(F.array_distinct(F.concat(shown("own1"), shown("own2")))).alias("evidence"))

    heavy = direct.join(light, "a", "left_anti")
    side = lambda rows, end, k: rows.select(F.col("a").alias(end), F.col("b").alias("x"), F.col("ps").alias(f"p{k}"))
    rest = met(side(heavy, "source", 1), side(direct, "target", 2), HUB).unionByName(met(side(direct.join(light, "a", "left_semi"), "source", 1), side(heavy, "target", 2), HUB))
    rest = rest.join(direct.select(F.col("a").alias("source"), F.col("b").alias("target")), ["source", "target"], "left_anti")
    rest = rest.groupBy("source", "target").agg(F.sort_array(F.collect_set("x")).alias("connectors"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.concat("p1", "p2"))))).alias("evidence"))
    return both.unionByName(rest)


def lineage(props: DataFrame, pid: str, context_id: str | None = None) -> DataFrame:
    """(id, place, source): the proposition (place 0) and the propositions it was abstracted from."""
    own = props.where(F.col("id") == pid)
    if context_id is not None:
        own = own.where(F.col("context_id") == context_id)
    parents = own.select(F.posexplode("source_ids").alias("place", "id")).join(props, "id").select("id", (F.col("place") + 1).alias("place"), F.col("text").alias("source"))
    return own.select("id", F.lit(0).alias("place"), F.col("text").alias("source")).unionByName(parents)


def paths_in_context(paths: DataFrame, props: DataFrame, context_id: str) -> DataFrame:
    """The paths (path_id, via, ...) of which every proposition is in the context; a path without any is."""
    inside = props.where(F.col("context_id") == context_id).select("id").distinct().withColumn("_in", F.lit(True))
    steps = paths.select("path_id", F.explode(F.array_distinct("via")).alias("id")).join(inside, "id", "left")
    outside = steps.where("_in IS NULL").select("path_id").distinct()
    return paths.join(outside, "path_id", "left_anti")


def path_rows(path: DataFrame) -> DataFrame:
    """(hop, source, target, proposition_id) of a path (nodes, via), a row for each hop."""
    steps = path.select("nodes", F.posexplode("via").alias("_i", "proposition_id"))
    return steps.select((F.col("_i") + 1).alias("hop"), F.element_at("nodes", F.col("_i") + 1).alias("source"), F.element_at("nodes", F.col("_i") + 2).alias("target"), "proposition_id")


def explained(props: DataFrame, provenance: DataFrame, pid: str) -> DataFrame:
    """One row about a proposition: its text and validity, its sources in order, its grounding, and the texts it was abstracted from."""
    own = props.where(F.col("id") == pid)
    parents = own.select(F.posexplode("source_ids").alias("place", "id")).join(props.select("id", "text"), "id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("p"))
    sources = provenance.where(F.col("proposition_id") == pid).agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("s"))
    return own.crossJoin(F.broadcast(parents)).crossJoin(F.broadcast(sources)).select("id", "text", "status", "temporal", "s.key", "grounding", F.col("p.text").alias("abstracts"))  # one row each


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node it is connected with.

    Large-star and small-star rounds: a number of rounds logarithmic in the longest chain.
    """
    now = checkpoint(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    before = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        now = checkpoint(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        before = state
