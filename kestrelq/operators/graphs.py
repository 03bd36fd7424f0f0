"""Graph operators on tables of edges: PageRank, label propagation, triangles.

Nodes are values of one type; an edge is a row. Every round of the iterative ones is one join of the edges with a
table of a row per node and one aggregation with partial sums, and it is written, so that no lineage grows and a lost
executor costs one round. The joins are plain shuffles of written tables, which adaptive execution splits at nodes
with very many edges; PageRank's are of buckets, where the edges of one start stream through one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelq.operators.scratch import Rounds


def pagerank(edges: DataFrame, src: str = "src", dst: str = "dst", damping: float = 0.85, rounds: int = 20, tolerance: float = 0.0) -> DataFrame:
    """node, rank: the share of a random walk's time at each node of the edges; ranks add up to 1.

    A step follows an edge (repeated edges weigh as often as they stand there) with probability ``damping``, else goes
    to any node; from a node without an edge out of it (dangling) always to any. It ends after ``rounds`` steps, or
    earlier when the ranks have changed by ``tolerance`` or less in all. Edges with a null end are left out; an edge to
    itself counts; an empty table has no node. The dangling mass is one number a round.

    Edges are moved once, to buckets of their start, and ranks lie in buckets of their node, so a round moves only what
    flows along the edges: at most a row for each. Numbers as nodes make that row small.
    """
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Rounds(spark, "pagerank") as r:
        e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        # grouped where the rows of a start have met already
        e = r.bucketed(e.repartition(buckets, "src").groupBy("src", "dst").agg(F.count("*").alias("w")), "src", buckets)
        starts = e.groupBy("src").agg(F.sum("w").alias("out")).withColumnRenamed("src", "node")
        ends = e.select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("out"))
        nodes = r.bucketed(starts.unionByName(ends).groupBy("node").agg(F.sum("out").alias("out")), "node", buckets)
        n, dangling = nodes.agg(F.count("*"), F.count(F.when(F.col("out").isNull(), 1))).first()
        ranks, lost = nodes.withColumn("rank", F.lit(1.0 / max(1, n))), dangling / max(1, n)
        for _ in range(rounds if n else 0):
            share = ranks.where("out IS NOT NULL").select(F.col("node").alias("from"), (F.col("rank") / F.col("out")).alias("share"))
            got = e.join(share, F.col("src") == F.col("from")).groupBy("dst").agg(F.sum(F.col("share") * F.col("w")).alias("got"))
            rank = F.lit((1 - damping + damping * lost) / n) + damping * F.coalesce("got", F.lit(0.0))
            now = ranks.join(got, F.col("node") == F.col("dst"), "left").select("node", "out", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved"))
            now = r.bucketed(now, "node", buckets)
            moved, lost = now.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0))).first()
            r.drop(ranks)
            ranks = now
            if moved <= tolerance:
                break
        ranks = r.write(ranks.select("node", "rank"))
        r.keep(ranks)
    return ranks


def propagate_labels(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 10) -> DataFrame:
    """node, label: every node starts with itself as label, and takes in each round the most frequent label of its
    neighbours, the smallest one of equally frequent ones; all at once. Edges go both ways, repeated ones and those from
    a node to itself count once and not at all; edges with a null end are left out. Ends early when no label changes.
    Labels are counted with partial sums, by node and label, so a node with very many neighbours meets its distinct
    labels only."""
    with Rounds(edges.sparkSession, "labels") as r:
        e = r.write(both_ways(edges, src, dst))
        labels = r.write(e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("label")))
        for _ in range(rounds):
            # written, so that both sides of the join are plain shuffles
            seen = e.join(labels, F.col("v") == F.col("node")).groupBy("u", "label").agg(F.count("*").alias("c"))
            most = seen.groupBy("u").agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("best")).select("u", F.col("best.label").alias("new"))
            now = r.write(labels.join(most, F.col("u") == F.col("node")).select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("changed")))
            r.drop(labels)
            labels = now
            if not now.where("changed").limit(1).count():
                break
        r.keep(labels)
    return labels.select("node", "label")


def both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """u, v: every edge in both directions, once, without edges of a node to itself."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def numbered(nodes: DataFrame, by: list[str], r: Rounds) -> DataFrame:
    """``nodes`` with an id from 0 without gaps, in the order of ``by``: its place in a range sort, so that the driver
    gets one number a partition. Ids are int where they fit."""
    low = (1 << 33) - 1  # monotonically_increasing_id: the partition above 33 bits of the row's place in it
    placed = r.write(nodes.orderBy(*by).withColumn("id", F.monotonically_increasing_id()))
    with r.tidied():
        sizes = {x["part"]: x["count"] for x in placed.groupBy(F.shiftright("id", 33).alias("part")).count().collect()}
    before, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.array(*(F.lit(x).cast("long") for x in before)), (F.shiftright("id", 33) + 1).cast("int"))
    out = r.write(placed.withColumn("id", (F.col("id").bitwiseAND(F.lit(low)) + start).cast("int" if total < 1 << 31 else "long")))
    r.drop(placed)
    return out


def by_ids(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """``edges`` with ids for both ends. Numbers are a third of what names weigh, and each later step moves edges."""
    for c in ends:
        name = nodes.select(F.col("node").alias("node_"), F.col("id").alias("id_"))
        edges = edges.join(name.hint("shuffle_hash"), F.col(c) == F.col("node_")).drop(c, "node_").withColumnRenamed("id_", c)
    return edges


def in_slices(edges: DataFrame, r: Rounds, step: Callable[[DataFrame], DataFrame], slices: int = 2) -> DataFrame:
    """``step`` of written edges a, b, which are then removed: a part of them after the other, as a part's shuffle goes
    with it. The hash is another than that of shuffles, or a part would fill every other partition only."""
    out = None
    for k in range(slices):
        part = step(edges.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k))
        out = r.append(out, part) if out is not None else r.write(part)
    r.drop(edges)
    return out


def oriented(edges: DataFrame, src: str, dst: str, r: Rounds) -> tuple[DataFrame, DataFrame]:
    """Edges u, v and nodes node, id. Ids follow the number of neighbours (and the value among equals); every edge
    stands once, from the smaller id to the larger one. No node then has more edges out of it than the root of twice the
    number of edges, hubs least of all."""
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(F.col(src) != F.col(dst))
    one = in_slices(r.write(e), r, lambda x: x.distinct())
    # one table for each end, so that the shuffles of edges are not on disk together; likewise the ids
    ends = [r.write(one.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("d"))) for c in ("a", "b")]
    nodes = numbered(ends[0].unionByName(ends[1]).groupBy("node").agg(F.sum("d").alias("d")), ["d", "node"], r)
    r.drop(*ends)
    half = in_slices(one, r, lambda x: by_ids(x, nodes, ("a",)))
    return in_slices(half, r, lambda x: by_ids(x, nodes, ("b",)).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))), nodes


def triangles(edges: DataFrame, src: str = "src", dst: str = "dst", at_once: int = 1 << 24) -> DataFrame:
    """node, triangles: of every node with a neighbour, the number of triangles that it is a corner of.

    Edges have no direction here; repeated ones count once, those of a node to itself or with a null end not at all.
    Edges are oriented by degree, so a node's list of later neighbours is short even where a hub has all others as
    neighbours. For each edge the later end's list goes to the earlier end and the two lists are intersected: what moves
    is one array of ids for an edge, E^1.5 ids in all at most, and no pair of edges is ever a row.

    The lists go in rounds of earlier ends, each of about 2 E ids (``at_once``, if that is more), and a round's shuffles
    are removed with it. So the disk is that of a few ids for an edge, however long the lists are, and there are as many
    more rounds as there is more to move.
    """
    with Rounds(edges.sparkSession, "triangles", tidy=True) as r:
        e, nodes = oriented(edges, src, dst, r)
        lists = r.write(e.groupBy("u").agg(F.collect_list("v").alias("near")))
        r.drop(e)
        rounds, parts = _rounds(lists, nodes, at_once, r), []
        for k in range(rounds):
            parts.append(r.write(_corners(lists.where(F.pmod("u", F.lit(rounds)) == k), lists)))
            if len(parts) == 16:
                parts = [_added(parts, r)]
        corners = _added(parts, r)
        out = r.write(nodes.join(corners, "id", "left").select("node", F.coalesce("c", F.lit(0)).cast("long").alias("triangles")))
        r.keep(out)
    return out


def _rounds(lists: DataFrame, nodes: DataFrame, at_once: int, r: Rounds) -> int:
    """A node's list is sent once for each of its earlier neighbours, who are those that its list does not have."""
    size = lists.select(F.col("u").alias("id"), F.size("near").cast("long").alias("later"))
    with r.tidied():
        ids, n = size.join(nodes, "id").agg(F.sum(F.col("later") * (F.col("d") - F.col("later"))), F.sum("later")).first()
    return -(-(ids or 0) // max(at_once, 2 * (n or 0))) or 1


def _corners(near: DataFrame, lists: DataFrame) -> DataFrame:
    """id, c: corners in the triangles whose earliest node is in ``near``."""
    near = near.where(F.size("near") > 1)
    later = lists.select(F.col("u").alias("v"), F.col("near").alias("far"))
    # lists are unique and short, so they are the hashed side; the edges stream by
    sent = near.select("u", F.explode("near").alias("v")).join(later.hint("shuffle_hash"), "v")
    met = sent.join(near.hint("shuffle_hash"), "u").select("u", "v", F.array_intersect("far", "near").alias("w"))
    # no filter: Spark would intersect once for it and once more for what it lets through
    ids = F.when(F.size("w") > 0, F.concat(F.array("u", "v"), "w"))
    corners = met.select(F.size("w").alias("n"), F.posexplode(ids).alias("k", "id"))
    # partial sums a task, before any shuffle of corners
    return corners.groupBy("id").agg(F.sum(F.when(F.col("k") < 2, F.col("n")).otherwise(1).cast("long")).alias("c"))


def _added(parts: list[DataFrame], r: Rounds) -> DataFrame:
    """The sums of written parts, which are removed."""
    whole = r.spark.read.schema(parts[0].schema).parquet(*(p.scratch_path for p in parts))
    out = r.write(whole.groupBy("id").agg(F.sum("c").alias("c")))
    r.drop(*parts)
    return out


def wedge_bound(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[int, int]:
    """Wedges that ``triangles`` looks at, and those of the graph as it stands: what the orientation saves."""
    pairs = lambda d: F.coalesce(F.sum(_pairs(F.col(d))), F.lit(0)).cast("long")
    with Rounds(edges.sparkSession, "wedges") as r:
        e, _ = oriented(edges, src, dst, r)
        mine = e.groupBy("u").agg(F.count("*").alias("d")).agg(pairs("d")).first()[0]
        whole = both_ways(edges, src, dst).groupBy("u").agg(F.count("*").alias("d")).agg(pairs("d")).first()[0]
        r.keep()
    return mine, whole


def _pairs(d: Column) -> Column:
    return d * (d - 1) / 2
