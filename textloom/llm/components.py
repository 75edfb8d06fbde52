"""Connected components of a graph held in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, written


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, found: DataFrame, key: str, counted: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row a key) by an inner join in which no key is left to one task.

    A key is hot if it has more rows than a task's even share, so fewer keys are hot than there are partitions, at
    any size of the data. Their names, with the number of shares they take, are broadcast; their rows go to a share
    by the hash of the other columns, and their row of ``found`` to each share. ``counted`` is a table that has the
    keys of ``rows`` and is cheaper to count; ``total`` its number of rows, where known."""
    counted = rows if counted is None else counted
    total = counted.count() if total is None else total
    parts = _parts(rows)
    share = F.ceil(F.col("__n") * parts / F.lit(max(total, 1))).cast("int")
    hot = counted.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") * parts > total).select("__hot", share.alias("__shares"))
    shares = F.coalesce("__shares", F.lit(1))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__share", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), shares).cast("int"))
    right = found.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return left.drop("__hot", "__shares").join(right.drop("__hot", "__shares"), [key, "__share"]).drop("__share")


def _smallest(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with the smallest neighbour of u, as m."""
    return attach(edges, edges.groupBy("u").agg(F.min("v").alias("m")), "u", total=total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = _smallest(both, total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return hung.distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _smallest(down, total)
    ends = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u <> v").distinct()


def _torn(edges: DataFrame) -> bool:
    """Whether a node hangs on two others, or on a larger one, or on one that hangs itself: a group per node says all three."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), (F.col("v") > F.col("u")).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(False).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max(1 - F.col("out")).alias("held"), F.bool_or("up").alias("up"))
    return not nodes.where("out > 1 or up or (out = 1 and held = 1)").isEmpty()


def _kept(edges: DataFrame, label: str) -> DataFrame:
    """A round as a written table, in an eighth of the usual number of files: edges are small beside what they link."""
    return written(edges.coalesce(max(1, _parts(edges) // 8)), label)


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of one orderable type -> ``(node, root)`` for every node that has an edge to another.

    The root is the smallest node of the component. Loops and nulls are left out; repeated edges count once.
    Every round is a written table, so a lost executor costs one round at most. Rounds grow with the logarithm
    of the largest component; a hub's edges stay where they are."""
    now = _kept(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while _torn(now):
        total = now.count()
        large = _kept(_large_star(now, 2 * total), "stars")
        following = _kept(_small_star(large, large.count()), "stars")
        discard(now)
        discard(large)
        now = following
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def component_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(fp, least)`` and their links (u, v) -> (fp, component_id): the smallest ``least`` over links, as a written table."""
    roots = components(edges)
    labelled = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(attach(labelled, ids, "root").select("fp", "component_id"), "component-ids")
