"""Density clustering (DBSCAN) on Spark.

Points fall into grid cells small enough that all points of a cell are neighbours.
A cell with ``min_points`` rows is dense: its points are core points without looking
at any pair.  Only points of sparse cells (fewer than ``min_points`` each) are compared
with the surrounding cells, so the comparisons stay linear in the table size.  Cells
are then linked and connected components of cells give the clusters.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.session import cut_lineage

MAX_ROUNDS = 100
#: Parts of a box along each axis in one step of the branch and bound.
SPLIT = 4


def _cell(features: Sequence[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / F.lit(side)).cast("bigint") for c in features])


def _offsets(dims: int, reach: int) -> list[tuple[int, ...]]:
    """Neighbour cells whose nearest corners are within reach of each other."""
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=dims)
            if sum(max(0, abs(v) - 1) ** 2 for v in o) <= dims]


def _distance(a: str, b: str, dims: int) -> Column:
    return F.sqrt(sum((F.pow(F.get(a, F.lit(i)) - F.get(b, F.lit(i)), F.lit(2)) for i in range(1, dims)),
                      F.pow(F.get(a, F.lit(0)) - F.get(b, F.lit(0)), F.lit(2))))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node of the component of every node, by alternating label spreading and
    pointer jumping; each round is cut from its lineage."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(
        edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = cut_lineage(both)
    label = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    for _ in range(MAX_ROUNDS):
        near = both.join(label, both["y"] == label["node"]).groupBy("x").agg(F.min("root").alias("near"))
        spread = label.join(near, label["node"] == near["x"], "left").select(
            "node", "root", F.least(F.col("root"), F.coalesce("near", F.col("root"))).alias("new"))
        jump = spread.select(F.col("node").alias("_n"), F.col("new").alias("_up"))
        nxt = spread.join(jump, F.col("new") == F.col("_n"), "left").select(
            "node", F.col("root").alias("old"), F.least("new", F.coalesce("_up", F.col("new"))).alias("root"))
        nxt = cut_lineage(nxt)
        label = nxt.select("node", "root")
        if nxt.where(F.col("old") != F.col("root")).isEmpty():
            return label
    raise RuntimeError("components did not settle")


def dbscan(df: DataFrame, features: Sequence[str], key: str, eps: float, min_points: int = 5) -> DataFrame:
    """Add ``cluster`` (smallest key of the cluster's core points as id, NULL for noise).

    Border points join the nearest core point's cluster.
    """
    dims = len(features)
    side = eps / math.sqrt(dims)
    reach = math.ceil(math.sqrt(dims)) + 1 if dims > 1 else 2
    offsets = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in o]) for o in _offsets(dims, reach)])
    pts = df.select(F.col(key).alias("k"), F.array(*[F.col(c).cast("double") for c in features]).alias("p"),
                    _cell(features, side).alias("cell")).where(F.forall("p", lambda v: v.isNotNull()))
    pts = cut_lineage(pts)
    sizes = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    marked = pts.join(sizes, "cell")
    sparse = marked.where(F.col("size") < min_points).drop("size")
    around = lambda rows: rows.withColumn("near", F.explode(F.transform(
        offsets, lambda o: F.zip_with(F.col("cell"), o, lambda a, b: a + b))))
    other = pts.select(F.col("cell").alias("near"), F.col("k").alias("k2"), F.col("p").alias("p2"))
    close = around(sparse).join(other, "near").where(_distance("p", "p2", dims) <= eps)
    enough = close.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select("k")
    core = marked.where(F.col("size") >= min_points).select("k", "p", "cell").unionByName(
        sparse.join(enough, "k", "left_semi").select("k", "p", "cell"))
    core = cut_lineage(core)
    # one node per cell holding core points: they are all within eps of each other
    nodes = core.groupBy("cell").agg(F.min("k").alias("node"))
    boxes = core.groupBy("cell").agg(
        F.array(*[F.min(F.get("p", F.lit(i))) for i in range(dims)]).alias("lo"),
        F.array(*[F.max(F.get("p", F.lit(i))) for i in range(dims)]).alias("hi"))
    cells = cut_lineage(nodes.join(boxes, "cell"))
    linked = around(cells.select("cell", "node", "lo", "hi")).join(
        cells.select(F.col("cell").alias("near"), F.col("node").alias("node2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")),
        "near").where(F.col("node") < F.col("node2"))
    gap, span = _box_bounds("lo", "hi", "lo2", "hi2", dims)
    pairs = cut_lineage(linked.select("cell", "near", "node", "node2", "lo", "hi", "lo2", "hi2", gap.alias("gap"),
                                      span.alias("span")).where(F.col("gap") <= eps))
    sure = pairs.where(F.col("span") <= eps)
    edges = sure.select(F.col("node").alias("a"), F.col("node2").alias("b")).unionAll(
        _touching(core, pairs.where(F.col("span") > eps), eps, dims))
    roots = components(edges, nodes.select("node"))
    core_cluster = core.join(nodes, "cell").join(roots, "node").select("k", "p", "cell", F.col("root").alias("cluster"))
    core_cluster = cut_lineage(core_cluster)
    rest = sparse.join(enough, "k", "left_anti")
    target = core_cluster.select(F.col("cell").alias("near"), F.col("k").alias("k2"), F.col("p").alias("p2"), "cluster")
    border = around(rest).join(target, "near").withColumn("d", _distance("p", "p2", dims)).where(F.col("d") <= eps).groupBy(
        "k").agg(F.min_by("cluster", F.struct("d", "k2")).alias("cluster"))
    found = core_cluster.select("k", "cluster").unionByName(border)
    return df.join(found.withColumnRenamed("k", key), key, "left").select(*df.columns, "cluster")


def _box_bounds(lo: str, hi: str, lo2: str, hi2: str, dims: int) -> tuple[Column, Column]:
    """Least and greatest possible distance of a point of one box to a point of another."""
    at = lambda c, i: F.get(c, F.lit(i))
    near = [F.greatest(at(lo2, i) - at(hi, i), at(lo, i) - at(hi2, i), F.lit(0.0)) for i in range(dims)]
    far = [F.greatest(at(hi2, i), at(hi, i)) - F.least(at(lo2, i), at(lo, i)) for i in range(dims)]
    length = lambda parts: F.sqrt(sum((F.pow(v, F.lit(2)) for v in parts[1:]), F.pow(parts[0], F.lit(2))))
    return length(near), length(far)


def _touching(core: DataFrame, pairs: DataFrame, eps: float, dims: int) -> DataFrame:
    """Cell pairs holding two core points within ``eps``, by branch and bound.

    The points of both cells fall into the parts of a grid over their box, and of each part only its own box is kept.
    Two parts whose farthest corners are within ``eps`` decide their pair, which is dropped with all its other parts; parts
    whose nearest corners are farther apart are dropped.  What is left is cut again.  A part of a
    single point has one distance, so this ends; no two sets of points are ever multiplied.
    """
    open_ = pairs.select("node", "node2", F.col("cell").alias("ca"), F.col("near").alias("cb"), F.lit(0).cast("bigint").alias("pa"),
                         F.lit(0).cast("bigint").alias("pb"))
    boxes = pairs.select("cell", "lo", "hi").unionAll(pairs.select("near", "lo2", "hi2")).distinct().withColumn("part", F.lit(0).cast("bigint"))
    asked = boxes.select("cell", "part")
    points = core.select("cell", "p").distinct().withColumn("part", F.lit(0).cast("bigint"))
    edges = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).limit(0)
    at = lambda c, i: F.get(c, F.lit(i))
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            return edges
        placed = points.join(asked, ["cell", "part"], "left_semi").join(boxes, ["cell", "part"])
        code = F.array(*[F.when(at("hi", i) > at("lo", i), F.least(F.lit(SPLIT - 1), F.floor(
            (at("p", i) - at("lo", i)) / (at("hi", i) - at("lo", i)) * SPLIT))).otherwise(0) for i in range(dims)])
        points = cut_lineage(placed.select("cell", F.col("part").alias("up"), F.xxhash64("part", code).alias("part"), "p"))
        kids = cut_lineage(points.groupBy("cell", "up", "part").agg(
            F.array(*[F.min(at("p", i)) for i in range(dims)]).alias("lo"), F.array(*[F.max(at("p", i)) for i in range(dims)]).alias("hi")))
        gap, span = _box_bounds("lo", "hi", "lo2", "hi2", dims)
        met = open_.join(kids.toDF("ca", "pa", "ka", "lo", "hi"), ["ca", "pa"]).join(
            kids.toDF("cb", "pb", "kb", "lo2", "hi2"), ["cb", "pb"]).select("node", "node2", "ca", "cb", "ka", "kb", gap.alias("gap"), span.alias("span"))
        met = cut_lineage(met.where(F.col("gap") <= eps))
        sure = cut_lineage(met.where(F.col("span") <= eps).select("node", "node2").distinct())
        edges = edges.unionAll(sure)
        open_ = cut_lineage(met.join(sure, ["node", "node2"], "left_anti").select(
            "node", "node2", "ca", "cb", F.col("ka").alias("pa"), F.col("kb").alias("pb")))
        boxes = kids.select("cell", "part", "lo", "hi")
        asked = open_.select(F.col("ca").alias("cell"), F.col("pa").alias("part")).unionAll(open_.select("cb", "pb")).distinct()
        points = points.drop("up")
    raise RuntimeError("cell pairs did not settle")
