"""Connected components of an edge table (inventory id H1).

Alternating large-star and small-star rounds: each round rewires every edge to a
smaller neighbour, so that a component ends as a star around its least vertex
after a number of rounds that grows with the logarithm of its size.  A round is
aggregations and joins on vertex keys, with no state on the driver but two numbers;
its edges are written to the session's checkpoint folder, so that lineage stays
short and lost executors cost nothing.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the session names in spark.checkpoint.dir, or that its context has.

    Only a local session that names none gets a temporary folder; on a cluster that would
    be a folder of one machine, so it is an error there.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-"))
    return context.getCheckpointDir().get()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    shared_folder(spark)


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v: each vertex sends its greater neighbours to its least one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))
    # an edge (u, v), u > v, is seen from v: u goes to v's least neighbour
    return edges.join(least, edges["v"] == least["c"]).select("u", F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v: each vertex ties its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    moved = edges.join(least, edges["u"] == least["c"])
    pairs = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every vertex of an undirected edge table; component is its least vertex.

    Edges may be repeated, in either direction, or loops; an edge with a null end
    is left out.  A vertex that has only loops is its own component.  An empty
    table has no components.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    given = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    loops = now.where("u = v").select("u").distinct()
    links = now.where("u <> v")
    mark = None
    while True:
        links = _small_star(_large_star(links)).checkpoint()
        row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.join(nodes.union(roots), loops["u"] == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return nodes.union(roots).union(alone)
