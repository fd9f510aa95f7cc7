"""Queries on graphs that the tables hold: suppliers and parts, nations and their people, k-mers of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import cluster, graph, paths, solve
from ..operators.components import connected_components
from ._register import Register, table

query = Register()

_NATION = """
node AS (SELECT 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer),
one AS (SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b, 1 + s_suppkey % 3 AS cost FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 1 + c_custkey % 4 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1), 2 FROM nation WHERE n_nationkey < 24),
link AS (SELECT a, b, cost FROM one UNION ALL SELECT b, a, cost FROM one)
"""


def _nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, cost) in both directions between nations, suppliers and customers."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("a"), name("s", "s_suppkey").alias("b"), (1 + F.col("s_suppkey") % 3).alias("cost"))
    c = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("a"), name("c", "c_custkey").alias("b"), (1 + F.col("c_custkey") % 4).alias("cost"))
    n = table(spark, sf_dir, "nation").where("n_nationkey < 24").select(name("n", "n_nationkey").alias("a"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("b"), F.lit(2).cast("long").alias("cost"))
    one = s.union(c).union(n)
    return one.union(one.select("b", "a", "cost"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM x UNION SELECT r.node, x.b FROM r JOIN x ON x.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node
""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that line items connect (H1)."""
    e = table(spark, sf_dir, "lineitem")
    return connected_components(e.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("u"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("v")))


@query("""
WITH s AS (SELECT DISTINCT l_partkey AS v, l_quantity >= 25 AS e, l_suppkey % 3 AS n FROM lineitem),
p AS (SELECT v, e, list_sort(list(n)) AS ns FROM s GROUP BY v, e), q AS (SELECT v, list_sort(list(ns)) AS pair FROM p GROUP BY v),
g AS (SELECT pair, min(v) AS part_a, count(*) AS n_same FROM q GROUP BY pair HAVING count(*) > 1)
SELECT part_a, n_same FROM g
""")
def parallel_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the same two sets of neighbours (H5)."""
    sides = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v"), (F.col("l_quantity") >= 25).alias("end"), (F.col("l_suppkey") % 3).alias("neighbour"))
    return graph.parallel_vertices(sides).groupBy(F.col("group").alias("part_a")).agg(F.count("*").alias("n_same"))


@query(f"""
WITH RECURSIVE {_NATION},
r(node, q) AS (SELECT 's7', 9 UNION SELECT link.b, r.q - link.cost FROM r JOIN link ON link.a = r.node WHERE r.q - link.cost >= 0)
SELECT node, CAST(max(q) AS BIGINT) AS best_quota FROM r GROUP BY node
""")
def bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a quota of 9 at each node that a supplier reaches (H6, H7)."""
    seeds = spark.createDataFrame([("s7", 9)], "node STRING, quota LONG")
    return graph.bounded_reach(seeds, _nation_links(spark, sf_dir)).select("node", F.col("quota").alias("best_quota"))


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT a, b FROM (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_custkey + 1, c_custkey FROM customer WHERE c_custkey % 9 <> 0)),
n AS (SELECT c_custkey AS node, c_acctbal > 3000 AS tagged FROM customer),
two AS (SELECT a, min(b) AS x, max(b) AS y FROM l GROUP BY a HAVING count(*) = 2),
t0 AS (SELECT node FROM n WHERE tagged),
t1 AS (SELECT node FROM t0 UNION SELECT a FROM two WHERE a IN (SELECT node FROM n) AND x IN (SELECT node FROM t0) AND y IN (SELECT node FROM t0))
SELECT node, node IN (SELECT node FROM t1) AS tagged FROM n
""")
def tag_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers tagged because both neighbours in a chain are."""
    c = table(spark, sf_dir, "customer")
    one = c.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return graph.tag_between(c.select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") > 3000).alias("tagged")), one.union(one.select("b", "a")))


@query("""
WITH k AS (SELECT p_partkey, i, p_name[i + 1:i + 5] AS kmer, length(p_name) - 4 AS n FROM part, unnest(range(length(p_name) - 4)) u(i)),
c AS (SELECT kmer, count(*) AS cnt FROM k GROUP BY kmer), l AS (SELECT a.kmer AS kmer, count(DISTINCT b.kmer) AS links FROM k a JOIN k b ON a.p_partkey = b.p_partkey AND b.i = a.i + 1 GROUP BY a.kmer)
SELECT kmer, cnt, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (kmer)
""")
def debruijn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of 5-letter words of names and how many different ones follow."""
    nodes, links = graph.kmer_graph(table(spark, sf_dir, "part"), F.col("p_name"), 5)
    out = links.groupBy(F.col("k1").alias("kmer")).agg(F.count("*").alias("links"))
    return nodes.join(out, "kmer", "left").select("kmer", "cnt", F.coalesce("links", F.lit(0)).alias("links"))


@query("""
WITH k AS (SELECT p_partkey, i, p_name[i + 1:i + 5] AS kmer FROM part, unnest(range(length(p_name) - 4)) u(i)),
l AS (SELECT a.kmer AS k1, b.kmer AS k2, count(*) AS cnt FROM k a JOIN k b ON a.p_partkey = b.p_partkey AND b.i = a.i + 1 GROUP BY ALL)
SELECT k1, k2, cnt FROM l
""")
def debruijn_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one 5-letter word of names follows another."""
    return graph.kmer_graph(table(spark, sf_dir, "part"), F.col("p_name"), 5)[1]


@query("""
WITH RECURSIVE k AS (SELECT p_partkey, i, p_name[i + 1:i + 5] AS kmer FROM part, unnest(range(length(p_name) - 4)) u(i)),
n AS (SELECT kmer, count(*) AS cnt FROM k GROUP BY kmer), l AS (SELECT DISTINCT a.kmer AS a, b.kmer AS b FROM k a JOIN k b ON a.p_partkey = b.p_partkey AND b.i = a.i + 1),
o AS (SELECT a, min(b) AS b FROM l GROUP BY a HAVING count(*) = 1), i AS (SELECT b FROM l GROUP BY b HAVING count(*) = 1), only_ AS (SELECT o.a, o.b FROM o JOIN i ON o.b = i.b WHERE o.a <> o.b),
walk AS (SELECT kmer AS start, kmer AS node, kmer AS txt, cnt AS total, 1 AS k FROM n WHERE kmer NOT IN (SELECT b FROM only_)
  UNION ALL SELECT start, only_.b, txt || right(only_.b, 1), total + n.cnt, k + 1 FROM walk JOIN only_ ON walk.node = only_.a JOIN n ON n.kmer = only_.b),
ring AS (SELECT kmer AS start, kmer AS node, kmer AS least_, left(kmer, 1) AS txt, cnt AS total, 1 AS k FROM n WHERE kmer NOT IN (SELECT node FROM walk)
  UNION ALL SELECT start, only_.b, least(least_, only_.b), txt || left(only_.b, 1), total + n.cnt, k + 1 FROM ring JOIN only_ ON ring.node = only_.a JOIN n ON n.kmer = only_.b WHERE only_.b <> start)
SELECT txt AS contig, CAST(length(txt) AS INTEGER) AS len, total / k AS cov, false AS circular FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY k DESC) = 1
UNION ALL SELECT txt, CAST(length(txt) AS INTEGER), total / k, true FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY k DESC) AS nth FROM ring) WHERE nth = 1 AND start = least_
""")
def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbranched runs of the k-mer graph of names."""
    return graph.contigs(*graph.kmer_graph(table(spark, sf_dir, "part"), F.col("p_name"), 5))


_FOUR = [("L", True, "R", False), ("R", True, "S", False), ("S", True, "R", True), ("R", False, "L", False)]


@query("""
SELECT 'L' || s_suppkey AS component, CAST(p AS INTEGER) AS path_id, 2.0::DOUBLE AS score, 1 AS pattern FROM supplier, unnest(range(2)) u(p) WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'L' || s_suppkey, 0, 0.0, 1 FROM supplier WHERE s_suppkey % 3 = 0
""")
def circular_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles through a small graph for each supplier, ranked by how far copies of a vertex lie apart.

    Two of three have four parts, of which one is there twice, mirrored; the others are plain rings of three.
    """
    c = table(spark, sf_dir, "supplier")
    name = lambda letter: F.concat(F.lit(letter), F.col("s_suppkey").cast("string"))
    ring = [("L", True, "R", False), ("R", True, "S", False), ("S", True, "L", False)]
    link = lambda es: F.array(*[F.struct(name(a).alias("v1"), F.lit(x).alias("e1"), name(b).alias("v2"), F.lit(y).alias("e2"), F.lit(0).alias("overlap")) for a, x, b, y in es])
    four = F.col("s_suppkey") % 3 != 0
    edges = c.select(F.explode(F.when(four, F.concat(link(_FOUR[:3]), link(_FOUR[3:]))).otherwise(link(ring))).alias("e")).select("e.*")
    depth = c.select(F.explode(F.array(F.struct(name("L").alias("v"), F.lit(1.1).alias("float_copy")), F.struct(name("R").alias("v"), F.when(four, 2.2).otherwise(1.2).alias("float_copy")), F.struct(name("S").alias("v"), F.lit(0.9).alias("float_copy")))).alias("x")).select("x.*")
    comp = graph.clusters(depth, edges)
    found = paths.circular_paths_of(solve.solve_components(depth, edges, comp), edges, comp)
    return paths.rank_paths(found, ["component"])


@query()
def cluster_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price classes of parts by brand, weighted by size (G1)."""
    return cluster.cluster_groups(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_retailprice", "p_size")


@query("""
WITH t AS (SELECT l_orderkey AS v, l_returnflag AS db FROM lineitem)
SELECT v FROM t GROUP BY v HAVING NOT bool_or(db = 'R')
""")
def exclude_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders tagged for other flags only."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v"), F.col("l_returnflag").alias("db"))
    return graph.exclude_other(t, "R")


@query("SELECT p_partkey, p_name[greatest(1, length(p_name) - 2):] = p_name[1:3] AS overlaps, left(p_name || p_name, length(p_name) + 4) AS padded FROM part")
def edge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether names end as they begin, and names padded round the circle."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", strings.overlaps(name, name, F.lit(3)).alias("overlaps"), strings.pad_circular(name, F.lit(4)).alias("padded"))


QUERIES, ORACLE_SQL = query.queries, query.sql
