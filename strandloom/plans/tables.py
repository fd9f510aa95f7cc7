"""Queries on the star schema: statistics, pairing, comparison, sets, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import graph, profile, report
from ._register import Register, table

query = Register()


@query("""
WITH r AS (SELECT l_suppkey AS suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
b AS (SELECT * FROM r WHERE r >= floor(n * ((1 - CAST(0.06 AS DOUBLE)) - CAST(0.06 AS DOUBLE) / 2)) AND r < floor(n * ((1 - CAST(0.06 AS DOUBLE)) + CAST(0.06 AS DOUBLE) / 2))),
m AS (SELECT suppkey, avg(x) AS m, min(x) AS lo, max(x) AS hi, count(*) AS k FROM b GROUP BY suppkey),
d AS (SELECT suppkey, m, lo, hi, sqrt(sum(CASE WHEN x < m THEN (x - m) ** 2 ELSE 0 END) / k) AS d, sqrt(sum(CASE WHEN x > m THEN (x - m) ** 2 ELSE 0 END) / k) AS u FROM b JOIN m USING (suppkey) GROUP BY suppkey, m, lo, hi, k)
SELECT suppkey, round(greatest(m - d, lo), 2) AS low, round(m, 2) AS mean, round(least(m + u, hi), 2) AS high FROM d
""")
def band_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band below the top prices of each supplier."""
    return profile.band_profile(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "suppkey"), ["suppkey"], F.col("l_extendedprice"), 0.06)


@query("""
WITH t AS (SELECT l_returnflag AS flag, l_extendedprice AS x, l_quantity AS w, sum(l_extendedprice * l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS upto, sum(l_extendedprice * l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem),
k AS (SELECT * FROM t WHERE upto > total * 0.1 AND upto - x * w < total * (1 - 0.4)),
m AS (SELECT flag, sum(w * x) / sum(w) AS m, min(x) AS a, max(x) AS b FROM k GROUP BY flag),
s AS (SELECT flag, m, a, b, sqrt(sum(w * (x - m) ** 2) / sum(w)) AS s FROM k JOIN m USING (flag) GROUP BY flag, m, a, b)
SELECT flag, round(greatest(a, m - s), 3) AS lo, round(m, 3) AS mean, round(least(b, m + s), 3) AS hi FROM s
""")
def weight_trimmed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of prices by flag, without the lightest tenth and the heaviest four tenths of the mass."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = profile.weight_trimmed_range(rows, ["flag"], F.col("l_extendedprice"), F.col("l_quantity"), ["l_orderkey", "l_linenumber"])
    return out.select("flag", F.round("lo", 3).alias("lo"), F.round("mean", 3).alias("mean"), F.round("hi", 3).alias("hi"))


@query("""
WITH m AS (SELECT l_returnflag AS flag, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT flag, round(m, 4) AS wmean, round(sqrt(sum(l_quantity * (l_extendedprice - m) ** 2) / sum(l_quantity)), 4) AS wstd FROM lineitem JOIN m ON l_returnflag = flag GROUP BY flag, m
""")
def weighted_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of prices weighted by quantity."""
    out = profile.weighted_mean_std(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], F.col("l_extendedprice"), F.col("l_quantity"))
    return out.select("flag", F.round("wmean", 4).alias("wmean"), F.round("wstd", 4).alias("wstd"))


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))
""")
def grouping_sets_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation by flag and status, and by status over all flags."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice")
    return profile.grouping_stats(rows, "flag", "status", "l_extendedprice").select("flag", "status", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""
SELECT coalesce(c_custkey, o_custkey) AS key, CASE WHEN c_custkey IS NOT NULL AND o_custkey IS NOT NULL THEN 'both' WHEN c_custkey IS NOT NULL THEN 'left' ELSE 'right' END AS side
FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey
""")
def pair_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without orders."""
    return report.pair_sides(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("""
SELECT doc_id, 'not in b' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)
UNION ALL SELECT DISTINCT doc_id, 'not in a' FROM labels WHERE toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM documents)
""")
def missing_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a harmless label, and labels without a document."""
    return report.missing_both_ways(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id")


@query("""
SELECT a, round(max(ratio), 6) AS best_ratio, max(ratio) >= 0.95 AS pass FROM (
SELECT a.p_partkey AS a, least(a.p_retailprice, b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) AS ratio FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey) GROUP BY a
""")
def best_of_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest price among parts of the same brand and size."""
    part = table(spark, sf_dir, "part").withColumn("key", F.struct("p_brand", "p_size"))
    return report.best_of_cross(part, part, "key", "p_partkey", "p_partkey", "p_retailprice", 0.95).select("a", F.round("best_ratio", 6).alias("best_ratio"), "pass")


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, round(a.p_retailprice / b.p_retailprice, 6) AS ratio
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey WHERE a.p_retailprice / b.p_retailprice < 0.995
""")
def theta_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a brand and size where one part is half a percent cheaper or more."""
    part = table(spark, sf_dir, "part").withColumn("key", F.struct("p_brand", "p_size"))
    return report.theta_pairs(part, "key", "p_partkey", "p_retailprice", 0.995, 6)


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey
WHERE a.s_acctbal > 0 AND b.s_acctbal > 0 AND abs(ln(a.s_acctbal) - ln(b.s_acctbal)) > ln(10)
""")
def ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose balances differ tenfold."""
    return report.far_apart(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey", "s_acctbal")


@query("""
WITH s AS (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 2.0 ELSE 0 END) AS inc, sum(CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 0 THEN 3.0 ELSE 0 END) AS exc FROM labels GROUP BY doc_id)
SELECT doc_id, CASE WHEN inc = 0 AND exc = 0 THEN 'none' WHEN inc >= 3 * exc THEN 'include' WHEN exc >= 3 * inc THEN 'exclude' ELSE 'ambiguous' END AS decision FROM s
""")
def include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to take or leave by the ratio of two label scores."""
    s = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.sum(F.when(F.col("quality") == 1, 2.0).otherwise(0.0)).alias("inc"), F.sum(F.when(F.col("toxic") == 1, 1.0).when(F.col("quality") == 0, 3.0).otherwise(0.0)).alias("exc"))
    return report.arbitrate(s, "doc_id", "inc", "exc")


@query("""
WITH s AS (SELECT p_brand AS v, p_type AS db, sum(p_size) - 20 AS weight FROM part GROUP BY ALL)
SELECT v, db, CAST(weight AS BIGINT) AS weight, max(weight) OVER (PARTITION BY v) > 0 AND weight * 3 >= max(weight) OVER (PARTITION BY v) AS kept FROM s
""")
def label_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that carry a brand's weight."""
    by = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("v"), F.col("p_type").alias("db")).agg((F.sum("p_size") - 20).alias("weight"))
    return report.labels_kept(by)


@query("""
SELECT source, sum(n_chars) FILTER (lang = 'de') AS de, sum(n_chars) FILTER (lang = 'en') AS en, sum(n_chars) FILTER (lang = 'es') AS es, sum(n_chars) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source
""")
def pivot_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by source and language."""
    out = report.pivot_sum(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"], "n_chars")
    return out


@query("SELECT source AS key, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY len(regexp_extract_all(text, '[N?n]')), n_chars DESC, doc_id) = 1")
def top1_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the document with fewest missing marks, then the longest."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id", F.col("n_chars").alias("len"), strings.missing_bases(F.col("text")).alias("n_missing"), F.col("doc_id").alias("nth"))
    return report.choose_copy(rows, ["key"]).select("key", "doc_id")


@query("SELECT source AS key, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def top_k_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each source."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id", "n_chars")
    return report.top_per_key(rows, ["key"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("key", "doc_id")


@query("""
WITH d AS (SELECT doc_id FROM documents), l AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT 'union' AS op, (SELECT count(*) FROM (FROM d UNION FROM l)) AS n UNION ALL SELECT 'difference', (SELECT count(*) FROM (FROM d EXCEPT FROM l))
UNION ALL SELECT 'intersection', (SELECT count(*) FROM (FROM d INTERSECT FROM l)) UNION ALL SELECT 'distinct', (SELECT count(DISTINCT text) FROM documents)
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of set operations on documents and labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    d = docs.select("doc_id")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    distinct = docs.select(F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g")).distinct()
    return count(d.union(labels).distinct(), "union").union(count(d.subtract(labels), "difference")).union(count(d.intersect(labels), "intersection")).union(count(distinct, "distinct"))


@query("""
SELECT o_custkey AS custkey, string_agg(o_orderpriority[1:1], '' ORDER BY o_orderkey) AS parts FROM orders GROUP BY o_custkey
""")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First letters of a customer's priorities, in order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("parts"))
    return report.joined_parts(rows, ["custkey"], "o_orderkey", "parts")


@query("""
SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) > 1 THEN c_mktsegment || '-' || row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) ELSE c_mktsegment END AS name FROM customer WHERE c_custkey % 50 = 0
""")
def numbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments numbered where they repeat."""
    return profile.numbered_labels(table(spark, sf_dir, "customer").where("c_custkey % 50 = 0"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "name")


@query("""
WITH g AS (SELECT l_orderkey, CAST(list_reduce(list(CAST(l_quantity AS BIGINT)), lambda a, x: gcd(a, x)) AS BIGINT) AS g FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) // g AS BIGINT) AS qty FROM lineitem JOIN g USING (l_orderkey)
""")
def gcd_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order divided by their greatest common divisor."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"))
    return profile.reduce_by_gcd(rows, ["l_orderkey"], "qty")


@query("""
WITH RECURSIVE v AS (SELECT p_partkey AS v, p_size AS len, p_retailprice AS cov FROM part),
c AS (SELECT sum(len * cov) AS mass, sum(len) AS n, 0.9 * min(cov) AS floor FROM v),
r(i, m) AS (SELECT 0, greatest(mass / n, floor) FROM c UNION ALL SELECT i + 1, (SELECT greatest(max(mass) / sum(len * greatest(1, CAST(round_even(cov / m, 0) AS BIGINT))), max(floor)) FROM v, c) FROM r WHERE i < 12),
d AS (SELECT m FROM r ORDER BY i DESC LIMIT 1)
SELECT v AS part, CAST(greatest(1, CAST(round_even(cov / m, 0) AS BIGINT)) AS INTEGER) AS copy FROM v, d
""")
def baseline_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplicities of parts at the baseline of their prices."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_size").alias("len"), F.col("p_retailprice").alias("cov"))
    return graph.baseline(rows)[1].select(F.col("v").alias("part"), "copy")


@query("""
SELECT o_orderkey, round(abs(o_totalprice), 2) AS size, greatest(o_totalprice / 150000, 150000 / o_totalprice) >= 2 AS out_of_fold, o_totalprice / 1.5 < 150000 AND 150000 < o_totalprice * 1.5 AS compatible FROM orders
""")
def coverage_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on ratios of amounts."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(strings.positive(price), 2).alias("size"), strings.out_of_fold(price, F.lit(150000.0), 2.0).alias("out_of_fold"), strings.compatible(price, F.lit(150000.0), 1.5).alias("compatible"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 5")
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each supplier in a range of quantities."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20)).select("l_suppkey", "l_orderkey", "l_linenumber")
    return profile.first_n(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 5).select("l_orderkey", "l_linenumber")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, filter and aggregate: the plain relational path."""
    t = table(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of the star schema; small sides are left to the planner's size estimates."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES, ORACLE_SQL = query.queries, query.sql
