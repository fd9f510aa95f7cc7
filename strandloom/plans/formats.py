"""Queries that write the tables in a file format, read that again, and return what was read.

Texts are made from keys by their MD5, so that SQL can say what must come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import graph, intervals, profile, words
from ..operators.components import shared_folder
from ..sources import alignments, annotations, graphs, sequences
from ._register import Register, table

query = Register()


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"


def _dna(x: Column) -> Column:
    """32 bases made from a key."""
    return F.translate(F.md5(x.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


def _dna_sql(x: str) -> str:
    return f"translate(md5(CAST({x} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _text(x: str) -> Column:
    return F.col(x).cast("string")


# ---- sequences ------------------------------------------------------------


def _parts_fasta(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    path = _folder(spark)
    records = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), _text("p_partkey"), F.lit(" "), F.col("p_brand")).alias("label"), F.concat(_dna(F.col("p_partkey")), F.left(_dna(F.col("p_name")), (F.col("p_partkey") % 30).cast("int"))).alias("seq"))
    sequences.write_fasta(records, path, width)
    return sequences.read_fasta(spark, path)


@query(f"SELECT 'p' || p_partkey || ' ' || p_brand AS label, {_dna_sql('p_partkey')} || left({_dna_sql('p_name')}, CAST(p_partkey % 30 AS INTEGER)) AS seq FROM part")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as wrapped FASTA records, read again."""
    return _parts_fasta(spark, sf_dir, 10).select("label", "seq")


@query("SELECT 'p' || p_partkey AS label, 32 + p_partkey % 30 AS len FROM part")
def fasta_record_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names and lengths of FASTA records (A2)."""
    return sequences.fasta_lengths(_parts_fasta(spark, sf_dir, 7), short_names=True)


_HEADS = "CASE o_orderkey % 4 WHEN 0 THEN 'r' || o_orderkey || ' 1:N:0:A' WHEN 1 THEN 'r' || o_orderkey || '/2' WHEN 2 THEN 'r' || o_orderkey || '#AC/1' ELSE 'r' || o_orderkey END"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head, name, seq, qual) of orders; qualities may begin with @ or +."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("r"), k.cast("string"))
    head = F.when(k % 4 == 0, F.concat(name, F.lit(" 1:N:0:A"))).when(k % 4 == 1, F.concat(name, F.lit("/2"))).when(k % 4 == 2, F.concat(name, F.lit("#AC/1"))).otherwise(name)
    n = (20 + k % 13).cast("int")
    return table(spark, sf_dir, "orders").select(head.alias("head"), name.alias("name"), F.left(_dna(k), n).alias("seq"), F.left(F.translate(F.md5(k.cast("string")), "0123456789abcdef", "@+!IIIIIHHHHGGGF"), n).alias("qual"))


_READS_SQL = f"""
reads AS (SELECT o_orderkey, {_HEADS} AS head, 'r' || o_orderkey AS name, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS mate,
  left({_dna_sql('o_orderkey')}, CAST(20 + o_orderkey % 13 AS INTEGER)) AS seq, left(translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', '@+!IIIIIHHHHGGGF'), CAST(20 + o_orderkey % 13 AS INTEGER)) AS qual FROM orders)
"""


def _fastq(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    path = _folder(spark)
    graphs.write_lines(_reads(spark, sf_dir).select(sequences.fastq_text(F.col("head"), F.col("seq"), F.col("qual")).alias("value")), path, compression=how.pop("compression", None))
    return sequences.read_fastq(spark, [path], **how)


@query(f"WITH {_READS_SQL} SELECT name, mate, seq, qual FROM reads")
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as FASTQ, read in small byte ranges (A3, A4, A5)."""
    return _fastq(spark, sf_dir, range_bytes=5000).select("name", "mate", "seq", "qual")


@query(f"WITH {_READS_SQL} SELECT seq FROM reads")
def fastq_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of compressed FASTQ, no other column being made."""
    return _fastq(spark, sf_dir, compression="gzip", columns=["seq"]).select("seq")


@query(f"WITH {_READS_SQL} SELECT head, name, mate FROM reads")
def heads_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and mates from heads, as expressions (A5)."""
    return _reads(spark, sf_dir).select("head", sequences.head_name(F.col("head")).alias("name"), sequences.head_mate(F.col("head")).alias("mate"))


@query(f"WITH {_READS_SQL} SELECT 'r' || (o_orderkey % 5) AS rep, name, seq FROM reads WHERE o_orderkey % 5 < 2")
def accepted_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ of the members of accepted clusters."""
    path = _folder(spark)
    rep = F.concat(F.lit("r"), (F.substring("name", 2, 20).cast("long") % 5).cast("string"))
    sequences.write_accepted(_reads(spark, sf_dir).withColumn("rep_id", rep), spark.createDataFrame([("r0",), ("r1",)], "rep_id STRING"), path)
    return sequences.read_fastq(spark, [path]).select(rep.alias("rep"), "name", "seq")


@query(f"""
WITH {_READS_SQL}, x AS (SELECT *, o_orderkey % 3 <> 0 AS a, o_orderkey % 4 <> 0 AS b FROM reads)
SELECT 'paired_1' AS folder, name, seq FROM x WHERE a AND b UNION ALL SELECT 'paired_2', name, seq FROM x WHERE a AND b
UNION ALL SELECT 'unpaired_1', name, seq FROM x WHERE a AND NOT b UNION ALL SELECT 'unpaired_2', name, seq FROM x WHERE b AND NOT a
""")
def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired and unpaired reads of two files, by folder."""
    path = _folder(spark)
    reads, k = _reads(spark, sf_dir), F.substring("name", 2, 20).cast("long")
    sequences.write_pairs(reads.where(k % 3 != 0), reads.where(k % 4 != 0), path)
    read = lambda folder: sequences.read_fastq(spark, [f"{path}/{folder}"]).select(F.lit(folder).alias("folder"), "name", "seq")
    return read("paired_1").union(read("paired_2")).union(read("unpaired_1")).union(read("unpaired_2"))


@query(f"""
WITH s AS (SELECT 'p' || p_partkey AS label, {_dna_sql('p_partkey')} || {_dna_sql('p_name')} AS seq FROM part),
w AS (SELECT label, seq, i FROM s, unnest(range(0, 64 - 20 + 1, 5)) u(i))
SELECT label || '_' || (i // 5) AS name, 1 AS mate, seq[i + 1:i + 8] AS seq FROM w
UNION ALL SELECT label || '_' || (i // 5), 2, reverse(translate(seq[i + 13:i + 20], 'ACGT', 'TGCA')) FROM w
""")
def simulated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates cut from both ends of windows."""
    records = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), _text("p_partkey")).alias("label"), F.concat(_dna(F.col("p_partkey")), _dna(F.col("p_name"))).alias("seq"))
    return sequences.simulate_reads(records, 8, 5, insert=20).select("name", "mate", "seq")


# ---- alignments -----------------------------------------------------------


def _sam(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as alignments on their suppliers: a match, an insertion, a match, a deletion, a match."""
    path = _folder(spark)
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    n = lambda m, plus: (k % m + plus).cast("string")
    cigar = F.concat(n(7, 3), F.lit("M"), n(3, 1), F.lit("I"), n(5, 2), F.lit("M"), n(4, 1), F.lit("D"), n(6, 1), F.lit("M"))
    flag = F.when(k % 10 == 0, 4).otherwise(0) + F.when(k % 2 == 0, 0x80).otherwise(0x40) + 1
    ref = F.concat(F.lit("s"), _text("l_suppkey"))
    line = F.concat_ws("\t", F.concat(F.lit("q"), k.cast("string")), flag.cast("string"), ref, (1 + k % 90).cast("string"), (k % 60).cast("string"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("MD:Z:"), n(7, 3), F.lit("A"), n(5, 1), F.lit("^AC"), n(6, 1), F.lit("G2")))
    heads = table(spark, sf_dir, "supplier").select(F.concat(F.lit("@SQ\tSN:s"), _text("s_suppkey"), F.lit("\tLN:130")).alias("value"))
    graphs.write_lines(heads.union(li.select(line.alias("value"))), path)
    return alignments.read_sam(spark, path)


_SAM_SQL = "h AS (SELECT l_orderkey * 8 + l_linenumber AS k, 's' || l_suppkey AS ref FROM lineitem), m AS (SELECT * FROM h WHERE k % 10 <> 0)"


@query(f"""
WITH {_SAM_SQL}, b AS (
  SELECT ref, 'M' AS op, 1 + k % 90 AS lo, 1 + k % 90 + k % 7 + 2 AS hi FROM m UNION ALL SELECT ref, 'I', 1 + k % 90 + k % 7 + 2, 1 + k % 90 + k % 7 + 2 FROM m
  UNION ALL SELECT ref, 'M', 1 + k % 90 + k % 7 + 3, 1 + k % 90 + k % 7 + 3 + k % 5 + 1 FROM m UNION ALL SELECT ref, 'D', 1 + k % 90 + k % 7 + k % 5 + 5, 1 + k % 90 + k % 7 + k % 5 + 5 + k % 4 FROM m
  UNION ALL SELECT ref, 'M', 1 + k % 90 + k % 7 + k % 5 + k % 4 + 6, 1 + k % 90 + k % 7 + k % 5 + k % 4 + 6 + k % 6 FROM m)
SELECT ref, op, CAST(sum(hi - lo + 1) AS BIGINT) AS bases, CAST(min(lo) AS BIGINT) AS first_pos, CAST(max(hi) AS BIGINT) AS last_pos FROM b GROUP BY ref, op
""")
def sam_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference positions of each operation of alignments."""
    blocks = alignments.aligned_blocks(_sam(spark, sf_dir)[1], best=False)
    return blocks.groupBy("ref", "op").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("bases"), F.min("lo").alias("first_pos"), F.max("hi").alias("last_pos"))


@query(f"WITH {_SAM_SQL} SELECT DISTINCT 'q' || k AS name, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS mate FROM h")
def sam_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and mates of alignments."""
    return alignments.sam_heads(_sam(spark, sf_dir)[1])


@query(f"""
WITH {_SAM_SQL} SELECT ref, 1 + k % 90 + k % 7 + 3 AS pos, count(*) AS n FROM m GROUP BY ALL
UNION ALL SELECT ref, 1 + k % 90 + k % 7 + 4 + k % 5 + 1 + 2 + k % 6 + 1 + 1000, count(*) FROM m GROUP BY ALL
""")
def sam_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatched positions from MD tags, the second of each tag moved by 1000."""
    hits = _sam(spark, sf_dir)[1]
    first = hits.withColumn("tags", F.create_map(F.lit("MD"), F.regexp_replace(F.col("tags")["MD"], "G2$", "2")))
    second = hits.withColumn("tags", F.create_map(F.lit("MD"), F.regexp_replace(F.col("tags")["MD"], "^([0-9]+)A", r"$1=")))
    moved = alignments.mismatches(second.withColumn("tags", F.transform_values("tags", lambda _, v: F.concat((F.regexp_extract(v, "^([0-9]+)=", 1).cast("int") + 1 + F.regexp_extract(v, "=([0-9]+)", 1).cast("int")).cast("string"), F.regexp_extract(v, r"(\^.*)$", 1)))))
    return alignments.mismatches(first).groupBy("ref", F.col("lo").alias("pos")).agg(F.count("*").alias("n")).union(moved.groupBy("ref", (F.col("lo") + 1000).alias("pos")).agg(F.count("*").alias("n")))


@query(f"WITH {_SAM_SQL}, q AS (SELECT k, max(k % 10 <> 0) AS mapped FROM h GROUP BY k) SELECT count(*) FILTER (mapped) AS paired, 0::BIGINT AS single FROM q")
def mapped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries are mapped, as pairs or alone."""
    return profile.mapped_counts(_sam(spark, sf_dir)[1])


@query("""
SELECT 'p' || l_partkey AS query, 's' || l_suppkey AS subject, round(90 + l_discount * 100, 2) AS pident, least(l_orderkey % 500, l_partkey % 700) + 1 AS qlo, greatest(l_orderkey % 500, l_partkey % 700) + 1 AS qhi FROM lineitem
""")
def blast_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular hits with query positions in rising order (A10)."""
    path = _folder(spark)
    li = table(spark, sf_dir, "lineitem")
    q1, q2 = F.col("l_orderkey") % 500 + 1, F.col("l_partkey") % 700 + 1
    line = F.concat_ws("\t", F.concat(F.lit("p"), _text("l_partkey")), F.concat(F.lit("s"), _text("l_suppkey")), F.round(90 + F.col("l_discount") * 100, 2).cast("string"), F.lit("50"), F.lit("1"), F.lit("0"), q1.cast("string"), q2.cast("string"), F.lit("1"), F.lit("50"), F.lit("1e-10"), F.lit("99.5"))
    graphs.write_lines(li.select(line.alias("value")), path)
    return alignments.read_blast(spark, path).select("query", "subject", "pident", "qlo", "qhi")


@query("""
WITH h AS (SELECT 'p' || l_partkey AS query, l_returnflag AS db, l_orderkey % 80 + 1 AS lo, l_orderkey % 80 + 10 AS hi FROM lineitem),
c AS (SELECT query, db, count(DISTINCT x) AS covered FROM h, unnest(range(lo, hi + 1)) u(x) GROUP BY query, db)
SELECT query, db, covered FROM c WHERE covered >= 0.25 * 90
""")
def least_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which a class of hits covers a quarter."""
    lo = F.col("l_orderkey") % 80 + 1
    hits = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), _text("l_partkey")).alias("query"), F.col("l_returnflag").alias("db"), lo.alias("lo"), (lo + 9).alias("hi"))
    return intervals.union_length(hits, ["query", "db"]).where(F.col("covered") >= 0.25 * 90)


# ---- graphs ---------------------------------------------------------------


def _customer_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers in chains of nine with side links; neighbours share five bases at their ends."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seq = lambda key: F.concat(F.left(_dna(key), F.lit(5)), _dna(key * 7 + 1), F.left(_dna(key + 1), F.lit(5)))
    v = c.select(k.cast("string").alias("v"), seq(k).alias("seq"), F.lit(42).cast("long").alias("len"), (1 + k % 50).cast("double").alias("cov"))
    e = c.where("c_custkey % 9 <> 0").join(c.select((k - 1).alias("c_custkey")), "c_custkey").select(k.cast("string").alias("v1"), F.lit(True).alias("e1"), (k + 1).cast("string").alias("v2"), F.lit(False).alias("e2"), F.lit(5).alias("overlap"))
    return v, graph.symmetric(e)


_GRAPH_SQL = f"""
v AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS v, left({_dna_sql('c_custkey')}, 5) || {_dna_sql('c_custkey * 7 + 1')} || left({_dna_sql('c_custkey + 1')}, 5) AS seq, CAST(42 AS BIGINT) AS len, 1.0 + c_custkey % 50 AS cov FROM customer),
one AS (SELECT a.v AS v1, true AS e1, b.v AS v2, false AS e2 FROM v a JOIN v b ON b.k = a.k + 1 WHERE a.k % 9 <> 0),
e AS (SELECT v1, e1, v2, e2 FROM one UNION SELECT v2, e2, v1, e1 FROM one)
"""


def _gfa(spark: SparkSession, sf_dir: str, **limits: float) -> tuple[DataFrame, DataFrame]:
    path = _folder(spark)
    graphs.write_lines(graphs.gfa_lines(*_customer_graph(spark, sf_dir)), path, compression="gzip")
    return graphs.read_gfa(spark, path, **limits)


@query(f"WITH {_GRAPH_SQL} SELECT v, seq, len, round(cov, 4) AS cov FROM v WHERE cov BETWEEN 5 AND 40")
def gfa_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of a compressed GFA within a range of depth."""
    return _gfa(spark, sf_dir, min_cov=5.0, max_cov=40.0)[0].select("v", "seq", "len", F.round("cov", 4).alias("cov"))


@query(f"WITH {_GRAPH_SQL} SELECT e.*, 5 AS overlap FROM e")
def gfa_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a GFA, in both directions."""
    return _gfa(spark, sf_dir)[1]


@query(f"WITH {_GRAPH_SQL} SELECT v AS label, seq FROM v")
def gfa_to_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's sequences as FASTA."""
    path = _folder(spark)
    sequences.write_fasta(graphs.graph_fasta(_gfa(spark, sf_dir)[0]), path)
    return sequences.read_fasta(spark, path).select("label", "seq")


def _fastg(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = _folder(spark)
    graphs.write_lines(graphs.fastg_lines(*_customer_graph(spark, sf_dir)), path)
    return graphs.read_fastg(spark, path)


@query(f"WITH {_GRAPH_SQL} SELECT v, seq, len, cov FROM v")
def fastg_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of FASTG, both strands written."""
    return _fastg(spark, sf_dir)[0].select("v", "seq", "len", "cov")


@query(f"WITH {_GRAPH_SQL} SELECT v1, e1, v2, e2 FROM e")
def fastg_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of FASTG."""
    return _fastg(spark, sf_dir)[1].select("v1", "e1", "v2", "e2")


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'NODE_' || k || '_length_100_cov_' || (k % 40) || '.5' AS node, (k % 40) + 0.5 AS cov, CAST(p AS INTEGER) AS sub_path, k * 10 + 3 * p + i AS vertex, (k + i) % 2 = 0 AS fwd FROM s, unnest(range(2)) a(p), unnest(range(3)) b(i)
""")
def scaffold_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oriented vertices of scaffolds of two parts each."""
    path = _folder(spark)
    k = F.col("s_suppkey")
    step = lambda p, i: F.concat((k * 10 + 3 * p + i).cast("string"), F.when((k + i) % 2 == 0, "+").otherwise("-"))
    part = lambda p: F.concat_ws(",", *[step(p, i) for i in range(3)])
    text = F.concat(F.lit("NODE_"), k.cast("string"), F.lit("_length_100_cov_"), (k % 40).cast("string"), F.lit(".5\n"), part(0), F.lit(";\n"), part(1))
    graphs.write_lines(table(spark, sf_dir, "supplier").select(text.alias("value")), path)
    t = graphs.read_scaffold_paths(spark, path)
    return t.select("node", "cov", "sub_path", F.explode("path").alias("x")).select("node", "cov", "sub_path", F.col("x.v").cast("long").alias("vertex"), "x.fwd")


def _locus_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lo = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(F.concat(F.lit("p"), _text("l_partkey")).alias("v"), F.col("l_returnflag").alias("db"), F.concat(F.lower("l_linestatus"), F.lit("-"), _text("l_linenumber")).alias("locus"), lo.alias("lo"), (lo + 4).alias("hi"))


_HITS_SQL = "h AS (SELECT 'p' || l_partkey AS v, l_returnflag AS db, lower(l_linestatus) || '-' || l_linenumber AS locus, l_orderkey * 8 + l_linenumber AS lo, l_orderkey * 8 + l_linenumber + 4 AS hi FROM lineitem)"


@query(f"WITH {_HITS_SQL} SELECT v, db, locus, lo, hi FROM h")
def hits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as the table that the visualiser takes, read again."""
    path = _folder(spark)
    graphs.hits_lines(_locus_hits(spark, sf_dir)).write.csv(path, sep="\t", header=True)
    return graphs.read_hits_table(spark, path)


@query(f"""
WITH {_HITS_SQL}, l AS (SELECT v, db, locus, CAST(sum(hi - lo + 1) AS BIGINT) AS w FROM h GROUP BY ALL)
SELECT v AS "EDGE", db AS database, CAST(sum(w) AS VARCHAR) AS database_weight, string_agg(locus, ',' ORDER BY locus) AS loci FROM l GROUP BY v, db
""")
def tag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of vertices as text columns."""
    tags = _locus_hits(spark, sf_dir).withColumn("weight", F.col("hi") - F.col("lo") + 1)
    return graphs.tag_lines(tags).select("EDGE", "database", "database_weight", "loci")


@query("""
WITH t AS (SELECT 'p' || p_partkey AS v, p_size AS len, p_partkey % 3 = 0 AS at_end FROM part)
SELECT v, CASE WHEN at_end THEN len - 4 ELSE 2 END AS lo FROM t WHERE NOT (at_end AND 5 <= 7)
""")
def overlap_only_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that don't lie within the overlap at an end."""
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), _text("p_partkey")).alias("v"), F.col("p_size").cast("long").alias("len"), (F.col("p_partkey") % 3 == 0).alias("at_end"))
    hits = t.select("v", F.when(F.col("at_end"), F.col("len") - 4).otherwise(2).alias("lo"), F.when(F.col("at_end"), F.col("len")).otherwise(4).alias("hi"), "at_end", F.col("len").alias("whole"))
    # the others are kept clear of their vertices' ends
    return graphs.overlap_only(hits, t.select("v", F.when(F.col("at_end"), F.col("len")).otherwise(1000).alias("len")), 7).select("v", "lo")


# ---- annotations, logs, registries ----------------------------------------


def _genbank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One record for each part: a gene on the reverse strand in two pieces, and one over the origin."""
    path = _folder(spark)
    k = F.col("p_partkey")
    seq = F.concat(_dna(k), _dna(F.col("p_name")))
    text = F.concat(
        F.lit("LOCUS       rec"), k.cast("string"), F.lit("   64 bp\nFEATURES             Location/Qualifiers\n     CDS             complement(join("), (1 + k % 9).cast("string"), F.lit(".."), (12 + k % 9).cast("string"),
        F.lit(",\n                     30..41))\n                     /gene=\"g"), (k % 7).cast("string"), F.lit("\"\n     tRNA            join(60..64,1..3)\n                     /product=\"trna\"\nORIGIN\n        1 "), F.lower(F.left(seq, F.lit(40))), F.lit("\n       41 "), F.lower(F.substring(seq, 41, 24)), F.lit("\n//"),
    )
    graphs.write_lines(table(spark, sf_dir, "part").select(text.alias("value")), path)
    return annotations.read_genbank(spark, path)


_GENBANK_SQL = f"g AS (SELECT p_partkey AS k, 'rec' || p_partkey AS record, {_dna_sql('p_partkey')} || {_dna_sql('p_name')} AS s FROM part)"


@query(f"""
WITH {_GENBANK_SQL}
SELECT record, 'g' || (k % 7) AS name, 1 AS nth, 24 AS len, reverse(translate(s[1 + k % 9:12 + k % 9] || s[30:41], 'ACGT', 'TGCA')) AS seq FROM g
UNION ALL SELECT record, 'trna', 1, 8, s[60:64] || s[1:3] FROM g
""")
def genbank_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of annotated regions, nested and on either strand."""
    return annotations.regions(*_genbank(spark, sf_dir)).select("record", "name", "nth", "len", "seq")


@query(f"""
WITH {_GENBANK_SQL}
SELECT record, '>Feature ' || record || chr(10) || '41' || chr(9) || '30' || chr(9) || 'CDS' || chr(10) || (12 + k % 9) || chr(9) || (1 + k % 9) || chr(10) || chr(9) || chr(9) || chr(9) || 'gene' || chr(9) || 'g' || (k % 7) AS value FROM g
""")
def feature_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature tables of coding regions."""
    return annotations.tbl_lines(_genbank(spark, sf_dir)[0], kinds=("CDS",)).select("record", "value")


@query("""
SELECT 'sample=' || s_suppkey AS sample, CAST(2 + s_suppkey % 5 AS VARCHAR) AS rounds, CAST(s_suppkey * 10 AS VARCHAR) AS accepted_lines, CAST(100 + s_suppkey % 50 AS VARCHAR) AS mean_read_len, round(3.0 + s_suppkey % 9, 2) AS time, CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END AS circular FROM supplier
""")
def log_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the logs of runs say, one folder a run."""
    path = _folder(spark)
    k = F.col("s_suppkey")
    said = lambda *x: F.concat(F.lit("2020-01-01 00:00:00,000 - INFO: "), *[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    rounds = F.transform(F.sequence(F.lit(1), 2 + (k % 5).cast("int")), lambda r: F.concat(F.lit("2020-01-01 00:00:00,000 - INFO: Round "), r.cast("string"), F.lit(": 5/9 AI "), F.when(r == 2 + k % 5, k * 10).otherwise(1).cast("string"), F.lit(" AW 7")))
    lines = F.flatten(F.array(F.array(said("Mean = ", 100 + k % 50, " bp, maximum = 150 bp.")), rounds, F.array(said("Result status of x: ", F.when(k % 2 == 0, "circular genome").otherwise("1 scaffold(s)"))), F.array(F.concat(F.lit("Total cost "), (3 + k % 9).cast("string"), F.lit(".0 s")))))
    annotations.write_logs(table(spark, sf_dir, "supplier").select(F.concat(F.lit("sample="), k.cast("string")).alias("sample"), F.array_join(lines, "\n").alias("value")), path)
    return annotations.read_logs(spark, f"{path}/*/*.txt").select("sample", "rounds", "accepted_lines", "mean_read_len", "time", "circular")


@query("SELECT 's' || s_suppkey AS sample, CASE WHEN s_acctbal < 0 THEN '-' ELSE CAST(s_nationkey AS VARCHAR) END AS depth, '-' AS absent FROM supplier")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary with the columns asked for, others left out, missing ones as -."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _text("s_suppkey")).alias("sample"), F.when(F.col("s_acctbal") >= 0, _text("s_nationkey")).alias("depth"), F.lit(1).alias("extra"))
    annotations.write_summary(rows, path, ["sample", "depth", "absent"])
    return spark.read.csv(path, sep="\t", header=True)


@query("SELECT p_partkey, sha256(p_name || p_partkey) AS sha256, CASE WHEN p_partkey % 4 = 0 THEN 'known' END AS type FROM part")
def content_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents found in a registry that was written and read."""
    path = _folder(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", _text("p_partkey")).alias("content"))
    part.where("p_partkey % 4 = 0").select(F.lit("known"), F.lit("1"), F.sha2("content", 256)).write.csv(path, sep="\t")
    return profile.with_hash(part, "content", annotations.read_registry(spark, path)).select("p_partkey", "sha256", "type")


@query(f"""
SELECT DISTINCT label, seq FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'gene' || p_partkey ELSE p_brand END AS label, left({_dna_sql('p_size')}, CAST(10 + p_size % 22 AS INTEGER)) AS seq FROM part) WHERE length(seq) >= 20 AND NOT starts_with(label, 'gene')
""")
def coding_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records fit for a search database."""
    label = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("gene"), _text("p_partkey"))).otherwise(F.col("p_brand"))
    return words.coding_references(table(spark, sf_dir, "part").select(label.alias("label"), F.left(_dna(F.col("p_size")), (10 + F.col("p_size") % 22).cast("int")).alias("seq")))


# ---- functions ------------------------------------------------------------


@query(f"""
WITH s AS (SELECT p_partkey AS k, {_dna_sql('p_partkey')} AS d FROM part)
SELECT k, translate(d, 'A', 'N') LIKE '%N%' AS degenerate, CAST(length(d) - length(replace(d, 'A', '')) AS INTEGER) AS missing, 'NN' || d[3:4] || 'N' || d[6:] AS masked, (k % 130) % 2 = 1 AND k % 130 BETWEEN 21 AND 127 AND k % 130 <= 100 AS fits,
  round(k % 100 * 150.0 / (150 - 21 + 1), 4) AS base_cov, round(-pow(k % 10 - 5, 2) / 8 - ln(2 * sqrt(2 * pi())), 6) AS logpdf FROM s
""")
def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degenerate and missing bases, masking, valid word sizes, base coverage, log density."""
    k, d = F.col("p_partkey"), _dna(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(
        k.alias("k"), strings.is_degenerate(F.translate(d, "A", "N")).alias("degenerate"), strings.missing_bases(F.translate(d, "A", "N")).alias("missing"), strings.mask(d, F.array(*[F.lit(i) for i in (0, 1, 4)])).alias("masked"),
        strings.valid_k(k % 130, F.lit(100)).alias("fits"), F.round(strings.expected_rows(k % 100, F.lit(150.0), F.lit(21)), 4).alias("base_cov"), F.round(strings.normal_logpdf((k % 10).cast("double"), F.lit(5.0), F.lit(2.0)), 6).alias("logpdf"),
    )


@query("""
SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'trnK-UUU' WHEN 1 THEN 'trnM' WHEN 2 THEN 'rrn16' ELSE 's' || s_suppkey END AS gene,
  '~a_' || lpad(CAST(s_suppkey AS VARCHAR), 30, '0') AS sort_key, 'reads_' || s_suppkey AS stem FROM supplier
""".replace("trnK-UUU", "trnK-TTT"))
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene names in one spelling, natural sort keys, file stems."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "tRNA-Lys (UUU)").when(k % 4 == 1, "trna_Met").when(k % 4 == 2, "16S ribosomal RNA").otherwise(F.concat(F.lit("s"), k.cast("string")))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), strings.gene_name(name).alias("gene"), strings.natural_key(F.concat(F.lit("a_"), k.cast("string"))).alias("sort_key"), strings.file_stem(F.concat(F.lit("/data/x/reads_"), k.cast("string"), F.lit(".fq.gz"))).alias("stem"))


@query(f"""
WITH s AS (SELECT p_partkey AS k, {_dna_sql('p_partkey')} || {_dna_sql('p_name')} || {_dna_sql('p_partkey * 3')} AS d FROM part),
c AS (SELECT k, string_agg(CASE WHEN d[i * 3 + 1:i * 3 + 3] IN ('ATG', 'GTG', 'ACG') THEN 'S' WHEN d[i * 3 + 1:i * 3 + 3] IN ('TAA', 'TAG', 'TGA') THEN 'E' ELSE 'o' END, '' ORDER BY i) AS p FROM s, unnest(range(32)) u(i) GROUP BY k),
f AS (SELECT k, unnest(regexp_extract_all(p, 'S[So]*E')) AS orf FROM c)
SELECT k, CAST(length(orf) * 3 AS INTEGER) AS orf_len, count(*) AS n FROM f WHERE length(orf) * 3 >= 12 GROUP BY ALL
""")
def open_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open frames of at least 12 bases."""
    d = F.concat(_dna(F.col("p_partkey")), _dna(F.col("p_name")), _dna(F.col("p_partkey") * 3))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(strings.let(d, lambda s: strings.orf_lengths(s, 0, ("ATG", "GTG", "ACG"), ("TAA", "TAG", "TGA"), 12))).alias("orf_len"))
    return t.groupBy("k", "orf_len").agg(F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT {_dna_sql('c_custkey')} AS d FROM customer), k AS (SELECT (d || d)[i + 1:i + 5] AS kmer FROM s, unnest(range(32)) u(i)) SELECT kmer, count(*) AS n FROM k GROUP BY kmer
""")
def circular_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of circular strings, over their ends."""
    t = table(spark, sf_dir, "customer").select(F.explode(strings.circular_substrings(_dna(F.col("c_custkey")), 5)).alias("kmer"))
    return t.groupBy("kmer").agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = query.queries, query.sql
