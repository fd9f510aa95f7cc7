"""Assembly graphs and their side tables (inventory ids A11-A15, A23-A25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import symmetric, undirected
from ..operators.intervals import collapse_runs


def read_gfa(spark: SparkSession, path: str, default_cov: float = 1.0, min_cov: float = 0.0, max_cov: float = float("inf")) -> tuple[DataFrame, DataFrame]:
    """vertices (v, seq, len, cov, attrs) and symmetric edges of GFA 1 or 2.

    Depth is KC or RC over the length, else DP or RD, else the default; vertices outside
    the range of depth are left out before edges are built, and so are their edges.
    """
    c = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    two = at(2).rlike("^[0-9]+$") & (F.size("c") > 3)  # the second version has a length before the sequence
    seg = c.where(at(0) == "S").select(at(1).alias("v"), F.when(two, at(3)).otherwise(at(2)).alias("seq"), F.when(two, at(2).cast("long")).alias("told"), F.filter("c", lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")).alias("t"))
    seg = seg.withColumn("attrs", F.map_from_entries(F.transform("t", lambda x: F.struct(F.left(x, F.lit(2)).alias("key"), F.substring(x, 6, 1_000_000).alias("value")))))
    tag = lambda k: F.try_element_at("attrs", F.lit(k)).cast("double")
    length = F.coalesce(tag("LN").cast("long"), F.col("told"), F.length("seq").cast("long"))
    v = seg.withColumn("len", length).withColumn("cov", F.coalesce(F.coalesce(tag("KC"), tag("RC")) / F.col("len"), tag("DP"), tag("RD"), F.lit(default_cov)))
    v = v.where((F.col("cov") >= min_cov) & (F.col("cov") <= max_cov)).select("v", "seq", "len", "cov", "attrs")
    link = c.where(at(0) == "L").select(at(1).alias("v1"), (at(2) == "+").alias("e1"), at(3).alias("v2"), (at(4) == "-").alias("e2"), F.coalesce(F.regexp_extract(at(5), "^([0-9]+)M", 1).try_cast("int"), F.lit(0)).alias("overlap"))
    name, sign = lambda i: F.regexp_replace(at(i), "[+-]$", ""), lambda i: F.right(at(i), F.lit(1))
    edge = c.where(at(0) == "E").select(name(2).alias("v1"), (sign(2) == "+").alias("e1"), name(3).alias("v2"), (sign(3) == "-").alias("e2"), (F.regexp_replace(at(5), r"\$", "").cast("int") - at(4).cast("int")).alias("overlap"))
    edges = symmetric(link.union(edge))
    known = v.select("v")
    edges = edges.join(known.withColumnRenamed("v", "v1"), "v1", "left_semi").join(known.withColumnRenamed("v", "v2"), "v2", "left_semi").select("v1", "e1", "v2", "e2", "overlap")
    return v, edges


def read_fastg(spark: SparkSession, path: str, min_cov: float = 0.0, max_cov: float = float("inf")) -> tuple[DataFrame, DataFrame]:
    """vertices and symmetric edges of FASTG; only defined vertices count, overlaps are inferred."""
    from .sequences import read_fasta

    rows = read_fasta(spark, path)
    head = F.regexp_replace("label", ";.*$", "")
    own, nexts = F.substring_index(head, ":", 1), F.when(head.contains(":"), F.split(F.substring_index(head, ":", -1), ",")).otherwise(F.array().cast("array<string>"))
    name = lambda h: F.regexp_replace(F.regexp_extract(h, "^(?:EDGE_)?(.*?)(?:_length_.*|'*)$", 1), "'", "")
    parsed = rows.select(name(own).alias("v"), own.endswith("'").alias("rev"), F.regexp_extract(own, "_cov_([0-9.eE+-]+)", 1).try_cast("double").alias("cov"), "seq", nexts.alias("nexts"))
    parsed = parsed.where((F.col("cov") >= min_cov) & (F.col("cov") <= max_cov))
    from ..functions.strings import revcomp

    forward = F.when(F.col("rev"), revcomp(F.col("seq"))).otherwise(F.col("seq"))
    v = parsed.groupBy("v").agg(F.min_by(forward, "rev").alias("seq"), F.min_by("cov", "rev").alias("cov")).select("v", "seq", F.length("seq").cast("long").alias("len"), "cov", F.create_map().cast("map<string,string>").alias("attrs"))
    nxt = parsed.select("v", "rev", F.explode("nexts").alias("n"))
    edges = nxt.select(F.col("v").alias("v1"), (~F.col("rev")).alias("e1"), name(F.col("n")).alias("v2"), F.col("n").endswith("'").alias("e2"), F.lit(0).alias("overlap"))
    known = v.select("v")
    edges = symmetric(edges).join(known.withColumnRenamed("v", "v1"), "v1", "left_semi").join(known.withColumnRenamed("v", "v2"), "v2", "left_semi").select("v1", "e1", "v2", "e2", "overlap")
    return v, edges.withColumn("overlap", F.lit(infer_overlap(v, edges)))


def infer_overlap(vertices: DataFrame, edges: DataFrame, low: int = 21, high: int = 127) -> int:
    """The greatest odd k in a range at which all edges' ends agree, 0 if there is none."""
    from ..functions.strings import revcomp

    a, b = vertices.select(F.col("v").alias("v1"), F.col("seq").alias("s1")), vertices.select(F.col("v").alias("v2"), F.col("seq").alias("s2"))
    t = edges.join(a, "v1").join(b, "v2")
    out = F.when(F.col("e1"), F.col("s1")).otherwise(revcomp(F.col("s1")))
    into = F.when(F.col("e2"), revcomp(F.col("s2"))).otherwise(F.col("s2"))
    good = [F.min((F.length(out) >= k) & (F.length(into) >= k) & (F.right(out, F.lit(k)) == F.left(into, F.lit(k)))).alias(f"k{k}") for k in range(low | 1, high + 1, 2)]
    row = t.agg(*good).first()
    return max([k for k in range(low | 1, high + 1, 2) if row[f"k{k}"]], default=0)


def uniform_overlap(edges: DataFrame) -> int | None:
    """The one overlap of all edges, None if they differ."""
    few = edges.select("overlap").distinct().limit(2).collect()
    return few[0][0] if len(few) == 1 else None


def graph_fasta(vertices: DataFrame) -> DataFrame:
    """(label, seq) of a graph."""
    return vertices.select(F.col("v").alias("label"), "seq")


def gfa_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of GFA 1, each undirected link once."""
    s = vertices.select(F.concat_ws("\t", F.lit("S"), "v", "seq", F.concat(F.lit("LN:i:"), "len"), F.concat(F.lit("RC:i:"), F.round(F.col("cov") * F.col("len")).cast("long"))).alias("value"))
    sign = lambda plus: F.when(plus, "+").otherwise("-")
    link = undirected(edges).select(F.concat_ws("\t", F.lit("L"), "v1", sign(F.col("e1")), "v2", sign(~F.col("e2")), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    return s.union(link)


def fastg_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Records of FASTG, both strands; names become numbers where they aren't."""
    from ..functions.strings import revcomp

    numeric = vertices.where(~F.col("v").rlike("^[0-9]+$")).isEmpty()
    if not numeric:
        names = vertices.select("v").withColumn("name", F.row_number().over(Window.orderBy("v")).cast("string"))
        from ..operators.graph import rename_vertices

        vertices, edges = rename_vertices(vertices, edges, names)
    label = lambda v, n, c, rev: F.concat(F.lit("EDGE_"), v, F.lit("_length_"), n.cast("string"), F.lit("_cov_"), F.round(c, 4).cast("string"), F.when(rev, "'").otherwise(""))
    both = vertices.select("v", "len", "cov", F.explode(F.array(F.lit(False), F.lit(True))).alias("rev"), "seq")
    other = vertices.select(F.col("v").alias("v2"), F.col("len").alias("l2"), F.col("cov").alias("c2"))
    nexts = edges.join(other, "v2").select(F.col("v1").alias("v"), (~F.col("e1")).alias("rev"), label(F.col("v2"), F.col("l2"), F.col("c2"), F.col("e2")).alias("n")).groupBy("v", "rev").agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("ns"))
    t = both.join(nexts, ["v", "rev"], "left")
    head = F.concat(F.lit(">"), label(F.col("v"), F.col("len"), F.col("cov"), F.col("rev")), F.when(F.col("ns").isNotNull(), F.concat(F.lit(":"), F.col("ns"))).otherwise(""), F.lit(";"))
    return t.select(F.concat(head, F.lit("\n"), F.when(F.col("rev"), revcomp(F.col("seq"))).otherwise(F.col("seq"))).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "error", compression: str | None = None) -> None:
    """Write a value column as text, compressed if asked."""
    writer = lines.write.mode(mode)
    (writer.option("compression", compression) if compression else writer).text(path)


def read_scaffold_paths(spark: SparkSession, path: str) -> DataFrame:
    """(node, cov, sub_path, path): oriented vertices of scaffolds; a semicolon ends a sub-path.

    A file is read whole: its lines belong to the header above them.
    """
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.split(F.concat(F.lit("\n"), F.col("value")), "\nNODE_")).alias("b")).where(F.trim("b") != "")
    head = F.concat(F.lit("NODE_"), F.substring_index("b", "\n", 1))
    body = F.regexp_replace(F.regexp_replace("b", r"^[^\n]*\n?", ""), r"\s", "")
    parts = blocks.select(head.alias("node"), F.regexp_extract(head, "_cov_([0-9.]+)", 1).try_cast("double").alias("cov"), F.posexplode(F.split(body, ";")).alias("sub_path", "p")).where("p <> ''")
    step = lambda x: F.struct(F.regexp_replace(x, "[+-]$", "").alias("v"), x.endswith("+").alias("fwd"))
    return parts.select("node", "cov", "sub_path", F.transform(F.split("p", ","), step).alias("path"))


def read_hits_table(spark: SparkSession, path: str) -> DataFrame:
    """(v, db, locus, lo, hi) from a table whose details column is locus(start-end,db) joined by >>."""
    t = spark.read.csv(path, sep="\t", header=True)
    d = t.select(F.col("EDGE").alias("v"), F.explode(F.split("details", ">>")).alias("d"))
    part = lambda i: F.regexp_extract("d", r"^(.*)\((\d+)-(\d+),(.*)\)$", i)
    return d.select("v", part(4).alias("db"), part(1).alias("locus"), part(2).cast("long").alias("lo"), part(3).cast("long").alias("hi")).where("locus <> ''")


def overlap_only(hits: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """hits without those that lie within the overlap at an end."""
    t = hits.join(vertices.select("v", "len"), "v")
    at_end = ((F.col("lo") == 1) | (F.col("hi") == F.col("len"))) & (F.col("hi") - F.col("lo") + 1 <= k)
    return t.where(~at_end).drop("len")


def tag_lines(tags: DataFrame) -> DataFrame:
    """(EDGE, database, database_weight, loci, loci_weight) by vertex and database, text columns."""
    by = tags.groupBy("v", "db", "locus").agg(F.sum("weight").alias("w")).groupBy("v", "db").agg(F.array_sort(F.collect_list(F.struct("locus", "w"))).alias("ls"), F.sum("w").alias("w"))
    return by.select(F.col("v").alias("EDGE"), F.col("db").alias("database"), F.col("w").cast("string").alias("database_weight"), F.array_join(F.transform("ls", lambda x: x["locus"]), ",").alias("loci"), F.array_join(F.transform("ls", lambda x: F.concat_ws(":", x["locus"], x["w"].cast("string"))), ",").alias("loci_weight"))


def hits_lines(hits: DataFrame) -> DataFrame:
    """(EDGE, database, loci, loci_gene_sequential, loci_sequential, details): loci in order of start, equal neighbours as one."""
    order = ["lo", "hi", "locus"]
    gene = F.substring_index("locus", "-", 1)
    one = lambda value, name: collapse_runs(hits.withColumn("__x", value), ["v"], order, "__x").groupBy("v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "__x"))), lambda s: s["__x"]), ">>").alias(name))
    text = F.concat("locus", F.lit("("), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"), F.lit(","), "db", F.lit(")"))
    details = hits.groupBy("v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi", "locus", text.alias("t")))), lambda s: s["t"]), ">>").alias("details"), F.array_join(F.array_sort(F.collect_set("db")), ";").alias("database"), F.array_join(F.array_sort(F.collect_set("locus")), ",").alias("loci"))
    return details.join(one(gene, "loci_gene_sequential"), "v").join(one(F.col("locus"), "loci_sequential"), "v").select(F.col("v").alias("EDGE"), "database", "loci", "loci_gene_sequential", "loci_sequential", "details")


