import gzip

from conftest import rows
from pyspark.sql import functions as F

from strandloom.operators import intervals
from strandloom.sources import alignments, annotations, graphs, sequences


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 note\nACGTAC\nGT\n>s2\n>s3\nAC GT\n")
    r = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert rows(r, "label", "seq") == [("s1 note", "ACGTACGT"), ("s2", ""), ("s3", "ACGT")]
    assert rows(sequences.fasta_lengths(r, True)) == [("s1", 8), ("s2", 0), ("s3", 4)]
    sequences.write_fasta(r, str(tmp_path / "out"), 3)
    again = sequences.read_fasta(spark, str(tmp_path / "out"))
    assert rows(again, "label", "seq") == rows(r, "label", "seq")


def test_fastq_ranges_take_each_record_once(spark, tmp_path):
    # quality lines that begin with @ are the trap
    text = "".join(f"@r{i}/1\n{'ACGT' * 3}\n+\n@{'I' * 11}\n" for i in range(50))
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    for size in (37, 100, 1 << 20):
        got = sequences.read_fastq(spark, [str(tmp_path / "a.fq")], range_bytes=size)
        assert sorted(r["name"] for r in got.collect()) == sorted(f"r{i}" for i in range(50))
    both = sequences.read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")], columns=["file_id", "name", "mate"])
    assert both.columns == ["file_id", "name", "mate"] and both.count() == 100 and both.where("mate <> 1").isEmpty()


def test_heads(spark):
    heads = ["r1 1:N:0", "r1#AC/2", "r1/1", "r1"]
    want = [("r1", 1), ("r1", 2), ("r1", 1), ("r1", 0)]
    assert [sequences.split_head(h) for h in heads] == want
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert [tuple(r) for r in df.select(sequences.head_name(F.col("h")), sequences.head_mate(F.col("h"))).collect()] == want


def test_read_sinks(spark, tmp_path):
    reads = spark.createDataFrame([("a", "AC", "II", 1), ("b", "GT", "II", 1), ("c", "TT", "II", 2)], "name string, seq string, qual string, rep_id long")
    sequences.write_accepted(reads, spark.createDataFrame([(1,)], "rep_id long"), str(tmp_path / "acc"))
    assert spark.read.option("lineSep", "\n@").text(str(tmp_path / "acc")).count() == 2
    sequences.write_pairs(reads, reads.where("name <> 'a'"), str(tmp_path / "pairs"))
    assert spark.read.text(str(tmp_path / "pairs/unpaired_1")).count() == 4 and spark.read.text(str(tmp_path / "pairs/paired_2")).count() == 8


def test_simulated_reads_cover_the_text(spark):
    r = spark.createDataFrame([("s", "ACGTACGTTT")], "label string, seq string")
    got = sequences.simulate_reads(r, 4, 3)
    assert rows(got, "seq") == [("ACGT",), ("GTTT",), ("TACG",)]
    assert sequences.simulate_reads(r, 4, circular=True).count() == 10
    assert sequences.simulate_reads(r, 4, insert=6, count=5).groupBy("mate").count().count() == 2


SAM = "@SQ\tSN:S\tLN:12\nq1\t83\tS\t2\t30\t3M1D2M\t=\t1\t0\tACGTA\tIIIII\tMD:Z:3^A2\tNM:i:1\nq1\t163\tS\t11\t30\t2M\t=\t1\t0\tAC\tII\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    refs, hits = alignments.read_sam(spark, str(tmp_path / "a.sam"), spark.createDataFrame([("S", 8)], "ref string, real_len long"))
    assert rows(refs) == [("S", 12, 8)]
    assert rows(alignments.sam_heads(hits.where("is_mapped"))) == [("q1", 1), ("q1", 2)]
    assert rows(hits, "name", "pos", "is_first", "is_reversed") == [("q1", 2, True, True), ("q1", 3, False, False), ("q2", 0, True, False)]
    one = hits.where("is_first")
    d = intervals.depth_positions(intervals.depth(alignments.covered(alignments.aligned_blocks(one)), ["ref"]), ["ref"])
    assert sorted((r["pos"], r["depth"]) for r in d.collect()) == [(2, 1), (3, 1), (4, 1), (6, 1), (7, 1)]
    md = hits.where("is_first AND is_mapped").select(alignments.md_parts(F.col("tags")["MD"]).alias("m")).first()["m"]
    assert md == ["3", "^A", "2"]


def test_insertions_are_on_the_site_before(spark):
    h = spark.createDataFrame([("q", True, "S", 5, 9, "2M3I1M", True)], "name string, is_first boolean, ref string, pos long, mapq int, cigar string, is_mapped boolean")
    assert rows(alignments.aligned_blocks(h), "op", "lo", "hi") == [("I", 6, 6), ("M", 5, 6), ("M", 7, 7)]


def test_operations_of_an_alignment(spark):
    h = spark.createDataFrame([("q", True, "S", 2, 9, "3M1D2M", True, {"MD": "1A1^C2"})], "name string, is_first boolean, ref string, pos long, mapq int, cigar string, is_mapped boolean, tags map<string,string>")
    assert rows(alignments.mismatches(h)) == [("S", "X", 3, 3)]
    refs = spark.createDataFrame([("S", 10), ("T", 10)], "ref string, real_len long")
    stats = alignments.operation_statistics(alignments.aligned_blocks(h).union(alignments.mismatches(h)), refs)
    got = {(r["ref"], r["op"]): (round(r["mean"], 6), round(r["std"], 6)) for r in stats.collect()}
    assert got["S", "M"] == (0.5, 0.5) and got["T", "M"] == (0.0, 0.0) and got[None, "M"] == (0.25, round(0.1875**0.5, 6)) and got["S", "D"] == (0.1, 0.3)
    assert {r["ref"]: round(r["error"], 6) if r["error"] is not None else None for r in alignments.error_rates(stats.where("ref = 'S' OR ref IS NULL")).collect()} == {"S": 0.4, None: 0.4}


def test_blast(spark, tmp_path):
    (tmp_path / "b.tab").write_text("q\ts\t99.5\t10\t0\t0\t20\t11\t1\t10\t1e-5\t50\n")
    assert rows(alignments.read_blast(spark, str(tmp_path / "b.tab")), "query", "qlo", "qhi", "pident") == [("q", 11, 20, 99.5)]


def test_gfa_and_back(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("S\t1\tACGTACGT\tLN:i:8\tRC:i:80\nS\t2\tACGTC\tDP:f:2.5\nS\t3\tAAAAA\tDP:f:99\nL\t1\t+\t2\t-\t5M\nL\t1\t+\t3\t+\t0M\n")
    v, e = graphs.read_gfa(spark, str(tmp_path / "g.gfa"), max_cov=50)
    assert rows(v, "v", "len", "cov") == [("1", 8, 10.0), ("2", 5, 2.5)]
    assert rows(e) == [("1", True, "2", True, 5), ("2", True, "1", True, 5)]
    graphs.write_lines(graphs.gfa_lines(v, e), str(tmp_path / "out"))
    v2, e2 = graphs.read_gfa(spark, str(tmp_path / "out"))
    assert rows(e2) == rows(e) and rows(v2, "v", "seq", "len") == rows(v, "v", "seq", "len")
    assert graphs.uniform_overlap(e) == 5 and rows(graphs.graph_fasta(v)) == [("1", "ACGTACGT"), ("2", "ACGTC")]


def test_fastg_and_back(spark, tmp_path):
    a, b = "ACGTACGTACGGTTAACCGGTTAACCGTAGC", "GTTAACCGGTTAACCGTAGCTTACGATTTTT"
    k = next(k for k in range(31, 0, -1) if a[-k:] == b[:k])
    (tmp_path / "g.fastg").write_text(f">EDGE_1_length_{len(a)}_cov_10.5:EDGE_2_length_{len(b)}_cov_5,EDGE_9_length_3_cov_1;\n{a}\n>EDGE_2_length_{len(b)}_cov_5;\n{b}\n")
    v, e = graphs.read_fastg(spark, str(tmp_path / "g.fastg"))
    assert rows(v, "v", "cov") == [("1", 10.5), ("2", 5.0)]
    assert rows(e, "v1", "e1", "v2", "e2") == [("1", True, "2", False), ("2", False, "1", True)]
    assert e.first()["overlap"] == (k if k >= 21 and k % 2 else 0)
    graphs.write_lines(graphs.fastg_lines(v, e), str(tmp_path / "out"))
    v2, e2 = graphs.read_fastg(spark, str(tmp_path / "out"))
    assert rows(v2, "v", "seq", "cov") == rows(v, "v", "seq", "cov") and rows(e2) == rows(e)


def test_tables_of_hits(spark, tmp_path):
    (tmp_path / "h.tab").write_text("EDGE\tdatabase\tloci\tloci_gene_sequential\tloci_sequential\tdetails\n1\td\tx\tx\tx\tpsbA(5-9,d)>>psbA(10-19,d)>>rbcL(1-3,d)\n")
    h = graphs.read_hits_table(spark, str(tmp_path / "h.tab"))
    assert rows(h, "locus", "lo", "hi") == [("psbA", 10, 19), ("psbA", 5, 9), ("rbcL", 1, 3)]
    assert rows(graphs.hits_lines(h), "loci_sequential", "details") == [("rbcL>>psbA", "rbcL(1-3,d)>>psbA(5-9,d)>>psbA(10-19,d)")]
    v = spark.createDataFrame([("1", 19)], "v string, len long")
    assert rows(graphs.overlap_only(h, v, 3), "locus", "lo") == [("psbA", 10), ("psbA", 5)]
    tags = spark.createDataFrame([("1", "d", "x", 2.0), ("1", "d", "y", 1.0)], "v string, db string, locus string, weight double")
    assert rows(graphs.tag_lines(tags)) == [("1", "d", "3.0", "x,y", "x:2.0,y:1.0")]


def test_scaffold_paths(spark, tmp_path):
    (tmp_path / "s.paths").write_text("NODE_1_length_9_cov_2.5\n1+,2-;\n3+\nNODE_1_length_9_cov_2.5'\n3-\n")
    got = graphs.read_scaffold_paths(spark, str(tmp_path / "s.paths"))
    assert [(r["node"], r["sub_path"], [tuple(p) for p in r["path"]]) for r in got.orderBy("node", "sub_path").collect()] == [
        ("NODE_1_length_9_cov_2.5", 0, [("1", True), ("2", False)]), ("NODE_1_length_9_cov_2.5", 1, [("3", True)]), ("NODE_1_length_9_cov_2.5'", 0, [("3", False)]),
    ]


GB = """LOCUS       X1   20 bp
FEATURES             Location/Qualifiers
     source          1..20
     CDS             join(2..4,8..10)
                     /gene="abc"
                     /product="thing one
                     two"
     tRNA            complement(15..17)
                     /gene="tRNA-Leu"
ORIGIN
        1 acgtacgtac gtacgtacgt
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "x.gb").write_text(GB)
    f, s = annotations.read_genbank(spark, str(tmp_path / "x.gb"))
    assert rows(f.where("feature <> 'source'"), "feature", "start", "end", "strand", "part") == [("CDS", 1, 4, 1, 0), ("CDS", 7, 10, 1, 1), ("tRNA", 14, 17, -1, 0)]
    assert f.where("feature = 'CDS'").first()["quals"]["product"] == "thing one two"
    found = annotations.regions(f, s)
    assert rows(found, "name", "seq") == [("abc", "CGTTAC"), ("trnL", "TAC")]
    assert rows(annotations.region_statistics(found, ["abc", "nope"])) == [("X1", "6", "-")]
    text = annotations.tbl_lines(f).first()["value"]
    assert text.startswith(">Feature X1\n2\t4\tCDS\n8\t10") and "17\t15\ttRNA" in text
    assert annotations.parse_location("complement(join(1..3,complement(5..6)))") == [(4, 6, 1), (0, 3, -1)]


LOG = """Python 3 / x -F kind_a -w 0.6 -k 21,55 -o out
2020-01-01 00:00:00,000 - INFO: Mean = 149.5 bp, maximum = 150 bp.
2020-01-01 00:00:00,000 - INFO: Reads used = 100+100
2020-01-01 00:00:00,000 - INFO: Trimming bases with qualities (0.10%): 33..35  !"#
2020-01-01 00:00:00,000 - INFO: Estimated a base-coverage = 12.5
2020-01-01 00:00:00,000 - INFO: Estimated b base-coverage = 7
2020-01-01 00:00:00,000 - INFO: Setting '-w 95'
2020-01-01 00:00:00,000 - INFO: Mem 1.5 M, 180 candidates in all 200 reads
2020-01-01 00:00:00,000 - INFO: Round 1: 200/200 AI 20 AW 400 Mem 0.5
2020-01-01 00:00:00,000 - INFO: Round 2: 200/200 AI 30 AW 600 Mem 0.5
2020-01-01 00:00:00,000 - INFO: Writing PATH1 of x to a.K55.complete.1.fasta
2020-01-01 00:00:00,000 - INFO: Result status of x: circular genome
Total cost 12.5 s
Total cost 2.5 s
"""


def test_regions_against_references(spark):
    q = spark.createDataFrame([("a", "ATGAAATAA"), ("b", "ATGTAAAAATAA"), ("c", "ATGCCCTAA")], "name string, seq string")
    r = spark.createDataFrame([("a", "atgaaataa"), ("a", "ATG"), ("b", "GTGTAAAAATAA"), ("d", "ATG")], "name string, seq string")
    got = {x["name"]: x for x in annotations.compare(q, r, ends=3).collect()}
    assert got["a"]["passes"] and got["a"]["similarity"] == 1.0 and got["a"]["problems"] == []
    assert not got["b"]["passes"] and got["b"]["same_end"] and not got["b"]["same_start"] and got["b"]["problems"] == ["internal"]
    assert got["c"]["status"] == "only in query" and got["d"]["status"] == "only in reference"


def test_logs_and_summary(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1/log.txt").write_text(LOG)
    got = annotations.read_logs(spark, str(tmp_path / "s1/log.txt"), lengths=spark.createDataFrame([("s1", "150+9")], "sample string, res_len string"))
    r = got.first().asDict()
    want = {"sample": "s1", "type": "kind_a", "w": "95", "k": "21,55", "mean_read_len": "149.5", "max_read_len": "150", "num_reads_1": "100+100", "trim_int": "33..35", "trim_chars": '!"#', "trim_percent": "0.10%", "estimated_base_coverage": "12.5 & 7", "mem_dup": 3 << 19, "n_unique_reads": "180"}
    want |= {"rounds": "2", "accepted_lines": "30", "accepted_words": "600", "mem_extending": 1 << 29, "res_kmer": "55", "res_path_count": "1", "circular": "yes", "degenerate_base_used": "no", "time": 15.0, "n_reads": "200", "n_bases": 29900, "mem_max": 1 << 29, "res_len": "150+9", "pre_w": None}
    assert {k: r[k] for k in want} == want
    assert rows(annotations.read_logs(spark, str(tmp_path / "s1/log.txt"), {"n": ("all", "Round ([0-9])")})) == [("s1", "1 & 2")]
    got = got.withColumnRenamed("res_path_count", "paths")
    annotations.write_summary(got, str(tmp_path / "sum"), ["sample", "paths", "absent"])
    assert spark.read.csv(str(tmp_path / "sum"), sep="\t", header=True).columns == ["sample", "paths", "absent"]
    assert rows(annotations.rounds_of(spark, str(tmp_path / "s1")), "folder") == [("s1",)]
    (tmp_path / "reg.tsv").write_text("t\t1.0\tabc\n")
    assert rows(annotations.read_registry(spark, str(tmp_path / "reg.tsv"))) == [("t", "1.0", "abc")]
