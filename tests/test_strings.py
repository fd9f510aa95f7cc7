import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import strings

C = None  # the column, once there is a session


@pytest.fixture(autouse=True)
def _column(spark):
    global C
    C = F.col("s")


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_reverse_complement_over_ambiguity_codes(spark):
    assert one(spark, strings.revcomp(C), s="ATGCRMYKHBDVatgcNS") == "SNgcatBHVDMRKYGCAT"


def test_reverse_complement_twice_is_none(spark):
    texts = [("ACGTN?",), ("",), ("acgRYK",), ("Vhd-",)]
    df = spark.createDataFrame(texts, "s string")
    assert all(r["s"] == r["x"] for r in df.select("s", strings.revcomp(strings.revcomp(C)).alias("x")).collect())


def test_words_of_both_strands(spark):
    both = F.array_sort(F.array_distinct(F.concat(strings.substrings(C, 3), strings.substrings(strings.revcomp(C), 3))))
    assert one(spark, both, s="ACGTA") == ["ACG", "CGT", "GTA", "TAC"]
    two = F.array_sort(F.array_distinct(F.concat(strings.substrings(C, 3, 2), strings.substrings(strings.revcomp(C), 3, 2))))
    assert one(spark, two, s="ACGTA") == ["ACG", "CGT", "GTA", "TAC"]


def test_short_strings_have_no_words(spark):
    assert one(spark, strings.substrings(C, 3), s="AC") == []
    assert one(spark, strings.shingles(C, 3), s="a b") == []
    assert one(spark, strings.codons(C), s="AC") == []


def test_circular_words_wrap(spark):
    assert one(spark, strings.circular_substrings(C, 3), s="ACGT") == ["ACG", "CGT", "GTA", "TAC"]


def test_probes_take_the_middle_and_whole_rows(spark):
    assert one(spark, strings.probe_positions(F.lit(10), 4, 3), s="") == [0, 3, 6]
    assert one(spark, strings.probe_positions(F.lit(4), 4, 3), s="") == [0]
    assert one(spark, strings.probe_positions(F.lit(3), 4, 3), s="") == []


def test_open_frames(spark):
    found = strings.orf_lengths(C, 0, ("ATG",), ("TAA", "TAG", "TGA"), 6)
    assert one(spark, found, s="ATGAAATAACCCATGTAGATGAAA") == [9, 6]
    assert one(spark, strings.orf_lengths(C, 1, ("ATG",), ("TAA",), 9), s="CATGAAATAA") == [9]


def test_codon_problems(spark):
    assert one(spark, strings.codon_problems(C), s="ATGAAATAA") == []
    assert one(spark, strings.codon_problems(C), s="ATGTAAAAATAA") == ["internal"]
    assert sorted(one(spark, strings.codon_problems(C), s="CCCA")) == ["frame", "start", "stop"]


def test_gc_share_and_missing(spark):
    assert one(spark, strings.gc_fraction(C), s="GGCATN") == 0.6
    assert one(spark, strings.gc_fraction(C), s="NN") is None
    assert one(spark, strings.missing_bases(C), s="AN?n") == 3
    assert one(spark, strings.low_complexity(C), s="ABAB") and not one(spark, strings.low_complexity(C), s="ABC")


def test_mask_and_padding(spark):
    assert one(spark, strings.mask(C, F.array(F.lit(0), F.lit(2))), s="ACGT") == "NCNT"
    assert one(spark, strings.pad_circular(C, F.lit(7)), s="ACG") == "ACGACGACGA"
    assert one(spark, strings.overlaps(C, F.lit("GTA"), F.lit(2)), s="ACGT")


def test_least_rotation(spark):
    assert one(spark, strings.least_rotation(C), s="GAC") == "ACG"


def test_gene_names(spark):
    assert one(spark, strings.gene_name(C), s="tRNA-Leu (UAA)") == "trnL-TAA"
    assert one(spark, strings.gene_name(C), s="16S ribosomal RNA") == "rrn16"
    assert one(spark, strings.gene_name(C), s="rbcL") == "rbcL"


def test_natural_order(spark):
    names = ["a_10", "a_9", "a_x", "a_2"]
    got = spark.createDataFrame([(n,) for n in names], "s string").orderBy(strings.natural_key(C)).collect()
    assert [r["s"] for r in got] == ["a_2", "a_9", "a_10", "a_x"]


def test_greatest_common_divisor(spark):
    df = spark.createDataFrame([([4, 6, 10],), ([7],), ([0, 9, 6],)], "s array<long>")
    assert [r["g"] for r in df.select(strings.gcd_of(C).alias("g")).collect()] == [2, 7, 3]


def test_stems_and_labels(spark):
    assert one(spark, strings.file_stem(C), s="/a/b/x.fastq.gz") == "x"
    assert one(spark, strings.unique_names(C, F.lit(2)), s="a b") == "a_b-1"
    assert one(spark, strings.valid_k(F.lit(55), F.lit(100)), s="") and not one(spark, strings.valid_k(F.lit(56), F.lit(100)), s="")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="ACGT", min_size=1, max_size=12))
def test_rotation_name_is_the_same_for_all_rotations(text):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    k = len(text) // 2
    df = spark.createDataFrame([(text,), (text[k:] + text[:k],)], "s string")
    assert len({r["x"] for r in df.select(strings.least_rotation(C).alias("x")).collect()}) == 1
