import random

from conftest import rows
from pyspark.sql import functions as F

from strandloom.functions import registry
from strandloom.operators import graph
from strandloom.plans import pipelines
from strandloom.sources import sequences


def test_sql_functions(spark):
    assert set(registry.register(spark)) >= {"revcomp", "words", "probe_words", "edit_distance_banded", "word_rows"}
    r = spark.sql("SELECT revcomp('AACG') AS r, words('ACGTA', 3, 2) AS w, words('AC', 3, 1) AS n, probe_words('ACGTA', 3, 5) AS p, edit_distance_banded('Ab', 'ac', 3) AS d, canonical_word('TT') AS c").first()
    assert tuple(r) == ("CGTT", ["ACG", "GTA"], [], ["ACG", "GTA"], 1, "AA")
    assert rows(spark.sql("SELECT * FROM word_rows('ACGT', 3, 1)")) == [(0, "ACG"), (1, "CGT")]


def test_simulated_reads_of_a_circle_are_all_recruited(spark):
    rng = random.Random(1)
    ring, other = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (400, 400))
    make = lambda text, name, circular: sequences.simulate_reads(spark.createDataFrame([(name, text)], "label string, seq string"), 50, 7, circular=circular)
    reads = make(ring, "ring", True).union(make(other, "other", False))
    reads = reads.select(F.lit(1).alias("file_id"), F.monotonically_increasing_id().alias("read_id"), "name", "seq", "qual")
    seed = spark.createDataFrame([(ring[:60],)], "seq string")
    options = pipelines.Options(word=21, max_supersteps=None, max_words=None)
    got = pipelines.from_rows(reads, seed, options)
    assert {r["name"].split("_")[0] for r in got.collect()} == {"ring"} and got.count() == reads.where("name LIKE 'ring%'").count()
    assert pipelines.from_rows(reads, seed, options, exclude=spark.createDataFrame([(ring,)], "seq string")).isEmpty()
    grouped = pipelines.from_rows(reads.union(reads), seed, options, group=True)
    assert grouped.count() == 2 * got.count()
    assert pipelines.Options().fast().probe_step == 5


def test_graph_to_paths(spark):
    rng = random.Random(2)
    part = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    big, small, twice, spur, alien = part(300), part(100), part(150), part(40), part(200)
    v = spark.createDataFrame([("L", 300, 50.0, big), ("S", 100, 52.0, small), ("R", 150, 101.0, twice), ("t", 40, 51.0, spur), ("x", 200, 49.0, alien)], "v string, len long, cov double, seq string")
    e = spark.createDataFrame([("L", True, "R", False, 0), ("R", True, "S", False, 0), ("S", True, "R", True, 0), ("R", False, "L", False, 0), ("S", True, "t", False, 0)], "v1 string, e1 boolean, v2 string, e2 boolean, overlap int")
    tags = spark.createDataFrame([("L", "pt", "a", 9.0), ("R", "pt", "b", 5.0), ("S", "pt", "c", 3.0), ("x", "mt", "d", 50.0)], "v string, db string, locus string, weight double")
    target = pipelines.extract_target(v, e, tags, "pt")
    assert rows(target.copies) == [("L", 1), ("R", 2), ("S", 1)]
    report = pipelines.path_report(target).collect()
    assert len(report) == 2 and all(r["circular"] and len(r["seq"]) == 700 for r in report)
    assert graph.is_connected(target.vertices, target.edges)
