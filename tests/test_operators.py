import itertools
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandloom.functions import strings
from strandloom.operators import cluster, components, graph, intervals, paths, planning, profile, recruit, report, solve, words

# ---- words and recruit ----------------------------------------------------


def test_consensus(spark):
    df = spark.createDataFrame([("k", "ACG"), ("k", "ATG")], "key string, s string")
    assert rows(words.consensus_text(words.consensus(df, "key", F.col("s")), "key")) == [("k", "AYG")]


def _recruit_rows(spark):
    r = spark.createDataFrame([(1, "ACCGG"), (2, "CGGTT"), (3, "TTTTT")], "id long, s string")
    return words.word_table(r, "id", strings.substrings(F.col("s"), 3)), spark.createDataFrame([("AACC",)], "s string").select(F.explode(strings.substrings(F.col("s"), 3)).alias("word"))


def test_recruit_by_supersteps(spark):
    w, seeds = _recruit_rows(spark)
    assert rows(recruit.recruit(w, w, seeds)) == [(1, 1), (2, 2)]
    assert rows(recruit.recruit(w, w, seeds, max_supersteps=1)) == [(1, 1)]
    assert rows(recruit.superstep_counts(recruit.recruit(w, w, seeds))) == [(1, 1, 1), (2, 1, 2)]


def test_recruit_of_rows_over_both_strands(spark):
    r = spark.createDataFrame([(1, "ACCGG"), (2, "CGGTT"), (3, "TTTTT"), (4, "GGTTA")], "row_id long, s string")
    seeds = spark.createDataFrame([("AACC",)], "s string")
    assert rows(recruit.recruit_rows(r, seeds, 3, 1, 1)) == [(1, 1), (2, 2), (4, 3)]
    assert rows(recruit.recruit_rows(r, seeds, 3, 1, 1, "revcomp")) == [(1, 1), (2, 1), (4, 1)]


def test_recruit_excludes_and_groups(spark):
    w, seeds = _recruit_rows(spark)
    assert rows(recruit.recruit(w, w, seeds, exclude=spark.createDataFrame([(1,)], "id long"))) == []
    groups = spark.createDataFrame([(1, 1), (3, 1)], "id long, group_id long")
    assert rows(recruit.recruit(w, w, seeds, groups=groups)) == [(1, 1), (2, 2), (3, 1)]
    assert rows(recruit.recruit(w, w, seeds, max_words=1)) == [(1, 1)]


def test_recruit_grows_with_seeds(spark):
    rng = random.Random(3)
    data = [(i, "".join(rng.choice("AC") for _ in range(9))) for i in range(30)]
    w = words.word_table(spark.createDataFrame(data, "id long, s string"), "id", strings.substrings(F.col("s"), 6))
    few = spark.createDataFrame([(data[0][1][:6],)], "word string")
    more = few.union(spark.createDataFrame([(data[9][1][:6],)], "word string"))
    a, b = ({r[0] for r in recruit.recruit(w, w, s).select("id").collect()} for s in (few, more))
    assert 0 in a and a <= b


def test_quota_wears_off(spark):
    w = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcdef")] + [(2, i, x) for i, x in enumerate("xyzd")] + [(3, 0, "x")], "id long, pos int, word string")
    got = dict(rows(recruit.recruit_quota(w, spark.createDataFrame([("a",)], "word string"), 5)))
    assert got == {1: 5, 2: 2}  # d is 3 from a, so 2 are left; z gets 1, y nothing
    assert 3 not in got


def test_repeats_direct_and_inverted(spark):
    df = spark.createDataFrame([(1, "ACGTTxxACGTT"), (2, "AAGGxqzCCTT")], "id long, s string")
    assert rows(words.exact_repeats(df, "id", F.col("s"), 4)) == [(1, 0, 7, 5)]
    inverted = rows(words.exact_repeats(df.where("id = 2"), "id", F.col("s"), 4, inverted=True))
    assert inverted == [(2, 0, 7, 4)]
    arch = words.architecture(words.exact_repeats(df.where("id = 2"), "id", F.col("s"), 4, inverted=True), df.select("id", F.length("s").alias("n")), "id")
    assert rows(arch) == [(1, None, None, None, "no repeat"), (2, 3, 0, 4, "four parts")]


def test_isomers_have_one_layout(spark):
    rc = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rng = random.Random(4)
    outer, inner, repeat = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (30, 12, 20))
    made = [(o + repeat + i + rc(repeat), len(o)) for o in (outer, rc(outer)) for i in (inner, rc(inner))]
    made += [(rc(t), 0) for t, _ in made]
    data = []
    for k, (t, _) in enumerate(made):
        at = min(p for p in range(len(t) - 19) if rc(t[p : p + 20]) in t[p + 20 :] and len(t[p : p + 20]) == 20)
        data.append((k, t, at, t.index(rc(t[at : at + 20]), at + 20)))
    df = spark.createDataFrame(data, "k int, s string, a int, b int")
    assert df.select(words.canonical_layout(F.col("s"), F.col("a"), F.col("b"), F.lit(20)).alias("x")).distinct().count() == 1


def test_word_distance_is_zero_for_equal_texts(spark):
    p = spark.createDataFrame([(1, 2, "abab", "abab"), (1, 3, "abab", "cdcd")], "a int, b int, x string, y string")
    got = {r["b"]: r["dist"] for r in words.word_distance(p, strings.substrings(F.col("x"), 2), strings.substrings(F.col("y"), 2)).collect()}
    assert got == {2: 0.0, 3: 1.0}


# ---- profiles -------------------------------------------------------------


def test_band_of_one_to_hundred(spark):
    df = spark.range(1, 101).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"))
    assert rows(profile.band_profile(df, ["k"], F.col("x"), 0.06)) == [(1, 92.59, 94.0, 95.41)]


def test_dedup_of_reverse_complements(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, "AACG"), (3, "CGTT")], "id long, s string")
    assert rows(profile.dedup_clusters(df, "id", strings.canonical(F.col("s")))) == [(1, 1), (2, 2)]


def test_weighted_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "x double, w double").withColumn("k", F.lit(0))
    assert rows(profile.weighted_mean_std(df, ["k"], F.col("x"), F.col("w"))) == [(0, 2.5, np.sqrt(0.75))]
    assert rows(profile.weighted_mean_std(df, [], F.col("x"), F.col("w"))) == [(2.5, np.sqrt(0.75))]


def test_quality_profile_and_parts(spark):
    counts = profile.char_counts(spark.createDataFrame([(1, "IIII##")], "k int, q string"), ["k"], F.col("q"))
    found = profile.char_profile(counts, ["k"], "A")
    assert rows(profile.encoding_of(found, ["k"])) == [(1, "sanger", 33)]
    assert rows(profile.trim_characters(counts, ["k"], 0.4, least_score=5)) == [(1, "#")]
    parts = spark.createDataFrame([("ACGTACGTAC", "IIII##IIII")], "s string, q string").select(profile.quality_parts(F.col("s"), F.col("q"), "#", 3).alias("p"))
    assert parts.first()["p"] == ["ACGT", "GTAC"]


def test_every_kth_needs_no_single_task(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "x")
    assert [r[0] for r in rows(profile.every_kth(df, 25, ["x"]))] == [100, 25, 50, 75]


def test_planning_scalars():
    asked = []

    def measure(n):
        asked.append(n)
        return n / 10_000, n / 1_000_000

    assert planning.rows_needed(measure, 100, 10**6, [1_000_000, 500_000], 50) == [500_000, 250_000] and asked == [100, 500, 2500, 12_500, 62_500]
    assert planning.rows_needed(lambda n: (0.1, n / 1000), 100, 77, [1000], 50) == [77]
    assert planning.rows_needed(lambda n: (6.0, 0.5), 100, 10**6, [1000], 50) == [10**6]


@pytest.mark.parametrize(("coverage", "length", "size", "error"), [(30, 100, 150_000, 0.0), (30, 100, 150_000, 0.015), (100, 150, 150_000, 0.015), (500, 150, 16_000, 0.01), (8, 100, 150_000, 0.015), (2, 100, 390_000, 0.0), (60, 250, 390_000, 0.002), (150, 150, 10_000, 0.03), (12, 76, 16_000, 0.015), (1000, 300, 150_000, 0.001)])
def test_word_sizes_step_by_step(coverage, length, size, error):
    """The model's words, one condition after another and with plain loops."""
    wanted = min(60, coverage * 0.35)
    floor = 5.0
    while 1 - (1 - math.exp(-floor)) ** size > 0.01:
        floor += 0.05
    floor = min(floor, coverage * (1 - 48 / length))
    wanted = max(floor, wanted)
    e = error / 2
    if e:
        wrong = sum((1 - 2.0**-k) * math.comb(length, k) * e**k * (1 - e) ** (length - k) for k in range(1, int(min(length * e * 10, length))))
        more = wanted / (1 - wrong) - wanted
        half = coverage / 2
        wanted = wanted + more**0.34 if wanted > half else half + (wanted + more - half) ** 0.34 if wanted + more > half else wanted + more
    assert planning.word_size(coverage, length, size, error) == min(int(length * 0.75), max(49, int(length * (1 - wanted / coverage)) + 1))


def test_parameters_of_several_targets():
    a = planning.Measured(1000.0, 900.0, 1100.0, 150_000, 150_000, 0.04, (400, 100))
    b = planning.Measured(2000.0, 2000.0, 2000.0, 16_000, 16_000, 0.5, (9000,))
    got = planning.resolve_parameters([a, b], [10_001], 150, 150)
    assert got["rows"] == [5000] and got["coverage"] == [500, 1000] and got["word_size"] == min(planning.word_size(500, 150, 150_000), planning.word_size(1000, 150, 16_000))
    assert got["max_extend"] == [math.ceil(200 * 1.2 * (1 + 0.1**0.5) / 100) * 100, math.inf] and not got["divergent"]
    assert planning.resolve_parameters([b], [5], 150, 150)["max_extend"] == [math.inf] and planning.reach(a, 150, 100) == 500
    assert planning.resolve_parameters([a], [5], 100, 100, word=0.5)["word_size"] == 50 and planning.word_size_of_ratio(0.1, 100) == 29 and planning.word_size_of_ratio(99, 100) == 90


def _blocks(s, least, inverted, circular, allowed=None):
    """Maximal blocks by comparing every place with every other one."""
    n = len(s)
    flip = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = set()
    at = (lambda i: s[i % n]) if circular else (lambda i: s[i] if 0 <= i < n else None)
    rc = {c: flip[n - 1 - i] for i, c in enumerate(s)}
    good = lambda c: c is not None and (allowed is None or c in allowed)
    for i in range(n):
        for j in range(n):
            if not inverted:
                if i == j or (not circular and i > j):
                    continue
                same = lambda k: good(at(i + k)) and at(i + k) == at(j + k)
                if same(-1) and (circular or i > 0):
                    continue
                k = 0
                while k < n and same(k):
                    k += 1
                if k >= least:
                    out.add((min(i, j), max(i, j), k))
            else:
                # a block from i on, whose partner ends at j and is read backwards
                same = lambda k: good(at(i + k)) and at(j - k) is not None and at(i + k) == rc[at(j - k)]
                if same(-1):
                    continue
                k = 0
                while k < n and same(k):
                    k += 1
                if k >= least:
                    out.add((min(i, (j - k + 1) % n), max(i, (j - k + 1) % n), k))
    return out


@pytest.mark.parametrize(("inverted", "circular"), [(False, False), (True, True), (False, True)])
def test_repeats_equal_brute_force(spark, inverted, circular):
    rng = random.Random(4)
    texts = []
    for i in range(12):
        block = "".join(rng.choice("ACGT") for _ in range(9))
        other = block[::-1].translate(str.maketrans("ACGT", "TGCA"))
        texts.append((i, "".join(rng.choice((block, other, *["".join(rng.choice("ACGT") for _ in range(6))] * 2)) for _ in range(6))))
    texts += [(90, "ACG"), (91, ""), (92, None), (93, "ACGTAACGGT" * 3 + "TT")]
    df = spark.createDataFrame(texts, "id int, s string")
    got = {(r["id"], r["start1"], r["start2"], r["len"]) for r in words.exact_repeats(df, "id", F.col("s"), 7, inverted, circular=circular).collect()}
    want = {(i, *x) for i, s in texts if s and len(s) >= 7 for x in _blocks(s, 7, inverted, circular)}
    assert got == want and len(want) > 10


def test_repeats_of_an_alphabet(spark):
    s = "ACGTACNACGTACTTTTNNNACGTACN" + "GGNGG" + "ACGTACN"
    df = spark.createDataFrame([(1, s)], "id int, s string")
    got = {(r["start1"], r["start2"], r["len"]) for r in words.exact_repeats(df, "id", F.col("s"), 5, alphabet="ACGT").collect()}
    assert got == _blocks(s, 5, False, False, "ACGT") and (0, 7, 6) in got


# ---- intervals ------------------------------------------------------------


def _iv(spark, data):
    return spark.createDataFrame([(1, *d) for d in data], "k int, lo long, hi long, score double")


def test_merge_and_union(spark):
    df = _iv(spark, [(1, 5, 90.0), (5, 8, 95.0), (9, 12, 80.0)])
    merged = intervals.merge(df, ["k"], score="score")
    assert rows(merged, "lo", "hi", "score") == [(1, 8, 95.0), (9, 12, 80.0)]
    assert rows(intervals.merge(merged, ["k"], score="score")) == rows(merged)
    assert rows(intervals.union_length(df, ["k"])) == [(1, 12)]


def test_priority_trim(spark):
    assert rows(intervals.priority_trim(_iv(spark, [(1, 10, 90.0), (5, 12, 95.0)]), ["k"])) == [(1, 1120.0)]
    assert rows(intervals.priority_trim(_iv(spark, [(1, 10, 95.0), (5, 12, 90.0)]), ["k"])) == [(1, 950.0 + 180.0)]


def test_depth_sums_to_lengths(spark):
    data = [(1, 4, 0.0), (3, 8, 0.0), (20, 22, 0.0)]
    runs = intervals.depth(_iv(spark, data), ["k"])
    assert rows(intervals.depth_positions(runs, ["k"]), "pos", "depth")[:2] == [(1, 1), (2, 1)]
    assert runs.agg(F.sum(F.col("depth") * (F.col("hi") - F.col("lo") + 1))).first()[0] == sum(b - a + 1 for a, b, _ in data)


def test_gaps_linear_and_circular(spark):
    df = _iv(spark, [(3, 3, 0.0), (5, 5, 0.0)])
    linear = intervals.gaps(df, ["k"], F.lit(1), F.lit(6))
    assert sorted(r["gap_len"] for r in linear.collect()) == [1, 1, 2]
    circular = intervals.gaps(df, ["k"], F.lit(1), F.lit(6), circular=True)
    assert sorted(r["gap_len"] for r in circular.collect()) == [1, 3]


def test_folding(spark):
    df = spark.createDataFrame([(8, 11), (2, 3), (0, 30)], "lo long, hi long")
    assert rows(intervals.fold_circular(df, "lo", "hi", F.lit(10))) == [(0, 1), (0, 9), (2, 3), (8, 9)]


def test_runs_and_blocks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabba")], "k int, i int, v string")
    assert rows(intervals.collapse_runs(df, ["k"], ["i"], "v")) == [(1, 1, "a", 2), (1, 2, "b", 2), (1, 3, "a", 1)]
    b = spark.createDataFrame([("q", 1, 5, "s"), ("q", 1, 9, "t"), ("q", 4, 9, "u")], "k string, lo int, hi int, t string")
    assert rows(intervals.extreme_blocks(b, ["k"], "lo", "hi", "t")) == [("q", "t", "first"), ("q", "t", "last")]


def test_circular_band_join_equals_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.randrange(100)) for i in range(40)]
    b = [(i, rng.randrange(100)) for i in range(40)]
    got = intervals.circular_pairs(spark.createDataFrame(a, "a long, p long"), spark.createDataFrame(b, "b long, p long"), "a", "b", "p", 100, 7)
    assert rows(got) == sorted(((i, j, (q - p) % 100) for (i, p), (j, q) in itertools.product(a, b) if (q - p) % 100 <= 7), key=str)


def test_best_identity_and_offsets(spark):
    h = spark.createDataFrame([("q", 1, 2, 90.0, 4), ("q", 2, 3, 80.0, 4)], "k string, lo int, hi int, pid double, len int")
    assert rows(intervals.mean_best(h, ["k"], "lo", "hi", "pid", "len", 50.0)) == [("q", 65.0)]
    assert rows(intervals.offsets(h, ["k"], "len")) == [("q", 0, 1)]


# ---- graphs ---------------------------------------------------------------


def test_components_in_any_order(spark):
    e = [("a", "b"), ("b", "c"), ("d", "e"), ("x", "x"), (None, "a")]
    want = [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("x", "x")]
    for order in (e, e[::-1]):
        assert rows(components.connected_components(spark.createDataFrame(order, "u string, v string"))) == want
    assert rows(components.connected_components(spark.createDataFrame([], "u string, v string"))) == []


V = "v string, len long, cov double, seq string"
E = "v1 string, e1 boolean, v2 string, e2 boolean, overlap int"


def test_contraction(spark):
    v = spark.createDataFrame([("a", 10, 4.0, "AAAAAAACGT"), ("b", 7, 8.0, "CGTTTTT")], V)
    e = graph.symmetric(spark.createDataFrame([("a", True, "b", False, 3)], E))
    nv, ne = graph.contract(v, e)
    r = nv.first()
    assert (r["len"], round(r["cov"], 6), r["seq"]) == (14, round(72 / 13, 6), "AAAAAAACGTTTTT")
    assert nv.count() == 1 and ne.isEmpty()


def test_bounded_reach(spark):
    v = spark.createDataFrame([("A", 5, 1.0, ""), ("B", 6, 1.0, ""), ("C", 9, 1.0, "")], V)
    e = graph.symmetric(spark.createDataFrame([("A", True, "B", False, 2), ("B", True, "C", False, 2)], E))
    baits = spark.createDataFrame([("A", 10.0)], "node string, quota double")
    assert rows(graph.bounded_reach(baits, graph.reach_costs(v, e))) == [("A", 10.0), ("B", 6.0)]
    nv, ne = graph.reduce_to_reach(v, e, baits)
    assert rows(nv, "v") == [("A",), ("B",)] and ne.count() == 2


def test_baseline(spark):
    v = spark.createDataFrame([("a", 100, 10.0), ("b", 100, 30.0)], "v string, len long, cov double")
    depth, out = graph.baseline(v)
    assert round(depth, 4) == 13.3333 and rows(out, "v", "copy") == [("a", 1), ("b", 2)]


def test_tags_spread_between(spark):
    n = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", False)], "node string, tagged boolean")
    one = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert rows(graph.tag_between(n, one.union(one.select("b", "a")))) == [("a", True), ("b", True), ("c", True), ("d", False)]


def test_kmer_graph_round_trip(spark):
    text = "ACGTTGCAACTGGA"
    nodes, links = graph.kmer_graph(spark.createDataFrame([(text,)], "s string"), F.col("s"), 5)
    found = graph.contigs(nodes, links)
    assert rows(found, "contig", "circular") == [(text, False)]
    ring = graph.contigs(*graph.kmer_graph(spark.createDataFrame([("ACGTTGCA",)], "s string"), F.col("s"), 5, circular=F.lit(True)))
    r = ring.first()
    assert r["circular"] and r["len"] == 8 and r["contig"] in "ACGTTGCA" * 2


def test_rename_remove_and_degrees(spark):
    v = spark.createDataFrame([("a", 1, 1.0, "A"), ("b", 1, 1.0, "C")], V)
    e = graph.symmetric(spark.createDataFrame([("a", True, "b", False, 0)], E))
    nv, ne = graph.rename_vertices(v, e, spark.createDataFrame([("a", "z")], "v string, name string"))
    assert rows(nv, "v") == [("b",), ("z",)] and ("z", True, "b", False) in rows(ne, "v1", "e1", "v2", "e2")
    nv, ne = graph.remove_vertices(v, e, spark.createDataFrame([("a",)], "v string"))
    assert rows(nv, "v") == [("b",)] and ne.isEmpty()
    assert rows(graph.degrees(v, e), "v", "heads", "tails", "terminal") == [("a", 0, 1, True), ("b", 1, 0, True)]
    assert not graph.is_connected(v, e.limit(0)) and graph.is_connected(v, e)


def test_purify_and_bridge(spark):
    v = spark.createDataFrame([("a", 10, 1.0, "A" * 10), ("b", 10, 100.0, "C" * 10)], V)
    hits = spark.createDataFrame([("a", "b", 1, 9)], "query string, subject string, qlo long, qhi long")
    assert rows(graph.purify(v, hits), "v") == [("b",)]
    part = graph.purify(v, hits.withColumn("qhi", F.lit(4).cast("long")), mask=True)
    assert rows(part, "v", "seq") == [("a", "NNNNAAAAAA"), ("b", "C" * 10)]
    ends = spark.createDataFrame([("a", True, 95, True), ("b", False, 2, False), ("a", False, 40, False)], "v string, e boolean, pos long, opens boolean")
    new = graph.bridges(ends, 100, 10, spark.createDataFrame([], "a string, b string"))
    assert rows(new, "v1", "e1", "v2", "e2", "gap", "name") == [("a", True, "b", False, 7, "gap_a_b")]
    gv, ge = graph.gap_vertices(new)
    assert rows(gv, "v", "len", "seq") == [("gap_a_b", 7, "N" * 7)] and ge.count() == 4


def test_scaffolds_bridge_open_ends(spark):
    v = spark.createDataFrame([("a", 4, 1.0, "AAAA"), ("b", 4, 1.0, "CCCC"), ("c", 4, 1.0, "GGGG")], V)
    e = spark.createDataFrame([("b", True, "c", False, 0)], E)
    way = "node string, sub_path int, path array<struct<v:string,fwd:boolean>>"
    s = spark.createDataFrame([("n", 0, [("a", True)]), ("n", 1, [("b", True), ("c", True)]), ("n'", 0, [("c", False), ("b", False)]), ("n'", 1, [("a", False)]), ("m", 0, [("b", True)]), ("m", 1, [("zz", True)])], way)
    assert graph.scaffold_jumps(s).count() == 3
    nv, ne = graph.bridge_with_scaffolds(v, e, s, gap=3)
    assert rows(nv, "v", "seq") == [("a", "AAAA"), ("b", "CCCC"), ("c", "GGGG"), ("gap_a_b", "NNN")]
    assert rows(graph.clusters(nv, ne), "component") == [("a",)] * 4 and ne.count() == 6


def test_circles_of_a_four_part_graph(spark):
    e = [("L", True, "R", False), ("R", True, "S", False), ("S", True, "R", True), ("R", False, "L", False)]
    assert len(paths.circular_paths({"L": 1, "R": 2, "S": 1}, e)) == 2
    assert solve.multiplicities({"L": 1.1, "R": 2.3, "S": 0.9}, solve.flow_balances(["L", "R", "S"], e)) == {"L": 1, "R": 2, "S": 1}
    assert paths.is_sequential_repeat("r", [("a", True, "r", False), ("r", True, "b", False), ("r", True, "x", False), ("x", True, "r", False)])
    assert paths.all_paths({"a": 1, "b": 1}, [("a", True, "b", False)]) == [((("a", True), ("b", True)),)]


def test_solver_equals_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        target = {v: rng.uniform(0.5, 3) for v in "abc"}
        balance = [(["a", "b"], ["c"])]
        got = solve.multiplicities(target, balance)
        top = 4 * int(np.ceil(max(target.values()) / min(target.values())))
        best = min((sum((x - target[v]) ** 2 for v, x in zip("abc", xs)), xs) for xs in itertools.product(range(1, top + 1), repeat=3) if xs[0] + xs[1] == xs[2])[1]
        g = np.gcd.reduce(best)
        assert [got[v] for v in "abc"] == [x // g for x in best]


def test_path_text(spark):
    v = spark.createDataFrame([("a", 5, 1.0, "AACGT"), ("b", 5, 1.0, "GTCCA")], V)
    e = spark.createDataFrame([("a", True, "b", False, 2)], E)
    p = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", True), (2, 0, "b", False), (2, 1, "a", False)], "path_id int, nth int, v string, fwd boolean")
    assert rows(graph.path_text(p, v, e)) == [(1, "AACGTCCA", False), (2, "TGGACGTT", False)]


def test_mixture_finds_two_levels(spark):
    x = np.array([100.0, 101, 99, 10, 11, 9])
    label = cluster.cluster_bic(x, np.ones(6))
    assert len(set(label[:3])) == 1 and label[0] != label[3]
    df = spark.createDataFrame([("k", i, float(v), 1.0) for i, v in enumerate(x)], "k string, id int, x double, w double")
    got = {r["id"]: r["label"] for r in cluster.cluster_groups(df, ["k"], "id", "x", "w").collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] == got[5] != 0
    v = spark.createDataFrame([("t", "a", 10, 100.0, 5.0), ("t", "b", 10, 101.0, 0.0), ("t", "c", 10, 1.0, 0.0)], "key string, v string, len long, cov double, weight double")
    assert rows(cluster.filter_by_depth(v, "key")) == [("a", True), ("b", True), ("c", False)]


# ---- reports --------------------------------------------------------------


def test_pairing(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(report.pair_sides(a, b, "k")) == [(1, "left"), (2, "both"), (3, "right")]
    assert rows(report.missing_both_ways(a, b, "k")) == [(1, "not in b"), (3, "not in a")]


def test_choices(spark):
    c = spark.createDataFrame([("k", 5, 1, 1), ("k", 9, 2, 2), ("k", 7, 1, 3)], "k string, len int, n_missing int, nth int")
    assert [rows(report.choose_copy(c, ["k"], m), "nth")[0][0] for m in ("first", "longest", "leastN", "leastN_longest")] == [1, 2, 1, 3]
    assert report.choose_copy(c, ["k"], "all").count() == 3
    s = spark.createDataFrame([("a", 9.0, 1.0), ("b", 1.0, 9.0), ("c", 2.0, 2.0), ("d", 0.0, None)], "v string, i double, e double")
    assert rows(report.arbitrate(s, "v", "i", "e")) == [("a", "include"), ("b", "exclude"), ("c", "ambiguous"), ("d", "none")]
    ids = spark.createDataFrame([(i,) for i in range(4)], "id int")
    assert rows(report.choose(ids, "id", ids.where("id < 2"), ids.where("id < 1"), include_first=False)) == [(1,)]
    assert rows(report.choose(ids, "id", ids.where("id < 2"), ids.where("id < 1"), include_first=True)) == [(0,), (1,)]
