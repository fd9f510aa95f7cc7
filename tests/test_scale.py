"""What queries move, hold and give where there is more of it: copies of rows, long texts, many files."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandloom.functions import strings
from strandloom.operators import intervals, profile, recruit, report, words
from strandloom.sources import annotations, sequences


def shuffled(spark, run) -> int:
    """Rows that the stages of a run write to shuffles."""
    sc = spark.sparkContext
    jvm = sc._gateway.jvm
    store = sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def _quota(texts, seeds, quota):
    """Best remainders by relaxing until nothing gets better."""
    best = {w: quota for w in seeds}
    changed = True
    while changed:
        changed = False
        for ws in texts.values():
            for p, w in enumerate(ws):
                for i, v in enumerate(ws):
                    d = best.get(w, 0) - abs(p - i)
                    if d > best.get(v, 0):
                        best[v], changed = d, True
    return sorted((k, max(best.get(w, 0) for w in ws)) for k, ws in texts.items() if any(w in best for w in ws))


def test_quota_does_not_shuffle_the_words(spark):
    rng = random.Random(5)
    texts = {i: [rng.randrange(400) for _ in range(30)] for i in range(40)}
    texts |= {100 + i: [1000 + 100 * i + k for k in range(100)] for i in range(40)}
    df = spark.createDataFrame([(k, i, w) for k, ws in texts.items() for i, w in enumerate(ws)], "id long, pos int, word long")
    seeds = spark.createDataFrame([(texts[0][3],), (texts[1][7],)], "word long")
    assert rows(recruit.recruit_quota(df, seeds, 6)) == sorted(_quota(texts, [texts[0][3], texts[1][7]], 6), key=str)
    arrays = spark.createDataFrame(list(texts.items()), "id long, ws array<long>")
    assert rows(recruit.quota_of_arrays(arrays, seeds, 1)) == sorted(_quota(texts, [texts[0][3], texts[1][7]], 1), key=str)
    assert shuffled(spark, lambda: recruit.quota_of_arrays(arrays, seeds, 1).collect()) < 200 < sum(map(len, texts.values()))


def _mirrored(s, least):
    """Blocks that occur mirrored: (start1, start2, len), by trying all pairs."""
    out = set()
    for line in range(2 * len(s)):
        run = 0
        for a in range(line // 2 + 2):
            b = line - a
            equal = a <= b and b + least <= len(s) and s[a : a + least] == s[b : b + least][::-1]
            if equal:
                run += 1
            elif run:
                out.add((a - run, line - a + 1, run + least - 1))
                run = 0
    return out


@pytest.mark.parametrize("inverted", [False, True])
def test_repeats_of_many_texts(spark, inverted):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice(("ab", "ba", "aab", "c", "é€")) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, "a" * 70), (61, "a" * 70), (62, None)]
    df = spark.createDataFrame(texts, "id int, s string")
    got = rows(words.exact_repeats(df, "id", F.col("s"), 5, inverted, "reverse"), "id", "start1", "start2", "len")

    def direct(s):
        equal = {(a, b) for a in range(len(s) - 4) for b in range(a + 1, len(s) - 4) if s[a : a + 5] == s[b : b + 5]}
        return {(a, b, next(k for k in range(1, 99) if (a + k, b + k) not in equal) + 4) for a, b in equal if (a - 1, b - 1) not in equal}

    assert got == sorted([(i, *x) for i, s in texts if s for x in (_mirrored(s, 5) if inverted else direct(s))], key=str)


def test_repeats_shuffle_texts_and_not_their_words(spark):
    df = spark.createDataFrame([(i, "=" * 3000 + str(i)) for i in range(3)], "id int, s string")
    for inverted in (False, True):
        assert shuffled(spark, lambda inverted=inverted: words.exact_repeats(df, "id", F.col("s"), 12, inverted, "reverse").count()) < 50


def test_small_ranges_share_a_task(tmp_path):
    text = "".join(f"@r{i}\n{'ACGT' * 5}\n+\n{'I' * 20}\n" for i in range(2000))
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text(text)
    reader = sequences.FastqReader(StructType.fromDDL("file_id INT, name STRING"), {"path": f"{tmp_path}/a.fq,{tmp_path}/b.fq", "rangebytes": "500"})
    parts = reader.partitions()
    assert len(parts) < 4
    assert [r for p in parts for r in reader.read(p)] == [(f, f"r{i}") for f in (0, 1) for i in range(2000)]


def test_values_apart_by_just_the_factor(spark):
    values = [v / 100 for k in range(1, 500) for v in (k * 7, k * 70)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    want = [(a, b) for a, x in enumerate(values) for b, y in enumerate(values) if a < b and abs(math.log(x) - math.log(y)) > math.log(10)]
    assert rows(report.far_apart(df, "i", "v")) == sorted(want, key=str)


def test_best_of_cross_equals_all_pairs(spark):
    rng = random.Random(2)
    data = [(rng.randrange(6), rng.randrange(30), float(rng.choice((1, 2, 3, 5, 8, 13)) if k else rng.choice((-1, 0, 2)))) for k in (0, *[1] * 8) for _ in range(15)]
    data = [(k + 10 if s <= 0 else k, i, s) for k, i, s in data]
    a, b = spark.createDataFrame(data, "k int, i int, s double"), spark.createDataFrame(data[5:] + [(10, 1, 4.0), (0, 99, 5.0)], "k int, i int, s double")
    best = {}
    for k, i, x in data:
        for k2, j, y in b.collect():
            if k == k2 and i != j:
                best[i] = max(best.get(i, -math.inf), min(x, y) / max(x, y) if max(x, y) else -math.inf)
    got = {r["a"]: -math.inf if r["best_ratio"] is None else r["best_ratio"] for r in report.best_of_cross(a, b, "k", "i", "i", "s", 0.9).collect()}
    assert got == pytest.approx(best)


def test_best_of_cross_compares_neighbours(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), "id", (F.col("id") + 1.0).alias("s"))
    plan = report.best_of_cross(df, df, "k", "id", "id", "s", 0.9)
    assert plan.count() == 3000 and shuffled(spark, plan.collect) < 60_000


def test_pairs_are_compared_by_distinct_values(spark):
    df = spark.range(400).select(F.lit(1).alias("k"), "id", (F.col("id") % 4 + 1.0).alias("v"), F.concat(F.lit("name"), (F.col("id") % 3).cast("string")).alias("s"))
    got = report.theta_pairs(df, "k", "id", "v", 0.6).agg(F.count("*"), F.sum("a"), F.sum("ratio")).first()
    want = [(a, (a % 4 + 1) / (b % 4 + 1)) for a in range(400) for b in range(400) if (a % 4 + 1) / (b % 4 + 1) < 0.6]
    assert tuple(got) == (len(want), sum(a for a, _ in want), pytest.approx(sum(r for _, r in want)))
    near = words.word_distance_within(df, ["k"], "id", F.col("s"), lambda s: strings.substrings(s, 2))
    # two names of five characters differ in one pair of four
    apart = sum(a % 3 != b % 3 for a in range(400) for b in range(a))
    assert tuple(near.agg(F.count("*"), F.sum("dist")).first()) == (400 * 399 // 2, pytest.approx(apart / 4))
    assert shuffled(spark, near.count) < 1000


def test_links_of_texts_are_counted_over_all_rows(spark):
    names = ["red bolt", "red volt", "blue gear", "blue gears", "something else", None]
    data = [(i, names[i % 6]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, s string")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in words.near_texts(df, "id", "s", 1, block=2).collect()}
    near = {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert got == {i: (i, 0) if i % 6 == 5 else (near[i % 6], 9 if i % 6 == 4 else 19) for i in range(60)}


def test_recruit_keeps_one_word_of_a_passage(spark):
    passages = {p: [1000 * p + i for i in range(200)] for p in range(4)}
    data = [(i, w) for i, ps in enumerate([(0,), (0, 1), (1, 2), (3,), (3,)]) for p in ps for w in passages[p]]
    df = spark.createDataFrame(data, "id long, word long")
    seeds = spark.createDataFrame([(3,), (-1,)], "word long")
    assert rows(recruit.recruit(df, df, seeds)) == [(0, 1), (1, 1), (2, 2)]
    assert shuffled(spark, lambda: recruit.recruit(df, df, seeds).collect()) < 2 * len(data)
    assert rows(recruit.pregroup(df)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]


def test_tasks_read_logs_and_records(spark, tmp_path):
    df = spark.createDataFrame([(f"run{i}", f"x Round {i}: a") for i in range(30)], "sample string, value string")
    annotations.write_logs(df, f"file:{tmp_path}/logs")
    assert rows(annotations.read_logs(spark, f"file:{tmp_path}/logs/*/*.txt", {"n": ("last", "Round ([0-9]+)")})) == sorted(((f"run{i}", str(i)) for i in range(30)), key=str)
    (tmp_path / "x.gb").write_text("".join(f"LOCUS       rec{i}\nORIGIN\n        1 acgt\n//\n" for i in range(1200)))
    found = annotations.read_genbank(spark, str(tmp_path / "x.gb"))[1]
    assert "BinaryFile" not in found._jdf.queryExecution().toString() and found.distinct().count() == 1200


def test_trimmed_range_is_not_one_task_a_key(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 977 + 1.0).alias("x"), (F.col("id") % 5 + 1.0).alias("w")).repartition(4)
    got = profile.weight_trimmed_range(df, ["k"], F.col("x"), F.col("w"), ["id"])
    data = sorted((i % 977 + 1.0, i, i % 5 + 1.0) for i in range(20_000))
    total, upto, kept = sum(x * w for x, _, w in data), 0.0, []
    for x, _, w in data:
        upto += x * w
        if upto > total * 0.1 and upto - x * w < total * 0.6:
            kept.append((x, w))
    assert got.first()["mean"] == pytest.approx(sum(x * w for x, w in kept) / sum(w for _, w in kept))
    assert shuffled(spark, got.collect) < 1000


def test_gaps_are_one_window(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 20, 22), ("b", 4, 4)], "k string, lo long, hi long")
    got = intervals.gaps(df, ["k"], F.lit(0), F.lit(30))
    assert rows(got) == sorted([("a", 0, 0, 1), ("a", 10, 19, 10), ("a", 23, 30, 8), ("b", 0, 3, 4), ("b", 5, 30, 26)], key=str)
    assert str(got._jdf.queryExecution().optimizedPlan().toString()).count("Window") == 1
