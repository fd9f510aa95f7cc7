"""Substring and near-duplicate operators against brute force, and their odd inputs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import flat, minhash, repeats, rlz, suffix, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, id long, u long, pid int"


def table(spark, texts, extra=()):
    """Documents by id, with other columns whose names the operators use inside."""
    rows = [(i, t, None, None, None, "x", None, 7, 3) for i, t in texts] + [(None, "no id " * 60, "en", "s", 1, None, 1, 1, 1), *extra]
    return spark.createDataFrame(rows, DOCS)


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=0):
    rng = random.Random(seed)
    passage, other = text(rng, 60), text(rng, 55)
    docs = [(i, text(rng, rng.choice((5, 49, 50, 120, 300)))) for i in range(12)]
    docs += [(20, text(rng, 30) + " " + passage + " " + text(rng, 40)), (21, passage), (22, text(rng, 10) + "\n" + passage.replace(" ", "  ") + "\t" + other), (23, other + " " + other), (24, passage[1:])]
    docs += [(30, None), (31, ""), (32, "  \n "), (33, "one"), (34, text(rng, 4000) + " " + passage + " é ß 漢字"), (35, docs[3][1]), (35, docs[3][1]), (36, "a " * 200)]
    return docs


def repeated_windows(docs, length):
    places = defaultdict(set)
    for i, t in docs:
        w = re.split(r"[ \t\n\v\f\r\x1c-\x1f]+", (t or "").strip(" \t\n\v\f\r\x1c\x1d\x1e\x1f"))
        for s in range(len(w) - length + 1):
            places[tuple(w[s : s + length])].add((i, s))
    return [sorted(p) for p in places.values() if len(p) > 1]


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_runs_equal_brute_force(spark, seed):
    docs = corpus(seed)
    words = defaultdict(int)
    for group in repeated_windows(docs, 50):
        for n, (i, s) in enumerate(group):
            for k in range(s, s + 50):
                words[i, k] = max(words[i, k], 2 if n else 1)
    want = set()
    for (i, k), v in words.items():
        if words.get((i, k - 1)) != v:
            n = next(n for n in range(1, 10**6) if words.get((i, k + n)) != v)
            want.add((i, k, n, v == 1))
    got = [tuple(r) for r in suffix.suffix_array_dedup(table(spark, docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[0] for r in got} >= {20, 21, 22, 34, 35, 36}


def longest_parse(docs, length):
    """Greedy parse by comparing every place with every earlier one."""
    words = {i: re.split(r"[ \t\n\v\f\r\x1c-\x1f]+", (t or "").strip(" \t\n\v\f\r\x1c\x1d\x1e\x1f")) for i, t in docs}
    earlier = {place: group[:k] for group in repeated_windows(docs, length) for k, place in enumerate(group) if k}
    out = set()
    for i, w in words.items():
        least = 0
        for s in range(len(w)):
            if s < least or (i, s) not in earlier:
                continue

            def shared(r, q):
                v = words[r]
                return next((k for k in range(len(w) - s) if q + k >= len(v) or v[q + k] != w[s + k]), len(w) - s)

            n, r, q = max(((shared(r, q), r, q) for r, q in earlier[i, s]), key=lambda x: (x[0], -x[1], -x[2]))
            out.add((i, s, n, r, q))
            least = s + n - length + 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_factors_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = [tuple(r) for r in rlz.substring_dedup(table(spark, docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == longest_parse(docs, 50)


@pytest.mark.parametrize("seed", range(3))
def test_factors_of_edited_copies(spark, seed):
    """Copies with many edits, so that matches branch everywhere and end at all lengths, and periodic texts."""
    rng = random.Random(seed)
    base = text(rng, 500).split(" ")
    docs = []
    for i in range(40):
        lo = rng.randrange(200)
        docs.append((i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(50)}" for w in base[lo : lo + rng.randrange(60, 300)])))
    docs += [(90, "b " * 3000), (91, "c " + "b " * 700 + "d"), (92, "p q r " * 200), (93, "q r p " * 150)]
    docs += [(94, " ".join(base + base)), (95, docs[3][1])]
    got = [tuple(r) for r in rlz.substring_dedup(table(spark, docs), 11).collect()]
    want = longest_parse([d for d in docs if d[0] != 90], 11) if seed else None
    assert len(got) == len(set(got))
    if want is not None:
        got = [tuple(r) for r in rlz.substring_dedup(table(spark, [d for d in docs if d[0] != 90]), 11).collect()]
        assert set(got) == want
    else:
        assert [g for g in got if g[0] == 90] == [(90, 1, 2999, 90, 0)]


def test_a_factor_is_the_longest_match(spark):
    w = [f"w{i}" for i in range(110)]
    docs = [(1, " ".join(w[:55])), (2, " ".join(w)), (3, " ".join(w))]
    assert sorted(tuple(r) for r in rlz.substring_dedup(table(spark, docs)).collect()) == [(2, 0, 55, 1, 0), (3, 0, 110, 2, 0)]
    passage, rest = " ".join(w[:60]), [f"v{i}" for i in range(1000)]
    docs = [(1, passage), (5, " ".join([*rest[:400], passage, *rest[400:]]))]
    got = sorted(tuple(r) for r in rlz.substring_dedup(table(spark, [*docs, (9, docs[1][1])])).collect())
    assert got == [(5, 400, 60, 1, 0), (9, 0, 1060, 5, 0)]


def test_two_texts_under_one_id(spark):
    """They are two documents, also where a passage is at the same place in both."""
    passage = text(random.Random(3), 60)
    docs = [(1, passage + " a b c"), (1, passage + " d e f g")]
    assert [tuple(r) for r in rlz.substring_dedup(table(spark, docs)).collect()] == [(1, 0, 60, 1, 0)]
    assert {r["n_words"] for r in suffix.suffix_array_dedup(table(spark, docs)).collect()} == {60}


def test_lengths_narrow():
    low, high = np.array([1, 4, 4, 8, 100]), np.array([0, 8, 5, 16, 1000])
    steps = np.stack([rlz.lengths(low, high, s) for s in range(rlz.STEPS + 1)])
    assert (steps[0] == low).all() and (np.diff(steps, axis=0) >= 0).all() and (steps[:, 1:] < high[1:]).all()
    assert steps[1:4, 0].tolist() == [2, 4, 8] and set(steps[:, 3]) == set(range(8, 16))


def test_no_documents(spark):
    empty = table(spark, []).limit(0)
    assert suffix.suffix_array_dedup(empty).isEmpty() and rlz.substring_dedup(empty).isEmpty() and minhash.near_duplicate_groups(empty).isEmpty()


def test_other_lengths(spark):
    rng = random.Random(5)
    p = text(rng, 13)
    docs = [(1, "a b " + p), (2, p + " c"), (3, text(rng, 40))]
    assert sorted(tuple(r) for r in suffix.suffix_array_dedup(table(spark, docs), 11).collect()) == [(1, 2, 13, True), (2, 0, 13, False)]
    assert [tuple(r) for r in rlz.substring_dedup(table(spark, docs), 11).collect()] == [(2, 0, 13, 1, 2)]
    assert suffix.packing(50) == 10 and suffix.packing(11) == 11 and suffix.packing(27) == 3


def test_winnowing_never_misses(spark):
    rng = np.random.default_rng(0)
    for _ in range(30):
        shared = rng.integers(0, 1 << 60, 50).astype(np.uint64)
        picked = []
        for _ in range(2):
            h = np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64), shared, rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)])
            _, grams = repeats.winnow(h, np.array([0, len(h)]), np.zeros(len(h), int), 50, 20)
            picked.append(set(grams.tolist()))
        inside = flat.ranges_hash(shared, np.arange(31), np.arange(31) + 20)
        assert picked[0] & picked[1] & set(inside.tolist())


def test_merge_order_is_a_suffix_order():
    """The merged order of a small string is its suffix order, by nine symbols and more."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.integers(1, 3, 40).astype(np.uint32)
        pad = np.concatenate([x, np.zeros(60, np.uint32)])
        cls = (np.arange(40) % 3).astype(np.uint8)
        sample = np.flatnonzero(cls)
        order = sorted(sample, key=lambda i: tuple(pad[i : i + 40]))
        rank = np.zeros(103, dtype=np.uint64)
        rank[order] = np.arange(1, len(order) + 1)
        i = np.arange(40)
        got = suffix.merged(cls, x, np.where(cls == 1, 0, pad[i + 1]).astype(np.uint32), np.where(cls > 0, rank[i], 0).astype(np.uint64), rank[i + 1] * (cls != 2), rank[i + 2] * (cls != 1))
        assert got.tolist() == sorted(range(40), key=lambda i: tuple(pad[i : i + 41]))


# ---- MinHash --------------------------------------------------------------


def jaccard_groups(docs, threshold):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\s!-/:-@\[-`{-~]+", (t or "").lower())
        if w:
            sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {(w[0],)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    size = defaultdict(int)
    for i in sets:
        size[root(i)] += 1
    return {i: root(i) for i in sets if size[root(i)] > 1}


def near_corpus(seed=0):
    rng = random.Random(seed)
    docs, n = [], 0
    for _ in range(25):
        base = text(rng, rng.choice((20, 80, 300)), 5000).split(" ")
        for _ in range(rng.choice((1, 1, 2, 5))):
            copy = [w if rng.random() > 0.03 else f"x{rng.randrange(10**6)}" for w in base]
            docs.append((n, " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
            n += 1
    docs += [(900, None), (901, ""), (902, "!!! ..."), (903, "Été"), (904, "été!"), (905, text(rng, 30_000, 10**6)), (906, docs[0][1]), (906, docs[0][1])]
    return docs


def test_groups_equal_brute_force(spark):
    docs = near_corpus()
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicate_groups(table(spark, docs)).collect()}
    want = jaccard_groups(docs, 0.55)
    assert got == want and got[904] == 903 and 902 not in got


def test_recall_near_the_threshold(spark):
    """Groups of two documents at Jaccard similarities from 0.45 to 0.7: nearly all from 0.55 on, none below."""
    rng = random.Random(7)
    docs = []
    for k in range(700):
        base = text(rng, rng.choice((40, 120, 300)), 10**6).split(" ")
        share = rng.uniform(0.08, 0.18)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(w if rng.random() > share else f"x{rng.randrange(10**9)}" for w in base))]
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicate_groups(table(spark, docs)).collect()}
    sets = [set(zip(w, w[1:])) for w in (t.split(" ") for _, t in docs)]
    at = {k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(700)}
    for low, high in ((0.55, 0.6), (0.6, 0.7)):
        near = [k for k, j in at.items() if low <= j < high]
        assert len(near) > 50 and sum(2 * k + 1 in got for k in near) >= 0.95 * len(near)
    assert set(got) == {i for k, j in at.items() if j >= 0.55 and 2 * k + 1 in got for i in (2 * k, 2 * k + 1)}


def test_pairs_in_doubt_are_those_that_links_leaves():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 8, dtype=np.uint64)
    sketches = np.repeat(base[None], 40, axis=0)
    for row in sketches:
        for _ in range(rng.integers(0, 9)):
            row[rng.integers(0, 8)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    ids = rng.permutation(40)
    distance = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(axis=2)
    u, v = minhash.links(ids, sketches, 3)
    star = dict(zip(u.tolist(), v.tolist()))
    stands = {int(i): min(ids[k] for k in range(40) if distance[n, k] == 0) for n, i in enumerate(ids)}
    place = {int(i): n for n, i in enumerate(ids)}
    want = {frozenset((a, b)) for a in place for b in place if stands[a] == a and stands[b] == b and 3 < distance[place[a], place[b]] <= 9 and star.get(a, a) != star.get(b, b)}
    assert want and {frozenset(p) for p in zip(*(x.tolist() for x in minhash.doubtful(ids, sketches, 3, 9)))} == want


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for j in (0.6, 0.8, 0.95):
        same = int(4000 * j)
        a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        b = a.copy()
        b[same:] = rng.integers(0, 2**64, 4000 - same, dtype=np.uint64)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = minhash.samples(np.concatenate([a, b]), np.array([0, 4000]))
        d = int(np.bitwise_count(minhash.odd_sketch(s)[0] ^ minhash.odd_sketch(s)[1]).sum())
        assert abs(1 + minhash.BITS / (4 * minhash.BANDS * minhash.ROWS) * np.log(1 - 2 * d / minhash.BITS) - true) < 0.12


def test_links_are_all_pairs_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (3, 8), dtype=np.uint64)
    sketches = base[rng.integers(0, 3, 60)].copy()
    for row in sketches:
        for _ in range(rng.integers(0, 12)):
            row[rng.integers(0, 8)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    ids = np.arange(60) * 3
    distance = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(axis=2)
    label = np.arange(60)
    for _ in range(60):
        label = np.array([label[distance[i] <= 9].min() for i in range(60)])
    u, v = minhash.links(ids, sketches, 9)
    assert dict(zip(u.tolist(), v.tolist())) == {int(ids[i]): int(ids[label[i]]) for i in range(60) if label[i] != i}


# ---- embeddings -----------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, a long, x int"


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    v = np.concatenate([base, base[:60] + 0.08 * rng.standard_normal((60, 16)), base[:5], 3 * base[5:8]]).astype(np.float32)
    rows = [(i, x.tolist(), None, 1, 1) for i, x in enumerate(v)] + [(0, v[0].tolist(), 4, 2, 2)]
    odd = [(900, None, 1, 1, 1), (901, [0.0] * 16, 1, 1, 1), (902, [1.0, 2.0], 1, 1, 1), (903, [float("nan")] * 16, 1, 1, 1), (904, [], 1, 1, 1), (905, [None] + [1.0] * 15, 1, 1, 1), (None, v[0].tolist(), 1, 1, 1), (906, [float("inf")] * 16, 1, 1, 1)]
    got = {(r["vec_id_a"], r["vec_id_b"]): r["cosine"] for r in vectors.near_duplicate_pairs(spark.createDataFrame(rows + odd, VECTORS)).collect()}
    n = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cos = n @ n.T
    want = {(i, j): cos[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if cos[i, j] >= 0.95}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(abs(got[p] - want[p]) < 2e-6 for p in got)


def test_lengths_and_equal_vectors(spark):
    """Pairs are found among vectors of every length, and between all of a large group of equal ones."""
    rng = np.random.default_rng(5)
    rows, v = [], {}
    for dim in (4, 16, 33):
        base = rng.standard_normal((20, dim))
        for x in (*base, *(base[:6] + 0.03 * rng.standard_normal((6, dim))), *[base[7]] * 40, 2 * base[7]):
            v[len(v)] = x.tolist()
    v[900], v[901] = [1.0] * 16 + [float("nan")], [1.0] * 16 + [float("nan")]
    rows = [(i, x, None, 1, 1) for i, x in v.items()] + [(7, v[8], None, 1, 1)]
    got = {(r["vec_id_a"], r["vec_id_b"]) for r in vectors.near_duplicate_pairs(spark.createDataFrame(rows, VECTORS.replace("float", "double"))).collect()}
    held = [(i, np.array(x) / np.linalg.norm(x)) for i, x, *_ in rows]
    want = {(min(i, j), max(i, j)) for n, (i, x) in enumerate(held) for j, y in held[:n] if i != j and len(x) == len(y) and x @ y >= 0.95}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 2400


def brute_classes(held, threshold=0.95):
    """(id, class, links) of distinct (id, vector), each by comparing it with all others."""
    held = sorted(set(held), key=str)
    good = [np.array(x, float) if x and None not in x else np.zeros(1) for _, x in held]
    good = [x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None for x in good]
    near = [[j for j in range(len(held)) if i != j and x is not None and good[j] is not None and len(good[j]) == len(x) and x @ good[j] >= threshold] for i, x in enumerate(good)]
    label = {i: i for i, _ in held}
    for _ in held:
        before = dict(label)
        for i, js in enumerate(near):
            for j in js:
                a, b = held[i][0], held[j][0]
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return sorted((i, label[i], len(js)) for (i, _), js in zip(held, near))


def test_classes_equal_brute_force(spark):
    """Copies, chains of neighbours, two vectors under one id, and vectors that can't be compared."""
    rng = np.random.default_rng(7)
    rows = []
    for dim in (8, 24):
        base = rng.standard_normal((15, dim))
        chain = [base[14]]
        for _ in range(12):
            step = rng.standard_normal(dim)
            chain.append(chain[-1] + 0.2 * np.linalg.norm(chain[-1]) * step / np.linalg.norm(step))
        for x in (*base, *(base[:5] + 0.03 * rng.standard_normal((5, dim))), *[base[6]] * 30, 3 * base[6], *chain):
            rows.append((1000 - len(rows), tuple(x.tolist())))
    bridge = [(2000, rows[0][1]), (2000, rows[1][1]), (2000, rows[0][1]), (2001, rows[2][1]), (2001, tuple(2 * x for x in rows[2][1]))]
    nan = float("nan")
    odd = [(900_001, None), (900_002, None), (900_003, (0.0,) * 8), (900_004, (0.0,) * 8), (900_005, ()), (900_006, (None, 1.0)), (900_007, (float("inf"),) * 8), (3000, None), (3000, rows[3][1])]
    held = rows + bridge + odd
    df = spark.createDataFrame([(i, list(x) if x is not None else None, 1, 2, 3) for i, x in held + [(None, rows[0][1]), (900_008, (nan,) * 8), rows[5]]], VECTORS.replace("float", "double"))
    got = sorted(tuple(r) for r in vectors.near_duplicate_classes(df).collect())
    want = sorted(brute_classes(held) + [(900_008, 900_008, 0)])
    assert [g[0] for g in got] == [w[0] for w in want] and sum(w[2] for w in want) > 2000
    assert got == want


def test_classes_equal_sql(spark, sf):
    """The query's SQL over the table, and over copies of it that have links."""
    import duckdb

    from strandloom.llm import queries, sql

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.QUERIES["op3_embedding_near_dedup"](spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("class_id", "bigint"), ("n_links", "bigint")]
    want = c.sql(queries.ORACLE_SQL["op3_embedding_near_dedup"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == c.sql("SELECT count(DISTINCT vec_id) FROM embeddings").fetchall()[0][0]
    copies = "SELECT vec_id * 4 + k AS vec_id, list_transform(range(1, len(e) + 1), lambda i: (k + 1) * e[i] + k // 2 * 0.02 * e[i % len(e) + 1]) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), range(4) r(k)"
    want = c.sql(sql.CLASSES.format(vectors=copies)).fetchall()
    table = spark.createDataFrame(c.sql(copies).fetchall(), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.near_duplicate_classes(table).collect())
    assert got == sorted(want) and all(n == 3 and i // 4 * 4 == k for i, k, n in got)


def test_rows_of_classes_follow_the_input(spark):
    """A table of few vectors in many copies gives as many rows as it has, not all pairs."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3, 8)).tolist()
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.get(F.array(*[F.array(*map(F.lit, x)) for x in base]), F.col("id") % 3).alias("embedding"))
    got = vectors.near_duplicate_classes(df).groupBy("class_id", "n_links").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 999, 1000), (1, 999, 1000), (2, 999, 1000)]


def test_no_classes(spark):
    assert vectors.near_duplicate_classes(spark.createDataFrame([], VECTORS)).isEmpty()
    assert [tuple(r) for r in vectors.near_duplicate_classes(spark.createDataFrame([(1, None, 1, 1, 1)], VECTORS)).collect()] == [(1, 1, 0)]


def test_no_vectors(spark):
    assert vectors.near_duplicate_pairs(spark.createDataFrame([], VECTORS)).isEmpty()
    assert vectors.near_duplicate_pairs(spark.createDataFrame([(1, None, 1, 1, 1)], VECTORS)).isEmpty()


def test_collision_chance():
    rng = np.random.default_rng(0)
    d, w = 0.5, 1.0
    start = rng.random(200_000) * w
    same = np.floor(start / w) == np.floor((start + rng.standard_normal(200_000) * d) / w)
    assert abs(same.mean() - vectors.collision(d, w)) < 0.01
