"""The pipeline against a brute-force version of its stages."""

from collections import Counter

import duckdb
import sentencepiece
from test_dedup import jaccard_groups

import corpus_pipeline
from strandloom.llm import pieces, sql


def test_run_equals_brute_force(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    c.execute(f"CREATE TABLE q AS WITH {sql.QUALITY_CTE.format(docs='documents')} SELECT doc_id, text, lang, source, n_chars FROM kept")
    c.execute(f"CREATE TABLE l AS WITH {sql.LINES_CTE.format(docs='q')} SELECT doc_id, c.text, lang, source FROM q JOIN clean c USING (doc_id) WHERE n_removed = 0 OR regexp_matches(c.text, '\\S')")
    groups = jaccard_groups(c.sql("SELECT doc_id, text FROM l").fetchall(), 0.55)
    c.execute("CREATE TABLE gone (doc_id BIGINT)")
    if gone := [(i,) for i, g in groups.items() if i != g]:
        c.executemany("INSERT INTO gone VALUES (?)", gone)
    c.execute("CREATE TABLE d AS SELECT * FROM l WHERE doc_id NOT IN (SELECT doc_id FROM gone)")
    mixed = c.sql(f"WITH {sql.MIXING_CTE.format(docs='d')} SELECT doc_id, text FROM mixed").fetchall()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = Counter((i, tuple(sp.encode(t))) for i, t in mixed)
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["exact"] for r in got)


def test_stages_keep_columns_and_take_odd_tables(spark, sf, tmp_path):
    rows = [(None, "no id\nat all", None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "text here", "en", None, 9), (3, "text here", "en", None, 9), (4, "long " * 60_000, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{name}-{docs.count()}".replace(" ", "_"))
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)


def test_near_dedup_keeps_other_texts_of_an_id(spark, sf):
    a = " ".join(f"word{k}" for k in range(40))
    b = " ".join(f"other{k}" for k in range(40))
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, a + " more", "en", "s", 1), (None, a, None, None, None), (4, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "lone text", "en", "s", 1), (5, "lone text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, a), (4, None), (4, ""), (5, "lone text"), (5, "lone text")], key=str)


def test_stages_values_and_clashing_columns(spark, sf):
    """Each stage's rows, with columns whose names the operators use inside and of types without an order."""
    boiler = "the same license line everywhere"
    rows = [(i, f"{boiler}\nown words of text number {i} " + " ".join(f"q{i}x{k}" for k in range(30)), "en", f"s{i % 6}", 9, "k", i, 7, {"a": i}) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, id long, group_id int, m map<string,int>")
    stage = dict(corpus_pipeline.STAGES)
    passed = stage["quality rules"](spark, docs, sf)
    assert passed.columns == docs.columns and passed.count() == 12
    clean = stage["line dedup"](spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in clean if boiler in r["text"]) == [0] and all(r["n_chars"] == len(r["text"]) for r in clean if r["doc_id"])
    assert sorted(r["doc_id"] for r in stage["MinHash near-dedup"](spark, docs, sf).collect()) == list(range(12))
    mixed = stage["source mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(range(12))
    assert sorted(r["doc_id"] for r in stage["SentencePiece encoding"](spark, docs, sf).where("exact").collect()) == list(range(12))
