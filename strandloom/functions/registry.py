"""SQL functions for sessions: temporary SQL functions, so that the planner sees through them (section 2.L)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .strings import _FROM, _TO

_FUNCTIONS = (
    f"revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, '{_FROM}', '{_TO}'))",
    f"canonical_word(s STRING) RETURNS STRING RETURN least(s, reverse(translate(s, '{_FROM}', '{_TO}')))",
    "words(s STRING, w INT, step INT) RETURNS ARRAY<STRING> RETURN CASE WHEN length(s) >= w THEN transform(sequence(0, length(s) - w, step), i -> substring(s, i + 1, w)) ELSE CAST(array() AS ARRAY<STRING>) END",
    "probe_words(s STRING, w INT, j INT) RETURNS ARRAY<STRING> RETURN CASE WHEN length(s) >= w THEN array_distinct(flatten(transform(sequence(0, CAST(floor((length(s) - w) / 2) AS INT), j), i -> array(substring(s, i + 1, w), substring(s, length(s) - w - i + 1, w))))) ELSE CAST(array() AS ARRAY<STRING>) END",
    "edit_distance_banded(a STRING, b STRING, band INT) RETURNS INT RETURN levenshtein(lower(a), lower(b), band)",
    "gc_share(s STRING) RETURNS DOUBLE RETURN CASE WHEN regexp_count(s, '[ACGTacgt]') > 0 THEN regexp_count(s, '[GCgc]') / regexp_count(s, '[ACGTacgt]') END",
)
_TABLES = (
    "word_rows(s STRING, w INT, step INT) RETURNS TABLE (pos INT, word STRING) RETURN SELECT i, substring(s, i + 1, w) FROM (SELECT explode(CASE WHEN length(s) >= w THEN sequence(0, length(s) - w, step) ELSE CAST(array() AS ARRAY<INT>) END) AS i)",
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for body in (*_FUNCTIONS, *_TABLES):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return [body.split("(")[0] for body in (*_FUNCTIONS, *_TABLES)]
