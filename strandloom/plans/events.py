"""Queries on events: intervals, depth, gaps, windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals
from ..streaming import windows
from ._register import Register, table

query = Register()

#: Seconds of an event's interval: 30 minutes.
_SPAN = 1800
_IV = f"iv AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + {_SPAN} AS hi, value AS score, event_type, event_id FROM events)"
_RUNS = """
g AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM iv),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM g),
m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, max(score) AS score FROM h GROUP BY user_id, run)
"""


def _seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = _seconds(F.col("ts"))
    return table(spark, sf_dir, "events").select("user_id", lo.alias("lo"), (lo + _SPAN).alias("hi"), F.col("value").alias("score"), "event_type", "event_id")


@query(f"WITH {_IV}, {_RUNS} SELECT user_id, lo, hi, score FROM m")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half hours after events, joined where they overlap, by user (F1)."""
    return intervals.merge(_intervals(spark, sf_dir), ["user_id"], score="score")


@query(f"WITH {_IV}, {_RUNS} SELECT user_id, CAST(sum(hi - lo + 1) AS BIGINT) AS covered FROM m GROUP BY user_id")
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that a user's half hours cover (F2)."""
    return intervals.union_length(_intervals(spark, sf_dir), ["user_id"])


@query(f"""
WITH RECURSIVE {_IV},
o AS (SELECT user_id, lo, hi, score, row_number() OVER (PARTITION BY user_id ORDER BY lo, hi, score) AS n FROM iv),
r(user_id, n, a, b, s, t) AS (
  SELECT user_id, n, lo, hi, score, 0.0::DOUBLE FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.n,
    CASE WHEN o.lo > b OR o.score >= s THEN o.lo WHEN o.hi > b THEN b + 1 ELSE a END,
    CASE WHEN o.lo > b OR o.score >= s OR o.hi > b THEN o.hi ELSE b END,
    CASE WHEN o.lo > b OR o.score >= s OR o.hi > b THEN o.score ELSE s END,
    t + CASE WHEN o.lo > b THEN CASE WHEN b >= a THEN s * (b - a + 1) ELSE 0 END WHEN o.score >= s THEN CASE WHEN o.lo - 1 >= a THEN s * (o.lo - a) ELSE 0 END WHEN o.hi > b THEN CASE WHEN b >= a THEN s * (b - a + 1) ELSE 0 END ELSE 0 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, round(t + CASE WHEN b >= a THEN s * (b - a + 1) ELSE 0 END, 2) AS score FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
""")
def interval_priority_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value by seconds, where overlaps go to the greater value."""
    return intervals.priority_trim(_intervals(spark, sf_dir), ["user_id"]).select("user_id", F.round("total", 2).alias("score"))


@query(f"""
WITH {_IV}, e AS (SELECT lo AS p, 1 AS d FROM iv UNION ALL SELECT hi + 1, -1 FROM iv), s AS (SELECT p, sum(d) AS d FROM e GROUP BY p),
r AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi, sum(d) OVER (ORDER BY p) AS depth FROM s)
SELECT lo // 86400 AS bin, CAST(count(*) AS BIGINT) AS runs, CAST(max(depth) AS BIGINT) AS depth FROM r WHERE depth > 0 GROUP BY lo // 86400
""")
def depth_per_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many half hours lie on each other, by the day on which a run begins.

    Depth is summed within days: events are cut at midnight first, so that days are the
    tasks' keys, and runs that go on over midnight are told apart by where they began.
    """
    day = 86400
    iv = _intervals(spark, sf_dir)
    events = iv.select(F.explode(F.array(F.struct(F.col("lo").alias("p"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("p"), F.lit(-1).alias("d")))).alias("e")).groupBy(F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d")).where("p IS NOT NULL")
    keyed = events.withColumn("bin", F.floor(F.col("p") / day))
    # one row for each day carries the depth at its begin
    start = keyed.groupBy("bin").agg(F.sum("d").alias("net")).withColumn("base", F.coalesce(F.sum("net").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    depth = keyed.join(start, "bin").withColumn("depth", F.col("base") + F.sum("d").over(within)).where("depth > 0")
    return depth.groupBy("bin").agg(F.count("*").alias("runs"), F.max("depth").alias("depth"))


@query(f"""
WITH {_IV}, {_RUNS}, n AS (SELECT user_id, hi + 1 AS a, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) - 1 AS b FROM m)
SELECT user_id, a AS lo, b AS hi, b - a + 1 AS gap_len FROM n WHERE b >= a
""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without an event in the last half hour, between a user's first and last."""
    iv = _intervals(spark, sf_dir)
    return intervals.gaps(iv, ["user_id"], F.col("lo"), F.col("hi"))


@query(f"""
WITH {_IV}, {_RUNS}, t AS (SELECT user_id, sum(hi - lo + 1) AS depth FROM iv GROUP BY user_id),
z AS (SELECT user_id, b - a + 1 AS g FROM (SELECT user_id, hi + 1 AS a, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) - 1 AS b FROM m) WHERE b >= a),
q AS (SELECT user_id, sum(g) AS g, list_sum(list_reverse_sort(list(g))[1:5]) AS top5 FROM z GROUP BY user_id),
l AS (SELECT user_id, max(hi) - min(lo) + 1 AS len FROM iv GROUP BY user_id)
SELECT user_id, CAST(depth AS BIGINT) AS total, CAST(coalesce(top5, 0) AS BIGINT) AS top5 FROM t LEFT JOIN q USING (user_id) JOIN l USING (user_id) ORDER BY depth DESC, coalesce(g, 0) / len, coalesce(top5, 0), user_id LIMIT 1
""")
def best_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user with most covered time and least gaps."""
    iv = _intervals(spark, sf_dir)
    gap_rows = intervals.gaps(iv, ["user_id"], F.col("lo"), F.col("hi"))
    length = iv.groupBy("user_id").agg((F.max("hi") - F.min("lo") + 1).alias("len"))
    return intervals.best_key(intervals.depth(iv, ["user_id"]), gap_rows, "user_id", length).select("user_id", "total", "top5")


@query("""
WITH v AS (SELECT CAST(ts AS DATE) AS day, user_id, sum(value) AS v FROM events GROUP BY ALL),
c AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY day) AS c FROM v),
k AS (SELECT day, count(*) FILTER (v > 100) AS k, count(*) FILTER (c > 100 AND c - v <= 100) AS n FROM c GROUP BY day)
SELECT day, round(k / 150, 6) AS round_cov, round(sum(n) OVER (ORDER BY day) / 150, 6) AS cum_cov FROM k
""")
def breadth_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of users over a value, day by day and so far (F8)."""
    out = intervals.breadth(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", "user_id", F.col("value"), 100.0, 150)
    return out.select("day", F.round("round_cov", 6).alias("round_cov"), F.round("cum_cov", 6).alias("cum_cov"))


@query("""
SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS bin, round(avg(value), 6) AS mean FROM events GROUP BY ALL
""")
def binned_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by user and hour."""
    rows = table(spark, sf_dir, "events").select("user_id", _seconds(F.col("ts")).alias("pos"), "value")
    return intervals.binned_mean(rows, ["user_id"], "pos", "value", 3600).select("user_id", "bin", F.round("mean", 6).alias("mean"))


@query(f"""
WITH {_IV}, c AS (SELECT user_id, lo, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
SELECT user_id, reach + 1 AS gap_lo, lo - 1 AS gap_hi, CAST(row_number() OVER (PARTITION BY user_id ORDER BY lo) AS INTEGER) AS nth FROM c WHERE lo > reach + 1
""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between a user's half hours, numbered."""
    return intervals.number_within(intervals.complement(_intervals(spark, sf_dir), ["user_id"]), ["user_id"], ["gap_lo"])


@query(f"""
WITH {_IV}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY lo, hi DESC) AS f, rank() OVER (PARTITION BY user_id ORDER BY hi DESC, lo) AS l FROM iv)
SELECT user_id, event_type, 'first' AS side FROM r WHERE f = 1 UNION ALL SELECT user_id, event_type, 'last' FROM r WHERE l = 1
""")
def extreme_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each user's first and last events."""
    return intervals.extreme_blocks(_intervals(spark, sf_dir), ["user_id"], "lo", "hi", "event_type")


@query(f"""
WITH {_IV}, l AS (SELECT user_id, max(hi) + 1000 AS len FROM iv GROUP BY user_id)
SELECT user_id, min(lo) - 1 AS head, max(len) - max(hi) AS tail FROM iv JOIN l USING (user_id) GROUP BY user_id
""")
def hull_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the hull of a user's half hours from both ends of an axis."""
    iv = _intervals(spark, sf_dir)
    length = iv.groupBy("user_id").agg((F.max("hi") + 1000).alias("len"))
    return intervals.offsets(iv.join(length, "user_id"), ["user_id"], "len")


@query("""
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM c)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, event_type, count(*) AS n FROM r GROUP BY ALL
""")
def run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of one type as one row (F16)."""
    return intervals.collapse_runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
WITH p AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS s FROM events)
SELECT a.event_id AS a, b.event_id AS b, ((b.s - a.s) % 86400 + 86400) % 86400 AS gap FROM p a JOIN p b ON ((b.s - a.s) % 86400 + 86400) % 86400 <= 30 WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase'
""")
def circular_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events within 30 seconds after a purchase on the clock, over midnight too."""
    p = table(spark, sf_dir, "events").select("event_id", "event_type", (_seconds(F.col("ts")) % 86400).alias("s"))
    return intervals.circular_pairs(p.where("event_type = 'purchase'"), p.where("event_type <> 'purchase'"), "event_id", "event_id", "s", 86400, 30)


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type; the same plan runs on a stream (extension)."""
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start, event_type, value FROM events, unnest(range(4)) u(k))
SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL
""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hours that begin every quarter (extension)."""
    return windows.sliding(table(spark, sf_dir, "events"), "1 hour", "15 minutes").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH c AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after two quiet hours (extension)."""
    return windows.sessions(table(spark, sf_dir, "events"), "2 hours")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts, event_id) = 1")
def first_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a user and type in each ten minutes (extension)."""
    return windows.first_in_bucket(table(spark, sf_dir, "events"), ["user_id", "event_type"], "10 minutes").select("event_id")


@query("""
WITH RECURSIVE nxt AS (SELECT e.user_id, e.event_type, e.event_id, e.ts, (SELECT min(struct_pack(t := f.ts, i := f.event_id)) FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND f.ts > e.ts + INTERVAL 6 HOUR) AS ahead FROM events e),
kept AS (SELECT event_id, ahead FROM nxt QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 UNION ALL SELECT nxt.event_id, nxt.ahead FROM kept JOIN nxt ON nxt.event_id = kept.ahead.i)
SELECT event_id FROM kept
""")
def dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type but for those within six hours of the one kept before (extension)."""
    return windows.dedup(table(spark, sf_dir, "events"), ["user_id", "event_type"], "6 hours").select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'click') OR user_id % 7 = 0")
def stream_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with one of the words asked for, each once; the same plan runs on a stream."""
    words = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")))
    vocabulary = spark.createDataFrame([("purchase",), ("click",), ("u0",)], "word STRING")
    return windows.probe_stream(table(spark, sf_dir, "events").withColumn("ws", words), vocabulary, "ws", ["event_id"])


@query("SELECT CAST(props ->> 'k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their properties (section 2.J)."""
    return table(spark, sf_dir, "events").groupBy(F.from_json("props", "k INT")["k"].alias("k")).agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = query.queries, query.sql
