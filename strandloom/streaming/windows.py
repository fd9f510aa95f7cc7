"""Windows of event time, in batch and on streams (section 2.K, extensions).

Each function takes a batch or a streaming table; with a watermark the stream's state
is bounded by time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window


def _late(events: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    if not (watermark and events.isStreaming):
        return events
    # watermarks need a time with a zone
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def tumbling(events: DataFrame, width: str, ts: str = "ts", key: str = "event_type", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(window_start, key, n, total) by windows side by side."""
    by = _late(events, ts, watermark).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts", key: str = "event_type", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(window_start, key, n, total) by windows that begin at every step."""
    by = _late(events, ts, watermark).groupBy(F.window(ts, width, step).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, ts: str = "ts", key: str = "user_id", watermark: str | None = None) -> DataFrame:
    """(key, session_start, n): stretches without a pause of at least the gap."""
    by = _late(events, ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select(key, F.col("w.start").alias("session_start"), "n")


def first_in_bucket(events: DataFrame, keys: list[str], width: str, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The first row of each key in each window (batch)."""
    w = Window.partitionBy(*keys, F.window(ts, width)).orderBy(ts, id_col)
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup(events: DataFrame, keys: list[str], watermark: str, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The first row of each key, and each later one that comes more than the watermark after the one kept before it.

    On a stream, state lives no longer than the watermark. In batch, rows go by time, then by
    id_col; a key's times are one array, folded in the JVM.
    """
    if events.isStreaming:
        return _late(events, ts, watermark).dropDuplicatesWithinWatermark(keys)
    at = F.struct(F.col(ts).alias("t"), F.col(id_col).alias("i"))
    none = F.array().cast(f"array<struct<t:{dict(events.dtypes)[ts]},i:{dict(events.dtypes)[id_col]}>>")
    late = F.expr(f"INTERVAL {watermark}")
    keep = lambda a, x: F.when((F.size(a) == 0) | (x["t"] > F.element_at(a, -1)["t"] + late), F.array_append(a, x)).otherwise(a)
    kept = events.groupBy(*keys).agg(F.array_sort(F.collect_list(at)).alias("__all")).select(F.explode(F.aggregate("__all", none, keep)).alias("__k"))
    return events.join(kept.select(F.col("__k.i").alias(id_col)), id_col, "left_semi").select(*events.columns)


def probe_stream(rows: DataFrame, vocabulary: DataFrame, words: str, id_cols: list[str], watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows of a stream with a word of a fixed vocabulary, each once: a stream-static semi-join.

    rows: words is the name of an array column. A row's hits are one row by its id_cols; on
    a stream that takes a watermark, or state for every row that hit.
    """
    probed = _late(rows, ts, watermark).withColumn("word", F.explode(F.array_distinct(words)))
    hit = probed.join(vocabulary.select("word").distinct(), "word", "left_semi")
    if rows.isStreaming and watermark:
        return hit.dropDuplicatesWithinWatermark(id_cols).select(*id_cols)
    return hit.select(*id_cols).dropDuplicates()


def quiet_gaps(events: DataFrame, seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, gap_lo, gap_hi) of a stream: pauses of more than so many seconds between a key's neighbouring events.

    State is one time a key. Events of a micro-batch are put in order; one that comes after
    a later one of its key has been seen, in another micro-batch, is passed over.
    """
    kind = dict(events.dtypes)[key]

    def update(k, parts, state: GroupState):
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        times = np.sort(np.concatenate([p[ts].to_numpy("datetime64[us]") for p in parts]))
        times = times if last is None else times[times >= last.to_datetime64()]
        if len(times):
            seen = times if last is None else np.append(last.to_datetime64().astype("datetime64[us]"), times)
            wide = np.flatnonzero(np.diff(seen) > np.timedelta64(seconds, "s"))
            state.update((int(times[-1].astype("int64")),))
            yield pd.DataFrame({key: [k[0]] * len(wide), "gap_lo": seen[wide], "gap_hi": seen[wide + 1]})

    at = events.select(key, F.col(ts).cast("timestamp_ntz").alias(ts))
    return at.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, gap_lo timestamp_ntz, gap_hi timestamp_ntz", "last long", "append", "NoTimeout")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of text lines from files that appear in a folder."""
    return spark.readStream.text(folder)
