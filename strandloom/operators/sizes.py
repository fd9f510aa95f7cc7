"""Join sides whose size is known before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import ensure_checkpoint_dir

_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
#: Bytes that a fixed-width row takes in a hash relation, by column, with its key.
_PER_COLUMN, _PER_ROW = 8, 24


def broadcast_limit(spark) -> int:
    """The session's broadcast threshold in bytes (negative: never)."""
    said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    digits = said.rstrip("bkmg")
    return int(digits) * _UNITS.get(said[len(digits) :] or "b", 1)


def small_side(df: DataFrame) -> DataFrame:
    """df, written and counted; hinted for broadcast only where its rows fit the session's threshold.

    For tables of fixed-width columns.  Beyond the threshold the join shuffles both sides.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    size = df.count() * (_PER_ROW + _PER_COLUMN * len(df.columns))
    return F.broadcast(df) if size <= broadcast_limit(df.sparkSession) else df
