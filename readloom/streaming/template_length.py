"""Template length of a stream of pairs, by event-time window with a watermark.

The batch form is operators.pairing.template_size; the stream keeps count, sum and sum of squares per window, which merge
exactly, and drops state once the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_template_size(pairs: DataFrame, ts: str = "ts", value: str = "template_length", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(begin, n, mean, sd) per window; works on a static and on a streaming DataFrame."""
    held = pairs.withWatermark(ts, late) if pairs.isStreaming else pairs
    by = held.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd")
    )
    return by.select(F.col("w.start").alias("begin"), "n", "mean", "sd")
