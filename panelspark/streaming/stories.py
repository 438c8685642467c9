"""Story aggregation over a stream: the batch aggregates by window, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import is_bearish, is_bullish


def story_stream(stories: DataFrame, time: str = "published", key: str = "ticker", lateness: str = "2 hours", window: str = "1 day", unique: list[str] = ("ticker", "published", "url")) -> DataFrame:
    """(window start, key) -> counts and means, each story once; rows later than ``lateness`` are left out. Works on batches, too."""
    once = stories.withWatermark(time, lateness)
    once = once.dropDuplicatesWithinWatermark(list(unique)) if stories.isStreaming else once.dropDuplicates(list(unique))
    up, down = is_bullish("overall_sentiment_label"), is_bearish("overall_sentiment_label")
    out = once.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("story_count"), F.avg("overall_sentiment_score").alias("overall_sentiment_mean"), F.count_if(up).alias("bullish_count"), F.count_if(down).alias("bearish_count"))
    return out.select(F.col("w.start").alias("window_start"), key, "story_count", "overall_sentiment_mean", "bullish_count", "bearish_count")
