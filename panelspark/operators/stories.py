"""News: payloads to rows, deduplication, aggregation by period, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import is_bearish, is_bullish, published_timestamp, to_double, topics
from panelspark.operators.windows import first_per_key

# The schema of the story table.
STORY_COLUMNS = ["ticker", "date", "time_published", "title", "summary", "source", "source_domain", "category_within_source", "url", "overall_sentiment_score", "overall_sentiment_label", "ticker_relevance_score", "ticker_sentiment_score", "ticker_sentiment_label", "authors_json", "topics_json", "banner_image"]


def story_rows(payload: DataFrame) -> DataFrame:
    """payload (feed: array of articles) -> one row for each article and mentioned ticker; articles without time and mentions without ticker are left out, as are times that don't parse (see ``bad_stories``)."""
    article = payload.select(F.explode("feed").alias("a")).select("a.*")
    mention = article.withColumn("m", F.explode("ticker_sentiment")).withColumn("at", published_timestamp("time_published"))
    kept = mention.where(F.col("at").isNotNull() & (F.coalesce(F.col("m.ticker"), F.lit("")) != ""))
    return kept.select(
        F.col("m.ticker").alias("ticker"), F.date_format("at", "yyyy-MM-dd").alias("date"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("time_published"),
        "title", "summary", "source", "source_domain", "category_within_source", "url", to_double("overall_sentiment_score").alias("overall_sentiment_score"), "overall_sentiment_label",
        to_double("m.relevance_score").alias("ticker_relevance_score"), to_double("m.ticker_sentiment_score").alias("ticker_sentiment_score"), F.col("m.ticker_sentiment_label").alias("ticker_sentiment_label"),
        F.to_json(F.coalesce("authors", F.array().cast("array<string>"))).alias("authors_json"), F.to_json("topics").alias("topics_json"), "banner_image",
    )


def bad_stories(payload: DataFrame) -> DataFrame:
    """The articles whose time is there but doesn't parse."""
    article = payload.select(F.explode("feed").alias("a")).select("a.*")
    return article.where((F.coalesce("time_published", F.lit("")) != "") & published_timestamp("time_published").isNull())


def deduplicate_stories(stories: DataFrame, order: str | None = None) -> DataFrame:
    """The first row for each (ticker, time_published, url), by ``order`` or by all columns."""
    keys = ["ticker", "time_published", "url"]
    return first_per_key(stories, keys, *([order] if order else [c for c in stories.columns if c not in keys]))


def aggregate_stories(stories: DataFrame, period: str = "time_range", key: str = "ticker", date: str = "date") -> DataFrame:
    """By key and period: number of stories, three means, bullish, bearish and neutral counts, bullish to bearish ratio, last date."""
    label = "overall_sentiment_label"
    up, down = is_bullish(label), is_bearish(label)
    out = stories.groupBy(key, period).agg(
        F.max(date).alias("story_date"), F.count("*").alias("story_count"),
        F.avg("overall_sentiment_score").alias("overall_sentiment_mean"), F.avg("ticker_sentiment_score").alias("ticker_sentiment_mean"), F.avg("ticker_relevance_score").alias("ticker_relevance_mean"),
        F.count_if(up).alias("bullish_count"), F.count_if(down).alias("bearish_count"), F.count_if(~up & ~down).alias("neutral_count"),
    )
    return out.withColumn("bullish_bearish_ratio", F.col("bullish_count") / (F.col("bearish_count") + 1e-8))


def topic_relevance(stories: DataFrame, period: str = "time_range", key: str = "ticker", topics_json: str = "topics_json") -> DataFrame:
    """Long form (key, period, topic, relevance): the mean over all stories of the period, 0 for stories without the topic; the last of a story's repeated topics counts."""
    listed = stories.select(key, period, topics(topics_json).alias("_l"))  # a column of its own: parsed once
    last = F.filter("_l", lambda t, i: ~F.exists(F.slice("_l", i + 2, F.size("_l")), lambda u: u["topic"] == t["topic"]))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("topic"), F.lit(0.0).alias("score")))  # counts the story
    each = listed.select(key, period, F.explode(F.concat(itself, last)).alias("t")).select(key, period, "t.topic", "t.score")
    sums = each.groupBy(key, period, "topic").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    stories_ = F.max(F.when(F.col("topic").isNull(), F.col("n"))).over(Window.partitionBy(key, period))
    return sums.select(key, period, "topic", (F.col("total") / stories_).alias("relevance")).where("topic is not null")


def distinct_names(df: DataFrame, name: str, most: int = 1000) -> list[str]:
    """The distinct values of a column that is to become columns; an error if there are over ``most``."""
    names = [r[0] for r in df.select(name).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{name} has over {most} values, too many for columns")
    return sorted(names)


def widen(df: DataFrame, keys: list[str], name: str, value: str, names: list[str] | None = None, prefix: str = "", fill: float | None = None) -> DataFrame:
    """One column for each name. The list of names is taken from the data if it isn't given: names are few (topics, indicators)."""
    names = distinct_names(df, name) if names is None else names
    wide = df.groupBy(*keys).pivot(name, names).agg(F.first(value))
    wide = wide.select(*keys, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])
    return wide.fillna(fill) if fill is not None else wide


def story_features(stories: DataFrame, names: list[str] | None = None, period: str = "time_range", key: str = "ticker") -> DataFrame:
    """Aggregates with one topic_relevance_* column for each topic, 0 where a period has none of it."""
    wide = widen(topic_relevance(stories, period, key), [key, period], "topic", "relevance", names, "topic_relevance_")
    out = aggregate_stories(stories, period, key).join(wide, [key, period], "left")
    return out.fillna(0.0, subset=[c for c in out.columns if c.startswith("topic_relevance_")])
