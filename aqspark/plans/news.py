"""News signals per city and hour, from articles or from the calendar."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.calendar import calendar_news
from aqspark.functions.text import names_mentioned, news_score, with_words
from aqspark.operators.windows import densify_hours, hour_grid


def matched_articles(articles: DataFrame, signal_terms=None, city_terms=None) -> DataFrame:
    """One row (city, timestamp, signal) per signal and city an article mentions.

    Each text is split into words once and dropped before anything is shuffled.
    """
    signal_terms = signal_terms or fixed.SIGNAL_TERMS
    city_terms = city_terms or fixed.CITY_TERMS
    words = with_words(articles.select("timestamp", "text"), "text", signal_terms, city_terms)
    rows = words.select(
        "timestamp", names_mentioned("_words", "_opening", signal_terms).alias("_signals"),
        names_mentioned("_words", "_opening", city_terms).alias("_cities"))
    # plain explode would add a test on the arrays that searches the text once more
    return (rows.withColumn("signal", F.explode_outer("_signals"))
            .withColumn("city", F.explode_outer("_cities"))
            .select("city", "timestamp", "signal")
            .filter(F.col("signal").isNotNull() & F.col("city").isNotNull()))


def article_counts(matched: DataFrame, keys=("city",), signals=fixed.NEWS_SIGNALS) -> DataFrame:
    """Articles per key and hour, one column per signal; null where there are none."""
    hour = F.date_trunc("hour", "timestamp").alias("timestamp")
    return (matched.groupBy(*keys, hour).pivot("signal", list(signals))
            .agg(F.count(F.lit(1))))


def news_hours(articles: DataFrame, cities: DataFrame, start, end, signal_terms=None,
               city_terms=None) -> DataFrame:
    """Signal scores for every city and hour from ``start`` to ``end``; quiet hours are 0."""
    names = list(signal_terms or fixed.SIGNAL_TERMS)
    counts = article_counts(matched_articles(articles, signal_terms, city_terms),
                            signals=names)
    scores = counts.select("city", "timestamp", *[news_score(n).alias(n) for n in names])
    return densify_hours(scores, cities.select("city"), start, end)


def calendar_news_table(cities: DataFrame, start, end) -> DataFrame:
    """Calendar signals for every city (``city``, ``lat``) and hour."""
    hours = hour_grid(cities, start, end)
    return hours.withColumns(calendar_news("timestamp", "lat")).select(
        "city", "timestamp", *[F.col(c).cast("float").alias(c) for c in fixed.NEWS_SIGNALS])
