"""Articles → news signals of every city and hour, or the same table from the calendar alone.

    spark-submit --py-files aqspark.zip aqspark/jobs/build_news.py --start DAY --end DAY --out DIR [--articles DIR] [--append]

The hours run from the start of the first day to the last hour of the last one. With ``--append`` the hours that the table at
``--out`` does not hold yet are added to it.
"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aqspark.plans.news import calendar_news_table, news_hours
from aqspark.sources import dims, readers, writers
from aqspark.storage import configure, scratch


def run(spark, args):
    first = F.lit(args.start).cast("timestamp")
    last = F.lit(args.end).cast("timestamp") + F.expr("INTERVAL 23 HOURS")
    cities = dims.news_cities(spark)
    if args.articles:
        news = news_hours(readers.read_articles(spark, args.articles), cities, first, last)
    else:
        news = calendar_news_table(cities, first, last)
    with scratch(spark):
        if args.append:
            writers.append_hours(news, args.out, keys=("city", "timestamp"))
        else:
            writers.write_dataset(news, args.out)


def arguments(argv=None):
    p = argparse.ArgumentParser()
    for name in ("--start", "--end", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--articles")
    p.add_argument("--append", action="store_true")
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("build-news").getOrCreate()), arguments())
