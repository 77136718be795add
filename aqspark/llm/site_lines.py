"""Boilerplate lines by their frequency within a site.

For every host the pages that hold a line are divided by all pages of the host; lines above a ratio
are dropped from that host's pages. Pages with the same text count as one, so that mere copies do not
make their lines boilerplate. The ratio decides, for small hosts too; ``least_pages`` pages make a line repeated at
all, as two may be near copies of each other.

Lines are compared without the spaces around them; blank lines stay. Null texts stay null, and pages without
a host are left as they are, being of no one site. A page of nothing but boilerplate ends with an
empty text. Repeated rows are treated alike. All columns are kept; working columns avoid their names.

Only DataFrame operations run. The lines dropped from one host are few by arithmetic, less than the mean number
of lines of its pages divided by the ratio, so they travel as one array per host. Only the table of
hosts may grow: it is broadcast if small, else joined by a shuffle in which a large host may be split.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import fresh, written

# lines in a table of hosts that may be broadcast: 8 bytes each
BROADCAST_LINES = 1_000_000


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float, least_pages: int) -> DataFrame:
    """(host, lines): keys of the lines to drop, one row per host that has some."""
    keys = F.array_distinct(F.transform(F.filter(lines_of(text), lambda l: F.trim(l) != ""), line_key))
    distinct = (pages.where(host.isNotNull() & text.isNotNull())
                .select(host.alias("host"), F.xxhash64(text).alias("page"), keys.alias("keys"))
                .dropDuplicates(["host", "page"]))
    distinct = written(distinct, "site-pages")
    totals = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (distinct.select("host", F.explode("keys").alias("line")).groupBy("host", "line")
              .agg(F.count("*").alias("n")).where(F.col("n") >= least_pages))
    often = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return written(often.groupBy("host").agg(F.collect_set("line").alias("lines")), "site-boilerplate")


def drop_boilerplate(pages: DataFrame, host: Column, ratio: float = 0.1, least_pages: int = 3,
                     text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """All rows and columns, with the boilerplate lines of their host taken out of the text.

    ``counts`` names two more columns: lines before, and lines dropped (null text: 0).
    """
    own, dropped, kept = fresh(pages, "site", "site_lines", "kept_lines")
    text = F.col(f"`{text_col}`")
    found = boilerplate(pages, host, text, ratio, least_pages)
    if (found.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES:
        found = F.broadcast(found)
    found = found.select(F.col("host").alias(own), F.col("lines").alias(dropped))
    joined = pages.withColumn(own, host).join(found, own, "left")
    rest = F.filter(lines_of(text), lambda l: (F.trim(l) == "") | ~F.array_contains(F.col(dropped), line_key(l)))
    joined = joined.withColumn(kept, F.when(F.col(dropped).isNotNull(), rest))
    out = [F.coalesce(F.array_join(F.col(kept), "\n"), text).alias(c) if c == text_col else F.col(f"`{c}`")
           for c in pages.columns]
    if counts:
        before = F.coalesce(F.size(lines_of(text)), F.lit(0))
        before = F.when(text.isNull(), 0).otherwise(before)
        out += [before.cast("long").alias(counts[0]),
                F.when(F.col(kept).isNull(), 0).otherwise(before - F.size(kept)).cast("long").alias(counts[1])]
    return joined.select(*out)
