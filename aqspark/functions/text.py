"""Names, labels and term matching."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqspark.functions.calendar import any_of
from aqspark.functions.scalars import as_col


def first_text(*columns) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(as_col(c), F.lit("")) for c in columns])


def city_label(locality, city) -> Column:
    return F.coalesce(first_text(locality, city), F.lit("Unknown"))


def station_slug(name, location_id) -> Column:
    """Readable key of at most 50 characters. Long names are cut and the id is always whole, so no two
    locations share a key."""
    location_id = as_col(location_id).cast("string")
    base = F.coalesce(first_text(name), F.concat(F.lit("loc_"), location_id))
    end = F.concat(F.lit("_"), location_id)
    cut = F.substring(F.translate(base, " ,", "_"), F.lit(1), F.lit(50) - F.length(end))
    return F.lower(F.concat(cut, end))


def is_pm25(parameter) -> Column:
    name = F.lower(F.coalesce(as_col(parameter), F.lit("")))
    return name.contains("pm25") | name.contains("pm2.5")


def is_pm25_archive(parameter) -> Column:
    """The looser archive rule: any character may stand between the digits."""
    return F.lower(as_col(parameter)).rlike("pm25|pm2.5")


def word_list(text) -> Column:
    """Lower-cased words of the whole text."""
    return F.split(F.lower(as_col(text)), "[^a-z0-9]+")


def _term_words(term: str) -> list[str]:
    return re.findall("[a-z0-9]+", term.lower())


def opening_words(words, *term_lists) -> Column:
    """Those of ``words`` (a ``word_list``) that any term begins with.

    One hash lookup per word, however many terms there are.
    """
    firsts = sorted({_term_words(t)[0] for terms in term_lists for t in terms})
    return F.array_intersect(as_col(words), F.array(*[F.lit(w) for w in firsts]))


def mentions(words, opening, terms) -> Column:
    """True if the text holds any of the terms, as whole words.

    Only texts with the first word of a longer term are searched for all of it.
    """
    def one(term):
        parts = _term_words(term)
        begun = F.array_contains(as_col(opening), parts[0])
        if len(parts) == 1:
            return begun
        whole = F.concat(F.lit(" "), F.array_join(as_col(words), " "), F.lit(" "))
        return begun & whole.contains(f" {' '.join(parts)} ")
    return any_of(one(t) for t in terms)


def names_mentioned(words, opening, terms_by_name) -> Column:
    """Names from ``{name: terms}`` of which the text holds any term, as an array."""
    return F.array_compact(F.array(
        *[F.when(mentions(words, opening, terms), F.lit(name))
          for name, terms in terms_by_name.items()]))


def with_words(df, text, *terms_by_name):
    """Add ``_words`` and ``_opening`` of a text column, each computed once per row."""
    lists = [terms for group in terms_by_name for terms in group.values()]
    return (df.withColumn("_words", word_list(text))
            .withColumn("_opening", opening_words("_words", *lists)))


def news_score(count) -> Column:
    """Three articles an hour are full strength; no count is no article."""
    articles = F.coalesce(as_col(count), F.lit(0))
    return F.least(articles / F.lit(3.0), F.lit(1.0))
