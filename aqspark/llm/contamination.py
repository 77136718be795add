"""Benchmark decontamination by winnowing.

Texts are compared in windows of ten words. Of every six consecutive hashes of five words (ten
words together) the smallest is kept as a fingerprint, on both sides by the same rule, so two texts that share
ten consecutive words share a fingerprint. Documents join the items by fingerprint; every place that
has a fingerprint in common is extended to the windows around it, and these are compared word by
word. So no shared window is lost, and none is found by a hash alone.

An item of fewer than ten words is one window. Where items have five to nine words, fewer hashes
stand behind each fingerprint, so that the guarantee covers their length; items of one to four words are
looked up at every place of the documents.

Words are runs of digits, letters with A-Z lower-cased, and all characters beyond ASCII. Fingerprints and
hits belong to a text, not to a row: copies are examined once, and repeated or null ids do no harm. Null and
empty texts have no words and are not contaminated; null items and items without a word have no window. An
item without an id marks words but is not listed. Other columns are ignored by ``contamination`` and
kept by ``without_contaminated``; working columns avoid their names.

Only DataFrame operations run. The items' fingerprints are broadcast only if they are few; beyond that both
sides are shuffled.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import fresh, written

WINDOW = 10
GRAM = 5
# rows of a table that may be broadcast: fingerprints of 8 bytes, or keys of texts of 16
BROADCAST_ROWS = 300_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NO_WORD), lambda w: w != "")


def grams(words: str, n: int) -> Column:
    """Hashes of every ``n`` consecutive words of an array column."""
    places = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(places, lambda _, i: F.xxhash64(F.slice(words, i + 1, F.lit(n))))


def winnowed(hashes: str, width: int) -> Column:
    """The smallest of every ``width`` consecutive hashes of an array column; of all, if there are fewer."""
    if width == 1:
        return F.array_distinct(hashes)
    windows = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(1)))
    return F.array_distinct(F.transform(
        windows, lambda h, i: F.least(h, *[F.get(F.col(hashes), i + k) for k in range(1, width)])))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, window): every window of every item, as its words joined by a space."""
    rows = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    rows = rows.withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    places = F.slice("words", F.lit(1), F.size("words") - F.col("n") + 1)
    windows = F.transform(places, lambda _, i: F.array_join(F.slice("words", i + 1, F.col("n")), " "))
    return rows.select("item", "n", F.explode(windows).alias("window"))


def fingerprints(rows: DataFrame, width: int, short: list[int]) -> DataFrame:
    """Add ``prints``: winnowed hashes of ``GRAM`` words, and all hashes of each shorter length in ``short``.

    ``rows`` has the array column ``words``. Hashes of different lengths are told apart by the words they cover.
    """
    lengths = ([GRAM] if width else []) + short
    for n in lengths:
        rows = rows.withColumn(f"grams{n}", grams("words", n))
    parts = [winnowed(f"grams{n}", width if n == GRAM else 1) for n in lengths]
    both = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast("array<bigint>")
    return rows.withColumn("prints", both).drop(*[f"grams{n}" for n in lengths])


def _few(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the (written) table has few enough rows (of a hash or a digest)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def text_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What is contaminated, by text.

    Returns (rows, hits): ``rows`` has the columns of ``keep``, ``text_key`` and ``n_words`` of every document row;
    ``hits`` has one row per contaminated text: ``text_key``, ``n_hit``, ``items`` (sorted ids as strings) and
    ``spans`` (first word and number of words of each window found).
    """
    windows = written(item_windows(items, item_id, item_text).distinct(), "item-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    # a shorter rule covers longer windows too
    long = [n for n in lengths if n >= GRAM]
    width = min(long) - GRAM + 1 if long else 0
    short = [n for n in lengths if n < GRAM]

    kept = [F.col(f"`{c}`") for c in keep or []]
    words = docs.select(*kept, _key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    rows = written(fingerprints(words.withColumn("n_words", F.size("words").cast("long")), width, short)
                   .drop("words"), "prints")
    # the windows of an item carry its fingerprints
    item_words = windows.where(F.col("n") >= GRAM).select("window").distinct().withColumn("words", F.split("window", " "))
    prints = [fingerprints(item_words, width, []).select(F.explode("prints").alias("print"))] if width else []
    prints += [windows.where(F.col("n") == n).select(F.xxhash64(F.split("window", " ")).alias("print")) for n in short]
    if prints:
        known = _few(written(reduce(DataFrame.union, prints).distinct(), "item-prints"))
        shared = rows.select("text_key", F.explode("prints").alias("print")).join(known, "print", "left_semi").distinct()
    else:
        shared = rows.select("text_key", F.lit(0).cast("bigint").alias("print")).where("false")
    shared = written(shared, "shared-prints")

    # the texts behind the hits, once each
    texts = docs.select(_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    # few texts are hit as a rule; only if they are many do all texts take part in a shuffle
    texts = texts.join(_few(written(shared.select("text_key").distinct(), "hit-keys")), "text_key", "left_semi")
    texts = written(texts.groupBy("text_key").agg(F.first("text").alias("text")), "hit-texts")
    texts = texts.select("text_key", words_of(F.col("text")).alias("words"))
    places = []
    for n in ([GRAM] if width else []) + short:
        own = texts.select("text_key", F.posexplode(grams("words", n)).alias("at", "print"))
        own = own.join(shared, ["text_key", "print"], "left_semi")
        for size in (long if n == GRAM else [n]):
            # a window of that size around the shared words
            starts = F.sequence(F.greatest(F.col("at") - (size - n), F.lit(0)), F.col("at"))
            places.append(own.select("text_key", F.lit(size).alias("n"), F.explode(starts).alias("at")))
    if not places:
        hits = shared.select("text_key", F.lit(0).cast("bigint").alias("n_hit"),
                             F.array().cast("array<string>").alias("items"),
                             F.array().cast("array<struct<at:int,n:int>>").alias("spans"))
        return rows.drop("prints"), hits
    spots = reduce(DataFrame.union, places).distinct().groupBy("text_key").agg(
        F.collect_list(F.struct("at", "n")).alias("spots"))
    around = F.transform("spots", lambda s: F.struct(
        s["at"].alias("at"), s["n"].alias("n"),
        F.array_join(F.slice("words", s["at"] + 1, s["n"]), " ").alias("window")))
    around = texts.join(spots, "text_key").select("text_key", F.inline(around))
    found = written(around.join(windows, ["n", "window"]).select("text_key", "at", "n", "item"), "windows-found")
    hits = found.groupBy("text_key").agg(
        F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["at"] + s["n"] - F.greatest(acc["to"], s["at"]), F.lit(0))).alias("n"),
        F.greatest(acc["to"], s["at"] + s["n"]).alias("to")))
    return rows.drop("prints"), hits.withColumn("n_hit", covered["n"].cast("bigint"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row.

    ``n_hit`` counts the words inside any occurrence of an item's window.
    """
    rows, hits = text_hits(docs, items, text_col, item_id, item_text, keep=[id_col])
    joined = rows.join(hits, "text_key", "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,n:int>>")).alias("spans"))


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                         item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text holds no window of an item."""
    key, = fresh(docs, "text_key")
    _, hits = text_hits(docs, items, text_col, item_id, item_text)
    marked = docs.withColumn(key, _key(F.col(text_col)))
    # contaminated texts are few as a rule: then the documents stay where they are
    bad = _few(written(hits.select(F.col("text_key").alias(key)), "contaminated"))
    return marked.join(bad, key, "left_anti").select(docs.columns)
