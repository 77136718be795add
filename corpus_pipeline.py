"""The training-text pipeline: every stage works on what the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import functions as F

from aqspark.llm.batches import fresh, held_out, written
from aqspark.llm.byte_codec import round_trip
from aqspark.llm.contamination import without_contaminated
from aqspark.llm.language import UNKNOWN, identify, learn_languages
from aqspark.llm.near_copies import without_near_copies
from aqspark.llm.site_lines import drop_boilerplate


def language_stage(spark, docs, sf_dir):
    """Keep the documents whose language is recognised: those with letters."""
    automata = learn_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    lang, score = fresh(docs, "lang_pred", "score")
    found = identify(docs, automata, keep=docs.columns, names=(lang, score))
    return found.where(F.col(lang) != UNKNOWN).drop(lang, score)


def line_stage(spark, docs, sf_dir):
    """Take boilerplate lines of their source out of the texts; the number of characters follows.

    The share of a source's pages decides, for small sources too: three pages make a line repeated, since two may be
    near copies of each other.
    """
    out = drop_boilerplate(docs, F.col("source"), least_pages=3)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def near_copy_stage(spark, docs, sf_dir):
    """Keep one document of every class of near copies."""
    return without_near_copies(docs)


def benchmark_stage(spark, docs, sf_dir):
    """Drop the documents that hold a window of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark, docs, sf_dir):
    """Token ids of every text, with the digests of the ids and of what they decode to."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("encoding", encoding_stage),
]

# language identification, sampling and encoding have no SQL form
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
