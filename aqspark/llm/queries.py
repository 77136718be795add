"""The operators of this package as queries over the given tables, and their SQL twins."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqspark.llm.bag_search import rank_documents
from aqspark.llm.batches import held_out
from aqspark.llm.byte_codec import round_trip
from aqspark.llm.contamination import contamination
from aqspark.llm.language import identify, learn_languages
from aqspark.llm.near_copies import near_classes
from aqspark.llm.neighbours import build_index, search
from aqspark.llm.shards import shard_documents
from aqspark.llm.site_lines import drop_boilerplate
from aqspark.llm.spelling import spelling_variants
from aqspark.llm.token_counts import count_tokens
from aqspark.llm.toxicity import learn_toxicity, score_toxicity
from aqspark.llm.transcripts import learn_transcripts, recover_turns
from aqspark.llm.wrappers import extract_text

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teaching(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def op1_learned_partitions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors, k=20), vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_languages(teaching(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """Transcripts as they are found: by transcript, speakers are marked in one of three ways or not at all."""
    role, style = F.lower(F.coalesce("role", F.lit(""))), F.pmod(F.xxhash64("conv_id"), F.lit(4))
    text = F.coalesce("text", F.lit(""))
    marked = (F.when((style == 0) & (role != ""), F.concat(F.initcap(role), F.lit(": "), text))
              .when((style == 1) & (role != ""), F.concat(F.lit("### "), F.initcap(role), F.lit(":\n"), text))
              .when((style == 2) & (role != ""), F.concat(F.lit("["), role, F.lit("] "), text)).otherwise(text))
    return turns.select("conv_id", "turn", "role", marked.alias("text"))


def op3_transcripts(spark, sf_dir):
    records = raw_transcripts(table(spark, sf_dir, "conversations"))
    model = learn_transcripts(records.where(~held_out(F.col("conv_id"))))
    return recover_turns(records.drop("role"), model)


def op4_site_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return drop_boilerplate(docs, F.col("source"), counts=("n_lines", "n_dropped")).select(
        "doc_id", "text", "n_lines", "n_dropped")


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = teaching(docs).select("doc_id", "text").join(
        teaching(labels).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    found = score_toxicity(docs, learn_toxicity(labelled))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")


def op6_contamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, items).drop("spans")


def op7_wrappers(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY, limit=2048)


def op9_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN)


def op10_near_copies(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))


def op11_bag_search(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_contiguous_shards(spark, sf_dir):
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {q.__name__: q for q in (
    op1_learned_partitions, op2_language, op3_transcripts, op4_site_lines, op5_toxicity, op6_contamination, op7_wrappers, op8_token_counts, op9_byte_bpe,
    op10_near_copies, op11_bag_search, op12_spelling_variants, op13_contiguous_shards)}

# CRC-32 and 60 bits of MD5 in SQL, which has no numbers of either
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS entries FROM (
          SELECT i, list_reduce(list_prepend(i, [x FOR x IN range(8)]),
            lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(digits: str) -> str:
    """Of a column of hexadecimal digits, next to ``crc_table``."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(len({digits}) // 2),
            lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"""


def digest_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_site_lines": """
        WITH cut AS (SELECT *, string_split(text, chr(10)) AS parts FROM documents),
        pages AS (SELECT source, text, list_distinct(list_filter(
                    list_transform(any_value(parts), lambda l: trim(l, ' ')), lambda l: l <> '')) AS keys
                  FROM cut WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source, text),
        totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
        counts AS (SELECT source, line, count(*) AS n
                   FROM (SELECT source, unnest(keys) AS line FROM pages) GROUP BY source, line),
        often AS (SELECT source, list(line) AS lines FROM counts JOIN totals USING (source)
                  WHERE n >= 3 AND n > CAST(0.1 AS DOUBLE) * pages GROUP BY source),
        kept AS (SELECT cut.*, CASE WHEN lines IS NULL THEN parts ELSE list_filter(
                   parts, lambda l: NOT list_contains(lines, trim(l, ' '))) END AS rest
                 FROM cut LEFT JOIN often USING (source))
        SELECT doc_id, array_to_string(rest, chr(10)) AS text, coalesce(len(parts), 0) AS n_lines,
               coalesce(len(parts) - len(rest), 0) AS n_dropped FROM kept""",
    "op6_contamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words, row_number() OVER () AS r FROM documents),
        i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[a:a + least(len(words), 10) - 1], ' ') AS w
               FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS a FROM i WHERE len(words) > 0)),
        dw AS (SELECT r, a, n, array_to_string(words[a:a + n - 1], ' ') AS w
               FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS a
                     FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
        f AS (SELECT r, a, n, item_id FROM dw JOIN iw USING (n, w)),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM f) GROUP BY r),
        g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM f WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)""",
    "op11_bag_search": rf"""
        WITH t AS (SELECT r, doc_id, unnest(list_filter(regexp_split_to_array({FOLDED.format("coalesce(text, '')")},
                     '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term
                   FROM (SELECT *, row_number() OVER () AS r FROM documents)),
        tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
        size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
        corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
        lengths AS (SELECT r, 100 - 90 + (90 * n * docs) // terms AS m FROM size, corpus),
        items AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array({FOLDED.format("coalesce(text, '')")},
                    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
                    FROM tf, corpus WHERE term IN (SELECT term FROM items) GROUP BY term),
        scores AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
                   FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (r) GROUP BY item_id, r)
        SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
                       FROM scores WHERE score > 0) WHERE rank <= 10""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (SELECT doc_id, run, count(*) AS n FROM (
                   SELECT doc_id, unnest(regexp_extract_all({FOLDED.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
                 WHERE len(run) >= 6 GROUP BY doc_id, run),
        marked AS (SELECT run, n, {crc_sql("digits")} AS h FROM (
                     SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits FROM runs), crc_table),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
                    SELECT CASE WHEN h % 199 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM marked)
                  WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        less AS MATERIALIZED (SELECT word, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(len(word))) AS i FROM words)),
        pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                  UNION SELECT word, rest FROM less JOIN (SELECT word AS rest FROM words) USING (rest)
                  UNION SELECT rest, word FROM less JOIN (SELECT word AS rest FROM words) USING (rest)),
        near AS (SELECT a AS word, count(*) AS n_near, list(b ORDER BY n DESC, b)[1] AS best, max(n) AS best_n
                 FROM pairs JOIN words ON word = b GROUP BY a),
        forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form,
                    CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
        chain AS (SELECT word, word AS root, form AS next FROM forms
                  UNION ALL SELECT chain.word, chain.next, forms.form FROM chain JOIN forms ON forms.word = chain.next)
        SELECT word, n, n_near, form, form_n, root FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)""",
    "op13_contiguous_shards": f"""
        WITH RECURSIVE {CRC_TABLE},
        d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {digest_sql("coalesce(text, '')")} AS grp,
                     hex(encode(coalesce(text, ''))) AS digits FROM documents),
        g AS (SELECT grp, sum(size)::BIGINT AS b FROM d GROUP BY grp),
        ranked AS (SELECT *, row_number() OVER w AS r, sum(b) OVER () - sum(b) OVER w + b AS rest FROM g
                   WINDOW w AS (ORDER BY b DESC, grp ROWS UNBOUNDED PRECEDING)),
        alone AS (SELECT grp, r FROM (SELECT *, bool_and(r <= 40 AND b * (41 - r) >= rest) OVER (
                    ORDER BY r ROWS UNBOUNDED PRECEDING) AS yes FROM ranked) WHERE yes),
        n AS (SELECT 40 - count(*) AS shards FROM alone),
        p AS MATERIALIZED (SELECT grp, b, (sum(b) OVER (ORDER BY grp ROWS UNBOUNDED PRECEDING))::BIGINT AS e
                           FROM g ANTI JOIN alone USING (grp)),
        bounds AS (SELECT greatest(max(b), -(-max(e) // shards)) AS lo, max(b) AS top, max(e) AS total, shards FROM p, n GROUP BY shards),
        s AS (SELECT lo, lo + top AS hi, 0::BIGINT AS step, 0::BIGINT AS at FROM bounds
              UNION ALL
              SELECT CASE WHEN nxt < total AND step + 1 = shards THEN mid + 1 ELSE lo END,
                     CASE WHEN nxt = total THEN mid ELSE hi END,
                     CASE WHEN nxt = total OR step + 1 = shards THEN 0 ELSE step + 1 END,
                     CASE WHEN nxt = total OR step + 1 = shards THEN 0 ELSE nxt END
              FROM (SELECT s.lo, s.hi, s.step, (s.lo + s.hi) // 2 AS mid, max(p.e) AS nxt, any_value(total) AS total, any_value(shards) AS shards
                    FROM s JOIN p ON p.e <= s.at + (s.lo + s.hi) // 2, bounds WHERE s.lo < s.hi GROUP BY s.lo, s.hi, s.step)),
        best AS (SELECT lo AS capacity FROM s WHERE lo = hi),
        cuts AS (SELECT 0::BIGINT AS at UNION ALL
                 SELECT max(p.e) FROM cuts JOIN best ON true JOIN p ON p.e <= cuts.at + capacity JOIN bounds ON true
                 WHERE cuts.at < total GROUP BY cuts.at),
        placed AS (SELECT grp, r - 1 AS shard FROM alone
                   UNION ALL SELECT grp, 40 - any_value(shards) + count(cuts.at) - 1 FROM p JOIN cuts ON cuts.at < p.e, n GROUP BY grp)
        SELECT doc_id, size::BIGINT AS size, {crc_sql("digits")} AS text_crc32, 'bytes' AS law, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY {digest_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(grp AS VARCHAR)")},
                                  doc_id NULLS FIRST, grp, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
        FROM d JOIN placed USING (grp), crc_table""",
}
