"""Line dedup and decontamination against plain Python."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aqspark.llm.contamination import contamination, without_contaminated
from aqspark.llm.site_lines import drop_boilerplate

DOCS = "doc_id bigint, text string, source string"


def plain_lines(rows, ratio, least):
    pages = {}
    for _, text, source in rows:
        if text is not None and source is not None:
            pages.setdefault(source, set()).add(text)
    out = []
    for i, text, source in rows:
        if text is not None and source is not None:
            own = pages[source]
            keep = []
            for line in text.split("\n"):
                n = sum(line.strip(" ") in {x.strip(" ") for x in p.split("\n")} for p in own)
                if not line.strip(" ") or n < least or n <= ratio * len(own):
                    keep.append(line)
            text = "\n".join(keep)
        out.append((i, text, source))
    return sorted(out, key=repr)


def test_boilerplate_lines(spark):
    rows = [(i, f"head\nown {i}\n\n  foot \nrare {i // 6}", "a") for i in range(12)]
    rows += [(i, f"head\nbody {i}", "b") for i in range(20, 23)]
    # copies of one text do not make its lines boilerplate
    rows += [(i, "copied once\ncopied twice", "a") for i in range(30, 60)]
    rows += [(70, None, "a"), (71, "head", None), (72, "", "a"), (73, "head", "a"), (None, "foot\n", "a"), rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    found = drop_boilerplate(docs, F.col("source"), ratio=0.5, least_pages=3)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_lines(rows, 0.5, 3)
    counted = {r["doc_id"]: r for r in drop_boilerplate(
        docs, F.col("source"), ratio=0.5, least_pages=3, counts=("n", "gone")).collect()}
    assert (counted[1]["n"], counted[1]["gone"]) == (5, 2)
    assert (counted[70]["n"], counted[70]["gone"]) == (0, 0)


def test_small_hosts_are_cleaned(spark):
    """By default a host of five pages loses the footer of all of them; two pages alike prove nothing."""
    rows = [(i, f"own {i}\nfooter", "five") for i in range(5)] + [(i, f"own {i}\nfooter", "two") for i in (10, 11)]
    found = drop_boilerplate(spark.createDataFrame(rows, DOCS), F.col("source"))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_lines(rows, 0.1, 3)
    assert {r["text"] for r in found.where("source = 'five'").collect()} == {f"own {i}" for i in range(5)}


def test_clashing_columns_and_empty_table(spark):
    rows = [(i, "same\nx%d" % i, "a", 1, 2, 3) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, host string, site int, site_lines int, kept_lines int")
    found = drop_boilerplate(docs, F.col("host"), ratio=0.5, least_pages=3)
    assert found.columns == docs.columns
    assert {r["text"] for r in found.collect()} == {f"x{i}" for i in range(6)}
    empty = spark.createDataFrame([], DOCS)
    assert drop_boilerplate(empty, F.col("source")).count() == 0


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(docs, items):
    out = []
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, other in items:
            other = words(other)
            n = min(len(other), 10)
            windows = {tuple(other[k:k + n]) for k in range(len(other) - n + 1)} if n else set()
            for k in range(len(own) - n + 1):
                if n and tuple(own[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    if item is not None:
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination(d, b).drop("spans")
    assert sorted(map(tuple, found.collect()), key=repr) == plain_contamination(docs, items)


LONG = " ".join(f"w{i % 17}x{i % 5}" for i in range(30))


def test_items_of_every_length(spark):
    docs = [(1, f"start {LONG} end"), (2, LONG.upper().replace(" ", ", ")), (3, "one two three four five six seven"),
            (4, "É é Über 12 x"), (5, None), (6, ""), (7, "a a a a a a a a a a a a a"), (None, LONG), (1, f"start {LONG} end"),
            (8, " ".join(LONG.split()[3:13])), (9, " ".join(LONG.split()[3:12])), (10, "two three " * 50 + LONG * 3)]
    items = [(1, " ".join(LONG.split()[2:20])), (10, "three four five six seven"), (2, "über"), (3, "two THREE"), (4, None),
             (5, "..."), (6, "a a a a a a a a a a a"), (None, "one two three four five six seven"), (2, "über"), (7, "x " * 7)]
    check(spark, docs, items)


def test_long_items_only(spark):
    check(spark, [(1, LONG), (2, "nothing here"), (3, None)], [(1, LONG + " more"), (2, LONG[:60])])


def test_no_items_or_documents(spark):
    check(spark, [(1, LONG), (2, None)], [])
    check(spark, [(1, LONG), (2, None)], [(1, None), (2, "!")])
    check(spark, [], [(1, LONG)])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=6),
       st.lists(st.text(alphabet="ab ", max_size=30), min_size=1, max_size=4))
def test_any_texts(spark, docs, items):
    check(spark, list(enumerate(docs)), list(enumerate(items)))


def test_contaminated_rows_go(spark):
    docs = spark.createDataFrame(
        [(1, f"x {LONG}", "k", 1), (2, "clean", "k", 2), (None, None, None, None), (2, "clean", "k", 2)],
        "doc_id bigint, text string, text_key string, print int")
    items = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    found = without_contaminated(docs, items)
    assert found.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["2", "2", "None"]
