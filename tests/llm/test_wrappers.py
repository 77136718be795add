"""Wrapper inference and text extraction on hand-made and given pages."""

import html
import random
import re

import pytest

from aqspark.llm import wrappers as W

SCHEMA = "page_id bigint, url string, html string"


def own_text(source):
    page = W.read_page(source)
    wrapper = W.shape(page)
    return W.main_text(page, wrapper, *W.main_slots(wrapper))


@pytest.mark.parametrize("source, want", [
    ("", ""),
    ("plain words", "plain words"),
    ("<p>One <b>two</b>three<br>four<p>Five &amp;amp; &eacute;&nbsp; six", "One twothree four\n\nFive &amp; é six"),
    ("<article><h1>T</h1><p>a</p></article><p>outside</p>", "T\n\na"),
    ("<main><h1>T</h1><article><p>a</p><footer>f</footer></article><aside>x</aside></main>", "T\n\na"),
    ("<header>Site</header><div class='post'><p>a</p></div><div id=sidebar><p>s</p></div>", "a"),
    ("<article><p>a</p><div class='ad-box'>Buy</div><div id=comments><p>c</p></div><form>q</form></article>", "a"),
    ("<article>x<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->y<p>z</article>", "xy\n\nz"),
    ("<article><p hidden>h</p><p style='display: none'>i</p><p aria-hidden='true'>j</p><p>k</p></article>", "k"),
    ("<article><p title='a > b'>x</p><p>1 < 2 & 3</p></article>", "x\n\n1 < 2 & 3"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    ("<article><p>a</p><p>b", "a\n\nb"),
    ("<nav><a>m</a></nav><footer>f</footer>", ""),
    ("<article><p>a</p></article><script>never ends <p>b", "a"),
])
def test_single_pages(source, want):
    assert own_text(source) == want


def test_alignment_finds_repeated_optional_and_text_slots():
    pages = ["<div><h2>a</h2><p>1</p><p>2</p></div>", "<div><h2>b</h2><p>3</p></div>", "<div><h2>c</h2><ul><li>x</li></ul><p>4</p></div>"]
    wrapper = None
    for source in pages:
        page = W.shape(W.read_page(source))
        wrapper = page if wrapper is None else W.aligned(wrapper, page)
    parts = {p.name: p for p in wrapper.parts[0].parts}
    assert list(parts) == ["h2", "ul", "p"]
    assert parts["p"].repeated and not parts["p"].optional
    assert parts["ul"].optional and not parts["h2"].optional
    assert len(parts["h2"].parts[0].kinds) == 3
    again = W.Group.unpacked(wrapper.packed())
    assert again.packed() == wrapper.packed()


def test_groups_of_several_names_are_folded():
    wrapper = W.shape(W.read_page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    names = [(p.name, p.repeated) for p in wrapper.parts[0].parts]
    assert names == [("dt", True), ("dd", True)]
    assert own_text("<article><dl><dt>a<dd>b<dt>c<dd>d</dl></article>") == "a\n\nb\n\nc\n\nd"


def test_words_of_every_page_are_template_where_no_part_is_marked(spark):
    rows = [(i, "https://A.example.org:8080/x?y", f"<div><p>Our site</p><div><p>story {i}</p><p>more {i}</p></div>"
             "<ul><li><a href=x>home</a></li></ul></div>") for i in range(8)]
    rows += [(20, "https://b.example.org/", "<div><p>Our site</p></div>"), (21, None, "<p>alone</p>"), (22, "no url", "<p>alone</p>"),
             (23, "https://b.example.org/", None), (None, "https://b.example.org/", ""), rows[0]]
    table = spark.createDataFrame(rows, SCHEMA)
    found = W.extract_text(table).collect()
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[3] == "story 3\n\nmore 3"
    assert (texts[20], texts[21], texts[22], texts[23], texts[None]) == ("Our site", "alone", "alone", "", "")
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert W.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_page_without_the_marked_part_is_read_by_itself(spark):
    rows = [(i, "https://a.example.org/", f"<article><p>t {i}</p></article><p>out</p>") for i in range(5)]
    rows.append((9, "https://a.example.org/", "<nav>n</nav><p>another form</p>"))
    texts = {r["page_id"]: r["text"] for r in W.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts[2] == "t 2" and texts[9] == "another form"


def test_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in W.extract_text(table).collect()}
    assert len(found) == table.count()
    for row in table.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S)[1].replace("<br>", " ")
        blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|table|tr|td)[^>]*>", article)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in blocks]
        assert found[row["page_id"]] == "\n\n".join(b for b in blocks if b)


def read_by_one_wrapper(sources):
    wrapper = None
    for source in sources:
        page = W.shape(W.read_page(source))
        wrapper = page if wrapper is None else W.aligned(wrapper, page)
    slots = W.main_slots(wrapper)
    return [W.main_text(W.read_page(source), wrapper, *slots) for source in sources]


@pytest.mark.parametrize("outer", ["article", "div"])
def test_parts_in_the_wrong_one_of_two_forms_keep_their_texts(outer):
    quote, table = "<blockquote><ul><li>{}</li></ul></blockquote>", "<blockquote><table><tr><td>{}</td></tr></table></blockquote>"
    inner = [f"<h2>a</h2><ol><li>b</li></ol>{quote.format('c')}<p>d</p>", f"{quote.format('e')}<p>f</p>",
             f"{table.format('g')}<h2>h</h2><ol><li>i</li></ol><p>j</p>"]
    found = read_by_one_wrapper([f"<{outer}>{x}</{outer}>" for x in inner])
    assert found == ["a\n\nb\n\nc\n\nd", "e\n\nf", "g\n\nh\n\ni\n\nj"]


def test_every_text_of_a_marked_part_is_given():
    draw = random.Random(5)

    def content(depth):
        out = ""
        for _ in range(draw.randint(1, 4)):
            name = draw.choice(["div", "figure", "blockquote", "section", "h2", "p"])
            inside = content(depth - 1) if depth and name not in ("h2", "p") else f"t{draw.randint(0, 10 ** 9)}"
            out += f"<{name}>{inside}</{name}>"
        return out

    sources = [f"<nav>n</nav><div><article>{content(3)}</article></div><footer>f</footer>" for _ in range(40)]
    for source, text in zip(sources, read_by_one_wrapper(sources), strict=True):
        assert text.split("\n\n") == re.findall(r"t\d+", source)


def test_common_places_are_a_longest_subsequence_however_long():
    draw = random.Random(3)
    for _ in range(300):
        a, b = (draw.choices("abcd", k=draw.randint(0, 12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        found = W.common_places(a, b)
        assert len(found) == best[0][0] and all(a[i] == b[j] for i, j in found)
        assert all(x < y and v < w for (x, v), (y, w) in zip(found, found[1:], strict=False))
    # going to the next place of "z" first would leave nothing for the rest
    a, b = ["z", *map(str, range(1000))], [*map(str, range(1000)), "z"]
    assert len(W.common_places(a, b)) == 1000


def test_texts_of_most_pages_are_template_also_in_a_repeated_slot():
    sources = [f"<div><p>same words</p><p>own text {i}</p></div>" for i in range(6)]
    assert read_by_one_wrapper(sources) == [f"own text {i}" for i in range(6)]
    # the wrapper is what tells: a page alone does not
    assert own_text(sources[0]) == "same words\n\nown text 0"
    # two pages are enough to see it, and many copies of a page are one page
    assert read_by_one_wrapper(sources[:2]) == ["own text 0", "own text 1"]
    assert read_by_one_wrapper(sources[:1] * 9) == ["same words\n\nown text 0"] * 9
    assert read_by_one_wrapper(sources[:1] * 9 + sources[1:3]) == ["own text 0"] * 9 + ["own text 1", "own text 2"]


def test_common_texts_are_found_among_many_and_in_wrappers_of_parts():
    draw = random.Random(7)
    pages = []
    for i in range(120):
        own = [f"w{i} {draw.random()}" for _ in range(draw.randint(1, 25))]
        pages.append((own, "<div>" + "".join(f"<p>{x}</p>" for x in ["at the top", *own, "at the end"]) + "</div>"))
    parts = []
    for start in range(0, 120, 30):
        wrapper = None
        for _, source in pages[start:start + 30]:
            page = W.shape(W.read_page(source))
            wrapper = page if wrapper is None else W.aligned(wrapper, page)
        parts.append(W.Group.unpacked(wrapper.packed()))
    whole = parts[0]
    for other in parts[1:]:
        whole = W.aligned(whole, other)
    for wrapper in (W.Group.unpacked(whole.packed()), W.settled(whole)):
        assert wrapper.pages == 120
        slots = W.main_slots(wrapper)
        for own, source in pages:
            assert W.main_text(W.read_page(source), wrapper, *slots) == "\n\n".join(own)


def test_pages_nested_very_deeply(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, "https://a.example.org/", deep), (2, "https://a.example.org/", "<div>flat</div>"), (3, None, deep),
            (4, "https://b.example.org/", "<article>" + "<div>" * 1500 + "<p>x</p>" + "</div>" * 1500 + "</article>"),
            (5, "https://b.example.org/", "<article>" + "<div>" * 1500 + "<p>y</p>")]
    texts = {r["page_id"]: r["text"] for r in W.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts == {1: "deep", 2: "flat", 3: "deep", 4: "x", 5: "y"}
