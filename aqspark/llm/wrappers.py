"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page is read as a stream of block tags and texts, kept as nested groups. Streams of one host are aligned
again and again with the wrapper found so far: where tags differ, the odd part becomes optional; where a group
follows itself it becomes repeated; where texts differ they become a slot. A wrapper remembers for each slot on how many pages
it took its commonest texts, and how much of all of them was inside links. Wrappers of parts of a host are aligned with each other
in the same way, so every page counts and no task sees a whole host.

The wrapper, not the single page, decides which slots are main text: those of the article or main part, if the
host has one, else those that do not consist of links; never
those inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments. Where no part is marked,
a text that its slot takes on more than half of the host's pages belongs to the template too, also among the texts of
a repeated slot; the largest group of copies of a page counts as one page here. Each page is then aligned with
its host's wrapper and gives the other texts of these slots.

Elements may be nested as deep as they like. Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line. Null
and empty html give an empty text. Pages without a readable host share no wrapper: each is its own. Repeated
rows give repeated results. Very long pages are read whole. Only the id, the url and the html are read, so
other columns cannot clash.
"""

import html as entities
import json
import re
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, text_steps, written

# fixed values: elements and the names that mark regions --------------------------------------------------
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section
summary table tbody td tfoot th thead tr ul""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
SILENT = frozenset("""head script style title textarea xmp iframe noembed noframes noscript template svg math object
video audio canvas button select datalist map""".split())
REGIONS = frozenset("nav footer aside form menu dialog".split())
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted menu
nav navbar navigation breadcrumb breadcrumbs footer sidebar aside widget widgets cookie cookies consent gdpr notice
notices notification alert popup modal overlay comment comments respond reply replies disqus share sharing social
related recommended recommendations newsletter subscribe subscription signup login pagination pager copyright
disclaimer hidden""".split())
OUTER_MARKS = frozenset("header masthead banner search topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BODY_MARKS = frozenset("article articlebody content post entry story main".split())
# an open element on the left ends where one on the right opens
ENDS = {"p": BLOCKS - {"body", "html", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"},
        "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
        "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
        "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
# ---------------------------------------------------------------------------------------------------------

TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']|"[^"]*+"|'[^']*+')*+)>)""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

# texts that a slot remembers. The count of each is short by at most a 64th of the texts that the slot took, so with up to
# 30 texts a page none is missed that stands on nearly every page
KINDS = 64
TEXT = "#"


def merged_kinds(left: dict[int, int], right: dict[int, int], same_page: bool = False) -> dict[int, int]:
    """Pages per text; of many texts the commonest, each less by what the first one left out has (Misra and Gries)."""
    out = dict(left)
    for text, n in right.items():
        out[text] = max(out.get(text, 0), n) if same_page else out.get(text, 0) + n
    if len(out) > 2 * KINDS and not same_page:
        less = sorted(out.values(), reverse=True)[KINDS]
        out = {text: n - less for text, n in out.items() if n > less}
    return out


class Group:
    """A node of a page or wrapper: an element with its parts in order, or a text slot."""

    __slots__ = ("name", "parts", "repeated", "optional", "pages", "kinds", "chars", "linked", "text")

    def __init__(self, name, parts=None, pages=1):
        self.name, self.parts, self.pages = name, [] if parts is None else parts, pages
        self.repeated = self.optional = False
        # of a text slot: pages by hash of its texts, characters, those in links; of a page: the text
        # of a whole page: itself by the hash of its source
        self.kinds, self.chars, self.linked, self.text = {}, 0, 0, ""

    def inner(self) -> list["Group"]:
        """The group and all groups in it, each before its parts. Pages may be nested as deep as they like."""
        out, work = [], [self]
        while work:
            group = work.pop()
            out.append(group)
            work += reversed(group.parts)
        return out

    def packed(self):
        """One row per group, each before its parts, whose number comes last."""
        return [[g.name, int(g.repeated) + 2 * int(g.optional), g.pages, sorted(g.kinds.items()), g.chars, g.linked, len(g.parts)]
                for g in self.inner()]

    @staticmethod
    def unpacked(rows):
        open_: list[list] = []
        out = None
        for name, flags, pages, kinds, chars, linked, n in rows:
            group = Group(name, pages=pages)
            group.repeated, group.optional = bool(flags & 1), bool(flags & 2)
            group.kinds, group.chars, group.linked = dict(kinds), chars, linked
            while open_ and not open_[-1][1]:
                open_.pop()
            if open_:
                open_[-1][0].parts.append(group)
                open_[-1][1] -= 1
            else:
                out = group
            open_.append([group, n])
        return out


def _name(tag: str, attributes: str) -> str:
    """Element with the words of its class, id and role that tell what it is, e.g. ``div.ad``."""
    if not attributes.strip():
        return tag
    words = set()
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "itemprop"):
            words.update(w.lower() for w in NAME_PART.findall(value))
        elif key == "role":
            words.update({"role:" + value.strip().lower()} if value else ())
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" \
                or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            words.add("hidden")
    return ".".join([tag, *sorted(words)])


def _unwanted(name: str) -> bool:
    """Elements that hold no main text wherever they stand."""
    tag, *words = name.split(".")
    return tag in SILENT or tag in REGIONS or any(w in MARKS or w[:5] == "role:" and w[5:] in ROLES for w in words)


def read_page(source: str) -> Group:
    """Groups and texts of a page."""
    root = Group("html")
    root.kinds = {zlib.crc32(source.encode("utf-8", "surrogatepass")): 1}
    stack, names = [root], ["html"]
    opened: dict[str, int] = {}
    run: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush():
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            slot = Group(TEXT)
            slot.text, slot.chars = text, len(text)
            slot.linked = min(state["linked"], len(text))
            slot.kinds = {zlib.crc32(text.encode("utf-8", "surrogatepass")): 1}
            stack[-1].parts.append(slot)
        state["linked"] = 0

    def close(depth):
        flush()
        for ended in names[depth:]:
            opened[ended] -= 1
        del stack[depth:], names[depth:]

    def add(text):
        run.append(text)
        if state["links"]:
            state["linked"] += len(text)

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        if lt > at:
            add(source[at:lt])
        tag = TAG.match(source, lt) or LOOSE.match(source, lt)
        if tag is None:
            # no tag, or one that never ends, which hides the rest of the page
            if re.match(r"</?[a-zA-Z]", source[lt:lt + 3]):
                break
            add("<")
            at = lt + 1
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if opened.get(name):
                depth = len(names) - 1
                while names[depth] != name:
                    depth -= 1
                close(depth)
            elif name == "a":
                state["links"] = max(0, state["links"] - 1)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW and not tag[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            if name == "textarea" or name == "title":
                flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name == "hr":
            flush()
            continue
        if name in EMPTY:
            continue
        full = _name(name, tag[3])
        if name not in BLOCKS and not _unwanted(full):
            if name == "a":
                state["links"] += 1
            continue
        if name in ("html", "body"):
            flush()
            continue
        # what the new element ends
        while len(stack) > 1 and name in ENDS.get(names[-1], ()):
            close(len(stack) - 1)
        flush()
        if tag[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        group = Group(full)
        stack[-1].parts.append(group)
        stack.append(group)
        names.append(name)
        opened[name] = opened.get(name, 0) + 1
        state["links"] = 0
    flush()
    return root


def folded(parts: list[Group]) -> list[Group]:
    """Parts in which a group (of one to three names) that follows itself stands once, as repeated."""
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(parts):
            names = [p.name for p in parts[i:i + period]]
            times = 1
            while len(names) == period and [p.name for p in parts[i + times * period:i + (times + 1) * period]] == names:
                times += 1
            if times > 1 and (period == 1 or len(set(names)) > 1):
                for k in range(period):
                    group = parts[i + k]
                    for turn in range(1, times):
                        group = aligned(group, parts[i + k + turn * period], same_page=True)
                    group.repeated = True
                    out.append(group)
                i += period * times
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def shape(group: Group) -> Group:
    """A page as the first guess of a wrapper."""
    made: dict[int, Group] = {}
    # parts before their groups
    for own in reversed(group.inner()):
        out = Group(own.name, folded([made.pop(id(p)) for p in own.parts]))
        out.kinds, out.chars, out.linked = dict(own.kinds), own.chars, own.linked
        made[id(own)] = out
    return out


def pairing(left: list[Group], right: list[Group]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of names."""
    return common_places([p.name for p in left], [p.name for p in right])


def common_places(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of several, the one with the first places of ``b``.

    A row of the table of lengths is one number, whose bit i from the end of ``a`` is 0 where the length grows by
    a[i]. Every so many rows one is kept, from which those between are computed again, so lists of any length fit.
    """
    if a == b:
        return [(i, i) for i in range(len(a))]
    n, m = len(a), len(b)
    full = (1 << n) - 1
    places: dict[str, int] = {}
    for i, name in enumerate(a):
        places[name] = places.get(name, 0) | 1 << (n - 1 - i)

    def following(row, name):
        both = row & places.get(name, 0)
        return ((row + both) | (row - both)) & full

    step = max(int(m ** 0.5), 1)
    # row r belongs to the last r names of b
    kept, row = {0: full}, full
    for r in range(1, m + 1):
        row = following(row, b[m - r])
        if r % step == 0:
            kept[r] = row
    out, i, j = [], 0, 0
    rows, first = [], m + 1
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        r = m - j
        if r < first:
            first = r // step * step
            rows = [kept[first]]
            while first + len(rows) <= r:
                rows.append(following(rows[-1], b[m - first - len(rows)]))
        # without a[i] as long as with it
        if rows[r - first] >> (n - 1 - i) & 1:
            i += 1
        else:
            j += 1
    return out


def aligned(left: Group, right: Group, same_page: bool = False) -> Group:
    """The wrapper of two groups of one name."""

    def joined(left, right):
        out = Group(left.name, pages=left.pages if same_page else left.pages + right.pages)
        out.repeated, out.optional = left.repeated or right.repeated, left.optional or right.optional
        out.kinds = merged_kinds(left.kinds, right.kinds, same_page)
        out.chars, out.linked = left.chars + right.chars, left.linked + right.linked
        return out

    top = joined(left, right)
    work, made = [(left, right, top)], []
    while work:
        left, right, out = work.pop()
        made.append(out)
        i = j = 0
        for a, b in [*pairing(left.parts, right.parts), (len(left.parts), len(right.parts))]:
            for odd in (*left.parts[i:a], *right.parts[j:b]):
                odd.optional = True
                out.parts.append(odd)
            if a < len(left.parts):
                both = joined(left.parts[a], right.parts[b])
                out.parts.append(both)
                work.append((left.parts[a], right.parts[b], both))
            i, j = a + 1, b + 1
    for out in reversed(made):
        # two odd parts of one name may now follow each other
        names = [p.name for p in out.parts]
        if any(x == y for x, y in zip(names, names[1:], strict=False)):
            out.parts = folded(out.parts)
    return top


def common_texts(wrapper: Group, slot: Group) -> set[int]:
    """Hashes of the texts that a slot takes on more than half of the pages; copies of one page count once."""
    copies = max(wrapper.kinds.values(), default=1) - 1
    pages = wrapper.pages - copies
    return {text for text, n in slot.kinds.items() if 2 * (n - copies) > pages} if pages > 1 else set()


def main_slots(wrapper: Group) -> tuple[dict[int, set[int]], set[str]]:
    """The text slots of a wrapper (by ``id``) that are main text, each with the hashes of its texts that are not, and the
    names of the parts marked as main."""
    bodies: list[Group] = []

    def look(group, test):
        work = list(group.parts)
        while work:
            part = work.pop()
            if part.name == TEXT or _unwanted(part.name):
                continue
            if test(part.name):
                bodies.append(part)
            else:
                work += part.parts

    tests = (lambda n: n.split(".")[0] == "main" or "role:main" in n.split("."),
             lambda n: n.split(".")[0] == "article",
             lambda n: any(w in BODY_MARKS for w in n.split(".")[1:]))
    marked = False
    for test in tests:
        bodies.clear()
        look(wrapper, test)
        # a marked part counts if it holds words
        if any(_chars(b) for b in bodies):
            marked = True
            break
    chosen: dict[int, set[int]] = {}
    found = {id(b) for b in bodies}
    work = [(wrapper, not marked)]
    while work:
        group, inside = work.pop()
        for part in group.parts:
            if part.name == TEXT:
                if inside and (marked or not _links(part)):
                    chosen[id(part)] = set() if marked else common_texts(wrapper, part)
            else:
                outer = not marked and any(w in OUTER_MARKS for w in part.name.split("."))
                work.append((part, (inside or id(part) in found) and not outer and not _unwanted(part.name)))
    return chosen, {b.name for b in bodies} if marked else set()


def _holds(group: Group, names: set[str]) -> bool:
    work = list(group.parts)
    while work:
        part = work.pop()
        if part.name in names:
            return True
        work += part.parts
    return False


def main_text(page: Group, wrapper: Group, chosen: dict[int, set[int]], bodies: set[str]) -> str:
    """Main text of a page of the wrapper's host. A page without the part that the host marks is read by itself."""
    if bodies and not _holds(page, bodies):
        wrapper = shape(page)
        chosen, bodies = main_slots(wrapper)
    return "\n\n".join(page_texts(page, wrapper, chosen, bodies))


def _chars(group: Group) -> int:
    total, work = 0, [group]
    while work:
        own = work.pop()
        total += own.chars if own.name == TEXT else 0
        work += [p for p in own.parts if not _unwanted(p.name)]
    return total


def _links(slot: Group) -> bool:
    """Mostly links."""
    return 2 * slot.linked > slot.chars


def turns(parts: list[Group]) -> list[list[Group]]:
    """The parts that stand as one when they are ``folded``."""
    runs = [[p] for p in parts]
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(runs):
            names = [r[0].name for r in runs[i:i + period]]
            times = 1
            while len(names) == period and [r[0].name for r in runs[i + times * period:i + (times + 1) * period]] == names:
                times += 1
            if times > 1 and (period == 1 or len(set(names)) > 1):
                out += [sum(runs[i + k:i + times * period:period], []) for k in range(period)]
                i += period * times
            else:
                out.append(runs[i])
                i += 1
        runs = out
    return runs


def page_texts(page: Group, wrapper: Group, chosen: dict[int, set[int]], bodies: set[str]) -> list[str]:
    """Texts of a page, in order, that fall into the chosen slots of its wrapper.

    Parts are paired with the wrapper as in its inference. A part without a place is judged by the page alone: its texts
    count inside the marked part, or where no part is marked, unless they are mostly links.
    """
    out: list[str] = []

    def places(group, form):
        """The part of the wrapper that each part of a group falls into, by ``id``."""
        forms, runs = form.parts, turns(group.parts)
        paired = dict(common_places([r[0].name for r in runs], [f.name for f in forms]))
        names: dict[str, list[int]] = {}
        for k, part in enumerate(forms):
            names.setdefault(part.name, []).append(k)
        place: dict[int, Group] = {}
        at = 0
        for i, run in enumerate(runs):
            here = paired.get(i)
            if here is None:
                # what the wrapper holds as a turn of a repeated part, or in another order
                own = names.get(run[0].name)
                if not own:
                    continue
                here = next((k for k in own if k >= at), own[-1])
            else:
                at = here
            place.update((id(part), forms[here]) for part in run)
        return place

    # (part, its place in the wrapper or None, inside a chosen part), the next one last
    work = [(page, wrapper, not bodies)]
    while work:
        part, form, inside = work.pop()
        if part.name == TEXT:
            if form is None:
                own = inside and (bodies or not _links(part))
            else:
                own = id(form) in chosen and not part.kinds.keys() & chosen[id(form)]
            if own:
                out.append(part.text)
        elif not _unwanted(part.name):
            outer = not bodies and any(w in OUTER_MARKS for w in part.name.split("."))
            inside = (inside or part.name in bodies) and not outer
            place = places(part, form) if form is not None else {}
            work += [(own, place.get(id(own)), inside) for own in reversed(part.parts)]
    return out


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def settled(wrapper: Group) -> Group:
    """A wrapper of all pages of its host, whose slots remember only the texts that belong to the template."""
    for slot in wrapper.inner():
        if slot.name == TEXT:
            common = common_texts(wrapper, slot)
            slot.kinds = {text: n for text, n in slot.kinds.items() if text in common}
    copies = max(wrapper.kinds, key=wrapper.kinds.get, default=None)
    wrapper.kinds = {} if copies is None else {copies: wrapper.kinds[copies]}
    return wrapper


def _merge_rows(keys, whole=False):
    def run(table: pa.Table) -> pa.Table:
        wrapper = None
        for blob in table["wrapper"].to_pylist():
            other = Group.unpacked(json.loads(blob))
            wrapper = other if wrapper is None else aligned(wrapper, other)
        wrapper = settled(wrapper) if whole else wrapper
        return pa.table({k: pa.array([table[k][0].as_py()], table.schema.field(k).type) for k in keys}
                        | {"wrapper": pa.array([json.dumps(wrapper.packed())])})
    return run


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of every host, from all its pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = rows.where("host IS NOT NULL AND html IS NOT NULL")

    def run(batches):
        own: OrderedDict[str, Group] = OrderedDict()

        def give(hosts):
            return pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array([json.dumps(own.pop(h).packed()) for h in hosts], pa.string())],
                ["host", "wrapper"])

        for batch in batches:
            for part, texts in text_steps(batch, "html"):
                for host, source in zip(part.column(0).to_pylist(), texts, strict=True):
                    page = shape(read_page(source))
                    own[host] = aligned(own[host], page) if host in own else page
                    own.move_to_end(host)
                if len(own) > 2000:
                    yield give(list(own)[:1000])
        yield give(list(own))

    parts = map_arrow(rows, run, "host string, wrapper string")
    # wrappers of one host come from many tasks: they meet in 32 groups first
    parts = parts.withColumn("turn", F.pmod(F.xxhash64("wrapper"), F.lit(32)).cast("int"))
    parts = parts.groupBy("host", "turn").applyInArrow(_merge_rows(["host", "turn"]), "host string, turn int, wrapper string")
    return written(parts.groupBy("host").applyInArrow(_merge_rows(["host"], whole=True), "host string, wrapper string"), "wrappers")


# characters of all wrappers that may be broadcast
BROADCAST_CHARS = 16_000_000


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    wrappers = infer_wrappers(pages, url_col, html_col)
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        wrappers = F.broadcast(wrappers)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left").select("id", "url", "wrapper", "html")

    def run(batches):
        known: OrderedDict[str, tuple] = OrderedDict()
        for batch in batches:
            for part, sources in text_steps(batch, "html"):
                out = []
                for blob, source in zip(part.column(2).to_pylist(), sources, strict=True):
                    page = read_page(source)
                    if blob is None:
                        wrapper = shape(page)
                        out.append(main_text(page, wrapper, *main_slots(wrapper)))
                        continue
                    if blob not in known:
                        wrapper = Group.unpacked(json.loads(blob))
                        known[blob] = wrapper, *main_slots(wrapper)
                        if len(known) > 500:
                            known.popitem(last=False)
                    out.append(main_text(page, *known[blob]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                    [id_col, "url", "text", "n_chars"])

    return map_arrow(rows, run, f"`{id_col}` {kind}, url string, text string, n_chars bigint")
