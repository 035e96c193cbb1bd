"""Main text of web pages by equivalence classes of template tokens.

Pages are read into a sequence of tokens: elements, each named by the path of tags and classes that leads to it, and the
words between block-level tags, whose role is told apart by path and by the block they stand in, so a block's words are one
token. Over the different pages of a host, tokens with the same occurrence vector (the pages they occur on and how often)
form an equivalence class; equal vectors are recognised by a checksum that adds up over pages in any order, so a host with
a third of all pages is aggregated like any other. A class is valid if it is on at least `SUPPORT` pages and holds elements:
text that occurs on just the pages where an element does, as often, was put there by a template, and each layout of a host has
its own vector. Text that some pages happen to share, such as a quoted paragraph, has no element's vector and is content.

On each page the valid classes are nested into its template, widest first: a class whose tokens lie within one gap of every
class before it, or around it, stays, one that is interleaved with another is dropped. Texts of the classes that stay are
constant; what is between them are the page's slots.

Among the slots the main text is chosen. Slots within menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, told by their elements, roles and whole class names, are left out. If a page has articles, the longest and those
at least half as long give the text, without articles inside them; else its main element does; else the container of the
gap that holds most slot text, by preference the path with most such text on the host's pages. An article that is all constant
is kept.

Defined results: a null page is empty, an empty page gives an empty text; unclosed and cut-off markup is read as far as
it goes; a url without a host is a host of its own; copies of a page count once in the template; repeated rows each get a
row; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stage

#: Pages with a class for it to be valid.
SUPPORT = 4
#: An article's length, as a share of the page's longest, for it to be main text too.
ALSO = 0.5
#: Tokens of hosts that a task counts before it passes them on.
FLUSH = 200_000

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Fixed values of HTML.
RAW = {"script", "style", "template", "title", "textarea", "iframe", "object", "svg", "canvas", "audio", "video", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
MATH = {"math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msubsup", "msup", "mtext"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "option", "pre"}
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Elements whose class names say nothing about what they hold.
WHOLE = {"html", "body", "main", "article"}
#: Class names of what is no main text; alone, or with one of the words that may stand before or after.
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
BEFORE = {"bottom", "global", "left", "main", "page", "primary", "right", "secondary", "site", "top"}
AFTER = {"area", "bar", "block", "box", "container", "items", "links", "list", "section", "slot", "unit"}


def _says_aside(name: str) -> bool:
    parts = re.split(r"[-_]+", name)
    while len(parts) > 1 and parts[0] in BEFORE:
        parts = parts[1:]
    while len(parts) > 1 and parts[-1] in AFTER:
        parts = parts[:-1]
    return WORDS.issuperset(parts)


class Block:
    """Text of a page: the path of its element, its parent's, the text, and where it stands."""

    __slots__ = ("path", "text", "aside", "main", "parent", "article", "token")

    def __init__(self, path: str, parent: str, text: str, aside: bool, main: int, article: int):
        self.path, self.parent, self.text, self.aside, self.main, self.article = path, parent, text, aside, main, article
        self.token = _hash("=" + text)


def _signs(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The classes and id that name a tag in a path, whether they mark it as no main text, and as the page's main element."""
    names, aside, main = "", False, False
    if "=" in attributes:
        for k, v in ATTRIBUTE.findall(attributes):
            v = v.strip("\"'").lower()
            if k.lower() == "role":
                aside |= v in ROLES
                main |= v == "main"
            else:
                names += "." + v
                aside |= tag not in WHOLE and any(map(_says_aside, v.split()))
    return names, aside, main


def read(page: str) -> tuple[list[Block], list[tuple[int, Block | None]]]:
    """The text blocks of a page, and all its tokens with their blocks, in order."""
    out: list[Block] = []
    tokens: list[tuple[int, Block | None]] = []
    stack: list[tuple[str, str, bool, int, int]] = [("", "", False, 0, 0)]  # tag, path, aside, 2 in an article, 1 in main, which article
    parts: list[str] = []
    articles = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            tag, path, aside, main, article = stack[-1]
            out.append(Block(path, stack[-2][1] if tag in LEAVES and len(stack) > 1 else path, text, aside, main, article))
            tokens.append((out[-1].token, out[-1]))

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = max(m.end(), at + 1)
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE or tag in MATH:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            if not m.group(3).endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID:
            continue
        while stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1][0] == tag and tag in LEAVES:
            stack.pop()
        names, aside, is_main = _signs(tag, m.group(3))
        _, path, was_aside, main, article = stack[-1]
        if tag == "article":
            aside |= main == 2  # an article inside another is a comment or a teaser
            if main < 2:
                articles += 1
                article = articles
            main = 2
        elif tag == "main" or is_main:
            main = max(main, 1)
        aside |= tag in ASIDE or tag == "header" and main < 2
        path = f"{path}/{tag}{names}"
        stack.append((tag, path, was_aside or aside, main, article))
        tokens.append((_hash(path), None))
    flush()
    return out, tokens


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


#: A host's template: tokens with the number of their class (widest first) and whether they occur once on each of its pages.
Template = dict[int, tuple[int, bool]]


def nested(tokens: list[int], template: Template) -> tuple[set[int], list[int]]:
    """The classes that nest into one template on a page, and the places of their tokens."""
    places: dict[int, list[int]] = {}
    for at, t in enumerate(tokens):
        number, once = template.get(t, (-1, False))
        if number >= 0:
            places.setdefault(number, [])
            if once:
                places[number].append(at)
    one_gap = lambda inner, outer: bisect_left(outer, inner[0]) == bisect_left(outer, inner[-1])
    kept: list[int] = []
    for number in sorted(places):
        own = places[number]
        if all(not own or not places[k] or one_gap(own, places[k]) or one_gap(places[k], own) for k in kept):
            kept.append(number)
    return set(kept), sorted(x for k in kept for x in places[k])


def extract(page: str, template: Template | None = None, main_path: str | None = None) -> str:
    """The main text of a page, given its host's template and the path that holds most slot text there."""
    found, tokens = read(page)
    template = template or {}
    kept, anchors = nested([t for t, _ in tokens], template)
    constant = lambda b: template.get(b.token, (-1, False))[0] in kept
    slots = [b for b in found if not b.aside]
    best = max((b.main for b in slots), default=0)
    if best:
        within = [b for b in slots if b.main == best]
        size: Counter[int] = Counter()
        for b in within:
            size[b.article] += len(b.text)
        least = ALSO * max(size.values())
        within = [b for b in within if size[b.article] >= least]
        text = [b for b in within if not constant(b)] or within
        return "\n\n".join(b.text for b in text)
    slots = [b for b in slots if not constant(b)]
    if slots and (main_path is None or not any(b.parent == main_path or b.parent.startswith(main_path + "/") for b in slots)):
        place = {id(b): at for at, (_, b) in enumerate(tokens) if b is not None}
        mass: Counter[int] = Counter()
        for b in slots:
            mass[bisect_left(anchors, place[id(b)])] += len(b.text)
        gap = max(mass, key=lambda g: (mass[g], -g))
        paths: Counter[str] = Counter()
        for b in slots:
            if bisect_left(anchors, place[id(b)]) == gap:
                paths[b.parent] += len(b.text)
        main_path = max(paths, key=lambda p: (paths[p], p))
    return "\n\n".join(b.text for b in slots if b.parent == main_path or b.parent.startswith(f"{main_path}/"))


def _host(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")), F.lit("-"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) of different pages: host, token, kind (0 element, 1 text, 2 path), pages, vector, most times, characters, path."""
    seen: dict[tuple[str, int], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, t, *x) for (h, t), x in seen.items()]
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "token", "kind", "pages", "vector", "times", "chars", "path"])

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            me = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
            found, tokens = read(page)
            kind = {t: 0 if block is None else 1 for t, block in tokens}
            for t, n in Counter(t for t, _ in tokens).items():
                x = seen.setdefault((host, t), [kind[t], 0, 0, 0, 0, None])
                x[1] += 1
                x[2] ^= xxhash.xxh64_intdigest(me.to_bytes(8, "little") + n.to_bytes(8, "little")) - (1 << 63)
                x[3] = max(x[3], n)
            for block in found:
                if not block.aside:
                    x = seen.setdefault((host, _hash("@" + block.parent)), [2, 0, 0, 0, 0, block.parent])
                    x[4] += len(block.text)
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    yield out()


def deduce(pages: DataFrame, url: str = "url", page: str = "html") -> tuple[DataFrame, DataFrame]:
    """Two staged tables.

    classes: host, support, vector, elements, texts: the valid equivalence classes.
    hosts: host, template (support, vector, token and once of each token of valid classes), main_path.
    """
    rows = pages.where(F.length(page) > 0).select(_host(F.col(url)).alias("host"), F.col(page).alias("html")).withColumn("same", F.xxhash64("html"))
    twice = small(stage(rows.groupBy("host", "same").count().where("count > 1").select("host", "same"), "template-copies"))
    once = rows.join(twice, ["host", "same"], "left_semi").dropDuplicates(["host", "same"])
    different = rows.join(twice, ["host", "same"], "left_anti").unionByName(once).select("host", "html")
    made = different.mapInArrow(_tokens, "host string, token bigint, kind int, pages bigint, vector bigint, times bigint, chars bigint, path string")
    sums = [F.max("kind").alias("kind"), F.sum("pages").alias("support"), F.bit_xor("vector").alias("vector"), F.max("times").alias("times"), F.sum("chars").alias("chars"), F.max("path").alias("path")]
    tokens = made.groupBy("host", "token").agg(*sums)
    tokens = stage(tokens.where((F.col("support") >= SUPPORT) | (F.col("kind") == 2)), "template-tokens")
    key = ["host", "support", "vector"]
    classes = tokens.where("kind < 2").groupBy(*key).agg(F.count_if(F.col("kind") == 0).alias("elements"), F.count_if(F.col("kind") == 1).alias("texts"))
    classes = stage(classes.where("elements > 0 AND texts > 0"), "template-valid")
    valid = tokens.where("kind < 2").join(small(classes.select(*key)), key)
    cell = F.struct(F.col("support").alias("support"), F.col("vector").alias("vector"), F.col("token").alias("token"), (F.col("times") == 1).alias("once"))
    template = valid.groupBy("host").agg(F.collect_list(cell).alias("template"))
    path = tokens.where("kind = 2").groupBy("host").agg(F.max_by("path", F.struct("chars", "path")).alias("main_path"))
    return classes, stage(path.join(template, "host", "left"), "template")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url and text of every row of pages."""
    _, hosts = deduce(pages, url, page)
    # a host's row holds as many tokens as its template: the tokens are counted, not the hosts
    size = hosts.agg(F.sum(F.coalesce(F.size("template"), F.lit(0)) + 8)).first()[0] or 0
    hosts = F.broadcast(hosts) if size <= BROADCAST_ROWS // 4 else hosts
    rows = pages.select(key, F.col(url).alias("url"), F.col(page).alias("html"), _host(F.col(url)).alias("host"))
    joined = rows.join(hosts, "host", "left").select(key, "url", "html", "host", "template", "main_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in batches:
            text = []
            for k, (html_, host, path) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist())):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    cells = b.column(4)[k].as_py() or []
                    order = {c: n for n, c in enumerate(sorted({(-x["support"], x["vector"]) for x in cells}))}
                    known[host] = {x["token"]: (order[-x["support"], x["vector"]], x["once"]) for x in cells}
                text.append(extract(html_ or "", known[host], path))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], [key, "url", "text"])

    return joined.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string")
