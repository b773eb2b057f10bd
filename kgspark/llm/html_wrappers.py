"""Main text of web pages by wrappers, union-free regular expressions inferred for each host.

A page is a stream of tags and texts. Aligning streams of the same host, tags that both have stay, tags that only one
has become optional, a tag that comes again becomes a repeated group together with what stands between, and texts
become slots. A wrapper keeps, for each slot, whether its text ever varied and how much text and link text it held.
Each task folds its pages into a wrapper for each host; wrappers are merged in two rounds, so no group holds more than
one small wrapper for each task. Constant slots are the host's own text, and slots outside its main region are menus,
adverts and the like; what is left of a page in page order is its main text.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import rows_of, staged

#: Hosts whose wrappers a task holds at once; more are handed on early.
HOSTS_HELD = 2000
SALTS = 64
#: Bytes of wrappers that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Pages that must share a text before it counts as the host's own.
CONSTANT_PAGES = 5
#: Levels of elements that are kept apart; deeper ones stand beside each other, in page order.
DEEP = 200

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|object)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that end an open one of these kinds.
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTSIDE = set("nav header footer aside form button select option menu dialog head title input".split())
OUTSIDE_WORD = re.compile(
    r"(?:^|[\s_/.#-])(?:ad|ads|adv|advert\w*|banner\w*|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|side|sidebar\w*|footer\w*|header|masthead|topbar"
    r"|breadcrumb\w*|comment\w*|disqus\w*|respond|repl(?:y|ies)|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*"
    r"|signup|share|sharing|social\w*|related\w*|recommend\w*|widget\w*|toolbar|pagination|pager|login|search\w*|legal|copyright|skip\w*|complementary|contentinfo"
    r"|hidden)(?:$|[\s_/.#-])",
    re.I,
)
MAIN_WORD = re.compile(r"(?:^|[\s_/.#-])(?:main|maincontent|article|articlebody|content|post|entry|story|body)(?:$|[\s_/.#-])", re.I)


class Node:
    """An element: its label, the texts right in it (text, whether in a link) and its children, in page order."""

    __slots__ = ("label", "tag", "parts")

    def __init__(self, label: str, tag: str):
        self.label, self.tag, self.parts = label, tag, []


def parse(page: str | None) -> Node:
    """A page's elements. Inline tags are passed over, but for links; missing and stray end tags are allowed for."""
    root = Node("", "")
    stack, at, links, page = [root], 0, 0, page or ""

    def add(part: tuple[str, bool]) -> None:
        if len(stack) > DEEP and stack[DEEP - 1].parts[-1] is not stack[-1]:  # goes on after a deeper element
            stack[-1] = Node(stack[-1].label, stack[-1].tag)
            stack[DEEP - 1].parts.append(stack[-1])
        stack[-1].parts.append(part)

    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            add((html.unescape(text), links > 0))
        if not m:
            break
        at, tag = m.end(), (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = max(0, links + (-1 if m[2] else 1))
        if tag in INLINE:
            continue
        if tag == "br":
            add((" ", False))
        elif m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            ends = CLOSES.get(tag, {"p"} if tag in CLOSES_P else ())
            if ends and stack[-1].tag in ends:
                stack.pop()
                if tag == "tr" and stack[-1].tag in ends:
                    stack.pop()
            node = Node(_label(tag, m[4]), tag)
            stack[min(len(stack), DEEP) - 1].parts.append(node)
            if not m[4].rstrip().endswith("/") or tag in ("p", "div"):
                stack.append(node)
            links = 0 if tag in CLOSES_P else links
    return root


def _label(tag: str, attributes: str) -> str:
    if not attributes or attributes.isspace():
        return tag
    found = sorted({(a.lower(), re.sub(r"\d+", "9", (x or y or z or "").strip().lower())) for a, x, y, z in ATTRIBUTE.findall(attributes)})
    return tag + "".join(f" {a}={v}" if v else f" {a}" for a, v in found)


def _outside(label: str) -> bool:
    tag, _, rest = label.partition(" ")
    values = re.sub(r"(?:^| )(?:class|id|role|itemprop)=", " ", " " + rest)
    return tag in OUTSIDE or bool(rest) and (bool(OUTSIDE_WORD.search(values)) and not (tag in ("article", "main", "body") and "comment" not in rest) or "aria-hidden=true" in rest)


def _main(label: str) -> bool:
    tag, _, rest = label.partition(" ")
    return tag in ("article", "main") or tag in ("div", "section", "td") and bool(MAIN_WORD.search(re.sub(r"(?:^| )(?:class|id|role|itemprop)=", " ", " " + rest)))


# A wrapper's node: [pages, smallest and largest hash of its text, characters, of these in links, children]; a child
# is [label, optional, repeated, node].


def new_wrapper() -> list:
    """The wrapper of no page."""
    return [0, None, None, 0, 0, []]


def single(node: Node) -> list:
    """The wrapper of one page."""
    texts = [(re.sub(r"\s+", " ", t).strip(), a) for t, a in (p for p in node.parts if type(p) is tuple)]
    text = " ".join(t for t, _ in texts if t)
    mark = xxhash.xxh64_intdigest(text) >> 1 if text else None
    w = [1, mark, mark, len(text), sum(len(t) for t, a in texts if a), []]
    for part in node.parts:
        if type(part) is Node:
            _place(w[5], [part.label, False, False, single(part)], len(w[5]))
    return w


def _place(children: list, child: list, at: int) -> int:
    """Put a child into an ordered list of children, in which a label stands once. Returns the place after it."""
    for k, have in enumerate(children):
        if have[0] == child[0]:
            if k < at:  # it comes again: what stands between is repeated with it
                for x in children[k:at]:
                    x[2] = True
                for x in children[k + 1 : at]:
                    x[1] = True
            have[1] |= child[1]
            have[2] |= child[2]
            have[3] = merged(have[3], child[3])
            return max(k + 1, at)
    children.insert(at, child)
    return at + 1


def merged(a: list, b: list) -> list:
    """The wrapper that takes what either takes."""
    marks = [x for x in (a[1], b[1]) if x is not None]
    tops = [x for x in (a[2], b[2]) if x is not None]
    children, seen, at = [[c[0], c[1], c[2], c[3]] for c in a[5]], {c[0] for c in b[5]}, 0
    had = {c[0] for c in children}
    for c in children:
        c[1] |= bool(b[0]) and c[0] not in seen
    for c in b[5]:
        at = _place(children, [c[0], c[1] or (bool(a[0]) and c[0] not in had), c[2], c[3]], at)
    return [a[0] + b[0], min(marks, default=None), max(tops, default=None), a[3] + b[3], a[4] + b[4], children]


def expression(w: list) -> str:
    """A wrapper as a regular expression over tags, for people to read."""
    inner = "".join(f"({x[0]}{{{expression(x[3])}}}){'*' if x[1] and x[2] else '+' if x[2] else '?' if x[1] else ''}" for x in w[5])
    return ("#text" if w[3] else "") + inner


def _constant(w: list) -> bool:
    return w[0] >= CONSTANT_PAGES and w[1] is not None and w[1] == w[2]


def plan(w: list) -> dict:
    """What to take of a host's pages: the main region's path, if no label says it, and whether constant slots count."""
    best, named, varies = [], [False], [False]

    def walk(node: list, path: tuple[str, ...], main: bool) -> float:
        own = max(0, node[3] - 3 * node[4])
        for label, _, _, child in node[5]:
            if _outside(label):
                continue
            inside = main or _main(label)
            named[0] |= inside and child[0] > 0
            got = walk(child, (*path, label), inside)
            own += got if label.partition(" ")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "table", "tbody", "tr", "td", "dl", "dd", "dt") else 0.3 * got
        if main and node[3] and not _constant(node):
            varies[0] = True
        best.append((own, path))
        return own

    walk(w, (), False)
    return {"named": named[0], "path": max(best, key=lambda x: (x[0], len(x[1])))[1] if best else (), "varies": varies[0]}


def main_text(page: str | None, w: list, how: dict) -> str:
    """The main text of a page under its host's wrapper."""
    root = parse(page)

    def collect(named: bool) -> str:
        blocks: list[str] = []

        def walk(node: Node, wrap: list | None, path: tuple[str, ...], inside: bool) -> None:
            take = inside and not (how["varies"] and wrap is not None and _constant(wrap))
            kids, block = {c[0]: c[3] for c in wrap[5]} if wrap else {}, []
            for part in node.parts:
                if type(part) is tuple:
                    if take:
                        block.append(part[0])
                    continue
                blocks.append("".join(block))
                block = []
                if not _outside(part.label):
                    here = (*path, part.label)
                    walk(part, kids.get(part.label), here, inside or (_main(part.label) if named else here == how["path"]))
            blocks.append("".join(block))

        walk(root, w, (), not named and not how["path"])
        return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)

    return (collect(True) if how["named"] else "") or collect(False)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    salt = TaskContext.get().partitionId() % SALTS

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([salt] * len(held)), pa.array([json.dumps(w) for w in held.values()])], ["host", "salt", "wrapper"])

    for hosts, pages in rows_of(batches, "host", "html"):
        for host, page in zip(hosts, pages, strict=True):
            held[host] = merged(held.get(host) or new_wrapper(), single(parse(page)))
        if len(held) > HOSTS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    w = new_wrapper()
    for x in sorted(group["wrapper"]):
        w = merged(w, json.loads(x))
    return group.head(1)[["host", "salt"]].assign(wrapper=json.dumps(w))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) over all pages (url, html)."""
    rows = pages.select(F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), "html")
    schema = "host string, salt long, wrapper string"
    part = rows.mapInArrow(_fold, schema).groupBy("host", "salt").applyInPandas(_merge, schema)
    return staged(part.groupBy("host").applyInPandas(_merge, schema).select("host", "wrapper"), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[list, dict]] = {}
    for batch in batches:
        out = []
        for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if wrapper not in known:
                if len(known) > HOSTS_HELD:
                    known.clear()
                w = json.loads(wrapper)
                known[wrapper] = (w, plan(w))
            out.append(main_text(page, *known[wrapper]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, and pages of nothing but boilerplate, give an empty text. Pages without a url share one wrapper.
    Repeated rows are rows of their own. Other columns are ignored; an empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    wrappers = infer_wrappers(pages)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    rows = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host")
    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
