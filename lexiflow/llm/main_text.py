"""Main text of web pages: site templates and page furniture removed.

Every element's subtree (tag, class, id, text and children) has a hash. Spark counts, per
host, on how many different pages a subtree occurs; pages with the same main content count
once. Subtrees on MIN_PAGES of them or more are the site's template and are deleted, as are
elements whose tag, role, class or id marks them as menu, header, footer, sidebar, notice,
advert, form, script, style or reader comments. Inside an article (or, without one, the main
element) only containers (CONTAINERS) are taken for template: headings, paragraphs and other
passages of its own are text, however often they recur. The text of a page is that of its articles, else of its main element, else of its body.

Blocks are separated by one line feed; white space inside a block is one space. Character
references are decoded. Tags may be left open, misnested or broken; a comment or script
that never ends takes the rest of the page. Nested elements, and closing
tags of elements that are not open, take linear time. Null or empty html has an empty text. Pages
without a host are one host. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stage

MIN_PAGES = 10
MOST_BROADCAST = 1_000_000  # template subtrees, 16 bytes each

# Fixed sets of element names and of words in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("details div dl fieldset figure ol section table ul".split())
FURNITURE = frozenset(
    "head nav footer aside form script style noscript template iframe button select textarea title menu dialog svg canvas "
    "object audio video datalist noembed noframes".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs comment "
    "comments disqus share sharing social related newsletter subscribe popup modal overlay widget widgets footer masthead "
    "toolbar pagination pager complementary contentinfo search banner skip login signup".split()
)
PAGE_HEADER_WORDS = frozenset("header site-header page-header topbar".split())
# An opening tag closes these open elements, up to the element named after the bar.
CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
MARKS = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Element:
    __slots__ = ("tag", "marks", "children", "digest")

    def __init__(self, tag: str, marks: str):
        self.tag, self.marks, self.children, self.digest = tag, marks, [], 0


def parse(page: str) -> Element:
    """The element tree of a page; texts are decoded strings among the children."""
    root = Element("#page", "")
    stack, at, open_tags = [root], 0, Counter()
    while (match := TOKEN.search(page, at)) is not None:
        if match.start() > at:
            stack[-1].children.append(entities.unescape(page[at : match.start()]))
        at = match.end()
        end, name, rest = (match.group(1), match.group(2), match.group(3)) if match.group(2) else match.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if end:
            if open_tags[name] and (depth := _opened(stack, name)):
                _cut(stack, depth, open_tags)
            continue
        if name in BLOCK:
            _close(stack, name, open_tags)
        marks = " ".join(m[1].strip("\"'").lower() for m in sorted(MARKS.findall(rest))) if "=" in rest else ""
        element = Element(name, marks)
        stack[-1].children.append(element)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            element.children.append(page[at : close.start() if close else len(page)])
            at = close.end() if close else len(page)
        elif name not in VOID and not (rest.endswith("/") and name not in BLOCK):
            stack.append(element)
            open_tags[name] += 1
    if at < len(page):
        stack[-1].children.append(entities.unescape(page[at:]))
    return root


def _opened(stack: list[Element], name: str) -> int:
    """Where the open element that a closing tag ends stands; 0 if a block lies between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            return i
        if name not in BLOCK and stack[i].tag in BLOCK:
            return 0
    return 0


def _cut(stack: list[Element], depth: int, open_tags: Counter) -> None:
    """Close all open elements from depth on; every one is taken off once."""
    for element in stack[depth:]:
        open_tags[element.tag] -= 1
    del stack[depth:]


def _close(stack: list[Element], name: str, open_tags: Counter) -> None:
    """Close what an opening block element closes: a paragraph, or its own kind up to a parent."""
    closed, parents = (words.split() for words in CLOSES.get(name, ("", "")))
    if not any(open_tags[tag] for tag in ("p", *closed)):
        return
    for i in range(len(stack) - 1, 0, -1):
        tag = stack[i].tag
        if tag == "p" or tag in closed:
            _cut(stack, i, open_tags)
            if not closed or not any(open_tags[tag] for tag in ("p", *closed)):
                return
        elif tag in parents or (not closed and tag in BLOCK) or tag in ("table", "article", "main", "body"):
            return


def _hash(root: Element) -> None:
    """Digests of all subtrees, children first."""
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo += [c for c in element.children if isinstance(c, Element)]
    for element in reversed(order):
        parts = [element.tag, element.marks]
        parts += [f"<{c.digest:x}>" if isinstance(c, Element) else " ".join(c.split()) for c in element.children]
        element.digest = xxhash.xxh64_intdigest("\0".join(p for p in parts if p)) >> 1


def is_furniture(element: Element, inside: bool) -> bool:
    if element.tag in FURNITURE or element.tag == "header" and not inside:
        return True
    if not element.marks or element.tag in ("html", "body", "article", "main"):
        return False
    words = set(re.split(r"[^a-z0-9]+", element.marks))
    return bool(words & FURNITURE_WORDS) or not inside and bool(set(element.marks.split()) & PAGE_HEADER_WORDS)


def _main_parts(root: Element) -> list[Element]:
    """Outermost articles, else main elements, outside of furniture."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            element = todo.pop()
            role = element.marks.split()
            if element.tag == wanted or wanted in role:
                found.append(element)
            elif not is_furniture(element, False):
                todo += [c for c in reversed(element.children) if isinstance(c, Element)]
        if found:
            return found
    return []


def text_of(parts: list[Element], inside: bool, template: np.ndarray) -> str:
    """Blocks of the parts, joined by line feeds."""
    blocks, words = [], []

    def flush() -> None:
        if block := " ".join("".join(words).split()):
            blocks.append(block)
        words.clear()

    todo: list = list(reversed(parts))
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            words.append(node)
        elif node.tag == "br":
            words.append(" ")
        elif is_furniture(node, inside) or len(template) and _may_recur(node, inside) and _among(template, node.digest):
            words.append(" ")
        else:
            block = node.tag in BLOCK or node.tag == "#page"
            if block:
                flush()
                todo.append(None)
            todo += reversed(node.children)
    flush()
    return "\n".join(blocks)


def _may_recur(element: Element, inside: bool) -> bool:
    """Whether an element that recurs is template: any one outside the main part, a container inside it."""
    return not inside or element.tag in CONTAINERS


def _among(template: np.ndarray, digest: int) -> bool:
    at = int(np.searchsorted(template, digest))
    return at < len(template) and int(template[at]) == digest


def main_text(page: str, template: np.ndarray) -> str:
    root = parse(page)
    parts = _main_parts(root)
    for part in (parts or [root]) if len(template) else []:
        _hash(part)
    return text_of(parts or [root], bool(parts), template)


def _above(root: Element, own: set[int]) -> set[int]:
    """The elements that hold one of own, each marked once."""
    order, todo = [], [(root, None)]
    while todo:
        element, parent = todo.pop()
        order.append((element, parent))
        if id(element) not in own:
            todo += [(c, element) for c in element.children if isinstance(c, Element)]
    above: set[int] = set()
    for element, parent in reversed(order):  # children before parents
        if parent is not None and (id(element) in own or id(element) in above):
            above.add(id(parent))
    return above


def subtrees(page: str) -> tuple[int, set[int]]:
    """Digest of the main content (of all text, without an article), and those of the subtrees that may be template."""
    root = parse(page)
    _hash(root)
    parts = _main_parts(root)
    own = {id(p) for p in parts}
    above = _above(root, own) if parts else own
    found, texts, todo = set(), [], [root]
    while todo:
        element = todo.pop()
        for child in element.children:
            if isinstance(child, str):
                texts.append(" ".join(child.split()))
            elif id(child) not in own:
                todo.append(child)
                if child.tag not in ("html", "body", "head") and id(child) not in above:
                    found.add(child.digest)
    todo = list(parts)
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Element):
                todo.append(child)
                if _may_recur(child, True):
                    found.add(child.digest)
    content = " ".join(str(p.digest) for p in parts) or " ".join(sorted(texts))
    return xxhash.xxh64_intdigest(content) >> 1, found


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, digest) of the subtrees on at least min_pages pages of different main content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, digests = [], [], []
            for host, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content, found = subtrees(body.decode("utf-8", "replace"))
                hosts += [host] * len(found)
                contents += [content] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(digests, pa.int64())],
                names=["host", "content", "digest"],
            )

    read = pages.filter("html is not null").select(_host().alias("host"), F.col("html").cast("binary"))
    found = read.mapInArrow(run, "host string, content long, digest long").distinct()
    counted = found.groupBy("host", "digest").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    return stage(counted.select("host", "digest"), "templates")


def _page_templates(keyed: DataFrame, templates: DataFrame) -> DataFrame:
    """(page, host, template): the template subtrees that occur on each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (page, host, digest)
                for page, host, body in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for digest in subtrees(body.decode("utf-8", "replace"))[1]
            ]
            kinds = (pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "host", "digest"])

    found = keyed.select("page", "host", "body").mapInArrow(run, "page long, host string, digest long")
    met = found.join(templates, ["host", "digest"])
    return stage(met.groupBy("page", "host").agg(F.sort_array(F.collect_set("digest")).alias("template")), "page_templates")


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    The templates go to every task while they are few; beyond most_broadcast they are
    joined by host to the pages.
    """
    templates = site_templates(pages, min_pages)
    schema = "page_id long, url string, text string, n_chars long"
    read = pages.select(
        F.col("page_id").cast("long"), "url", _host().alias("host"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("body")
    )
    if templates.count() <= most_broadcast:
        by_host: dict[str, list[int]] = {}
        for row in templates.collect():
            by_host.setdefault(row.host, []).append(row.digest)
        shared = pages.sparkSession.sparkContext.broadcast({h: np.array(sorted(d), np.int64) for h, d in by_host.items()})
        given = read
    else:
        shared = None
        keyed = read.withColumn("page", F.xxhash64("body"))
        needed = _page_templates(keyed, templates)
        given = keyed.join(needed, ["page", "host"], "left").select("page_id", "url", "host", "body", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            texts = []
            for i, (host, body) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if shared is not None:
                    template = shared.value.get(host, none)
                else:
                    template = np.array(batch.column(4)[i].as_py() or [], np.int64)
                texts.append(main_text(body.decode("utf-8", "replace"), template))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return given.mapInArrow(run, schema)
