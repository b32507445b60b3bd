"""Main text of web pages by wrapper induction.

Pages of a host share a template. One page of each host is its reference; simple tree matching aligns every page of the
host with it, articles included. Text nodes that stay the same on most pages are template, the others are slots.
The main text is what the slots hold, inside the article if the page has one, less the parts whose element says that they
are something else. Copies of one article are no evidence of a template: each article is counted once a host, and an
article that is mostly the reference's own is not counted against it.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, stored

SHARE = 0.6  # of aligned pages on which a template node has the same text
LEAST_PAGES = 3  # of a host before anything is called template
SHORT = 32  # characters up to which an outline holds a text itself

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article aside section main div table td th ul ol dl blockquote form nav header footer".split())

# What is not main text, by element, role and the words of class and id.
ASIDE_TAGS = RAW | frozenset("head nav footer aside form button select dialog menu search object canvas datalist".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar comment comments commentlist respond reply disqus "
    "share sharing social related recommended newsletter subscribe signup login footer masthead toolbar widget skip".split()
)
MAIN_TAGS = ("article", "main")

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "apart", "children")

    def __init__(self, tag: str, apart: bool = False):
        self.tag, self.apart, self.children = tag, apart, []


def _apart(tag: str, attributes: str) -> bool:
    if tag in ASIDE_TAGS:
        return True
    if not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ASIDE_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and not ASIDE_WORDS.isdisjoint(w.lower() for w in WORD.findall(value)):
            return True
    return False


def parse(page: str) -> Node:
    """A tree of elements and decoded texts; unclosed and misplaced tags are mended like a browser would."""
    root = Node("#page")
    stack, at, end = [root], 0, len(page)
    search = TAG.search
    while at < end:
        m = search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",))
        if tag in SELF_CLOSING:
            _close(stack, SELF_CLOSING[tag])
        attributes = m.group(3) or m.group(6) or ""
        node = Node(tag, _apart(tag, attributes))
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    else:
        return root
    stack[-1].children.append(page[at:])
    return root


def _close(stack: list[Node], tags) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in SCOPE:
            return


def blocks(node: Node, skip: frozenset[int] = frozenset(), numbers: dict[int, int] | None = None, whole: bool = False) -> list[str]:
    """The texts of a subtree's blocks in page order, without parts set apart and without the template nodes in ``skip``.

    ``numbers`` gives the number of an aligned element. With ``whole`` a block goes only if all its text is template, so that
    a link or an emphasis that recurs is not cut out of a sentence.
    """
    out: list[str] = []
    open_text: list[str] = []
    held = False  # by the open block: text that is no template

    def flush() -> None:
        nonlocal held
        text = " ".join(entities.unescape("".join(open_text)).split()) if held else ""
        if text:
            out.append(text)
        open_text.clear()
        held = False

    todo: list = [node]  # nodes, texts, template texts in a tuple and None where a block ends; a stack, so that deep pages are no trouble
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            open_text.extend(x)
        elif isinstance(x, str):
            open_text.append(x)
            held = held or not x.isspace()
        elif x.tag in ("br", "wbr", "img"):
            open_text.append(" " if x.tag == "br" else "")
        elif x.apart and x is not node:
            if x.tag in BLOCK:
                flush()
        else:
            template = numbers is not None and numbers.get(id(x)) in skip
            inner = x.children
            if template:
                inner = [(c,) if isinstance(c, str) else c for c in inner if whole or not isinstance(c, str)]
            if x.tag in BLOCK or x is node:
                flush()
                todo.append(None)
            todo.extend(reversed(inner))
    return out


def mains(root: Node) -> list[Node]:
    """The topmost articles, or else main elements, that are not set apart."""
    for tag in MAIN_TAGS:
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str) or x.apart and x is not root:
                continue
            if x.tag == tag:
                found.append(x)
            else:
                todo.extend(reversed(x.children))
        if found:
            return found
    return []


def outline(root: Node, depth: int = 200) -> tuple[list, list[Node]]:
    """The tree as [tag, text, children] and its elements in the same order of numbers; a long text is its length and digest."""
    nodes: list[Node] = []

    def walk(x: Node, left: int) -> list:
        nodes.append(x)
        if not left:
            return [x.tag, "", []]
        own = " ".join([c for c in x.children if isinstance(c, str)])
        own = " ".join((entities.unescape(own) if "&" in own else own).split())
        return [x.tag, own if len(own) <= SHORT else f"{len(own)}:{_digest(own)}", [walk(c, left - 1) for c in x.children if not isinstance(c, str)]]

    return walk(root, depth), nodes


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _chars(text: str) -> int:
    """Characters of a text of an outline."""
    return len(text) if len(text) <= SHORT else int(text.split(":", 1)[0])


class Outline:
    """An outline with elements numbered in page order, ready to be matched."""

    def __init__(self, tree: list):
        self.tag, self.text, self.size, self.shape, self.kids = [], [], [], [], []
        self._add(tree)

    def _add(self, tree: list) -> int:
        n = len(self.tag)
        self.tag.append(tree[0])
        self.text.append(tree[1])
        self.size.append(1)
        self.shape.append(tree[0] + "()")
        self.kids.append([])
        if tree[2]:
            self.kids[n] = kids = [self._add(c) for c in tree[2]]
            self.size[n] = len(self.tag) - n
            self.shape[n] = f"{tree[0]}({','.join([self.shape[k] for k in kids])})"
        return n


def matched(a: Outline, b: Outline) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping match of the two trees, as b's number -> a's number.

    Children of equal shape at both ends match at once; the rest goes through the usual table, a row at a time. Of the
    table only two bits a cell are kept. Elements of equal shapes have equal scores, so a score is found once for two shapes.
    """
    known: dict[tuple[str, str], int] = {}

    def score(x: int, y: int) -> int:
        if a.tag[x] != b.tag[y]:
            return 0
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        if not a.kids[x] or not b.kids[y]:
            return 1
        key = a.shape[x], b.shape[y]
        if key not in known:
            known[key] = solve(x, y)[0]
        return known[key]

    def solve(x: int, y: int) -> tuple[int, list]:
        p, q = a.kids[x], b.kids[y]
        total, pairs = 1, []
        start, end = 0, min(len(p), len(q))
        while start < end and a.shape[p[start]] == b.shape[q[start]]:
            total += a.size[p[start]]
            pairs.append((p[start], q[start]))
            start += 1
        p, q, end = p[start:], q[start:], 0
        while end < min(len(p), len(q)) and a.shape[p[-1 - end]] == b.shape[q[-1 - end]]:
            end += 1
            total += a.size[p[-end]]
            pairs.append((p[-end], q[-end]))
        p, q = p[: len(p) - end], q[: len(q) - end]
        if not p or not q:
            return total, pairs
        kinds: dict[str, int] = {}
        kind = np.array([kinds.setdefault(b.shape[v], len(kinds)) for v in q])
        some = list({b.shape[v]: v for v in q}.values())  # an element of each shape, in the order of kinds
        scores: dict[str, np.ndarray] = {}
        above, from_above, from_left = np.zeros(len(q) + 1, dtype=np.int64), [], []
        for u in p:
            if a.shape[u] not in scores:
                scores[a.shape[u]] = np.array([score(u, v) for v in some])
            row = np.zeros_like(above)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + scores[a.shape[u]][kind]), out=row[1:])
            from_above.append(np.packbits(row[1:] == above[1:]))
            from_left.append(np.packbits(row[1:] == row[:-1]))
            above = row
        i, j = len(p), len(q)
        while i and j:
            at, bit = divmod(j - 1, 8)
            if from_above[i - 1][at] >> (7 - bit) & 1:
                i -= 1
            elif from_left[i - 1][at] >> (7 - bit) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((p[i], q[j]))
        return total + int(above[-1]), pairs

    out: dict[int, int] = {}
    todo = [(0, 0)] if a.tag[0] == b.tag[0] else []
    while todo:
        x, y = todo.pop()
        out[y] = x
        todo.extend(zip(a.kids[x], b.kids[y]) if a.shape[x] == b.shape[y] else solve(x, y)[1])
    return out


def extract(page: str, reference: Outline | None = None, template: frozenset[int] = frozenset()) -> str:
    """The main text: all slots of the page's articles, or of the whole page if it has none, that are not set apart."""
    root = parse(page)
    numbers = None
    if reference is not None and template:
        tree, nodes = outline(root)
        numbers = {id(nodes[y]): x for y, x in matched(reference, Outline(tree)).items()}
    main = mains(root)
    if main:
        return "\n".join(b for m in main for b in blocks(m, template, numbers, whole=True))
    return "\n".join(blocks(_without_header(root), template, numbers))


def _without_header(root: Node) -> Node:
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag == "header":
            x.apart = True
        todo.extend(c for c in x.children if not isinstance(c, str))
    return root


def _outliner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(outline(parse(p))[0]) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], ["host", "tree"])


def votes(page: str, reference: Outline) -> tuple[str, list[int]]:
    """A key of the page's article (or whole text) and, for each aligned text of the reference, its number twice, plus one if it is equal.

    Where more than half of an article is the reference's own text it is a copy of that and says nothing about what is inside.
    """
    root = parse(page)
    tree, nodes = outline(root)
    own = Outline(tree)
    main = {id(m) for m in mains(root)}
    inside = {i for y, n in enumerate(nodes) if id(n) in main for i in range(y, y + own.size[y])}
    key = _digest("\0".join(own.text[y] for y in sorted(inside)) if inside else "\0".join(own.text))
    pairs = matched(reference, own)
    equal = {y for y, x in pairs.items() if own.text[y] and own.text[y] == reference.text[x]}
    copy = 2 * sum(_chars(own.text[y]) for y in equal & inside) > sum(_chars(own.text[y]) for y in inside)
    return key, sorted(2 * x + (y in equal) for y, x in pairs.items() if reference.text[x] and not (copy and y in inside))


def _aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page says about the texts of its host's reference."""
    for batch in batches:
        known: dict[str, Outline] = {}
        hosts, keys, said = batch.column("host").to_pylist(), [], []
        for host, page, tree in zip(hosts, *(batch.column(c).to_pylist() for c in ("html", "tree"))):
            if host not in known:
                known[host] = Outline(json.loads(tree))
            key, own = votes(page, known[host])
            keys.append(key)
            said.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.string()), pa.array(said, pa.list_(pa.int64()))], ["host", "article", "votes"])


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, tuple] = {}
        out = []
        for host, page, tree, slots in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tree", "slots"))):
            if host not in known:
                known[host] = (Outline(json.loads(tree)) if tree is not None and slots else None, frozenset(slots or ()))
            out.append(extract(page, *known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _by_host(side: DataFrame, size: str, most_mb: int = 64) -> DataFrame:
    """Broadcast a stored table by host if its measured size is small; else leave the join to a shuffle."""
    chars = side.agg(F.coalesce(F.sum(F.length(size)), F.lit(0))).first()[0]
    return F.broadcast(side) if chars <= most_mb << 20 else side


def main_texts(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (page_id, url, html; other columns are not read).

    A null or empty page, or one without main text, gives an empty text. A null url or one without a host has no template.
    Repeated pages and ids are rows of their own. An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.min(F.xxhash64("html")).alias("h"))
    hosts = stored(hosts.where(F.col("n") >= least_pages).select(F.col("host").alias("o"), "h"), "html-hosts")
    chosen = pages.join(_by_host(hosts, "o"), (F.col("host") == F.col("o")) & (F.xxhash64("html") == F.col("h"))).select("host", "html")
    references = chosen.mapInArrow(_outliner, "host string, tree string").groupBy("host").agg(F.min("tree").alias("tree"))
    references = stored(references, "html-references")

    near = pages.join(_by_host(references, "tree"), "host").select("host", "html", "tree")
    seen = near.mapInArrow(_aligner, "host string, article string, votes array<long>")
    seen = seen.groupBy("host", "article").agg(F.min("votes").alias("votes")).select("host", F.explode("votes").alias("vote"))
    seen = seen.groupBy("host", F.shiftright("vote", 1).alias("slot")).agg(F.count("*").alias("aligned"), F.sum(F.col("vote").bitwiseAND(1)).alias("same"))
    fixed = seen.where((F.col("aligned") >= least_pages) & (F.col("same") >= share * F.col("aligned")))
    wrappers = references.join(fixed.groupBy("host").agg(F.collect_set("slot").alias("slots")), "host", "left")
    wrappers = stored(wrappers.withColumnRenamed("host", "o"), "html-wrappers")
    discard(hosts)
    joined = pages.join(_by_host(wrappers, "tree"), F.col("host") == F.col("o"), "left")
    return joined.select("page_id", "url", "host", "html", "tree", "slots").mapInArrow(_extractor, "page_id long, url string, text string")
