"""Main text of web pages: site templates are found as recurring subtrees and removed.

Every page is parsed into elements. First each container element's subtree is hashed in
two ways, and the different pages of a host that hold it are counted in Spark: with its
texts (tag, text and parts), and, where it is a menu outside of any article (half of its
text or more is in links), by its shape alone (tags, classes, runs of equal parts as
one), as menus list other links on every page. Subtrees on many of a host's pages are
its template. Then each page's main parts (all of them, else body) are written block by
block, without template subtrees, and without elements that are no content by tag, role
or class, for what hosts of few pages have.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import at_most, durable

#: Template subtrees up to which all are sent to every task.
SMALL = 200_000
#: Fixed values of HTML: elements without content, with raw text, those a new one of the same kind ends, and blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("aside details div dl fieldset figure footer form header nav ol section table ul".split())
#: What is no content: by tag, by role, and by a whole name of the class or id; elements that hold the content are never judged by names.
NOT_TAGS = RAW | set("nav header footer aside form button select svg head dialog menu canvas object video audio".split())
NOT_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOT_WORDS = set("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing newsletter subscribe signup popup modal pagination pager comment comments commentlist disqus replies".split())
BY_TAG = set("html body main article figure".split())
NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")


class Element:
    __slots__ = ("digest", "drop", "linked", "menu", "names", "parts", "shape", "size", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.parts, self.names = tag, [], ""
        self.digest, self.shape, self.menu, self.size, self.linked = b"", b"", b"", 0, 0
        self.drop = tag in NOT_TAGS
        if attrs:
            for k, v in ATTR.findall(attrs):
                k, v = k.lower(), v.strip("\"'").lower()
                if k == "class":
                    self.names = " ".join(v.split())
                if (k == "role" and v in NOT_ROLES) or (k in ("class", "id") and tag not in BY_TAG and not NOT_WORDS.isdisjoint(v.split())):
                    self.drop = True


def tag_end(page: str, at: int, lone: set[str]) -> int:
    """The place behind the > that ends a tag, quoted ones left out; -1 if the page ends before. ``lone`` holds quotes that are never closed."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        end = -1 if m[0] in lone else page.find(m[0], m.end())
        if end < 0:
            lone.add(m[0])
        at = m.end() if end < 0 else end + 1
    return -1


def parse(page: str) -> Element:
    """The page as a tree; what isn't closed ends with its parent, a closing tag without an opening one is nothing.

    Every character is passed a few times at most, however broken the page is; a tag that
    the page's end cuts is no text.
    """
    root = Element("#root")
    stack, at, size = [root], 0, len(page)
    depth: Counter = Counter()
    lone: set[str] = set()

    def close(k: int) -> None:
        depth.subtract(e.tag for e in stack[k:])
        del stack[k:]

    while at < size:
        start = page.find("<", at)
        if start < 0:
            stack[-1].parts.append(page[at:])
            break
        if start > at:
            stack[-1].parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("/", start + 1)
        m = NAME.match(page, start + 1 + closing)
        if m is None:
            if closing or page.startswith(("!", "?"), start + 1):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                stack[-1].parts.append("<")
                at = start + 1
            continue
        end = tag_end(page, m.end(), lone)
        if end < 0:
            break
        tag, attrs, at = m[0].lower(), page[m.end() : end - 1], end
        if closing:
            if depth[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        ends = ENDS.get(tag) or ({"p"} if tag in BLOCKS else ())
        if any(depth[t] for t in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in CONTAINERS or stack[k].tag in ("article", "main", "body", "table"):
                    break
        new = Element(tag, attrs)
        stack[-1].parts.append(new)
        if tag in RAW:
            last = re.compile(rf"</{tag}(?![A-Za-z0-9:-])", re.I).search(page, at)
            end = page.find(">", last.end()) if last else -1
            at = size if end < 0 else end + 1
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(new)
            depth[tag] += 1
    return root


def digests(element: Element) -> Iterator[bytes]:
    """Hashes of the subtrees of containers; deep pages are walked with a list of steps, not by recursion."""
    todo = [(element, False, False)]
    while todo:
        e, ready, own = todo.pop()
        if not ready:
            todo.append((e, True, own))
            inside = own or e.tag == "article"
            todo += [(p, False, inside) for p in e.parts if isinstance(p, Element)]
            continue
        h, shape, before = hashlib.md5(e.tag.encode(), usedforsecurity=False), hashlib.md5(f"{e.tag} {e.names}".encode(errors="replace"), usedforsecurity=False), b""
        for p in e.parts:
            if isinstance(p, Element):
                h.update(p.digest)
                e.size, e.linked, now = e.size + p.size, e.linked + p.linked, p.shape
            else:
                text = " ".join((html.unescape(p) if "&" in p else p).split())
                h.update(text.encode(errors="replace"))
                e.size, now = e.size + len(text), b"text" if text else before
            if now != before:
                shape.update(now)
                before = now
        if e.tag == "a":
            e.linked = e.size
        e.digest, e.shape = h.digest()[:8], shape.digest()[:8]
        if e.tag in CONTAINERS:
            yield e.digest
        if e.tag in CONTAINERS and not own and e.size and 2 * e.linked >= e.size:
            e.menu = e.shape
            yield e.menu


def main_parts(root: Element) -> list[Element]:
    """The outermost main elements, else the body, else all."""
    found: dict[str, list[Element]] = {"main": [], "body": []}
    todo = [root]
    while todo:
        e = todo.pop()
        if e.drop:
            continue
        if e.tag in found:
            found[e.tag].append(e)
            if e.tag == "main":
                continue
        todo += [p for p in reversed(e.parts) if isinstance(p, Element)]
    return found["main"] or found["body"][:1] or [root]


def main_text(root: Element, template: set[bytes]) -> str:
    """The main parts' blocks, joined by one line feed."""
    blocks, run = [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    for part in main_parts(root):
        todo: list = [part]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                run.append(e)
            elif e is None:
                flush()
            elif e.tag == "br":
                run.append(" ")
            elif not (e.drop or (e.tag in CONTAINERS and (e.digest in template or e.menu in template))):
                if e.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo += [html.unescape(p) if isinstance(p, str) else p for p in reversed(e.parts)]
        flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    """The url's host in lower case without a port; the empty string if it has none."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", (url or "").strip(), re.I)
    return m[1].lower() if m else ""


def subtree_key(host: str, digest: bytes) -> int:
    """A host's subtree as one number."""
    return int.from_bytes(hashlib.md5(digest + host.encode(errors="replace"), usedforsecurity=False).digest()[:8], "big", signed=True)


def page_key() -> Column:
    """The same for rows of equal url and html."""
    return F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))


def subtree_rows(pages: DataFrame) -> DataFrame:
    """host, page (its key), content (hash of its main text), subtree: each distinct container of a page (null for the page's own row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, contents, found = [], [], [], []
            for url, page, key in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                host, root = host_of(url.as_py()), parse(page.as_py() or "")
                own = [None, *(subtree_key(host, d) for d in dict.fromkeys(digests(root)))]
                content = hashlib.md5(main_text(root, set()).encode(errors="replace"), usedforsecurity=False).digest()
                hosts += [host] * len(own)
                keys += [key.as_py()] * len(own)
                contents += [int.from_bytes(content[:8], "big", signed=True)] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (keys, contents, found))], ["host", "page", "content", "subtree"]
            )

    return pages.select("url", "html", page_key().alias("page")).mapInArrow(run, "host string, page long, content long, subtree long")


def templates(rows: DataFrame, min_pages: int, percent: int, ceiling: int) -> DataFrame:
    """The subtrees on over ``min_pages`` pages of a host, and on over ``percent`` of them or over ``ceiling``; pages of one main text count once."""
    different = rows.groupBy("host", "subtree", "content").agg(F.lit(1).alias("one"))
    counts = durable(different.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(f"subtree is null or n > {min_pages}"))
    of_host = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = counts.where("subtree is not null").join(of_host, "host")
    return often.where((F.col("n") * 100 > F.col("pages") * percent) | (F.col("n") > ceiling)).select("subtree")


def page_text(pages: DataFrame, min_pages: int = 5, percent: int = 20, ceiling: int = 20) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    Returns page_id, url, text (blocks in page order, one to a line, references decoded,
    white space runs as one space; empty if there is none) and n_chars (its code points).
    White space is what Unicode says it is, U+00A0 (``&nbsp;``) among it. A null or empty html gives the empty text; a url that is null or has no host belongs
    to the host "". Repeated rows each give a row; for templates pages of one main text
    count once. An empty table gives an empty result. Paragraphs, headings and list items
    are never taken for a template, however often they recur, nor are menus within an
    article unless their texts recur; other columns are not read. Pages are parsed whole,
    in time proportional to their length.
    """
    types = dict(pages.dtypes)
    found = durable(subtree_rows(pages))
    often = durable(templates(found, min_pages, percent, ceiling))
    everywhere = None
    rows = pages.select("page_id", "url", "html")
    if at_most(often, SMALL):
        everywhere = pages.sparkSession.sparkContext.broadcast(frozenset(r.subtree for r in often.collect()))
        rows = rows.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        held = found.join(often.distinct().hint("merge"), "subtree", "left_semi").groupBy("page").agg(F.collect_set("subtree").alias("template"))
        rows = rows.withColumn("page", page_key()).join(durable(held), "page", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for url, page, own in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                root, host = parse(page.as_py() or ""), host_of(url.as_py())
                known = everywhere.value if everywhere is not None else set(own.as_py() or ())
                texts.append(main_text(root, {d for d in set(digests(root)) if subtree_key(host, d) in known} if known else set()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
