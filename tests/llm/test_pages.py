"""Main texts of generated sites against plain recursion over the trees that the pages are written from."""

import html
import random
from collections import defaultdict

import pytest

from sparkloom.llm import html_text as H

WORDS = "alpha beta gamma delta é 中文 a<b x&y \"q\" it's".split()


class Page:
    """A node: tag, attributes, and children that are nodes or texts."""

    def __init__(self, tag, children=(), **attrs):
        self.tag, self.children, self.attrs = tag, list(children), {k.rstrip("_"): v for k, v in attrs.items()}

    def write(self, rng):
        attrs = "".join(f' {k}="{v}"' if rng.random() < 0.5 else f" {k.upper()} = '{v}'" for k, v in self.attrs.items())
        tag = self.tag.upper() if rng.random() < 0.3 else self.tag
        inner = "".join(c.write(rng) if isinstance(c, Page) else written(c, rng) for c in self.children)
        return f"<{tag}{attrs}>{inner}</{self.tag}>"


def written(text, rng):
    out = "".join(f"&#{ord(c)};" if rng.random() < 0.05 else html.escape(c, quote=rng.random() < 0.5) for c in text)
    return out.replace(" ", rng.choice([" ", "\n  ", "\t", "&nbsp;", " "]))


def squeezed(text):
    return " ".join(text.split())


def dropped(n):
    words = {w for k in ("class", "id") for w in n.attrs.get(k, "").lower().split()}
    named = n.tag not in H.BY_TAG and not H.NOT_WORDS.isdisjoint(words)
    return n.tag in H.NOT_TAGS or n.attrs.get("role", "") in H.NOT_ROLES or named


def content(n):
    """A subtree with its texts, as one string."""
    return f"<{n.tag}:" + "".join(content(c) if isinstance(c, Page) else squeezed(c) for c in n.children) + ">"


def shape(n):
    """A subtree without its texts, runs of equal parts as one."""
    parts = [shape(c) if isinstance(c, Page) else "text" for c in n.children if isinstance(c, Page) or squeezed(c)]
    return f"<{n.tag} {n.attrs.get('class', '')}:" + "|".join(p for k, p in enumerate(parts) if k == 0 or parts[k - 1] != p) + ">"


def letters(n, linked=False):
    own = sum(letters(c, linked) if isinstance(c, Page) else len(squeezed(c)) * (not linked) for c in n.children)
    return sum(letters(c) if isinstance(c, Page) else len(squeezed(c)) for c in n.children) if linked and n.tag == "a" else own


def subtrees(n, in_article=False):
    """What can be a template: containers by their texts, and menus outside of articles by their shape."""
    if n.tag in H.CONTAINERS:
        yield "text", content(n)
        if is_menu(n, in_article):
            yield "menu", shape(n)
    for c in n.children:
        if isinstance(c, Page):
            yield from subtrees(c, in_article or n.tag == "article")


def is_menu(n, in_article):
    return n.tag in H.CONTAINERS and not in_article and letters(n) > 0 and 2 * letters(n, True) >= letters(n)


def outermost(n, tag):
    if dropped(n):
        return []
    return [n] if n.tag == tag else [m for c in n.children if isinstance(c, Page) for m in outermost(c, tag)]


def blocks_of(n, template, in_article):
    """Texts of blocks in order; None stands for a block's edge."""
    if dropped(n) or (n.tag in H.CONTAINERS and (("text", content(n)) in template or (is_menu(n, in_article) and ("menu", shape(n)) in template))):
        return []
    inner = []
    for c in n.children:
        inner += [c] if isinstance(c, str) else blocks_of(c, template, in_article or n.tag == "article")
    return [None, *inner, None] if n.tag in H.BLOCKS else inner


def text_of(page, template):
    mains = outermost(page, "main") or outermost(page, "body")[:1]
    out = []
    for m in mains:
        run = [None, *blocks_of(m, template, False), None]
        block = []
        for x in run:
            if x is None:
                out += [squeezed("".join(block))]
                block = []
            else:
                block.append(x)
    return "\n".join(b for b in out if b)


def site(rng, pages):
    """Pages of a site: some share a menu, a box, a footer without a name, or a whole article."""
    words = lambda n: " ".join(rng.choices(WORDS, k=n))
    links = lambda: Page("ul", [Page("li", [Page("a", [words(1)], href="/x")]) for _ in range(rng.randrange(2, 5))], class_="list")
    box = Page("div", [Page("p", [words(6)]), Page("div", [words(3)])])
    foot = Page("section", [words(4), Page("span", [words(2)])])
    rare = Page("div", [Page("p", [words(5)])])
    articles = [[Page("p", [words(8), Page("b", [words(2)]), " " + words(3)]), Page("div", [Page("h2", [words(2)]), words(5)]), Page("aside", [words(3)])] for _ in range(max(2, pages * 2 // 3))]
    out = []
    for k in range(pages):
        parts = [Page("article", [*rng.choice(articles), links()])]
        parts += [Page("p", [words(3)])] if rng.random() < 0.5 else []
        parts += [box] if rng.random() < 0.7 else []
        parts += [rare] if k < 3 else []
        parts += [foot] if rng.random() < 0.4 else []
        parts += [Page("div", [words(4)], class_="comments x")] if rng.random() < 0.3 else []
        rng.shuffle(parts)
        inner = [Page("main", parts)] if rng.random() < 0.3 else parts
        out.append(Page("html", [Page("head", [Page("title", ["t"])]), Page("body", [links(), *inner, Page("script", ["x = '<p>'"]), Page("footer", [words(2)])], class_="menu")]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_generated_sites(spark, seed):
    rng = random.Random(seed)
    sites = {f"h{n}.org": site(rng, n) for n in (1, 5, 9, 40, 130)}
    rows, wanted = [], {}
    for host, pages in sites.items():
        plain = [text_of(p, set()) for p in pages]
        held = defaultdict(set)
        for p, text in zip(pages, plain, strict=True):
            for s in set(subtrees(p)):
                held[s].add(text)
        different = len(set(plain))
        template = {s for s, texts in held.items() if len(texts) > 5 and (100 * len(texts) > 20 * different or len(texts) > 20)}
        for p in pages:
            key = len(rows)
            rows.append((key, f"https://{host.upper()}:80/{key}", p.write(rng), key))
            wanted[key] = text_of(p, template)
        assert host != "h40.org" or any(t != text_of(p, set()) for p, t in zip(pages, [text_of(p, template) for p in pages], strict=True))
    got = H.page_text(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert {r.page_id: r.text for r in got.collect()} == wanted
