"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors, discounted by link density; the best container and
those siblings that score well are kept, without what a page carries around its article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Element names of HTML and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas video audio xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav aside footer form button select dialog menu input fieldset label search".split()) | RAW
CLOSES_P = BLOCK - {"br", "html", "body", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|hidden|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|pager|pagination|popup|promo|related|replies|respond|share|sharing|sidebar|site-?header|skyscraper|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])", re.I
)
#: Words that stand beside those in names of such parts. Within an article a name counts only if it is made of both: "share-bar" does, "share-of-market" does not.
BESIDE = frozenset("area bar block body bottom box btn button buttons container content count form group header heading icons inner item items left link links list main outer page panel post posts right section site tags title tool tools top wrap wrapper".split())
LIKELY = re.compile(r"article|body|content|entry|hentry|main|page|post|story|text", re.I)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|[^<]+|<(?![a-zA-Z/])|<(?=/[^a-zA-Z]|/\Z)""", re.S)
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")  # a tag with an unclosed quotation mark ends at the first >
CONTAINER = frozenset("div section ul ol dl table aside nav header footer form article main center figure details menu".split())
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main figcaption".split())


class Node:
    __slots__ = ("tag", "name", "parent", "kids", "drop", "named", "doubtful", "score", "text", "links")

    def __init__(self, tag: str, parent: Node | None, name: str = "", drop: bool = False):
        self.tag, self.parent, self.name, self.drop = tag, parent, name, drop
        self.named = False  # dropped for its name alone
        self.doubtful = False  # named alike, but within an article: its links decide
        self.kids: list[Node | str] = []
        self.score, self.text, self.links = 0.0, 0, 0


def wholly_unlikely(name: str) -> bool:
    """Whether one of the names has an unlikely word and else only words that stand beside such."""
    for one in name.split():
        parts = [x for x in re.split(r"[-_]+", one.lower()) if x]
        if any(UNLIKELY.search(x) for x in parts) and all(x in BESIDE or x.isdigit() or UNLIKELY.search(x) for x in parts):
            return True
    return False


def parse(page: str) -> Node:
    """A tolerant tree: unclosed paragraphs, items and cells end where the next begins; stray end tags are ignored."""
    root = node = Node("html", None)
    at, n, opened, mains = 0, len(page), Counter(), []

    def leave(up: Node) -> Node:
        """Close what is open below ``up``."""
        x = node
        while x is not up:
            opened[x.tag] -= 1
            x = x.parent
        return up

    while at < n:
        m = TOKEN.match(page, at) or BROKEN.match(page, at)
        if not m:  # a tag that never ends: the rest is text
            node.kids.append(html.unescape(page[at:]))
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                node.kids.append(html.unescape(m[0]))
            continue
        if m[1]:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up.parent)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and opened["p"]:
            up = node
            while up.tag not in ("p", "table", "td", "th", "button") and up.parent is not None:
                up = up.parent
            if up.tag == "p":
                node = leave(up.parent)
        if tag in SELF_CLOSING and any(opened[x] for x in SELF_CLOSING[tag]):
            up = node
            while up.tag not in SELF_CLOSING[tag] and up.tag not in SCOPE[tag] and up.parent is not None:
                up = up.parent
            if up.tag in SELF_CLOSING[tag]:
                node = leave(up.parent)
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(m[3])} if m[3].strip() else {}
        name = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        if tag == "header":
            hidden = hidden or not (opened["article"] or opened["main"])
        main = tag in ("article", "main")
        unlikely = bool(name and tag in CONTAINER and UNLIKELY.search(name))
        drop = tag in DROPPED or hidden or attrs.get("role", "").lower() in ROLES
        new = Node(tag, node, name, drop)
        if main and not unlikely:
            mains.append(new)
        elif unlikely and not drop and not main:
            if (opened["article"] or opened["main"]) and not wholly_unlikely(name):
                new.doubtful = True
            else:
                new.drop = new.named = True
        node.kids.append(new)
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            node = new
            opened[tag] += 1
    # Where every article lies in parts dropped for their names, the names mislead: what holds an article stays.
    seen: set[int] = set()
    held = []
    for new in mains:
        up, some = new, []
        while up is not None and id(up) not in seen:
            seen.add(id(up))
            some += [up] if up.drop else []
            up = up.parent
        if up is None and not some:
            return root
        held += some
    for up in held:
        if up.named:
            up.drop = False
    return root


def walk(root: Node) -> list[Node]:
    """Nodes that are not dropped, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.drop]
    return order


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below the nodes, in page order, white space made plain."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if line := " ".join("".join(run).split()):
            out.append(line)
        run.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.drop:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page and for one that holds no text outside its frame."""
    root = parse(page or "")
    order = walk(root)
    for node in reversed(order):
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        kids = [k for k in node.kids if isinstance(k, Node) and not k.drop]
        node.text = own + sum(k.text for k in kids)
        node.links = node.text if node.tag == "a" else sum(k.links for k in kids)
        if node.doubtful and node.links > 0.5 * node.text:
            node.drop = True
            continue
        if node.tag in PARAGRAPH and node.parent is not None:
            inline = own + sum(k.text for k in kids if k.tag not in BLOCK)
            if inline >= 25:
                commas = sum(k.count(",") for k in node.kids if isinstance(k, str))
                points = 1 + commas + min(3.0, inline / 100)
                up, share = node.parent, 1.0
                while up is not None and share > 0.2:
                    up.score += points * share
                    up, share = up.parent, share / 2
    if not root.text:
        return ""
    order = walk(root)  # without what the links decided
    for node in order:
        node.score += {"article": 25, "main": 20, "section": 3, "div": 2}.get(node.tag, 0) * (node.text > 0) + 5 * bool(node.name and LIKELY.search(node.name))
        node.score *= 1 - node.links / max(1, node.text)
    best = max(order, key=lambda x: (x.score, x.text))
    if best.parent is None:
        return " ".join(blocks([best]))
    least = max(10.0, 0.2 * best.score)
    beside = [k for k in best.parent.kids if isinstance(k, Node) and not k.drop]
    alike = lambda k: k.score + (0.2 * best.score if k.name and k.name == best.name else 0) >= least
    prose = lambda k: k.tag == "p" and best.tag not in ("article", "main") and k.links <= 0.25 * k.text
    return " ".join(blocks([k for k in beside if k is best or alike(k) or prose(k)]))


def extract(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)``, one for each page; null html gives an empty text. Other columns are ignored."""

    @pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(p) for p in s], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
