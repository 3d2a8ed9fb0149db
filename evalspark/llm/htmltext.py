"""Main-text extraction by tag-path ratios.

A page is read once into blocks (runs of text between block-level tags) whose path is
the tags from the root to the block. Per path, text length outside links and punctuation
are summed over its nodes: mean text length and mean punctuation are the two path ratios.
Each is smoothed with the mean of the sibling paths (same parent), both are fused by their
product, and paths reaching a share of the fused values' spread are content. The smallest
element that holds all content nodes is the article's place. Within it, content paths
stay; of the others, paths that are mostly links go (with the headings over them), and so
do text runs after the last content node, unless they stand in a paragraph, list, table or
heading, so short lines and headings of the article stay. Where that place is the whole
body, only the content nodes count.

Class, id and role are a further signal: boxes named as comments, adverts, notices, menus
and the like are furniture, unless such a box holds most of the page's fused ratios and
what is outside all such boxes holds little (and no title that the box lacks).

Reading is linear in the page, whatever its nesting: paths are interned numbers.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm.common import short_batches, table

#: Weight of the sibling paths in smoothing, and the threshold in standard deviations.
SMOOTH = 0.3
THRESHOLD = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when a sibling of the set starts, up to the scope that contains them.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("html body article section div table ul ol dl form main aside nav header footer blockquote".split())
FURNITURE_TAGS = frozenset("head nav footer aside form menu dialog header fieldset".split())
#: Furniture by a word of a class or id name, as in cookie-notice, post_comments and siteFooter.
FURNITURE_WORDS = frozenset(
    "ad ads adsbygoogle adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice "
    "notices pagination popup promo promoted reactions related replies respond responses share sharing sidebar sidenav signup skip "
    "social sponsor sponsored subscribe subnav toolbar topnav widget".split())
#: Furniture only as the whole name, or as these two words beside each other.
FURNITURE_WHOLE = frozenset("hidden tags".split())
FURNITURE_PAIRS = frozenset([("author", "box"), ("author", "bio"), ("author", "card"), ("about", "author")])
#: Words that turn a name round or make it one of the layout: no-sidebar, has-comments, with-ads.
TURNS = frozenset("no not non has have with without is hide show disable free".split())
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Tags that are furniture whatever they hold.
NEVER_CONTENT = frozenset("head nav menu footer".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
ARTICLE_TAGS = frozenset(["article", "main"])

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]++)))?")
PUNCTUATION = re.compile(r"[^\w\s]")


def is_furniture_name(name: str) -> bool:
    """Whether a class or id name says page furniture."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if name.lower() in FURNITURE_WHOLE:
        return True
    return TURNS.isdisjoint(words) and (not FURNITURE_WORDS.isdisjoint(words) or not FURNITURE_PAIRS.isdisjoint(zip(words, words[1:])))


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element by its tag, class, id or role is page furniture, not article."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape(a or b or c).strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name in ("class", "id") and any(map(is_furniture_name, value.split())):
            return True
    return False


Block = tuple[str, int, int, int]  # text, path, element, characters of it in links


def read_blocks(page: str) -> tuple[list[Block], list[tuple[int, str]], list[int]]:
    """(blocks outside furniture, (parent, tag) of each element, parent of each path)."""
    blocks: list[Block] = []
    marks: list[tuple[int, bool]] = []  # innermost furniture of each block, 0 for none; whether an article holds the block
    furnitures: list[tuple[int, str]] = [(0, "")]  # enclosing furniture element and tag of each
    elements: list[tuple[int, str]] = [(-1, "")]
    path_parent = [-1]
    path_ids: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, path, element, innermost furniture
    open_tags: dict[str, int] = defaultdict(int)
    pieces: list[str] = []
    in_links: list[str] = []

    def add(text: str) -> None:
        pieces.append(text)
        if open_tags["a"] > 0:
            in_links.append(text)

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        linked = len(" ".join("".join(in_links).split()))
        pieces.clear()
        in_links.clear()
        if text:
            k = len(stack) - 1
            while stack[k][0] and stack[k][0] not in BLOCK:
                k -= 1
            blocks.append((text, stack[k][1], stack[k][2], linked))
            marks.append((stack[-1][3], open_tags["article"] > 0 or open_tags["main"] > 0))

    def pop() -> None:
        open_tags[stack.pop()[0]] -= 1

    def close_within(tags: set[str]) -> None:
        """End the innermost open element of ``tags`` unless a scope is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in SCOPES:
                return

    at, raw = 0, None
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            add(entities.unescape(page[at:m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if open_tags["p"] > 0:
                close_within({"p"})
        if tag in ENDED_BY:
            close_within(ENDED_BY[tag])
        attributes = m[3] or m[6] or ""
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            raw = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = raw.end() if raw else len(page)
            continue
        _, path, element, furniture = stack[-1]
        if tag in BLOCK:
            child = path_ids.setdefault((path, tag), len(path_parent))
            if child == len(path_parent):
                path_parent.append(path)
            elements.append((element, tag))
            in_article = open_tags["article"] > 0 or open_tags["main"] > 0
            path, element = child, len(elements) - 1
        else:
            in_article = True
        if is_furniture(tag, attributes, in_article):
            furnitures.append((furniture, tag))
            furniture = len(furnitures) - 1
        stack.append((tag, path, element, furniture))
        open_tags[tag] += 1
    if at < len(page):
        add(entities.unescape(page[at:]))
    flush()
    if 10 * sum(b[3] for b in blocks) > 9 * sum(len(b[0]) for b in blocks):  # a link left open over the page
        blocks = [(*b[:3], 0) for b in blocks]
    if len(furnitures) > 1:
        blocks = without_furniture(blocks, marks, furnitures, elements, path_parent)
    return blocks, elements, path_parent


def without_furniture(blocks: list[Block], marks: list[tuple[int, bool]], furnitures: list[tuple[int, str]],
                      elements: list[tuple[int, str]], path_parent: list[int]) -> list[Block]:
    """``blocks`` outside furniture. What holds most of the page's fused ratios is none, unless there is an article or a title besides."""
    fused = fused_ratios(blocks, path_parent)
    mass, titles = [0.0] * len(furnitures), [0] * len(furnitures)
    article = 0.0  # of articles outside furniture
    for (_, path, element, _), (furniture, in_article) in zip(blocks, marks):
        mass[furniture] += fused[path]
        titles[furniture] += elements[element][1] == "h1"
        article += fused[path] if in_article and not furniture else 0.0
    clear_title = titles[0] > 0
    for k in range(len(furnitures) - 1, 0, -1):  # inner ones come after those that hold them
        mass[furnitures[k][0]] += mass[k]
        titles[furnitures[k][0]] += titles[k]
    away = [False] * len(furnitures)
    for k, (outer, tag) in enumerate(furnitures[1:], 1):
        kept = (2 * mass[k] > mass[0] and 4 * article < mass[0] and (titles[k] > 0 or not clear_title)
                and tag not in NEVER_CONTENT)
        away[k] = away[outer] or not kept
    return [b for b, (furniture, _) in zip(blocks, marks) if not away[furniture]]


def fused_ratios(blocks: list[Block], path_parent: list[int]) -> dict[int, float]:
    """Smoothed, fused ratio of text outside links and of punctuation of each path."""
    length, points, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for text, path, _, linked in blocks:
        length[path] += max(0, len(text) - linked)
        points[path] += len(PUNCTUATION.findall(text))
        nodes[path] += 1
    paths = list(nodes)
    siblings = defaultdict(list)
    for p in paths:
        siblings[path_parent[p]].append(p)

    def smooth(total: dict[int, int]) -> dict[int, float]:
        ratio = {p: total[p] / nodes[p] for p in paths}
        mean = {k: sum(ratio[p] for p in v) / len(v) for k, v in siblings.items()}
        return {p: (1 - SMOOTH) * ratio[p] + SMOOTH * mean[path_parent[p]] for p in paths}

    by_text, by_points = smooth(length), smooth(points)
    return {p: by_text[p] * (1 + by_points[p]) for p in paths}


def content_paths(blocks: list[Block], path_parent: list[int]) -> set[int]:
    """Paths whose smoothed, fused text and punctuation ratio reaches the threshold."""
    fused = fused_ratios(blocks, path_parent)
    if not fused:
        return set()
    mean = sum(fused.values()) / len(fused)
    spread = (sum((v - mean) ** 2 for v in fused.values()) / len(fused)) ** 0.5
    return {p for p in fused if fused[p] >= THRESHOLD * spread and fused[p] > 0} or {max(fused, key=fused.get)}


def article_blocks(blocks: list[Block], elements: list[tuple[int, str]], chosen: set[int], place: list[int]) -> list[int]:
    """Of the blocks at ``place``, the article's: without link lists and loose text after the last content node."""
    length, linked = defaultdict(int), defaultdict(int)
    for i in place:
        length[blocks[i][1]] += len(blocks[i][0])
        linked[blocks[i][1]] += blocks[i][3]
    last = max((i for i in place if blocks[i][1] in chosen), default=-1)
    stays = {}
    for i in place:
        _, path, element, _ = blocks[i]
        tag = elements[element][1]
        menu = 2 * linked[path] > length[path] and tag not in HEADINGS
        stays[i] = path in chosen or not menu and (i < last or tag in LEAVES)
    above = False  # whether only furniture follows up to the next heading or the end
    for k in range(len(place) - 1, -1, -1):
        tag = elements[blocks[place[k]][2]][1]
        if tag not in HEADINGS:
            above = not stays[place[k]] and (above or k + 1 == len(place) or elements[blocks[place[k + 1]][2]][1] in HEADINGS)
        elif above and tag != "h1":
            stays[place[k]] = False
    return [i for i in place if stays[i]] or place


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by newlines; empty for null, empty and text-free pages."""
    if not page:
        return ""
    blocks, elements, path_parent = read_blocks(page)
    if not blocks:
        return ""
    chosen = content_paths(blocks, path_parent)
    mass: dict[int, int] = defaultdict(int)  # selected text below each element
    for text, path, element, _ in blocks:
        if path in chosen:
            mass[element] += len(text)
    total = sum(mass.values())
    for element in range(len(elements) - 1, 0, -1):  # children come after their parents
        if mass.get(element):
            mass[elements[element][0]] += mass[element]
    articles = [e for e in range(1, len(elements)) if elements[e][1] in ARTICLE_TAGS and 2 * mass.get(e, 0) >= total]
    if articles:
        container = articles[-1]
    else:
        container = max(e for e in range(len(elements)) if mass.get(e, 0) == total)
        while elements[container][1] in LEAVES:  # a single paragraph: its surroundings are the article
            container = elements[container][0]
    inside = [False] * len(elements)
    inside[container] = True
    for e in range(container + 1, len(elements)):
        inside[e] = inside[elements[e][0]]
    if articles or elements[container][1] not in ("", "html", "body"):
        place = [i for i, b in enumerate(blocks) if inside[b[2]]]
        return "\n".join(blocks[i][0] for i in article_blocks(blocks, elements, chosen, place))
    picked = [i for i, b in enumerate(blocks) if b[1] in chosen]
    keep = set(picked)
    keep.update(i for i in range(max(0, picked[0] - 1), picked[-1]) if elements[blocks[i][2]][1] in HEADINGS)
    return "\n".join(blocks[i][0] for i in sorted(keep))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars per row of ``pages(page_id, url, html)``; html null counts as empty.

    One row per row; page_id and url, null or repeated, are only carried.
    """

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in htmls], dtype="object")

    return (short_batches(pages).select("page_id", "url", text("html").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: main text of every page."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
