"""Main text of web pages by site template removal: element subtrees are hashed, counted for each host in Spark, and those that recur across many
pages of their host are deleted.

1. Every page becomes a tree of elements with its text blocks (``Tree``, one pass, open ends and missing tags closed as browsers do). A subtree's hash
   comes from its tag and the hashes of its blocks and subtrees, so a page costs time in proportion to its length. Only containers (div, ul,
   nav, table, ...) are counted; a paragraph or heading is never a template by itself.
2. Spark counts, for each host and hash, the distinct contents (hash of the page's main part) it appears with, so copies of a page count once, and joins
   the templates, those on ``LEAST`` and one in ``SHARE`` of the host's contents at least, back by host. A host's list is bounded by ``SHARE``
   times what a page holds on average; nothing is gathered but these lists, which are broadcast up to ``BROADCAST_BYTES`` and joined by
   shuffle beyond that.
3. A page's text is what is left of its main part: the articles, else the main element, else the body. Templates go, wherever they are outside of
   an article; inside one only where most of their text is links, as passages that articles share are content. As a host may have one page only, elements
   whose tag, role, id or class says that they are no content go too (menus, headers, footers, sidebars, notices, adverts, forms, comments,
   hidden ones), unless they hold the page's main part.

Defined results: a null or empty html, and a page without content, give an empty text; a null or hostless url counts as one host named by the empty text; rows
that repeat a page_id are pages of their own, equal ones count once for templates; no pages give no rows; other columns are ignored. Texts are whole,
whatever their length; ``<br>`` is white space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import saved, small_batches, table

#: Contents of a host that a subtree must recur with to be a template: so many at least, and one in SHARE of them.
LEAST, SHARE = 4, 10
#: Bytes of templates that are broadcast, at most.
BROADCAST_BYTES = 16 << 20
#: Pages that Python holds at once.
PAGES = 200

BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
             "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("aside details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text for readers, and those that are no content whatever their place.
SILENT = set("script style noscript template head title svg math object iframe canvas audio video datalist textarea".split())
ASIDE = set("nav footer aside form menu dialog search header select button".split())
IN_HEAD = set("title meta link base script style noscript template".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr hidden masthead menu modal nav navbar navigation "
            "newsletter notice notices notification paywall popup promo promoted promotion related replies respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Open elements that a start tag closes, up to the nearest element of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
CLOSES["tfoot"] = CLOSES["thead"] = CLOSES["tbody"]
ARTICLE, MAIN, OTHER = 2, 1, 0
PART = re.compile(r"[^a-z0-9]+")


def digest(*parts: bytes) -> bytes:
    h = blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return h.digest()


class Tree(HTMLParser):
    """Elements of a page in order, as parallel lists: tag, parent, first and last block, hash, characters of text and of links; and the blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.first, self.last, self.hash = ["#root"], [-1], [0], [0], [b""]
        self.kind, self.out, self.said = [OTHER], [False], [False]
        self.chars, self.links = [0], [0]
        self.blocks: list[str] = []
        self.owner: list[int] = []
        self._kids: list[list[bytes]] = [[]]
        self._stack, self._open, self._buffer, self._silent, self._linked, self._mute = [0], Counter(), [], None, 0, 0
        at = html.rfind("<")
        self.feed(html[:at] if at > html.rfind(">") and html[at + 1:at + 2].isalpha() | (html[at + 1:at + 2] in ("/", "!")) else html)  # a tag without an end
        self.close()
        self._flush()
        while len(self._stack) > 1:
            self._pop()
        self.last[0] = len(self.blocks)

    def _flush(self) -> None:
        text = " ".join("".join(self._buffer).split())
        self._buffer.clear()
        if text:
            at = self._stack[-1]
            self.blocks.append(text)
            self.owner.append(at)
            self._kids[-1].append(digest(text.encode("utf-8", "surrogatepass")))

    def _pop(self) -> None:
        if len(self._stack) - 1 == self._mute:
            self._mute = 0
        at = self._stack.pop()
        self._open[self.tag[at]] -= 1
        self.last[at] = len(self.blocks)
        kids = self._kids.pop()
        up = self._stack[-1]
        self.chars[up] += self.chars[at]
        self.links[up] += self.links[at]
        if self.tag[at] == "a":
            self._linked -= 1
        if self.tag[at] in BLOCKS:
            if kids:
                self.hash[at] = digest(self.tag[at].encode(), b"\0", *kids)
                self._kids[-1].append(self.hash[at])
        else:
            self._kids[-1].extend(kids)

    def _push(self, tag: str, attrs: list) -> None:
        given = {k: (v or "") for k, v in attrs} if attrs else {}
        role = given.get("role", "").lower().strip()
        names = set(PART.split(f"{given.get('class', '')} {given.get('id', '')}".lower())) if "class" in given or "id" in given else set()
        style = given.get("style", "").lower().replace(" ", "")
        self._stack.append(len(self.tag))
        self._open[tag] += 1
        self.parent.append(self._stack[-2])
        self.tag.append(tag)
        self.first.append(len(self.blocks))
        self.last.append(len(self.blocks))
        self.hash.append(b"")
        self.chars.append(0)
        self.links.append(0)
        self.kind.append(ARTICLE if tag == "article" or role == "article" else MAIN if tag == "main" or role == "main" else OTHER)
        self.out.append("hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or role in ROLES or tag in ASIDE)
        self.said.append(bool(names & WORDS) and tag not in ("html", "body"))
        self._kids.append([])
        if tag == "a":
            self._linked += 1
        if self.kind[-1]:
            self._mute = 0
        elif not self._mute and tag not in BLOCKS and (self.out[-1] or self.said[-1]):
            self._mute = len(self._stack) - 1  # inside of a block: its text is left out where it is read

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._silent:
            if self._silent[0] != "head" or tag in IN_HEAD:
                self._silent[1] += tag == self._silent[0]
                return
            self._silent = None
        if tag in SILENT:
            self._silent = [tag, 1]
            return
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img", "input"):
                self._buffer.append(" " if tag != "wbr" else "")
            if tag == "hr":
                self._flush()
            return
        if tag in BLOCKS:
            self._flush()
            if tag in CLOSES:
                self._close_up(*CLOSES[tag])
            elif self._open["p"]:
                self._close_up({"p"}, BLOCKS - {"p"})
        self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def _close_up(self, which: set[str], within: set[str]) -> None:
        """Closes the open elements of ``which`` above the nearest one of ``within``."""
        deepest = None
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in within and tag not in which:
                break
            if tag in which:
                deepest = k
                if "p" in which:
                    break
        if deepest is not None:
            while len(self._stack) > deepest:
                self._pop()

    def handle_endtag(self, tag: str) -> None:
        if self._silent:
            if tag == self._silent[0]:
                self._silent[1] -= 1
            if tag in ("html", "body") or not self._silent[1] or (self._silent[0] == "title" and tag == "head"):
                self._silent = None
            return
        if tag in BLOCKS:
            self._flush()
        if not self._open[tag] or tag in ("html", "body"):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            here = self.tag[self._stack[k]]
            if here == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if here in BLOCKS and tag not in BLOCKS:  # an inline end tag closes nothing beyond its block
                return

    def handle_data(self, data: str) -> None:
        if not self._silent and not self._mute:
            self._buffer.append(data)
            n = len(data) - data.count(" ")
            self.chars[self._stack[-1]] += n
            if self._linked:
                self.links[self._stack[-1]] += n

    def inside(self, marks: list[bool]) -> list[bool]:
        """Which elements are marked or lie in a marked one; parents come before their children."""
        got = list(marks)
        for k in range(1, len(got)):
            got[k] = got[k] or got[self.parent[k]]
        return got


def menu(tree: Tree, k: int) -> bool:
    return tree.links[k] > 0 and 2 * tree.links[k] >= tree.chars[k]


def main_part(tree: Tree) -> tuple[list[int], list[bool]]:
    """(elements of the main part: articles, else main elements, else the root; which elements are no content by tag, role or name).

    Names are weak: one on an element that holds the longest article, or the longest main element, says nothing.
    """
    n = len(tree.tag)
    size = [sum(map(len, tree.blocks[a:b])) if kind else 0 for a, b, kind in zip(tree.first, tree.last, tree.kind, strict=True)]
    # a header inside of an article or main element is its own
    within = tree.inside([k > 0 for k in tree.kind])
    strong = tree.inside([o and not (tree.tag[k] == "header" and within[k]) and not tree.kind[k] for k, o in enumerate(tree.out)])
    marks = [k for k in range(n) if tree.kind[k] and size[k] and not strong[k] and not tree.said[k]]
    top = max((tree.kind[k] for k in marks), default=OTHER)
    holds = set()
    if top:
        at = max((k for k in marks if tree.kind[k] == top), key=lambda k: (size[k], -k))
        while at >= 0:
            holds.add(at)
            at = tree.parent[at]
    gone = tree.inside([(o and not (tree.tag[k] == "header" and within[k]) or tree.said[k]) and k not in holds for k, o in enumerate(tree.out)])
    if not top:
        return [0], gone
    chosen = [k for k in marks if tree.kind[k] == top and not gone[k]]
    below = tree.inside([k in set(chosen) for k in range(n)])
    return [k for k in chosen if not below[tree.parent[k]]], gone


def text_of(tree: Tree, at: list[int]) -> list[int]:
    """Blocks of elements, in page order."""
    return sorted({i for k in at for i in range(tree.first[k], tree.last[k])})


def hashed(html: str) -> tuple[int, list[int]]:
    """(hash of the main part's text, hashes of the containers) of a page, as signed 64-bit numbers."""
    tree = Tree(html)
    part, gone = main_part(tree)
    blocks = [tree.blocks[i] for i in text_of(tree, part) if not gone[tree.owner[i]]] or tree.blocks
    number = lambda h: int.from_bytes(h, "little", signed=True)
    content = digest("\n\n".join(blocks).encode("utf-8", "surrogatepass"))
    return number(content), sorted({number(tree.hash[k]) for k in range(1, len(tree.tag)) if tree.tag[k] in CONTAINERS and tree.hash[k]})


def extract(html: str, templates: set[int]) -> tuple[str, int]:
    """(main text, template subtrees deleted) of a page."""
    tree = Tree(html)
    part, gone = main_part(tree)
    landmark = part != [0]
    chosen = tree.inside([k in set(part) for k in range(len(tree.tag))]) if landmark else [False] * len(tree.tag)
    holds = set()
    for k in part if landmark else []:
        at = tree.parent[k]
        while at >= 0 and at not in holds:
            holds.add(at)
            at = tree.parent[at]
    known = [False] * len(tree.tag)
    for k in range(1, len(tree.tag)):
        if tree.tag[k] in CONTAINERS and tree.hash[k] and k not in holds:
            again = int.from_bytes(tree.hash[k], "little", signed=True) in templates
            known[k] = again and (not chosen[k] or menu(tree, k)) or not landmark and tree.links[k] and menu(tree, k) and 5 * tree.links[k] >= 4 * tree.chars[k] and tree.tag[k] in ("ul", "ol", "menu")
    deleted = tree.inside(known)
    kept = [tree.blocks[i] for i in text_of(tree, part) if not gone[tree.owner[i]] and not deleted[tree.owner[i]]]
    return "\n\n".join(kept), sum(bool(x) and not deleted[tree.parent[k]] for k, x in enumerate(known))


def host(url):
    """The host of a url, lower case, without user and port; the empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def templates(pages: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """host, templates (array of subtree hashes) of the hosts that have any; saved."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, *hashed(t)) for h, t in zip(batch.host, batch.html, strict=True) if t]
            yield pd.DataFrame(rows, columns=["host", "content", "subtrees"])

    own = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    seen = saved(own.mapInPandas(run, "host string, content long, subtrees array<long>"), "subtrees")
    total = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents")).where(F.col("contents") >= least)
    each = seen.select("host", "content", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = each.join(total, "host").where(F.col("n") * share >= F.col("contents"))
    return saved(often.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates")), "templates")


def main_texts(pages: DataFrame, least: int = LEAST, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (subtrees deleted as templates) of every page."""
    spark = pages.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [extract(t, set(() if known is None else known.tolist())) if t else ("", 0) for t, known in zip(batch.html, batch.templates, strict=True)]
            text = [t.encode("utf-8", "replace").decode() for t, _ in got]
            yield pd.DataFrame({"page_id": batch.page_id, "url": batch.url, "text": text, "n_chars": [len(t) for t in text], "n_templates": [k for _, k in got]})

    with small_batches(spark, PAGES):
        known = templates(pages, least, share)
        size = known.agg(F.sum(F.size("templates") * 8 + F.octet_length("host") + 16).cast("long")).first()[0] or 0
        own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))
        own = own.join(F.broadcast(known) if size <= broadcast_bytes else known, "host", "left")
        kind = pages.schema["page_id"].dataType.simpleString()
        return saved(own.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "templates").mapInPandas(run, "page_id string, url string, text string, n_chars long, n_templates int")
                     .withColumn("page_id", F.col("page_id").cast(kind)), "main-texts")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


