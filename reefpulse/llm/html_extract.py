"""Main text of pages by site style trees.

All distinct pages of a host are merged into one tree: a node is a path of tags with their
classes and ids. Over the pages that have a node, its presentation importance is the
entropy of the child sequences seen there, and its content importance is one less the
mean entropy of its texts, each spread over the pages that repeat it; both to the base
of the number of pages. A branch whose texts recur on most pages of its host and whose
layout does not vary is noise, and is removed from each page, unless it holds most of
the page's text. Hosts with fewer than ``least_pages`` pages with a node say nothing
about it.

Nothing is cut ahead of the tree. What tags and names say of a purpose (menus, adverts, forms,
comments and so on) is a prior that is added to the importance: it decides alone where
a host has too few pages, and can be outweighed. A branch with most of a page's text
stays whatever it is called, unless a landmark (article or main) elsewhere on the page
holds the text, and its inner branches are then judged on their own; a name that may as well be an article's
(related, login and the like) counts only for branches that are mostly links or short lines. Landmarks that hold a third or more
of what is left make all outside them less important; their own paragraphs are always kept.

Counts of the trees are sums with map-side combining, so a host with a third of all
pages is no hot group; pages meet their host's list of removed branches in an equi-join
(broadcast by the planner while that table is small, split by AQE beyond).

Defined results: null or empty html gives an empty text; markup cut off at the end of a
page is dropped; a page without any tag is one block; a page without host belongs to
the host of empty name; repeated rows get equal results; an empty table gives an empty one. Nodes
deeper than ``MOST_DEPTH`` count as their ancestor there, so nesting costs no more than length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from reefpulse.llm.store import bounded_batches, stored
from reefpulse.llm.url_filter import host_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:/?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)|[!?][^>]*(?:>|\Z))", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "title", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
# Start tags that end an open paragraph, and elements that end their like.
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend"}
ENDS_LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu", "select"}
# Tags that never hold an article, and tags that rarely do.
HARD_TAGS = {"nav", "footer", "aside", "button", "dialog", "menu", "head"}
NOISE_TAGS = {"form", "fieldset"}
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar aside footer cookie cookies consent notice gdpr popup newsletter subscribe signup "
    "comment comments disqus replies respond pagination pager".split()
)
WEAK_WORDS = set("related recommended search login share sharing social widget skip modal toolbar masthead teaser card".split())
COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "respond"}
# How strongly tag and names speak against a node.
PLAIN, WEAK, STRONG, HARD = range(4)
# Importance without evidence from the host, and what is added to it: for strong and weak names,
# and for what stands outside the landmarks that hold the text.
NEUTRAL, NAMED, MAYBE, OUTSIDE = 0.5, -1.0, -0.4, -0.2
# A branch may be an article under any name from so many characters on; lines shorter on average are no prose.
ARTICLE_CHARS, PROSE_CHARS, LINKS = 60, 60, 0.3
MOST_DEPTH = 48
KEPT_IN_ARTICLE = set("p h1 h2 h3 h4 h5 h6 pre blockquote li td th dd dt figcaption article main".split())


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@lru_cache(1 << 14)
def _style(parent: int, tag: str, raw: str) -> tuple[int, int, bool]:
    """The path's hash, how strongly the node's names speak of a purpose other than the article, and whether of comments."""
    found = [(n.lower(), v.strip("\"'")) for n, v in _ATTRIBUTE.findall(raw)] if "=" in raw else []
    words = {w.lower() for _, v in found for w in _WORD.findall(v)}
    # Ids with digits and classes with long numbers are mostly one per page, and no style.
    shown = " ".join(sorted(w for n, v in found for w in v.split() if not re.search(r"\d" if n == "id" else r"\d{3}", w)))
    level = STRONG if words & NOISE_WORDS else WEAK if words & WEAK_WORDS else PLAIN
    return _hash(f"{parent}/{tag}.{shown}"), level, bool(words & COMMENT_WORDS)


class Node(NamedTuple):
    parent: int
    style: int
    tag: str
    # Inside an article or main element; itself one; how strongly tag and names speak against it.
    inside: bool
    landmark: bool
    against: int
    depth: int
    # The node itself, or the ancestor at the greatest depth that counts.
    counts_as: int


class Page:
    """Blocks of text of a page, (node, text, characters in links), and the tree they stand in."""

    def __init__(self, text: str):
        self.nodes: list[Node] = [Node(-1, 0, "", False, False, PLAIN, 0, 0)]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._parts, self._open_tags = [0], [], Counter()
        self._linked, self._in_link = 0, False
        at = 0
        while m := _TOKEN.search(text, at):
            if m.start() > at:
                self._add(text[at : m.start()])
            at = m.end()
            raw = m[0]
            name = _NAME.match(raw)
            if not name:
                continue
            tag = name[1].lower()
            if tag == "a":
                self._in_link = raw[1] != "/"
            elif raw[1] == "/":
                self._close(tag)
            elif tag in RAW:
                if not raw.endswith("/>") or tag not in ("svg", "math"):
                    end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(text, at)
                    at = end.end() if end else len(text)
            else:
                self._open(tag, raw)
        if at < len(text):
            self._add(text[at:])
        self._flush()

    def _add(self, text: str) -> None:
        self._parts.append(text)
        if self._in_link:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._parts:
            joined = "".join(self._parts)
            linked, self._parts, self._linked = self._linked, [], 0
            if "&" in joined:
                joined = entities.unescape(joined)
            if joined := " ".join(joined.split()):
                self.blocks.append((self._stack[-1], joined, min(linked, len(joined))))

    def _pop_to(self, depth: int) -> None:
        self._flush()
        for k in self._stack[depth:]:
            self._open_tags[self.nodes[k].tag] -= 1
        del self._stack[depth:]

    def _open(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._parts.append(" ")
            return
        if tag not in BLOCK:
            return
        self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P and self._open_tags["p"]:
            for depth in range(len(self._stack) - 1, 0, -1):
                if self.nodes[self._stack[depth]].tag == "p":
                    self._pop_to(depth)
                    break
        like = ENDS_LIKE.get(tag, ())
        if any(self._open_tags[t] for t in like):
            for depth in range(len(self._stack) - 1, 0, -1):
                open_tag = self.nodes[self._stack[depth]].tag
                if open_tag in like:
                    self._pop_to(depth)
                elif open_tag in SCOPES:
                    break
        k = self._stack[-1]
        parent = self.nodes[k]
        style, named, comments = _style(parent.style, tag, raw) if parent.depth < MOST_DEPTH else (parent.style, *_style(0, tag, raw)[1:])
        apart = any(self._open_tags[t] for t in ("aside", "footer", "nav"))
        landmark = tag in ("article", "main") and not comments and not apart
        against = PLAIN
        if tag == "article" and comments:
            against = STRONG
        elif landmark:
            against = WEAK if named == WEAK else PLAIN
        elif tag not in ("html", "body"):
            if tag in HARD_TAGS:
                against = HARD
            elif tag in NOISE_TAGS or (tag == "header" and not parent.inside):
                against = STRONG
            elif tag not in ("h1", "p"):
                against = named
        me = len(self.nodes)
        self.nodes.append(Node(
            k, style, tag, parent.inside or landmark, landmark, against, parent.depth + 1, me if parent.depth < MOST_DEPTH else parent.counts_as
        ))
        self._stack.append(me)
        self._open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        if tag not in BLOCK:
            return
        self._flush()
        if not self._open_tags[tag]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.nodes[self._stack[depth]].tag == tag:
                self._pop_to(depth)
                break

    def text(self, known: dict[int, float] | None = None, least: float = 0.4) -> str:
        """The page without the branches whose importance is under ``least``.

        ``known`` has the importance of styles on the page's host.
        """
        known = known or {}
        nodes = self.nodes
        hard = [False] * len(nodes)
        for k, x in enumerate(nodes[1:], 1):
            hard[k] = hard[x.parent] or x.against == HARD
        size, links, lines, marked = ([0] * len(nodes) for _ in range(4))
        for k, text, linked in self.blocks:
            if not hard[k]:
                size[k] += len(text)
                links[k] += linked
                lines[k] += 1
                marked[k] += len(text) if nodes[k].inside else 0
        for k in range(len(nodes) - 1, 0, -1):
            up = nodes[k].parent
            size[up] += size[k]
            links[up] += links[k]
            lines[up] += lines[k]
            marked[up] += marked[k]
        cut = self._cuts(known, least, hard, size, links, lines, marked, False)
        outside = sum(len(t) for k, t, _ in self.blocks if not cut[k] and not nodes[k].inside)
        inside = sum(len(t) for k, t, _ in self.blocks if not cut[k] and nodes[k].inside)
        if inside and 2 * inside >= outside:
            cut = self._cuts(known, least, hard, size, links, lines, marked, True)
        return "\n".join(t for k, t, _ in self.blocks if not cut[k])

    def _cuts(self, known, least, hard, size, links, lines, marked, landmarks: bool) -> list[bool]:
        """For each node whether it is in a branch that goes; with ``landmarks``, those hold the text."""
        nodes = self.nodes
        cut = [False] * len(nodes)
        # Text directly under the page's outermost elements is outside too.
        for k, x in enumerate(nodes):
            importance = known.get(x.style, NEUTRAL)
            if x.landmark:
                # A landmark stands for itself inside an unlikely branch, but for a weak name.
                prior = MAYBE if x.against == WEAK and not landmarks and self._no_prose(k, size, links, lines) else 0.0
                cut[k] = x.against == STRONG or prior < 0 and importance + prior < least
                continue
            prior = 0.0
            if x.against >= STRONG:
                prior = NAMED
            elif x.against == WEAK and self._no_prose(k, size, links, lines):
                prior = MAYBE
            if landmarks and not x.inside:
                prior += OUTSIDE
            wrapper = x.tag in ("", "html", "body")
            most = not hard[k] and size[k] >= ARTICLE_CHARS and 2 * size[k] >= size[0] and marked[k] >= marked[0]
            own = x.inside and x.tag in KEPT_IN_ARTICLE and x.against < STRONG
            goes = importance + prior < least and not (own or most or (wrapper and not landmarks))
            cut[k] = goes or (x.parent >= 0 and cut[x.parent])
        return cut

    @staticmethod
    def _no_prose(k: int, size, links, lines) -> bool:
        return links[k] > LINKS * size[k] or size[k] < PROSE_CHARS * lines[k]

    def features(self) -> Iterator[tuple[int, int, int]]:
        """(style, kind, feature) once each: 0 the node is there, 1 its children's tags, 2 a text in its branch."""
        seen = set()
        children: dict[int, dict[str, None]] = {}
        for k, x in enumerate(self.nodes):
            if x.parent >= 0 and x.counts_as == k:
                seen.add((x.style, 0, 0))
            if x.parent >= 0:
                children.setdefault(self.nodes[x.parent].counts_as, {})[x.tag] = None
        for k, tags in children.items():
            if k:
                seen.add((self.nodes[k].style, 1, _hash(" ".join(tags))))
        for k, text, _ in self.blocks:
            h, k = _hash(text), self.nodes[k].counts_as
            while k > 0:
                if self.nodes[k].tag not in ("html", "body"):
                    seen.add((self.nodes[k].style, 2, h))
                k = self.nodes[k].parent
        return iter(seen)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html")):
            if text.is_valid:
                total.update((host, *f) for f in Page(text.as_py()).features())
        if total:
            host, style, kind, feature = zip(*total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(style, pa.int64()), pa.array(kind, pa.int32()), pa.array(feature, pa.int64()),
                 pa.array(list(total.values()), pa.int64())],
                ["host", "style", "kind", "feature", "n"],
            )


def _once(pages: DataFrame) -> DataFrame:
    """host and html of each distinct page of a host; only pages that have copies are shuffled."""
    marks = {"__one": F.xxhash64("host", "html"), "__two": F.xxhash64(F.lit(1), "host", "html")}
    marked = pages.where("html is not null").select("host", "html").withColumns(marks)
    several = stored(marked.groupBy(*marks).count().where("count > 1").select(*marks), "copied")
    copied = marked.join(several, [*marks], "left_semi").groupBy(*marks).agg(F.first("host").alias("host"), F.first("html").alias("html"))
    return marked.join(several, [*marks], "left_anti").select("host", "html").unionByName(copied.select("host", "html"))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, style, pages, presentation and content: the importance of each style node.

    ``pages`` has host and html. Copies of a page on its host count as one.
    """
    rows = _once(pages).mapInArrow(_count_features, "host string, style long, kind int, feature long, n long")
    counted = rows.groupBy("host", "style", "kind", "feature").agg(F.sum("n").alias("n"))
    n, kind = F.col("n").cast("double"), F.col("kind")
    node = counted.groupBy("host", "style").agg(
        F.sum(F.when(kind == 0, n)).alias("m"),
        F.sum(F.when(kind == 1, n)).alias("laid_out"), F.sum(F.when(kind == 1, n * F.log(n))).alias("layouts"),
        F.sum(F.when(kind == 2, F.log(n))).alias("spread"), F.count_if(kind == 2).alias("texts"),
    )
    base = F.log(F.greatest(F.col("m"), F.lit(2.0)))
    presentation = F.when(F.col("laid_out") > 0, (F.log("laid_out") - F.col("layouts") / F.col("laid_out")) / base).otherwise(0.0)
    content = F.when(F.col("texts") > 0, 1 - F.col("spread") / F.col("texts") / base).otherwise(0.0)
    return node.select("host", "style", F.col("m").cast("long").alias("pages"), presentation.alias("presentation"), content.alias("content"))


def main_text(page: Column, known: Column, least: float) -> Column:
    """Texts of pages by their host's importance of styles, an array of structs (style, importance)."""
    def run(texts: pa.Array, hosts: pa.Array) -> pa.Array:
        last, table = None, {}
        out = []
        for text, styles in zip(texts, hosts):
            if last is None or not styles.equals(last):
                last, table = styles, {x["style"]: x["importance"] for x in styles.as_py() or ()}
            out.append(Page(text.as_py()).text(table, least) if text.is_valid else "")
        return pa.array(out, pa.string())

    return arrow_udf(run, "string")(page, known)


def extract_text(
    pages: DataFrame, url: str = "url", html: str = "html", share: float = 0.5, least: float = 0.4, least_pages: int = 4
) -> DataFrame:
    """``pages`` with ``text``, the main text of each page. A column of that name is replaced.

    A style node's composite importance is ``share`` of presentation and the rest of
    content; with the prior of its tag and names added, a branch under ``least`` is noise. Only styles that
    are under it, or high enough to outweigh a prior, travel to the pages.
    """
    bounded_batches(pages.sparkSession)
    known = pages.withColumn("__host", host_of(F.col(url)))
    tree = style_tree(known.select(F.col("__host").alias("host"), F.col(html).alias("html")))
    importance = F.round(share * F.col("presentation") + (1 - share) * F.col("content"), 6)
    telling = (importance < least) | (importance + OUTSIDE < least) | (importance + MAYBE >= least)
    told = tree.where((F.col("pages") >= least_pages) & telling).groupBy(F.col("host").alias("__host")).agg(
        F.array_sort(F.collect_list(F.struct("style", importance.alias("importance")))).alias("__known")
    )
    joined = known.join(stored(told, "importance"), "__host", "left")
    return joined.withColumn("text", main_text(F.col(html), F.col("__known"), least)).drop("__host", "__known")
