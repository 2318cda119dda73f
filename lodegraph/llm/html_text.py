"""HTML main-text extraction by consensus host paths.

1. Every page's containers are scored by the paragraph text they hold directly (half for grandparents, links don't count), and
   the page votes for the generalised tag-class paths of its best containers (digits dropped, classes sorted). Containers in an
   article or main element count for the outermost of these: what lies beside them in it is main text too.
2. Votes are summed by (host, path) in Spark and the path with most votes wins its host.
3. Every page is parsed again and its text taken from the containers on its host's path; a page without that path, or with no
   text there, uses its own best container, else its body. Boilerplate inside (menus, headers and footers of the page,
   sidebars, notices, adverts, forms, scripts, styles, comments) is left out. Names of classes count as boilerplate only inside
   the containers taken: whatever holds a host's main text is never dropped for its name.

White space in a block becomes one space, blocks are joined by one space in page order, character references are decoded.
Null html or url are empty; malformed and cut-off markup is parsed as far as it goes; no page is dropped; repeated rows are
extracted each; parsing takes time linear in the page, however long or hostile; empty tables give empty results. Hosts' winners are broadcast only while Spark's size threshold allows; else pages are joined by host.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_WANTED = re.compile("(?i)class|id|role|hidden|style")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp noembed noframes textarea title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROP = frozenset("script style nav footer aside noscript template iframe object svg canvas math button select textarea dialog menu head title audio video map datalist fieldset xmp noembed noframes".split())
_TOP = frozenset("html body main article".split())
_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies reply pagination pager toolbar skip search hidden outbrain taboola gdpr".split()
)
#: Words that mean boilerplate only as a whole class, or beside another word of boilerplate.
_WEAK = frozenset("alert notice notices share sharing social related reply replies search skip hidden login overlay comment subscription promotion respond cookie menu recommended".split())
_PARTS = _WORDS | frozenset("bar block box button buttons form icon icons item items link links list panel posts section tools widget wrapper area container module dialog articles stories overlay".split())
_STATES = frozenset("has with without no is js not can".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_HEADERS = frozenset("header siteheader".split())
_GOOD = frozenset("article content post entry story main text body".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr".split())
_SAME = {"li": ("li", frozenset(("ul", "ol"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",)))}
_LEAF = frozenset("p pre blockquote li h1 h2 h3 h4 h5 h6 dd dt td".split())
#: What text in boilerplate by name counts for in scores: it wins only where a page has next to nothing else.
_LITTLE = 0.05


@dataclass(slots=True)
class Node:
    tag: str
    path: int  # number of the generalised path
    parent: int
    block: int  # the element itself, or the nearest around it that isn't inline
    dropped: bool  # it, or what it lies in, is boilerplate by element or hidden
    soft: bool  # boilerplate by the name of its class, id or role, unless it holds the main text
    faint: bool  # it, or what it lies in, is soft
    good: bool
    inside: bool  # in an article or main element


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    texts: list[tuple[int, str, bool]]  # (element, text, in a link) in page order; (.., " ", ..) between blocks
    paths: list[tuple[int, str]]  # (path of the parent, tag and classes)

    def name(self, path: int) -> str:
        parts = []
        while path > 0:
            path, part = self.paths[path]
            parts.append(part)
        return "".join(f"/{x}" for x in reversed(parts))

    def number(self, name: str) -> int:
        """The number of the path of that name, -1 if the page has none."""
        found, wanted = {0: 0}, name.split("/")[1:]
        for k, (up, part) in enumerate(self.paths):  # parents have smaller numbers
            at = found.get(up, -1)
            if k and 0 <= at < len(wanted) and wanted[at] == part:
                found[k] = at + 1
        return next((k for k, at in found.items() if at == len(wanted)), -1)


def _spaces(text: str) -> str:
    return " ".join(text.split())


def _boilerplate(token: str, inside: bool) -> bool:
    """Whether a class or id names boilerplate: its first or last word does ("site-footer", "ad-slot"); words of _WEAK only
    alone or beside such a word ("share-buttons", not "share-price"); states ("has-sidebar", "overflow-hidden") don't."""
    words = [w.lower() for w in re.split(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])", token) if w and not w.isdigit()]
    if not words or (words[0] in _STATES and words[-1] != "hidden"):
        return False
    if not inside and (words[0] in _HEADERS or words[-1] in _HEADERS):
        return True
    if len(words) == 1 or (words[0] in _STATES and len(words) == 2):
        return words[-1] in _WORDS
    ends = [w for w in (words[0], words[-1]) if w in _WORDS]
    return any(w not in _WEAK for w in ends) or (bool(ends) and words[0] in _PARTS and words[-1] in _PARTS and words[-1] != "hidden")


@functools.lru_cache(4096)
def _traits(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """(tag and classes of the generalised path, dropped, soft, good) of an element."""
    dropped, good, classes = tag in _DROP, tag in ("article", "main"), []
    soft = tag == "form" or (tag == "header" and not inside)
    if _WANTED.search(attrs):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
                dropped = dropped or tag not in _TOP
            elif name in ("class", "id"):
                soft = soft or any(_boilerplate(x, inside) for x in value.split())
                good = good or bool({w.lower() for w in re.split("[^a-zA-Z]+", value)} & _GOOD)
                if name == "class":
                    classes += re.sub(r"\d+", "", value).replace("/", "").split()
            elif name == "role":
                soft = soft or value.lower() in _ROLES
    return tag + "".join(f".{c}" for c in sorted(set(classes))), dropped, soft and tag not in _TOP, good


def parse(page: str) -> Page:
    """The page's elements and texts, in time linear in its length whatever the markup: a tag ends at the first ">" outside
    quoted values; quotes that never close don't count, nor do any once a tag was found without end."""
    nodes, texts = [Node("", 0, -1, 0, False, False, False, False, False)], []
    paths, known = [(-1, "")], {}
    stack, opened, links, at, n = [0], {}, 0, 0, len(page)
    last = {c: page.rfind(c) for c in "\"'>"}
    broken = False

    def close(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            node = nodes[stack.pop()]
            opened[node.tag] -= 1
            links -= node.tag == "a"
            if node.tag not in _INLINE:
                texts.append((stack[-1], " ", False))

    def end_of(start: int) -> int:
        nonlocal broken
        here = start
        while not broken:
            m = _STOP.search(page, here)
            if not m:
                broken = True
            elif m[0] == ">":
                return m.start()
            else:
                quote = m[0][-1]
                here = page.find(quote, m.end()) + 1 if m.end() <= last[quote] else m.end()
        return page.find(">", start)

    begin = 0  # of the text not taken yet
    while True:
        at = page.find("<", at)
        if at < 0 or at > last[">"]:
            break
        c = page[at + 1 : at + 2]
        shut = c == "/"
        name = _NAME.match(page, at + 1 + shut)
        if not name and c not in ("!", "?"):
            at += 1
            continue
        if at > begin:
            texts.append((stack[-1], page[begin:at], links > 0))
        if not name:
            stop = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            at = begin = stop + 1 if stop > 1 else n
            continue
        stop = end_of(name.end())
        attrs = page[name.end() : stop]
        at = begin = stop + 1
        tag = name[0].lower()
        if shut:
            if opened.get(tag):
                k = len(stack) - 1
                while nodes[stack[k]].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _CLOSES_P and opened.get("p") and nodes[(b := nodes[stack[-1]].block)].tag == "p":
            k = len(stack) - 1
            while stack[k] != b:
                k -= 1
            close(k)
        if tag in _SAME:
            names, stops = _SAME[tag]
            for k in range(len(stack) - 1, max(0, len(stack) - 65), -1):
                if nodes[stack[k]].tag in stops:
                    break
                if nodes[stack[k]].tag in names.split():
                    close(k)
                    break
        if tag not in _INLINE:
            texts.append((stack[-1], " ", False))
        if tag in _VOID:
            continue
        up = nodes[stack[-1]]
        part, dropped, soft, good = _traits(tag, attrs, up.inside)
        path = up.path
        if tag not in _INLINE:
            path = known.get((up.path, part), -1)
            if path < 0:
                path = known[up.path, part] = len(paths)
                paths.append((up.path, part))
        here = len(nodes)
        nodes.append(Node(tag, path, stack[-1], up.block if tag in _INLINE else here, up.dropped or dropped, soft, up.faint or soft, good, up.inside or tag in ("article", "main")))
        if tag in _RAW:
            found = _ENDS[tag].search(page, at)
            gt = page.find(">", found.start()) if found else -1
            at = begin = n if gt < 0 else gt + 1
            continue
        if attrs.rstrip().endswith("/") and tag not in _INLINE and tag not in _CLOSES_P:
            continue
        links += tag == "a"
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(here)
    if begin < n:
        texts.append((stack[-1], page[begin:], links > 0))
    return Page(nodes, texts, paths)


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in _RAW}


def _shares(page: Page) -> dict[int, float]:
    """Scores of the page's containers."""
    nodes, own = page.nodes, {}
    for k, t, linked in page.texts:
        if not (nodes[k].dropped or linked or t.isspace()):
            k = nodes[k].block
            own[k] = own.get(k, 0) + len(_spaces(t))
    score: dict[int, float] = {}
    for k, size in own.items():
        if size < 2:
            continue
        if nodes[k].faint:
            size *= _LITTLE
        a = nodes[k].parent if nodes[k].tag in _LEAF and nodes[k].parent > 0 else k
        a = nodes[a].block
        score[a] = score.get(a, 0) + size
        b = nodes[nodes[a].parent].block if nodes[a].parent >= 0 else 0
        if b > 0:
            score[b] = score.get(b, 0) + size / 2
    for k in score:
        score[k] *= 3 if nodes[k].good else 1
    return score


def _lifted(page: Page) -> list[int]:
    """Of each element the outermost article or main element that holds it, itself if none does."""
    out: list[int] = []
    for k, node in enumerate(page.nodes):
        up = out[node.parent] if k else 0
        held = k and page.nodes[up].tag in ("article", "main") and not page.nodes[up].dropped
        out.append(up if held else k)
    return out


def votes(html: str, most: int = 3) -> list[tuple[str, int]]:
    """(path, votes) of the page's best containers: 1000 votes a page, by score."""
    page = parse(html)
    score = _shares(page)
    by: dict[int, float] = {}
    lifted = _lifted(page) if score else []
    for k, s in score.items():
        path = page.nodes[lifted[k]].path
        by[path] = by.get(path, 0) + s
    best = sorted(by.items(), key=lambda x: -x[1])
    near = [x for x in best if x[1] >= best[min(most, len(best)) - 1][1]] if best else []
    top = sorted(((page.name(p), s) for p, s in near), key=lambda x: (-x[1], x[0]))[:most]
    total = sum(s for _, s in top)
    return [(p, int(1000 * s / total)) for p, s in top if total]


def _taken(page: Page, wanted: set[int], soft: bool = True) -> str:
    """The text of the wanted elements, without what is boilerplate inside them; what lies around them doesn't matter."""
    inside, out = [False] * len(page.nodes), [False] * len(page.nodes)
    for k, node in enumerate(page.nodes):  # parents come before children
        if k in wanted:
            inside[k] = True
        elif k:
            inside[k] = inside[node.parent]
            out[k] = out[node.parent] or (soft and node.soft and inside[k])
    return _spaces(entities.unescape("".join(t for k, t, _ in page.texts if t == " " or (inside[k] and not out[k] and not page.nodes[k].dropped))))


def main_text(html: str | None, path: str | None = None) -> str:
    """The main text of a page whose host's path is `path`."""
    if not html:
        return ""
    page = parse(html)
    if path and (p := page.number(path)) >= 0:
        found = {k for k, x in enumerate(page.nodes) if x.path == p and x.tag not in _INLINE and not x.dropped}
        if found and (text := _taken(page, found)):
            return text
    score = _shares(page)
    if score:
        best = _lifted(page)[max(score, key=lambda k: (score[k], -k))]
        if text := _taken(page, {best}):
            return text
    return _taken(page, {0}) or _taken(page, {0}, soft=False)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _voting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(h, p, v) for h, page in zip(b["host"], b["html"], strict=True) if isinstance(page, str) for p, v in votes(page)]
        yield pd.DataFrame(out, columns=["host", "path", "votes"])


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host; of equals the first in order."""
    cast = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).mapInPandas(_voting, "host string, path string, votes long")
    total = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return total.withColumn("n", first).filter("n = 1").select("host", "path")


def extracted(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`."""
    winners = staged(host_paths(pages, url=url, html=html), "host-paths")
    d = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    kind = dict(d.dtypes)["page_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(page if isinstance(page, str) else "", p if isinstance(p, str) else None) for page, p in zip(b["html"], b["path"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64") if kind in ("bigint", "int") else b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return d.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(table(spark, sf_dir, "pages"))
