"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score positive and tags
negative; how much depends on the tag and on what encloses the token, with
weights learned from labelled pages.  One linear scan finds the contiguous
region of the highest sum.  Inside it, what stands in boilerplate elements is
left out, references are decoded, and blocks are joined.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by role.
SILENT = set("script style noscript template svg head title iframe canvas object select textarea option button".split())
BOILER = set("nav footer aside header form menu dialog".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
BLOCKS = set("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre article section main figure figcaption address body html hr nav footer aside header form details summary fieldset center".split())
#: Words in class, id or role that mark boilerplate.
MARKS = set("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer foot masthead topbar header comment comments reply replies discussion disqus share sharing social related recommended pagination pager toolbar login search complementary contentinfo disclaimer".split())
#: What may stand in a head; anything else ends one left open.
HEAD = set("title meta link base script style noscript template".split())
#: Compounds of a mark that speak of the page around it, such as has-sidebar.
_STATES = re.compile(r"(?<!\S)(?:has|no|with|without)[-_]\S*")
#: Elements an opening block tag closes if left open.
_ENDS_P = BLOCKS - {"body", "html"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\s(?:hidden(?=[\s>=/])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is not markup, and what ends them.
_RAW = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in ("script", "style", "title", "textarea", "noscript", "iframe")}
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

#: What encloses text: tags and links inside are part of it.
_TEXTS = {"article", "main", "p"}
#: Tags of running text, lists and tables.
_TEXT_TAGS = set("p h1 h2 h3 h4 blockquote br b i em strong pre ul ol li dl dt dd table caption thead tbody tfoot tr td th span code".split())

def _labelled() -> list[list[tuple[str, str | None]]]:
    """Labelled pages as fragments in page order: markup, and its main text or None for boilerplate."""
    link = lambda w: f"<a href='/{w}'>{w}</a>"
    item = lambda xs: "<ul>" + "".join(f"<li>{x}</li>" for x in xs) + "</ul>"
    names = ("home", "news", "about us", "contact", "archive", "shop", "all topics")
    menus = [
        "<nav>" + item(map(link, names)) + "</nav>",
        item(map(link, names)),
        "<div>" + " | ".join(map(link, names)) + "</div>",
        "<table><tr>" + "".join(f"<td>{link(x)}</td>" for x in names) + "</tr></table>",
        "<div>" + "".join(f"<div><span>{link(x)}</span></div>" for x in names) + "</div>",
    ]
    ends = [
        "<footer>&copy; site &middot; all rights reserved.</footer>",
        "<div>" + " ".join(map(link, ("imprint", "privacy", "terms", "press", "jobs"))) + "</div>",
        "<div>" + "".join(f"<h3>{link(x)}</h3>" for x in ("A bridge reopens", "Late trains", "What the harvest brought", "Old maps")) + "</div>",
        "<aside class='sidebar'><p>More stories that you may like to read.</p></aside><div class='comments'><p>I liked this a lot, thank you.</p></div>",
        item(map(link, names[::-1])),
    ]
    stories = [
        ("A walk by the river", ["The path follows the water for about two miles.", "Herons stand in the reeds, and in spring the banks are full of wild garlic.", "Bring boots."]),
        ("Bread without kneading", ["Mix flour, water, salt and a little yeast the night before.", "Bake it in a hot covered pot until the crust is dark."]),
        ("Notes on tides", ["Tides rise and fall twice a day in most places, though not in all of them.", "The moon pulls harder on the near side of the earth than on the far side, and the sea answers.", "Harbours keep tables."]),
        ("Short", ["One line only."]),
    ]
    extras = [
        [],
        [("<p>Read <a href='/x'>the longer version</a> first.</p>", "Read the longer version first.")],
        [(item(("flour", "salt")), "flour\nsalt"), ("<table><tr><td>oven</td><td><span>hot</span></td></tr></table>", "oven\nhot")],
        [("<div class='related'>" + item("<a href='/y'>another story</a>" for _ in range(10)) + "</div>", None), ("<blockquote>So it is <em>said</em>.</blockquote>", "So it is said.")],
    ]
    pages = []
    for k, menu in enumerate(menus):
        for j, end in enumerate(ends):
            title, paragraphs = stories[(k + j) % len(stories)]
            box = ("article", "div", "main", "section", "div")[(k + 2 * j) % 5]
            page = [(f"<html><head><title>{title}</title></head><body>", None), (menu, None)]
            if (k + j) % 3 == 0:
                page.append(("<div class='ad'>Buy two and get the third one for free today.</div>", None))
            page += [(f"<{box}>", ""), (f"<h1>{title}</h1>", title)] + [(f"<p>{x}</p>", x) for x in paragraphs]
            page += extras[(2 * k + j) % len(extras)] + [(f"</{box}>", ""), (end + "</body></html>", None)]
            pages.append(page)
    return pages


#: Labelled pages the weights are learned from: (html, main text).
LABELLED = [("".join(x for x, _ in page), "\n".join(t for _, t in page if t)) for page in _labelled()]


def _ends_head(token: str) -> bool:
    """Text or an opening body tag after a head whose end tag was left out."""
    if token[0] != "<" or len(token) == 1:
        return bool(token.strip())
    name = _NAME.match(token)
    return bool(name) and token[1] != "/" and name[1].lower() not in HEAD


class Open:
    """The open elements, each with boilerplate (1 by a mark, 2 by element or hidden) and silence.

    The places of every name, of blocks and of containers are kept, so that no
    step looks through the whole stack: a page takes time in line with its length.
    """

    GROUPS = {"block": BLOCKS, "text": _TEXTS, "list": set("ul ol dl table tbody".split())}

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = {}

    def _names(self, tag: str) -> list[str]:
        return [tag, *(f"*{g}" for g, tags in self.GROUPS.items() if tag in tags)]

    def push(self, tag: str, boiler: int, silent: bool) -> None:
        for name in self._names(tag):
            self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((tag, boiler, silent))

    def cut(self, depth: int) -> None:
        """Close what stands from a place on."""
        while len(self.stack) > depth:
            for name in self._names(self.stack.pop()[0]):
                self.places[name].pop()

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name or ``*group``; -1 without one."""
        found = self.places.get(name)
        return found[-1] if found else -1

    def top(self) -> tuple[str, int, bool]:
        return self.stack[-1] if self.stack else ("", 0, False)

    def clear_marks(self) -> None:
        self.stack = [(tag, 0, silent) for tag, _, silent in self.stack]


class Tokens:
    """A page's tokens: ``kinds`` (scoring class), ``texts``, ``blocks``, ``main`` (not boilerplate), ``places``.

    A tag's class says how much text, and whether in links only, its block has.
    """

    def __init__(self, page: str | None):
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.blocks: list[int] = []
        self.main: list[bool] = []
        self.places: list[int] = []
        inner = Open()
        article = False  # one was opened outside boilerplate
        block = 0
        page = page or ""
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.match(page, at)
            token = m[0]
            self._at, at = at, m.end()
            if inner.top()[0] == "head" and _ends_head(token):
                inner.cut(len(inner.stack) - 1)
            _, boiler, silent = inner.top()
            if token[0] != "<" or len(token) == 1:
                if silent:
                    continue
                kind = "boiler" if boiler else "link" if inner.last("a") >= 0 and inner.last("*text") < 0 else "word"
                self._add(kind, html.unescape(token), block, not boiler)
                continue
            name = _NAME.match(token)
            if not name:
                continue  # comments, declarations
            tag = name[1].lower()
            if token[1] == "/":
                depth = inner.last(tag)
                if tag in BLOCKS:
                    block += 1
                if depth >= 0 and (tag in BLOCKS or inner.last("*block") < depth):
                    inner.cut(depth)
                if not silent:
                    self._add("/boiler" if boiler else self._kind("/", tag, inner), "", block, False)
                continue
            if tag in _ENDS_P:
                block += 1
                if inner.last("p") >= 0:
                    inner.cut(inner.last("p"))
                if tag in ("li", "dt", "dd", "tr", "td", "th") and inner.last(tag) > inner.last("*list"):
                    inner.cut(inner.last(tag))
                _, boiler, silent = inner.top()
            marked = any(p in MARKS for a in _ATTRS.findall(token) for p in _PARTS.split(_STATES.sub(" ", "".join(a).lower())))
            if tag in ("article", "main"):
                if boiler == 1 and not marked and not article:  # the page's first: the marks were of a wrapper
                    inner.clear_marks()
                    boiler = 0
                article = article or not boiler
            elif marked and tag not in ("body", "html"):
                boiler = max(boiler, 1)
            if tag in BOILER or _HIDDEN.search(token):
                boiler = 2
            if not silent:
                self._add("<boiler" if boiler else self._kind("<", tag, inner), " " if tag == "br" else "", block, tag == "br" and not boiler)
            if tag in VOID or token.endswith("/>") and tag not in BLOCKS and tag not in SILENT - {"svg"}:
                continue
            silent = silent or tag in SILENT
            if tag in _RAW:
                end = _RAW[tag].search(page, at)
                at = end.end() if end else n
                continue
            inner.push(tag, boiler, silent)
        self._densities()

    @staticmethod
    def _kind(mark: str, tag: str, inner: Open) -> str:
        return mark + ("in:" if inner.last("*text") >= 0 else "") + tag

    def _add(self, kind: str, text: str, block: int, main: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.blocks.append(block)
        self.main.append(main)
        self.places.append(self._at)

    def _densities(self) -> None:
        """Append to a tag's class the words of the block it opens or closes: none, few, some, many, or only links."""
        words: dict[int, int] = {}
        free: set[int] = set()
        for kind, text, block in zip(self.kinds, self.texts, self.blocks):
            if kind in ("word", "link") and (n := len(text.split())):
                words[block] = words.get(block, 0) + n
                if kind == "word":
                    free.add(block)
        for k, (kind, block) in enumerate(zip(self.kinds, self.blocks)):
            if kind[0] in "</" and not kind.endswith("boiler"):
                of = block - (kind[0] == "/" and kind.split(":")[-1].strip("/") in BLOCKS)
                n = words.get(of, 0)
                self.kinds[k] = kind + ("~none" if not n else "~links" if of not in free else "~few" if n < 4 else "~some" if n < 10 else "~many")


def _group(kind: str) -> str:
    """Scoring class: words by enclosure, tags by kind, enclosure and the text of their block."""
    if kind in ("word", "link", "boiler", "<boiler"):
        return kind
    name, _, density = kind.strip("</").partition("~")
    if name == "boiler":
        return "<boiler"
    inside = "in:" if name.startswith("in:") else ""
    tag = name.removeprefix("in:")
    return f"{inside}{'a' if tag == 'a' else 'text' if tag in _TEXT_TAGS else 'box'}~{density}"


@functools.cache
def weights() -> dict[str, float]:
    """Log-odds of each scoring class to stand inside the main text, learned from the labelled pages.

    A text counts with its words, a tag once; classes seen on no page take the
    odds of their kind of tag.  As the method asks, words are positive and tags
    negative: odds of the other sign become nearly nothing.  Boilerplate is
    left out of a region anyway and must not cut one in two.
    """
    sides: dict[str, list[float]] = {}
    for page in _labelled():
        tokens = Tokens("".join(x for x, _ in page))
        ends, labels = [], []
        for x, t in page:
            ends.append((ends[-1] if ends else 0) + len(x))
            labels.append(t is not None)
        fragment = 0
        for kind, text, place in zip(tokens.kinds, tokens.texts, tokens.places):
            while place >= ends[fragment]:
                fragment += 1
            group = _group(kind)
            for name in {group, group.partition("~")[0]}:
                side = sides.setdefault(name, [0.5, 0.5])
                side[labels[fragment]] += len(text.split()) if kind in ("word", "link", "boiler") else 1
    out = {}
    for group in [*sides, *(f"{i}{k}~{d}" for i in ("", "in:") for k in ("a", "text", "box") for d in ("none", "links", "few", "some", "many"))]:
        outside, inside = sides.get(group) or sides.get(group.partition("~")[0]) or (0.5, 0.5)
        odds = math.log(inside / outside)
        out[group] = max(odds, 0.05) if group in ("word", "link") else -0.05 if "boiler" in group else min(odds, -0.05)
    return out


def region(tokens: Tokens) -> tuple[int, int]:
    """First and past-last token of the best contiguous region (first, longest on ties)."""
    w = weights()
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for k, (kind, text) in enumerate(zip(tokens.kinds, tokens.texts)):
        group = _group(kind)
        gain = w[group] * (len(text.split()) if group in ("word", "link", "boiler") else 1)
        if run <= 0:
            run, start = 0.0, k
        run += gain
        if run > best:
            best, span = run, (start, k + 1)
    return span


def extract(page: str | None) -> str:
    """The main text: blocks in page order, one line each; empty if there is none."""
    tokens = Tokens(page)
    lo, hi = region(tokens)
    lines: list[str] = []
    held: list[str] = []
    current = None
    for k in range(lo, hi):
        if not tokens.main[k]:
            continue
        if tokens.blocks[k] != current:
            lines.append("".join(held))
            held, current = [], tokens.blocks[k]
        held.append(tokens.texts[k])
    lines.append("".join(held))
    clean = (_SPACE.sub(" ", x).strip() for x in lines)
    return "\n".join(x for x in clean if x)


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null and empty pages, and pages without text, give an empty text.  Rows
    that repeat or lack an id are extracted each; an empty table gives no rows;
    further columns are not read.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), chars], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
