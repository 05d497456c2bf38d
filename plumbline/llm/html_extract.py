"""HTML extraction: structure proposes the article, and a host suffix array says what is boilerplate.

A page is parsed in one pass into blocks of text; elements that HTML itself sets apart (scripts, menus,
footers, forms, asides, hidden parts) go. Each block belongs to its innermost article or main element, or
to none. The blocks that structure leaves open (those outside articles, and those inside one whose class
hints at furniture) are the page's token stream. The streams of a host are concatenated, and the
engine of repeats.py finds every run of `run` tokens that a share of the host's distinct pages have (a host
may hold a third of all pages, so no host is ever in one task). These runs are covered by boilerplate:

* a page without an article keeps what isn't covered: its unique runs. What some pages name an advert by its class,
  and so drop, is in the streams too, and uncovers the same text on pages that don't;
* covered text doesn't count when the text outside articles is held against that inside;
* in an article a block goes if its class hints at furniture and it is covered. Neither is enough alone: hosts
  publish the same sentences and articles on many pages, and these are text.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
from collections import Counter
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, free_shuffles
from .repeats import Plan, Units, remove_repeats

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:(["'])|([^\s>]*)))?|[\s/]*(>)|[\s/]*=""")
_PARTS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none")

#: HTML elements by what they are.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_DROPPED = {"head", "nav", "aside", "footer", "form", "noscript", "template", "svg", "math", "canvas", "object", "select", "button", "dialog", "menu", "audio", "video", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
_BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "nav", "aside", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_SPACE = {"br", "td", "th", "img"}
#: Elements whose end tag may be left out: ended by these, unless one of the others lies between.
_ENDED = {
    "p": (_BLOCK - {"caption", "legend", "summary", "tbody", "tfoot", "thead", "tr", "li", "html", "body"} | {"li"}, {"table", "button", "object", "td", "th"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "tfoot"}, {"table"}),
}
_ENDS = {new: [old for old, (by, _) in _ENDED.items() if new in by] for new in set().union(*(by for by, _ in _ENDED.values()))}
#: ARIA landmarks that aren't the page's main text.
_ROLES = {"banner", "complementary", "contentinfo", "navigation", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar", "form"}
#: Names of a page's furniture, and words that add nothing to such a name.
_FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "search",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "teaser", "teasers", "toolbar", "widget",
}
_PLAIN = {
    "area", "bar", "block", "body", "box", "btn", "button", "buttons", "container", "content", "form", "group", "header", "inner", "item", "items", "link", "links", "list",
    "main", "outer", "panel", "post", "posts", "reader", "section", "site", "slot", "text", "thread", "top", "unit", "user", "wrap", "wrapper", "reply", "replies",
}
_NONE = -1  # the group of blocks outside article and main


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    group: int
    hint: bool  # a class has a part that could be furniture's
    named: bool  # a class or id is furniture's name: never the article's, but it shows what the host repeats

    @property
    def prose(self) -> int:
        """Characters outside links; none if most are in links."""
        free = len(self.text) - self.linked
        return free if 2 * free >= len(self.text) else 0


@dataclass
class Page:
    blocks: list[Block]
    parents: list[int]  # by group: the group around it
    names: list[str]


def _furniture(names: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture with a whole word of its own, and whether some part of it could."""
    hint = False
    for word in names.lower().split():
        parts = _PARTS.findall(word)
        some = _FURNITURE.intersection(parts)
        if some and all(p in _FURNITURE or p in _PLAIN or p.isdigit() for p in parts):
            return True, True
        hint = hint or bool(some)
    return False, hint


class _Parser:
    """One pass over a page; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.out = Page([], [], [])
        self.text: list[str] = []
        self.linked = 0
        self.stack: list[tuple] = []  # name, opened a group, dropped, hints, named, is a link
        self.open: dict[str, list[int]] = {}
        self.group, self.dropped, self.hints, self.named, self.links = _NONE, 0, 0, 0, 0

    def run(self) -> Page:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                begin = n
            if begin > at:
                self.add(page[at:begin])
            at = begin if begin == n else self.tag(begin)
        self.flush()
        return self.out

    def add(self, raw: str) -> None:
        if self.dropped and self.open.get("head") and raw.strip():
            self.close("head")
        if not self.dropped:
            raw = html.unescape(raw)
            self.text.append(raw)
            if self.links:
                self.linked += len(" ".join(raw.split()))

    def flush(self) -> None:
        if block := " ".join("".join(self.text).split()):
            self.out.blocks.append(Block(block, min(self.linked, len(block)), self.group, self.hints > 0, self.named > 0))
        self.text.clear()
        self.linked = 0

    def past(self, mark: str, at: int) -> int:
        found = self.page.find(mark, at)
        return len(self.page) if found < 0 else found + len(mark)

    def tag(self, at: int) -> int:
        page = self.page
        if page.startswith("<!--", at):
            return self.past("-->", at + 4)
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            return self.past(">", at)
        closing = after == "/"
        m = _NAME.match(page, at + 1 + closing) if self.last[">"] > at else None
        if not m:
            self.add("<")
            return at + 1
        name, attributes, at = m[0].lower(), {}, m.end()
        while True:
            m = _ATTRIBUTE.match(page, at)
            if not m:
                at = len(page)
                break
            at = m.end()
            if m[4]:
                break
            value = m[3] or ""
            if m[2]:
                if self.last[m[2]] < at:  # never closed: the tag ends at its first >
                    at = self.past(">", at)
                    break
                end = page.index(m[2], at)
                value, at = page[at:end], end + 1
            if m[1]:
                attributes.setdefault(m[1].lower(), value)
        if closing:
            self.end(name)
        else:
            at = self.start(name, attributes, at)
        return at

    def start(self, name: str, attributes: dict[str, str], at: int) -> int:
        if name not in _IN_HEAD and name not in ("head", "html") and self.open.get("head"):
            self.close("head")
        if name in _RAW:
            m = re.compile(f"</{name}", re.I).search(self.page, at)
            return self.past(">", m.end()) if m else len(self.page)
        for old in _ENDS.get(name, ()):
            if self.open.get(old) and self.open[old][-1] > max((self.open[x][-1] for x in _ENDED[old][1] if self.open.get(x)), default=-1):
                self.close(old)
        self.breaks(name)
        if name in _VOID:
            return at
        drops, named, hints = self.judge(name, attributes)
        holds = name in ("article", "main") and not self.dropped and not named and not drops
        if (drops or named or hints or holds) and not self.dropped:
            self.flush()
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, self.group if holds else None, drops, named, hints, name == "a"))
        if holds:
            self.out.parents.append(self.group)
            self.out.names.append(name)
            self.group = len(self.out.parents) - 1
        self.dropped += drops
        self.named += named
        self.hints += hints
        self.links += name == "a"
        return at

    def judge(self, name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
        """Whether an element is set apart by HTML itself, is named as furniture, and may be furniture."""
        if name in _DROPPED or (name == "header" and self.group == _NONE):
            return True, False, False
        if not attributes or name in ("html", "body", "main"):
            return False, False, False
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "").lower()):
            return True, False, False
        if _ROLES.intersection(attributes.get("role", "").lower().split()):
            return True, False, False
        named, hint = _furniture(f"{attributes.get('class', '')} {attributes.get('id', '')}")
        return False, named, hint and not named and name != "article"

    def breaks(self, name: str) -> None:
        if not self.dropped:
            if name in _BLOCK:
                self.flush()
            elif name in _SPACE:
                self.text.append(" ")

    def end(self, name: str) -> None:
        if self.open.get(name):
            self.breaks(name)
            self.close(name)

    def close(self, name: str) -> None:
        """Everything down to the innermost open element of that name."""
        to = self.open[name][-1]
        while len(self.stack) > to:
            top, around, drops, named, hints, link = self.stack.pop()
            self.open[top].pop()
            if (drops or named or hints or around is not None) and not self.dropped:
                self.flush()
            if around is not None:
                self.group = around
            self.dropped -= drops
            self.named -= named
            self.hints -= hints
            self.links -= link


def parse(page: str) -> Page:
    return _Parser(page).run()


def _ambiguous(p: Page) -> list[int]:
    """Blocks of which structure doesn't say whether they are the article's, by number."""
    return [i for i, b in enumerate(p.blocks) if b.hint or b.named or b.group == _NONE or p.names[b.group] == "main"]


def _unique_part(words: list[str], covered: list[bool], run: int) -> str:
    """A block without its covered runs; a run that has come over from a neighbouring block and is short stays."""
    out, at = [], 0
    for is_covered, same in itertools.groupby(covered):
        n = len(list(same))
        if not is_covered or (n < run and n < len(words)):
            out += words[at : at + n]
        at += n
    return " ".join(out)


def choose(p: Page, covered: dict[int, list[bool]], run: int) -> list[str]:
    """The article's blocks. covered: by ambiguous block, whether each of its words is in a run that the host repeats."""
    texts = ["" if b.named else b.text for b in p.blocks]
    for i, marks in covered.items():
        b = p.blocks[i]
        if b.named:
            continue
        if b.group == _NONE or p.names[b.group] == "main":
            texts[i] = _unique_part(b.text.split(" "), marks, run)
        elif b.hint and 5 * sum(marks) >= 4 * len(marks):
            texts[i] = ""
    size = Counter()
    for b, text in zip(p.blocks, texts, strict=True):
        size[b.group] += b.prose * len(text) // max(1, len(b.text))
    articles = [g for g, name in enumerate(p.names) if name == "article"]
    best = max(articles, key=lambda g: (size[g], -g), default=None)
    chosen = set()
    if best is not None:
        # articles beside it may be parts of it; those inside it or around it aren't, nor are much shorter ones
        chosen = {g for g in articles if g == best or (p.parents[g] == p.parents[best] and 2 * size[g] >= size[best] > 0)}
    mains = [g for g, name in enumerate(p.names) if name == "main"]
    main, rest = sum(size[g] for g in mains), size[_NONE]
    own = sum(size[g] for g in chosen)
    if main and main > 2 * own:
        chosen, own = set(mains), main
    if rest > 2 * own:
        chosen = {_NONE}
    out = []
    for b, text in zip(p.blocks, texts, strict=True):
        if text and b.group in chosen and (b.group != _NONE or b.prose):
            out.append(text)
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_GAP = "\x1e"
_PARSED = "page_id long, url string, html string, text string, host string, stream string, key binary"


def _stream(p: Page, own: str) -> str | None:
    """Each token after its host; a block ends with an empty token."""
    return " ".join(own + x for i in _ambiguous(p) for x in [*p.blocks[i].text.split(" "), ""]) or None


def _open_or_sure(run: int):
    def each(batches):
        for batch in batches:
            sources, texts, hosts, streams, keys = [], [], [], [], []
            for url, raw in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                page = (raw or b"").decode("utf-8", "replace")
                p, host = parse(page), host_of(url)
                sure = choose(p, {}, run)
                other = choose(p, {i: [True] * len(p.blocks[i].text.split(" ")) for i in _ambiguous(p)}, run)
                sources.append(None if sure == other else page)
                texts.append("\n\n".join(sure) if sure == other else None)
                hosts.append(host)
                streams.append(_stream(p, host + _GAP))
                keys.append(hashlib.sha256(host.encode() + b"\0" + (raw or b"")).digest())
            made = [*(pa.array(x, pa.string()) for x in (sources, texts, hosts, streams)), pa.array(keys, pa.binary())]
            yield pa.record_batch([batch["page_id"], batch["url"], *made], names=["page_id", "url", "html", "text", "host", "stream", "key"])

    return each


_COVERED = pa.schema([("doc_id", pa.int64()), ("covered", pa.binary())])


def _bits(u: Units, ids: list, gone: np.ndarray) -> pa.Table:
    bits = [np.packbits(gone[a : a + n]).tobytes() for a, n in zip(u.first.tolist(), u.count.tolist(), strict=True)]
    return pa.table([pa.array(ids, pa.int64()), pa.array(bits, pa.binary())], schema=_COVERED)


def _decide(run: int):
    def each(batches):
        for batch in batches:
            out = []
            for page, bits in zip(batch["html"].to_pylist(), batch["covered"].to_pylist(), strict=True):
                p = parse(page)
                marks, at, covered = np.unpackbits(np.frombuffer(bits or b"", np.uint8)).astype(bool).tolist(), 0, {}
                for i in _ambiguous(p):
                    n = len(p.blocks[i].text.split(" "))
                    covered[i] = marks[at : at + n]
                    at += n + 1
                out.append("\n\n".join(choose(p, covered, run)))
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return each


def extract_main_text(pages: DataFrame, run: int = 10, share: float = 0.3, least: int = 3, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    A run of `run` tokens is boilerplate if that share of a host's distinct pages have it, and `least` at least.
    Blocks are joined by an empty line, white space in a block is one space, character references are
    decoded. Null and empty html: an empty text. A null url's host is the empty one. Rows that share a
    page_id each have a result. Other columns are ignored; an empty table gives none.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    parsed = Written(bounded(pages).mapInArrow(_open_or_sure(run), _PARSED), "parsed").read()
    # copies of a page at one host are one page
    streams = Written(parsed.where("stream is not null").groupBy("key").agg(F.first("stream").alias("text"), F.first("host").alias("host")).withColumn("doc_id", F.monotonically_increasing_id()), "streams").read()
    # a hot host's pages are dealt over salts
    number = streams.groupBy("host").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * share)).cast("long").alias("need")
    salted = streams.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    ready = salted.join(number, ["host", "salt"]).select("doc_id", "text", need)
    plan = Plan("word", run, (run + 1) // 2, every=True)
    covered = remove_repeats(ready, plan, _bits, _COVERED)
    covered = covered.join(streams.select("doc_id", "key"), "doc_id").select("key", "covered")
    undecided = parsed.where("html is not null").select("page_id", "url", "html", "key")
    found = bounded(undecided.join(covered, "key", "left").select("page_id", "url", "html", "covered")).mapInArrow(_decide(run), "page_id long, url string, text string")
    out = parsed.where("html is null").select("page_id", "url", "text").unionAll(found)
    free_shuffles(spark)
    return out.withColumn("n_chars", F.length("text").cast("long"))
