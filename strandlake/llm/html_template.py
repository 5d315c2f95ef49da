"""Main text of web pages by template deduction.

A page is a sequence of tokens: tags by their path (names, classes and ids of the open blocks) and text blocks by their
path and wording. Over the different pages of one host a token has an occurrence vector, how often it stands in each.
Tokens with equal vectors form an equivalence class; a class is valid if it spans MIN_PAGES pages or more, holds a tag,
and has MIN_TOKENS tokens. Valid classes nest by the paths of their tags: that is the host's template, one tree for each
layout, as tags of different layouts have different vectors. Text of a valid class is part of the template and dropped.
Every other text block fills a slot: the innermost container of a valid class that stands once in each of its pages.

The article is found by the template: of the slots that a page has, the one with the most text that is no link over the
whole host, template text and the semantic elements outside an article (nav, aside, footer, form and the like) not
counted. Its region is that slot with all that nests in it, or the article or main element around it; a heading before a
region without one belongs to it. Elements of the region whose class or id names adverts, comments, sharing and the like
are left out, but never the region itself or what is around it. Where a host has no valid class (fewer pages than
MIN_PAGES), the page's own containers that stand once are its template and the text lengths its own.

Vectors are compared by sums over pages of the count times two numbers of the page's digest, so that Spark can aggregate
them before a shuffle: no host's pages are ever gathered. Copies of a page on a host count once.

Text: character references decoded, white space inside a block one space, blocks joined by two newlines. Null and empty
html gives an empty text; text outside any element is a block like others; a page without a url has the host ''; repeated
rows are repeated, extra columns ignored; an empty table gives an empty result; ties go to the path that sorts first.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.spark_io import durable

#: Pages that a valid class spans at least, and tokens that it has at least.
MIN_PAGES = 5
MIN_TOKENS = 2
#: Bytes of templates up to which they are broadcast; beyond, pages are joined to them by host and salt.
BROADCAST_BYTES = 8_000_000
SALTS = 16

RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "select", "object", "canvas", "title")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLOCKS = frozenset("html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary dialog hr menu search button center".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head"},
}
SCOPES = frozenset("ul ol dl table article section main div body td th blockquote form nav aside header footer".split())
OUTSIDE = frozenset("head nav aside form footer dialog menu search button fieldset".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations footer masthead toolbar pagination pager copyright".split())
HEADING = re.compile(r"/h1[^/]*$")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre figcaption blockquote summary address".split())


@dataclass
class Block:
    """One text block: its path, its containers' paths from outside in, and its wording.

    outside: by a semantic element or because it is hidden; marked: the outermost path that a class or id marks.
    """

    path: str
    around: tuple[str, ...]
    outside: bool
    marked: str
    text: str
    links: int


@dataclass
class _Open:
    name: str
    path: str
    around: tuple[str, ...]
    outside: bool
    marked: str
    inside: bool


@dataclass
class Page:
    """Tag counts by path (the page itself has the path ''), paths of containers, of article and main elements, blocks."""

    tags: Counter
    containers: set[str]
    regions: set[str] = field(default_factory=set)
    blocks: list[Block] = field(default_factory=list)


def parse(html: str) -> Page:
    """Blocks and tag counts of a page; end tags may be missing, inline tags are no boundary."""
    page, words, links, in_link = Page(Counter({"": 1}), {""}), [], 0, False
    stack = [_Open("", "", ("",), False, "", False)]

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if text:
                top = stack[-1]
                page.blocks.append(Block(top.path, top.around, top.outside, top.marked, text, min(links, len(text))))
            links = 0

    for found in TOKEN.finditer(html):
        piece = found.group()
        if piece[0] != "<" or piece == "<":
            words.append(piece)
            links += len(piece) if in_link else 0
            continue
        name = found.group(3)
        if not name:
            if found.group(1):
                words.append(" ")
            continue
        name = name.lower()
        if name == "a":
            in_link = not found.group(2)
            continue
        if name in ("br", "img", "input", "wbr"):
            if name != "wbr":
                words.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if found.group(2):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        in_link = False
        shut = CLOSES.get(name, {"p"})
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in shut:
                del stack[k:]
                if name == "tr":
                    continue
                break
            if stack[k].name in SCOPES:
                break
        attrs = {a.lower(): (x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(found.group(4))} if found.group(4).strip() else {}
        marks = " ".join(sorted(re.split(r"[^a-z]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))).strip()
        up = stack[-1]
        main = name in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        outside = up.outside or name in OUTSIDE or (name == "header" and not up.inside) or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        outside = outside or bool(HIDDEN.search(attrs.get("style", ""))) or attrs.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog")
        path = f"{up.path}/{name}" + (f".{marks}" if marks else "")
        marked = up.marked or ("" if main or name in ("html", "body") or MARKS.isdisjoint(marks.split()) else path)
        page.tags[path] += 1
        if name not in LEAVES:
            page.containers.add(path)
            if main:
                page.regions.add(path)
        if name != "hr":
            stack.append(_Open(name, path, up.around if name in LEAVES else (*up.around, path), outside, marked, up.inside or main))
    flush()
    return page


def masses(page: Page) -> Counter:
    """Characters of text that is no link, by every container around it."""
    out: Counter = Counter()
    for b in page.blocks:
        if not b.outside:
            for path in b.around:
                out[path] += len(b.text) - b.links
    return out


def token(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}") - (1 << 63)


def host_of(url):
    """The host in lower case, without user and port."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", ""))


SEEN = "host string, token long, kind int, name string, pages long, total long, s1 long, s2 long, low long, high long, mass long"


def occurrences(pages: DataFrame) -> DataFrame:
    """Occurrence vectors' sums by host and token, of (host, html, digest): kind 1 a tag with its path and the text under
    it, kind 2 a text block with its container. Added up in the task first, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, html, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                page, low, high = parse(html), digest & 0x7FFFFFFF, (digest >> 33) & 0x7FFFFFFF
                mass = masses(page)
                rows = [(token("tag", p), 1, p if p in page.containers else None, n, mass[p]) for p, n in page.tags.items()]
                texts = Counter((b.path, b.text, b.around[-1]) for b in page.blocks)
                rows += [(token("text", p, x), 2, c, n, n * len(x)) for (p, x, c), n in texts.items()]
                for t, kind, name, n, m in rows:
                    got = sums.get((host, t))
                    if got is None:
                        sums[host, t] = [kind, name, 1, n, n * low, n * high, digest, digest, m]
                    else:
                        got[2] += 1
                        got[3] += n
                        got[4] += n * low
                        got[5] += n * high
                        got[6], got[7] = min(got[6], digest), max(got[7], digest)
                        got[8] += m
            keys = list(zip(*sums, strict=True)) if sums else [(), ()]
            values = list(zip(*sums.values(), strict=True)) if sums else [()] * 9
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*keys, *values], kinds, strict=True)], [x.split()[0] for x in SEEN.split(", ")])

    added = [F.sum(c).alias(c) for c in ("pages", "total", "s1", "s2", "mass")]
    seen = pages.select("host", "html", "digest").mapInArrow(run, SEEN)
    return seen.groupBy("host", "token", "kind").agg(F.min("name").alias("name"), F.min("low").alias("low"), F.max("high").alias("high"), *added)


def first_copies(pages: DataFrame) -> DataFrame:
    """(host, html, digest): copies of a page on its host once. The copied pages are broadcast if they are few."""
    copied = pages.groupBy("host", "digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("host", "digest", "first")
    copied = durable(copied, "copies")
    if copied.count() * 64 <= BROADCAST_BYTES:
        copied = F.broadcast(copied)
    return pages.join(copied, ["host", "digest"], "left").where("first is null or id = first").select("host", "html", "digest")


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots, fixed) of (id, host, html, digest): the host's slots (path, mass) and its template's text tokens
    (token, container, mass)."""
    vector = ["host", "pages", "total", "s1", "s2"]
    seen = durable(occurrences(first_copies(pages)).where((F.col("pages") >= MIN_PAGES) & (F.col("low") != F.col("high"))), "tokens")
    valid = seen.groupBy(*vector).agg(F.max(F.col("kind") == 1).alias("tag"), F.count("*").alias("n")).where((F.col("n") >= MIN_TOKENS) & F.col("tag")).select(vector)
    kept = seen.join(valid, vector)
    slots = kept.where("kind = 1 and total = pages and name is not null").groupBy("host").agg(F.collect_list(F.struct("name", "mass")).alias("slots"))
    fixed = kept.where("kind = 2").groupBy("host").agg(F.collect_list(F.struct("token", "name", "mass")).alias("fixed"))
    return slots.join(fixed, "host", "left")


def under(path: str, top: str) -> bool:
    return path == top or not top or path.startswith(top + "/")


class Template:
    """Slots of a host with the mass of their own, and the template's text."""

    def __init__(self, slots: list[tuple[str, int]], fixed: list[tuple[int, str, int]]):
        mass = {"": 0} | dict(slots)
        self.fixed = {t for t, _, _ in fixed}
        for _, container, m in fixed:
            for path in mass:
                if under(container, path):
                    mass[path] -= m
        self.own = dict(mass)
        for path, m in mass.items():
            if path:
                self.own[self.slot_of(path.rpartition("/")[0])] -= m

    def slot_of(self, path: str) -> str:
        """The innermost slot at or around a path."""
        while path and path not in self.own:
            path = path.rpartition("/")[0]
        return path


def main_text(html: str, template: Template | None) -> str:
    page = parse(html)
    if template is None:
        mass = masses(page)
        template = Template([(p, mass[p]) for p in page.containers if page.tags[p] == 1], [])
    blocks = [(b, template.slot_of(b.around[-1])) for b in page.blocks if not b.outside and (not template.fixed or token("text", b.path, b.text) not in template.fixed)]
    open_ = [slot for b, slot in blocks if not b.marked or under(slot, b.marked)]
    if not open_:
        return ""
    best = min(set(open_), key=lambda x: (-template.own[x], x))
    around = [p for p in page.regions if under(best, p) and any(under(b.around[-1], p) for b, _ in blocks)]
    region = min(around, key=len) if around else best
    out, head = [], []
    for b, _ in blocks:
        if under(b.around[-1], region):
            if not b.marked or under(region, b.marked):
                out.append(b)
        elif not out and not b.marked and HEADING.search(b.path):
            head.append(b)
    if not any(HEADING.search(b.path) for b in out):
        out = [*head, *out]
    return "\n\n".join(b.text for b in out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    html = F.coalesce(pages[html_col], F.lit(""))
    base = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), html.alias("html"), host_of(pages[url_col]).alias("host"), F.xxhash64(html).alias("digest"))
    found = durable(templates(base), "templates")
    weight = found.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    base = base.drop("digest")
    if weight <= BROADCAST_BYTES:
        joined = base.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, known = [], {}
            host, html, slots, fixed = (batch.column(i) for i in (2, 3, 4, 5))
            for i, (h, x) in enumerate(zip(host.to_pylist(), html.to_pylist(), strict=True)):
                if h not in known:
                    known[h] = Template([(s["name"], s["mass"]) for s in slots[i].as_py()], [(f["token"], f["name"], f["mass"]) for f in fixed[i].as_py() or ()]) if slots[i].is_valid else None
                text.append(main_text(x, known[h]) if x else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(np.array([len(x) for x in text], np.int64))], [id_col, url_col, "text", "n_chars"])

    return joined.select("id", "url", "host", "html", "slots", "fixed").mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
