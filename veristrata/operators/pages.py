"""Articles out of web pages: title, date, body with provenance; text clean-up; near-equal paragraphs."""

from __future__ import annotations

import json
import re
import unicodedata
from difflib import SequenceMatcher
from html.parser import HTMLParser
from typing import Iterator  # noqa: UP035 - what Spark reads off a function

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import in_slices

EXTRACT = "title string, title_from string, published string, date_from string, body string, paragraphs int, status string"
_DROP = {"script", "style", "nav", "footer", "aside", "noscript", "form", "header", "iframe"}
_VOID = {"br", "img", "meta", "link", "input", "hr", "source"}


class _Reader(HTMLParser):
    """Paragraphs, headings, metadata and JSON-LD of a page; what stands in navigation and the like is skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.depth = 0, None, 0
        self.parts: list[str] = []
        self.found: dict[str, list[str]] = {"p": [], "h1": [], "time": [], "ld": []}
        self.meta: dict[str, str] = {}
        self.where: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a.get("content") or "")
        if tag == "script" and a.get("type") == "application/ld+json":
            self._begin("ld")
        elif tag in _DROP or (tag == "div" and re.search(r"\b(?:ad|ads|advert|comment|related)\b", a.get("class") or "")):
            self.skip += 1
            self.where = self.where or tag
        elif tag in ("p", "h1", "time") and not self.skip:
            self._begin(tag)
            if tag == "time" and a.get("datetime"):
                self.found["time"].append(a["datetime"])
        elif tag == "br":
            self.parts.append(" ")

    def _begin(self, kind: str) -> None:
        self._end()
        self.open, self.parts = kind, []

    def _end(self) -> None:
        if self.open and (text := " ".join("".join(self.parts).split())):
            self.found[self.open].append(text)
        self.open, self.parts = None, []

    def handle_endtag(self, tag):
        if self.open and tag in (self.open, "script", "article", "div", "body"):
            self._end()
        if self.skip and (tag in _DROP or tag == "div"):
            self.skip -= 1

    def handle_data(self, data):
        if self.open and (not self.skip or self.open == "ld"):
            self.parts.append(data)

    def close(self):
        super().close()
        self._end()


def json_objects(value) -> list[dict]:
    """All objects of a JSON-LD value: lists and ``@graph`` are walked."""
    if isinstance(value, list):
        return [o for x in value for o in json_objects(x)]
    return [value, *json_objects(value.get("@graph", []))] if isinstance(value, dict) else []


def iso_date(text: str | None) -> str | None:
    """An ISO date, or year, month and day of 20YY with other marks; else None."""
    m = re.search(r"(20\d{2})\s*[./년-]\s*(\d{1,2})\s*[./월-]\s*(\d{1,2})", text or "")
    return f"{int(m[1]):04d}-{int(m[2]):02d}-{int(m[3]):02d}" if m and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31 else None


def iso_date_column(text: Column) -> Column:
    """``iso_date`` as an expression."""
    p = r"(20\d{2})\s*[./년-]\s*(\d{1,2})\s*[./월-]\s*(\d{1,2})"
    y, m, d = (F.regexp_extract(text, p, i).try_cast("int") for i in (1, 2, 3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))


def good(paragraphs: list[str], least: int = 100) -> bool:
    text = re.sub(r"\s+", "", "".join(paragraphs))
    return len(text) >= least and len(re.findall(r"[A-Za-z가-힣]", text)) >= 30


def extract(html: str | None) -> dict:
    """Title: JSON-LD, then og:title, then h1. Date: JSON-LD, then meta, then time. Body: paragraphs, if they are enough."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    objects = []
    for block in reader.found["ld"]:
        try:
            objects += json_objects(json.loads(block))
        except ValueError:
            continue
    pick = lambda *choices: next(((v.strip(), n) for n, v in choices if isinstance(v, str) and v.strip()), (None, None))
    kinds = lambda o: o["@type"] if isinstance(o.get("@type"), list) else [o.get("@type")]
    told = [o for o in objects if any(str(k).lower() in ("article", "newsarticle", "reportagenewsarticle") for k in kinds(o))]
    first = lambda key: next((o[key] for o in told if isinstance(o.get(key), str)), None)
    title, title_from = pick(("jsonld", first("headline")), ("og", reader.meta.get("og:title")), ("h1", next(iter(reader.found["h1"]), None)))
    dates = (("jsonld", first("datePublished")), ("meta", reader.meta.get("article:published_time")), ("time", next(iter(reader.found["time"]), None)))
    day, date_from = next(((iso_date(v), n) for n, v in dates if iso_date(v)), (None, None))
    body = reader.found["p"]
    ok = good(body)
    return {"title": title, "title_from": title_from, "published": day, "date_from": date_from, "body": "\n".join(body) if ok else None, "paragraphs": len(body), "status": "OK" if ok else "BODY_TOO_SHORT"}


def html_extract(html: Column) -> Column:
    @F.pandas_udf(EXTRACT)
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from in_slices(pages, lambda rows: pd.DataFrame([extract(x) for x in rows], columns=[c.split()[0] for c in EXTRACT.split(", ")]))

    return run(html)


def html_paragraphs(html: Column) -> Column:
    """Texts of ``<p>`` by regular expressions alone: blocks that hold no article text first go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|aside|noscript|form)\b.*?</\1>", " ")
    inner = F.regexp_extract_all(bare, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    clean = F.transform(inner, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?s)<[^>]*>", " "), r"\s+", " ")))
    return F.filter(clean, lambda p: p != "")


def quality(text: Column, least: int = 100) -> Column:
    return (F.length(F.regexp_replace(text, r"\s+", "")) >= least) & (F.regexp_count(text, F.lit("[A-Za-z가-힣]")) >= 30)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def nfkc(text: Column, form: str = "NFKC") -> Column:
    """A Unicode normal form, which has no built-in function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run(text)


def merge_near_equal(paragraphs: list[str], least: float = 0.7) -> list[str]:
    """Paragraphs in order, without blank ones; of one and the last that was kept, if they are alike but for white space and have the same numbers, the longer stays.

    The kept list is the state of the fold: a paragraph is held against its last one only, so the work is that of neighbours.
    """
    kept: list[str] = []
    numbers, flat = (lambda x: re.findall(r"\d[\d,.]*", x)), (lambda x: re.sub(r"\s+", " ", x).strip())
    for text in (p.strip() for p in paragraphs if p and p.strip()):
        if kept and numbers(kept[-1]) == numbers(text) and SequenceMatcher(None, flat(kept[-1]), flat(text)).ratio() > least:
            kept[-1] = max(kept[-1], text, key=len)
        else:
            kept.append(text)
    return kept


def near_dup_paragraphs(paragraphs: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else merge_near_equal(list(x)))

    return run(paragraphs)


def json_object(text: Column, schema: str) -> Column:
    """The object from the first brace to the last, read by a schema; null if it cannot be."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


# What is no article text, where publishers keep theirs, and where articles are found in general.
UNWANTED = {"script", "style", "noscript", "nav", "footer", "aside"}
UNWANTED_CLASSES = {"advertisement", "ad", "ads", "related", "recommend", "subscription", "comment", "reply", "share"}
PUBLISHERS = {
    "KHAN_ARTICLE_V1": (("khan.co.kr", "www.khan.co.kr"), ("#articleBody .content_text", "#articleBody", "article")),
    "CHOSUN_ARTICLE_V1": (("chosun.com", "www.chosun.com"), ("#news-body", ".article-body", ".article_body", ".article_txt", ".article_content", "article")),
    "JOONGANG_ARTICLE_V1": (("joongang.co.kr", "www.joongang.co.kr"), ("#article_body", ".article_body", ".article-body", ".article-content", ".article_content", "article")),
    "DONGA_ARTICLE_V1": (("donga.com", "www.donga.com"), ("#article_body", ".article_txt", ".article-body", ".article_body", ".article_view", ".view_body", "article")),
    "NAVER_NEWS_ARTICLE_V1": (("n.news.naver.com", "news.naver.com"), ("#dic_area", "#newsct_article", "#newsEndContents", "#articeBody", "article")),
}
GENERIC = (
    "article[itemprop='articleBody']", "[itemprop='articleBody']", "article", "main article", ".article-body", ".article_body", ".article-content", ".article_content",
    "#articleBody", "#article_body", "#newsct_article", "#dic_area", "#newsEndContents", "#articeBody",
)
BODY = "body string, selector string, adapter string, paragraphs int"


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def wanted(self) -> bool:
        return self.tag not in UNWANTED and not UNWANTED_CLASSES & set((self.attrs.get("class") or "").split())

    def walk(self):
        """This node and all under it, in order, without unwanted ones."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node) and c.wanted()]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.wanted():
                stack += reversed(node.children)
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    """A page as nodes; an end tag closes the nearest open node of its name, or nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = self.root = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _fits(node: _Node, simple: tuple[str, str, str, str, str]) -> bool:
    tag, ident, cls, key, value = simple
    return (
        (not tag or node.tag == tag) and (not ident or node.attrs.get("id") == ident) and (not cls or cls in (node.attrs.get("class") or "").split())
        and (not key or node.attrs.get(key) == value)
    )


def select(root: _Node, selector: str) -> list[_Node]:
    """Nodes that fit a selector of tags, ids, classes and attributes, with spaces for "somewhere under"."""
    steps = [re.fullmatch(r"([a-z0-9]*)(?:#([\w-]+))?(?:\.([\w-]+))?(?:\[(\w+)='([^']*)'\])?", s).groups("") for s in selector.split()]
    found = []
    for node in root.walk():
        if not _fits(node, steps[-1]):
            continue
        up, left = node.parent, steps[:-1]
        while up is not None and left:
            if _fits(up, left[-1]):
                left = left[:-1]
            up = up.parent
        if not left:
            found.append(node)
    return found


def body_of(html: str | None, host: str | None) -> tuple:
    """(body, selector, adapter, paragraphs): by the publisher's selectors the first that gives enough text; else of the general ones that which gives most.

    All nodes of a selector count together: their paragraphs, or, without any, a node's whole text.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()

    def paragraphs(selector: str) -> list[str]:
        out = []
        for node in select(tree.root, selector):
            own = [t for p in node.walk() if p.tag == "p" and (t := p.text())]
            out += own or [t for t in [node.text()] if t]
        return out

    plain = (host or "").lower().rstrip(".")
    for name, (hosts, selectors) in PUBLISHERS.items():
        if plain in hosts:
            for selector in selectors:
                if good(ps := paragraphs(selector), 80):
                    return "\n\n".join(ps), selector, name, len(ps)
    best = max(((len("\n\n".join(ps)), -i, selector, ps) for i, selector in enumerate(GENERIC) if good(ps := paragraphs(selector))), default=None, key=lambda x: x[:2])
    return ("\n\n".join(best[3]), best[2], "GENERIC", len(best[3])) if best else (None, None, None, 0)


def html_body(html: Column, host: Column) -> Column:
    """struct of ``BODY``."""

    @F.pandas_udf(BODY)
    def run(pages: pd.Series, hosts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([body_of(x, h) for x, h in zip(pages, hosts, strict=True)], columns=["body", "selector", "adapter", "paragraphs"])

    return run(html, host)


def normalize_text(raw: Column) -> Column:
    """NFC, without markdown marks and bracketed notes on pictures; line ends as one, at most one blank line."""
    t = F.regexp_replace(nfkc(F.coalesce(raw, F.lit("")), "NFC"), r"\r\n?", "\n")
    for pattern, new in ((r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*(?:```.*|[-*_]{3,})\s*$", ""), (r"\*\*([^*\n]+)\*\*", "$1"), (r"\[(?:이미지|사진|그림|image|photo)[^\]\n]*\]", ""), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, new)
    return F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))
