"""A page's elements in document order, and the pieces that records are made of.

Parsing needs a parser, so it runs in Arrow batches; it yields texts alone. What the texts mean is read by columns.
Elements are rows of one list: an element's text is a run of the page's strings, so that no text is stored twice.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd

NOISE = ("script", "style", "nav", "footer", "header", "iframe", "noscript", "aside")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag ends the open elements named, up to the nearest list or table.
_ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_WALLS = frozenset(("ul", "ol", "table", "dl", "select", "div", "section", "body"))
_HEADINGS = ("h1", "h2", "h3", "h4")

# Where each site keeps things. Sections are found by a word of their text and go on for some siblings.
SECTION_TAGS = ("h2", "h3", "h4", "div", "section", "p")


@dataclass(frozen=True)
class Site:
    name: str
    eligibility: tuple[str, int] | None = None
    charges: tuple[str, int] | None = None
    rate_class: str | None = None
    item: tuple[int, int] = (15, 250)
    features: str | None = None  # how list items become features: by the list's parent, by their number, by their words


SITES = {
    "icicibank.com": Site("ICICI", ("eligibility|who can apply|criteria", 7), ("processing fee|charges|fees", 0), "rate|interest|roi", (15, 250), "parent"),
    "axisbank.com": Site("Axis", ("eligibility|who can apply", 9), ("interest rate|charges|fee", 5), None, (15, 250), "number"),
    "sbi.co.in": Site("SBI", ("eligibility|who can avail|criteria", 8)),
    "onlinesbi.sbi": Site("SBI", ("eligibility|who can avail|criteria", 8)),
    "paisabazaar.com": Site("Paisabazaar", item=(20, 300), features="words"),
    "bankbazaar.com": Site("BankBazaar", rate_class="rate|starting|interest", item=(30, 500), features="faq"),
}
GENERIC = Site("Unknown")
FEATURE_LISTS = "feature|benefit|highlight|advantage"
FEATURE_WORDS = r"\b(?:rate|eligib|income|salary|cibil|fee|tenure|amount)\b"
FACT_WORDS = r"\d+\.?\d*\s*%|\binterest\b|\beligib\b|\bsalary\b"
FINANCE = r"eligib|interest\s*rate|fee|charge|income|salary|cibil|credit\s*score|loan\s*amount|tenure|age|apply|feature|benefit|documentation|who\s*can"
COMPARISON = "bank|interest|rate|lender"


def site_of(host: str) -> Site:
    return next((site for part, site in SITES.items() if part in host), GENERIC)


@dataclass
class _Element:
    tag: str
    attrs: dict
    parent: int
    a: int  # its strings are [a, z); its raw text is [ra, rz)
    ra: int
    z: int = 0
    rz: int = 0
    kids: list[int] = field(default_factory=list)


class Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.all: list[_Element] = []
        self.strings: list[str] = []
        self.raw = ""
        self.json: list[str] = []
        self._open: list[int] = []
        self._noise: list[str] = []
        self._parts: list[str] = []
        self._size = 0
        self._ld = False
        self.feed(html)
        self.close()
        while self._open:
            self._end()
        self.raw = "".join(self._parts)

    def updatepos(self, i, j):
        return j  # lines are not counted: nothing asks for them

    def _end(self):
        e = self.all[self._open.pop()]
        e.z, e.rz = len(self.strings), self._size

    def handle_starttag(self, tag, attrs):
        if self._noise or tag in NOISE:
            if tag not in _VOID:
                self._noise.append(tag)
            self._ld = tag == "script" and dict(attrs).get("type") == "application/ld+json"
            return
        while self._open and self.all[self._open[-1]].tag in _ENDS.get(tag, ()):
            self._end()
        if tag in ("td", "th", "tr", "li"):  # something inside the cell or item is still open
            kept = [k for k in self._open if self.all[k].tag in _WALLS or self.all[k].tag in _ENDS[tag]]
            if kept and self.all[kept[-1]].tag in _ENDS[tag]:
                while self._open[-1] != kept[-1]:
                    self._end()
                self._end()
        parent = self._open[-1] if self._open else -1
        self.all.append(_Element(tag, dict(attrs), parent, len(self.strings), self._size))
        if parent >= 0:
            self.all[parent].kids.append(len(self.all) - 1)
        self._open.append(len(self.all) - 1)
        if tag in _VOID:
            self._end()

    def handle_endtag(self, tag):
        if self._noise:
            if tag in self._noise:
                while self._noise.pop() != tag:
                    pass
            return
        if any(self.all[k].tag == tag for k in self._open):
            while self.all[self._open[-1]].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if self._noise:
            if self._ld and self._noise[-1] == "script":
                self.json.append(data)
            return
        self._parts.append(data)
        self._size += len(data)
        if text := " ".join(data.split()):
            self.strings.append(text)

    # ---- reading

    def text(self, k: int) -> str:
        e = self.all[k]
        return " ".join(self.strings[e.a : e.z])

    def of(self, *tags: str, within: int | None = None) -> list[int]:
        inside = range(len(self.all)) if within is None else self._below(within)
        return [k for k in inside if self.all[k].tag in tags]

    def _below(self, k: int) -> list[int]:
        out, todo = [], list(reversed(self.all[k].kids))
        while todo:
            j = todo.pop()
            out.append(j)
            todo += reversed(self.all[j].kids)
        return out

    def classed(self, pattern: str, within: int | None = None) -> list[int]:
        inside = range(len(self.all)) if within is None else self._below(within)
        wanted = re.compile(pattern, re.I)
        return [k for k in inside if any(wanted.search(c) for c in (self.all[k].attrs.get("class") or "").split())]

    def siblings(self, k: int) -> list[int]:
        parent = self.all[k].parent
        own = self.all[parent].kids if parent >= 0 else [j for j, e in enumerate(self.all) if e.parent < 0]
        return own[own.index(k) + 1 :]

    def section(self, words: str) -> int | None:
        wanted = re.compile(words, re.I)
        return next((k for k in self.of(*SECTION_TAGS) if wanted.search(self.raw, self.all[k].ra, self.all[k].rz)), None)

    def run(self, where: tuple[str, int] | None) -> str | None:
        """A section and the siblings that belong to it."""
        k = self.section(where[0]) if where else None
        return None if k is None else " ".join(map(self.text, [k, *self.siblings(k)[: where[1]]]))

    def rows(self, table: int, tags: tuple[str, ...] = ("td", "th"), empty: bool = False) -> list[list[str]]:
        every = [[t for c in self.of(*tags, within=r) if (t := self.text(c)) or empty] for r in self.of("tr", within=table)]
        return every if empty else [r for r in every if r]


def _strings(value, depth: int = 0):
    """The strings of a JSON value, numbers as text, down to five levels."""
    if depth <= 5:
        if isinstance(value, (list, dict)):
            for x in value.values() if isinstance(value, dict) else value:
                yield from _strings(x, depth + 1)
        elif isinstance(value, (str, int, float)):
            yield str(value)


def _json_texts(p: Page) -> list[str]:
    out = []
    for raw in p.json:
        try:
            found = json.loads(raw)
        except ValueError:
            continue
        for item in found if isinstance(found, list) else [found]:
            out.append(" ".join(s for s in _strings(item) if len(s) > 20))
    return [x for x in out if x]


def sections(p: Page) -> list[dict]:
    """Each heading with its siblings' text up to the next heading, and their list items."""
    out = []
    for h in p.of(*_HEADINGS):
        texts, items = [], []
        for k in p.siblings(h):
            if p.all[k].tag in _HEADINGS:
                break
            if t := p.text(k):
                texts.append(t)
                items += [p.text(i) for i in p.of("li", within=k)]
        out.append({"heading": p.text(h), "text": " ".join(texts), "items": items})
    return out


def _main(p: Page) -> str:
    """The text of the first main, else article, else element named or classed like content, else body."""
    named = lambda attr, words: [k for k, e in enumerate(p.all) if re.search(words, e.attrs.get(attr) or "", re.I)]
    for found in (p.of("main"), p.of("article"), named("id", "content|main|body"), p.classed("content|main|body|container"), p.of("body")):
        if found:
            return p.text(found[0])
    return " ".join(p.strings)


def _distinct(texts) -> list[str]:
    return list(dict.fromkeys(texts))


def _features(p: Page, site: Site) -> list[str]:
    low, high = site.item
    fits = lambda t: low < len(t) < high
    lists = p.of("ul")
    if site.features == "parent":
        chosen = [k for k in lists if re.search(FEATURE_LISTS, p.text(p.all[k].parent) if p.all[k].parent >= 0 else "", re.I)]
        return [t for k in chosen for i in p.of("li", within=k) if fits(t := p.text(i))]
    if site.features == "number":
        each = [[t for i in p.of("li", within=k) if fits(t := p.text(i))] for k in lists]
        return [t for x in each if len(x) >= 3 for t in x]
    if site.features == "words":
        return [t for i in p.of("li") if fits(t := p.text(i)) and re.search(FEATURE_WORDS, t, re.I)]
    if site.features == "faq":
        found = p.classed("faq|question|accordion")
        where = found[0] if found else p.section("frequently asked|faq")
        if where is None:
            return []
        pairs = [f"{p.text(q)} {p.text(p.siblings(q)[0])}" for q in p.classed(r"question|q\b", within=where) if p.siblings(q)]
        return [t[:400] for t in pairs if fits(t)]
    return []


def _compared(p: Page, site: Site) -> tuple[list[str], str | None]:
    """Facts (`header: cell | ...`) of comparison tables, and the last such table (of the second site: the first) as text."""
    facts: list[str] = []
    told: list[str] = []
    pairs = lambda head, row: " | ".join(f"{h}: {c}" for h, c in zip(head, row) if c)
    for t in p.of("table"):
        if site.name == "Paisabazaar":
            rows = p.rows(t)
            head, body = (rows[0], rows[1:]) if rows else ([], [])
            if len(body) < 2 or not re.search(COMPARISON, " ".join(head).lower()):
                continue
            facts += [pairs(head, r) for r in body if len(r) > 1]
        else:
            rows = p.rows(t, empty=True)
            if not rows or not any(re.search(COMPARISON, h, re.I) for h in rows[0]):
                continue
            head, body = rows[0], [r for r in p.rows(t, ("td",), empty=True)[1:] if any(r)]
            facts += [pairs(head, r) for r in body]
        told.append("\n".join(" | ".join(r) for r in [head, *body])[:3000])
    if site.name == "BankBazaar":
        facts, told = _distinct(facts), told[:1]
    return [f for f in facts if f], told[-1] if told else None


def pieces(html: str | None, host: str | None) -> dict:
    p, site = Page(html or ""), site_of((host or "").lower())
    names = ("description", "og:description", "twitter:description")
    metas = [e.attrs.get("content") for e in p.all if e.tag == "meta" and (e.attrs.get("name") or e.attrs.get("property") or "").lower() in names]
    facts, told = _compared(p, site) if site.name in ("Paisabazaar", "BankBazaar") else ([], None)
    spoken = [p.text(k) for k in p.of("p", "li")] if site.name == "SBI" else []
    headings = [p.text(k) for k in p.of("h1")]
    return {
        "site": site.name,
        "json": _json_texts(p),
        "sections": sections(p),
        "tables": [r for t in p.of("table") if (r := p.rows(t))],
        "metas": [m for m in metas if m],
        "full": " ".join(p.strings),
        "main": _main(p),
        "links": [{"href": (p.all[k].attrs.get("href") or "").strip(), "text": p.text(k)} for k in p.of("a")],
        "h1": headings[0] if headings else None,
        "rates": [p.text(k) for k in p.classed(site.rate_class)] if site.rate_class else [],
        "eligibility": p.run(site.eligibility),
        "charges": p.run(site.charges),
        "cells": " ".join(p.text(k) for k in p.of("p", "td", "li")) if site.name == "SBI" else None,
        "features": _distinct(_features(p, site)),
        "facts": facts or _distinct(t for t in spoken if 30 < len(t) < 500 and re.search(FACT_WORDS, t, re.I)),
        "compared": told,
    }


def pieces_of(html: pd.Series, hosts: pd.Series) -> pd.DataFrame:
    """The pieces of each page of a batch."""

    def one(page, name):
        try:
            return pieces(page, name)
        except Exception:  # whatever breaks on a page's markup: the page counts as empty, the batch goes on
            return pieces(None, None)

    return pd.DataFrame([one(*x) for x in zip(html, hosts, strict=True)], columns=list(pieces(None, None)))


def sections_of(html: pd.Series) -> pd.Series:
    return html.map(lambda x: sections(Page(x or "")))
