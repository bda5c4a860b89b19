"""HTML to text, absolute links and taxonomy records, as Arrow UDFs on the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "title", "template"}
_BLOCK = set("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Reader(HTMLParser):
    """Collects links, table rows, the binomial name and text lines in one pass."""

    def __init__(self, plain: bool = False):
        super().__init__(convert_charrefs=True)
        self.plain = plain
        self.hidden = self.heading = 0
        self.hrefs: list[str] = []
        self.lines: list[str] = [""]
        self.open_links: list[str | None] = []
        self.rows: list[list[str]] = []
        self.tables: list[bool] = []
        self.cell = self.binomial = False
        self.name = ""

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        kinds = set(values.get("class", "").split())
        if tag == "body":
            self.hidden = 0
        if tag in _HIDDEN:
            self.hidden += 1
        if tag == "a":
            if "href" in values and not self.hidden:
                self.hrefs.append(values["href"])
            self.open_links.append(values.get("href"))
        if tag in _BLOCK or tag == "br":
            self.lines.append("* " if tag == "li" and not self.plain else "")
        self.heading += tag in _HEADING
        if tag == "table":
            self.tables.append({"infobox", "biota"} <= kinds)
        if any(self.tables):
            if tag == "tr":
                self.rows.append([])
            if tag == "td" and self.rows:
                self.rows[-1].append("")
                self.cell = True
        if tag == "span" and "binomial" in kinds and not self.name:
            self.binomial = True

    def handle_endtag(self, tag):
        if tag == "head":
            self.hidden = 0
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "a" and self.open_links:
            href = self.open_links.pop()
            if href and not self.plain and not self.hidden:
                self.lines[-1] += f" [{href}]"
        if tag in _HEADING and self.heading:
            self.heading -= 1
        if tag in _BLOCK:
            self.lines.append("")
        if tag == "table" and self.tables:
            self.tables.pop()
        if tag == "td":
            self.cell = False
        if tag == "span":
            self.binomial = False

    def handle_data(self, data):
        if self.hidden:
            return
        shown = re.sub(r"\s+", " ", data)
        self.lines[-1] += shown.upper() if self.heading and not self.plain else shown
        if self.cell and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data
        if self.binomial:
            self.name += data


def _read(html: str | None, plain: bool = False) -> _Reader:
    reader = _Reader(plain)
    reader.feed(html or "")
    reader.close()
    return reader


def page_text(html: str | None) -> str:
    """Readable text: headings in capitals, link targets in brackets, no title, script or style."""
    lines = (re.sub(r" +", " ", line).strip() for line in _read(html).lines)
    return "\n".join(line for line in lines if line)


def plain_text(html: str | None) -> str:
    """All rendered text, joined by single spaces."""
    return " ".join(" ".join(_read(html, plain=True).lines).split())


def base_of(url: str) -> str:
    """The base that relative links resolve against: no ``index.html``, and a slash at the end."""
    url = re.sub(r"index\.html$", "", url)
    return url if url.endswith("/") else url + "/"


def resolved_links(html: str | None, url: str | None) -> list[str]:
    """Absolute targets of all anchors with an href, in page order."""
    base = base_of(url or "")
    out = []
    for href in _read(html).hrefs:
        try:
            out.append(urljoin(base, href.strip()))
        except ValueError:
            continue
    return out


def taxonomy(html: str | None) -> dict:
    """(label, value) pairs of two-cell infobox rows, and the binomial name."""
    reader = _read(html)
    pairs = [(a.strip().lower()[:-1], b.strip().lower()) for a, b in (r for r in reader.rows if len(r) == 2)]
    return {"hierarchy": [{"label": a, "value": b} for a, b in pairs], "binomial_name": reader.name.strip() or None}


def _texts(htmls: pd.Series) -> pd.Series:
    return htmls.map(page_text)


def _plain_texts(htmls: pd.Series) -> pd.Series:
    return htmls.map(plain_text)


def _resolved(htmls: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series([resolved_links(h, u) for h, u in zip(htmls, urls, strict=True)])


def _hrefs(htmls: pd.Series) -> pd.Series:
    return htmls.map(lambda h: _read(h).hrefs)


def _taxonomies(htmls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([taxonomy(h) for h in htmls], columns=["hierarchy", "binomial_name"])


def page_text_col(html: Column | str) -> Column:
    return F.pandas_udf(_texts, "string")(html)


def plain_text_col(html: Column | str) -> Column:
    return F.pandas_udf(_plain_texts, "string")(html)


def resolved_links_col(html: Column | str, url: Column | str) -> Column:
    return F.pandas_udf(_resolved, "array<string>")(html, url)


def taxonomy_col(html: Column | str) -> Column:
    """Struct of ``hierarchy`` (label, value) and ``binomial_name``."""
    return F.pandas_udf(_taxonomies, "hierarchy array<struct<label string, value string>>, binomial_name string")(html)


def hrefs_col(html: Column | str) -> Column:
    """The href values of all anchors as they are written, in page order; none in comments and scripts."""
    return F.pandas_udf(_hrefs, "array<string>")(html)


def in_scope(link: Column) -> Column:
    """Encyclopedia links that are no images, anchors or special pages (the letter cases are listed as they count)."""
    return link.isNotNull() & link.startswith("/wiki/") & ~link.rlike("\\.(JPG|jpg|JPEG|jpeg|PNG|png)|[#:]")


def is_target(hierarchy: Column) -> Column:
    """Plants, fungi, cnidarians and butterflies."""

    def has(label: str, value: str) -> Column:
        return F.exists(hierarchy, lambda h: (h["label"] == label) & F.contains(h["value"], F.lit(value)))

    return has("kingdom", "plantae") | has("kingdom", "fungi") | has("phylum", "cnidaria") | has("order", "lepidoptera")


def is_indexable(hierarchy: Column, binomial_name: Column) -> Column:
    return is_target(hierarchy) & F.coalesce(binomial_name != "", F.lit(False))
