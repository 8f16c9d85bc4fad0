"""HTML pages to title and content, with the standard parser in an Arrow batch function."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.title: list[str] | None = None
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "title"):
            self.inside.append(tag)
            if tag == "title" and self.title is None:
                self.title = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if "script" in self.inside or "style" in self.inside:
            return
        if "title" in self.inside and self.title is not None:
            self.title.append(data)
        if text := data.strip():
            self.texts.append(text)


def read_page(page: str | bytes) -> tuple[str, str]:
    """(title, content): content is every text node but those of scripts and styles, stripped and joined by one space."""
    if isinstance(page, bytes):
        page = page.decode("utf-8", "ignore")
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.title or []), " ".join(reader.texts)


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [value for name, value in attrs if name == "href" and value]


def read_links(page: str) -> list[str]:
    """The href of every anchor that has one."""
    reader = _Anchors()
    reader.feed(page)
    reader.close()
    return reader.found


_PAGE = StructType().add("title", StringType()).add("content", StringType())


@F.pandas_udf(_PAGE)
def _pages(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(p) if p is not None else (None, None) for p in pages], columns=["title", "content"])


def page(html: Column) -> Column:
    """struct<title, content> of a page, string or binary."""
    return _pages(html)


@F.pandas_udf(ArrayType(StringType()))
def _links(pages: pd.Series) -> pd.Series:
    return pages.map(read_links, na_action="ignore")


def links(html: Column) -> Column:
    """array<string> of the targets of a page's anchors, in order."""
    return _links(html)


def splash_url(html: Column, template: str) -> Column:
    """The download address hidden in a page's last script: its first assignment's JSON fills the template's %s with file id and name."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    value = F.trim(F.regexp_extract(F.split(F.element_at(scripts, -1), ";")[0], r"(?s)=\s*(.*)$", 1))
    return F.format_string(template, F.get_json_object(value, "$.file_id"), F.get_json_object(value, "$.file_name"))
