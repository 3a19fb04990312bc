"""Links of documents as a table function: url, type and page of each, for LATERAL use from SQL."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.extraction import LINK_RULES

#: Between two pages of a document's text.
PAGE_MARK = "\f"


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v is not None]


def links(markup: str | None) -> list[tuple[str, str, int]]:
    """(url, type, page) of the links in order; none where the markup breaks off inside a tag, on any of its pages."""
    out = []
    for page, part in enumerate((markup or "").split(PAGE_MARK), 1):
        parser = _Links()
        parser.feed(part)
        if parser.rawdata.startswith("<"):
            return []
        for url in parser.found:
            low = url.lower()
            out.append((url, next((kind for kind, marks in LINK_RULES if any(m in low for m in marks)), "other"), page))
    return out


class DocumentLinks:
    def eval(self, markup: str | None) -> Iterator[tuple[str, str, int]]:
        yield from links(markup)


def register(spark: SparkSession, name: str = "document_links") -> None:
    """Make the table function known to SQL: select ... from docs, lateral document_links(docs.markup). Rows go to it and back as Arrow batches."""
    spark.udtf.register(name, F.udtf(DocumentLinks, returnType="url string, type string, page int", useArrow=True))
