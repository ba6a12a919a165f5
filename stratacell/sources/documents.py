"""Structured text to rows: markup pages, lists and tables, embedded JSON. Parsers keep state, so they are Python, a document a call."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

HIDDEN = {"script", "style", "nav", "template"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.title, self.parts, self.in_title = 0, "", [], False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.in_title = tag == "title"

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)


def page_text(html: str | None) -> tuple[str, str]:
    """Title and visible text of a page."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return p.title.strip(), re.sub(r"\s+", " ", " ".join(p.parts)).strip()


LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")


def list_items(markdown: str) -> Iterator[tuple[str, str, str]]:
    """Section path, link text and address of each link in an item of a list or in a row of a table."""
    path: list[str] = []
    for line in markdown.splitlines():
        if h := re.match(r"(#+)\s+(.*)", line):
            path = path[: len(h[1]) - 1] + [h[2].strip()]
        elif re.match(r"\s*(?:[-*]\s|\|)", line) and not re.fullmatch(r"[\s|:-]+", line):
            for name, url in LINK.findall(line):
                yield "/".join(path), name, url


def lists_to_rows(files: DataFrame, id_: str, text: str) -> DataFrame:
    """id_, section, name, url of every link in the lists and tables of each file."""

    def run(batches):
        for p in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(p[id_], p[text], strict=True) for x in list_items(t or "")], columns=[id_, "section", "name", "url"])

    return files.select(id_, text).mapInPandas(run, f"{id_} {files.schema[id_].dataType.simpleString()}, section string, name string, url string")


def streamed_payload(html: str) -> str:
    """The text that a page streams to its scripts, as pieces of JSON strings that are pushed to an array."""
    pieces = re.findall(r'\.push\(\[\s*1\s*,\s*("(?:[^"\\]|\\.)*")\s*\]\)', html)
    return "".join(json.loads(p) for p in pieces)


def embedded_objects(html: str, key: str) -> Iterator[dict]:
    """Every JSON object in a page that has the key at its top level."""
    decode = json.JSONDecoder()
    at = 0
    while (at := html.find("{", at)) >= 0:
        try:
            value, end = decode.raw_decode(html, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict) and key in value:
            yield value
            at = end
        else:
            at += 1


def pages_to_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text of every page, batch by batch."""

    def run(batches):
        for p in batches:
            got = [page_text(h) for h in p["html"]]
            yield pd.DataFrame({"page_id": p["page_id"], "title": [t for t, _ in got], "text": [x for _, x in got]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string")
