"""Catalogues that are written as lists of maps in YAML, as rows; the part of the format that they use, without a library."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def scalar(text: str) -> str:
    """A value without its quotes, or without a comment after it."""
    text = text.strip()
    if quoted := re.match(r"""(?:'((?:[^']|'')*)'|"((?:[^"\\]|\\.)*)")""", text):
        return quoted[1].replace("''", "'") if quoted[1] is not None else re.sub(r"\\(.)", r"\1", quoted[2])
    return re.sub(r"\s+#.*$", "", text)


def listed_maps(text: str) -> Iterator[dict[str, str]]:
    """Each item of the outermost list: its scalars by key; nested lists and maps are passed over."""
    entry: dict[str, str] | None = None
    indent = 0
    for line in text.splitlines():
        body = line.lstrip(" ")
        depth = len(line) - len(body)
        if not body or body.startswith("#"):
            continue
        if body.startswith("- ") and (entry is None or depth < indent):
            if entry:
                yield entry
            body = body[2:].lstrip(" ")
            entry, indent = {}, len(line) - len(body)
            depth = indent
        if entry is not None and depth == indent and (m := re.match(r"([\w.-]+):(?:\s+(.*))?$", body)) and m[2]:
            entry[m[1]] = scalar(m[2])
    if entry:
        yield entry


def catalogues(files: DataFrame, id_: str, text: str) -> DataFrame:
    """id_ and entry (a map) of every item of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(i, e) for i, t in zip(p[id_], p[text], strict=True) for e in listed_maps(t or "")], columns=[id_, "entry"])

    return files.select(id_, text).mapInPandas(run, f"{id_} {files.schema[id_].dataType.simpleString()}, entry map<string,string>")
