"""A coding manual in Markdown as rows, and where sources are found."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The parts of an entry, as their headings are written.
PARTS = {"definition": "definition", "values": "value", "decision rule": "rule"}


def manual_rows(text: str) -> Iterator[tuple[str, str, str, str]]:
    """Dimension, part, name and text. A heading of the second level opens a dimension; a part's name with a colon opens a part; a list item is a value with its gloss; other lines go on with what was open."""
    dimension, part, name, said = "", "", "", []

    def closed() -> Iterator[tuple[str, str, str, str]]:
        if dimension and part and (said or name):
            yield dimension, part, name, " ".join(said)
        said.clear()

    for line in text.splitlines():
        bare = line.strip()
        if heading := re.match(r"##\s+`?([\w.-]+)`?", line):
            yield from closed()
            dimension, part, name = heading[1], "", ""
        elif (opened := re.match(r"\**([A-Za-z ]+?)\**:\**\s*(.*)$", bare)) and opened[1].strip().lower() in PARTS:
            yield from closed()
            part, name = PARTS[opened[1].strip().lower()], ""
            said += [opened[2]] if opened[2] else []
        elif part == "value" and (item := re.match(r"[-*]\s+`?([^`:]+?)`?\s*(?::\s*(.*))?$", bare)):
            yield from closed()
            name = item[1].strip()
            said += [item[2]] if item[2] else []
        elif bare:
            said.append(bare)
    yield from closed()


def manuals(files: DataFrame, id_: str, text: str) -> DataFrame:
    """Rows of every manual, each file where it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(i, *r) for i, t in zip(p[id_], p[text], strict=True) for r in manual_rows(t or "")], columns=[id_, "dimension", "part", "name", "said"])

    kind = files.schema[id_].dataType.simpleString()
    return files.select(id_, text).mapInPandas(run, f"{id_} {kind}, dimension string, part string, name string, said string")


@dataclass(frozen=True)
class Located:
    """A folder of sources and how it was found."""

    path: str
    how: str


def located(given: str | None = None, variable: str = "STRATACELL_DATA", marker: str = "entities.json", start: str | None = None) -> Located:
    """The first of: the path that is given, the one that an environment variable names, and the nearest parent of the start that has the marker (itself or in its data folder)."""
    named = os.environ.get(variable)
    for path, how in ((given, "given"), (named, "environment")):
        if path:
            return Located(path, how)
    here = Path(start or os.getcwd()).resolve()
    for folder in (here, *here.parents):
        for place in (folder, folder / "data"):
            if (place / marker).exists():
                return Located(str(place), "parent")
    raise FileNotFoundError(f"no {marker} in {here} or above; give a path or set {variable}")


def packaged(spark: SparkSession, descriptor: dict, root: str) -> dict[str, DataFrame]:
    """The tables of a data package by name, typed by the schemas that it declares; a resource without one is read as text."""
    from stratacell.sources.tables import read_table, typed

    kinds = {"integer": "long", "number": "double", "boolean": "boolean", "date": "date"}
    out = {}
    for r in descriptor["resources"]:
        declared = {f["name"]: kinds[f["type"]] for f in r.get("schema", {}).get("fields", []) if f.get("type") in kinds}
        df = read_table(spark, f"{root}/{r['path']}")
        text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
        out[r["name"]] = typed(df, {c: k for c, k in declared.items() if c in text})
    return out
