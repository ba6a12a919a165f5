"""Bibliographies as rows: signs and words of the format first, then entries from them.

A value is parts joined by #: text in braces (which nest), text in quotes (in
which braces nest), a number, or the name of a string that the file defines. A
backslash before a sign of the format makes it plain. Comments and preambles
are passed over; an entry that the file breaks off ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

UNIT = re.compile(r"\s+|\\.|[@{}(),=\"#]|[^\s\\@{}(),=\"#]+", re.S)
PLAIN = re.compile(r"\\([{}%&$#_])")
CLOSES = {"{": "}", "(": ")"}


class Units:
    """The units of a text, one after the other."""

    def __init__(self, text: str) -> None:
        self.all, self.at = UNIT.findall(text), 0

    def next(self) -> str:
        """The next unit as it is, or nothing at the end."""
        self.at += 1
        return self.all[self.at - 1] if self.at <= len(self.all) else ""

    def solid(self) -> str:
        """The next unit that isn't space, which is left to be taken."""
        while self.at < len(self.all) and self.all[self.at].isspace():
            self.at += 1
        return self.all[self.at] if self.at < len(self.all) else ""

    def take(self, sign: str) -> bool:
        found = self.solid() == sign
        self.at += found
        return found

    def until(self, end: str) -> str:
        """All up to a closing sign outside of inner braces, which is passed."""
        out, inner = [], 0
        while (u := self.next()) and (inner or u != end):
            inner += (u == "{") - (u == "}")
            out.append(u)
        return PLAIN.sub(r"\1", "".join(out))

    def word(self, ends: str) -> str:
        """Units up to space or one of some signs."""
        out = [] if self.solid() else [""]
        while self.at < len(self.all) and not self.all[self.at].isspace() and self.all[self.at] not in ends:
            out.append(self.next())
        return "".join(out)


def value(units: Units, strings: dict[str, str]) -> str:
    parts = []
    while True:
        if units.take("{"):
            parts.append(units.until("}"))
        elif units.take('"'):
            parts.append(units.until('"'))
        else:
            name = units.word(",#})")
            parts.append(strings.get(name.lower(), name))
        if not units.take("#"):
            return "".join(parts)


def fields(units: Units, close: str, strings: dict[str, str]) -> Iterator[tuple[str, str]]:
    while (sign := units.solid()) and sign != close:
        if units.take(","):
            continue
        name = units.word("=,})").lower()
        if not units.take("="):
            units.next()
            continue
        yield name, value(units, strings)
    units.take(close)


def entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Kind, key and fields of each entry of a file."""
    units, strings = Units(text), {}
    while units.at < len(units.all):
        if not units.take("@"):
            units.next()
            continue
        kind, opening = units.word("{(").lower(), units.solid()
        if opening not in CLOSES:
            continue
        units.take(opening)
        if kind in ("comment", "preamble"):
            units.until(CLOSES[opening])
        elif kind == "string":
            strings |= dict(fields(units, CLOSES[opening], strings))
        else:
            key = units.word(",})")
            yield kind, key, dict(fields(units, CLOSES[opening], strings))


def bibliography(files: DataFrame, id_: str, text: str) -> DataFrame:
    """id_, kind, key and fields of every entry of each file; files are parsed where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(i, *e) for i, t in zip(p[id_], p[text], strict=True) for e in entries(t or "")], columns=[id_, "kind", "key", "fields"])

    kind = files.schema[id_].dataType.simpleString()
    return files.select(id_, text).mapInPandas(run, f"{id_} {kind}, kind string, key string, fields map<string,string>")
