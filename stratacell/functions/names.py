"""Names: normal forms and similarities that the built-in functions lack, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def normal_name(name: str | None) -> str | None:
    """Compatibility form, plain dashes and quotes, no text in parentheses, no leading article, lower case."""
    if name is None:
        return None
    plain = unicodedata.normalize("NFKC", name)
    plain = re.sub("[‐-―]", "-", plain)
    plain = re.sub("[‘’]", "'", plain)
    plain = re.sub("[“”]", '"', plain)
    plain = re.sub(r"\([^()]*\)", " ", plain)
    return re.sub(r"^the\s+", "", re.sub(r"\s+", " ", plain).strip().lower())


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, in bit vectors."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """100 for equal strings; 100 (1 - insertions and deletions over both lengths)."""
    if a is None or b is None:
        return None
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def partial_ratio(a: str | None, b: str | None) -> float | None:
    """The best ratio of the shorter string with a run of the longer one of its length."""
    if a is None or b is None:
        return None
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    return max(ratio(short, long[k : k + len(short)]) for k in range(len(long) - len(short) + 1))


@F.pandas_udf(StringType())
def normal_name_udf(names: pd.Series) -> pd.Series:
    return names.map(normal_name, na_action="ignore")


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
