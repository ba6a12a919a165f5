"""Scalar functions on names, identifiers, numbers, dates and prose, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers that follow a number.
SCALES = {"k": 1e3, "K": 1e3, "M": 1e6, "m": 1e6, "B": 1e9, "b": 1e9}

#: Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def norm_title(title: Column) -> Column:
    """Lower case, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether a quote's letters and digits are a run of the text's."""
    return (F.length(squash(quote)) > 0) & squash(text).contains(squash(quote))


def doi(text: Column) -> Column:
    found = F.regexp_extract(F.lower(text), r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)
    return F.when(found != "", F.rtrim(F.regexp_replace(found, r"[.,;)]+$", "")))


def preprint_id(text: Column) -> Column:
    """A four-and-five digit preprint number with a month that exists, without its version."""
    found = F.regexp_extract(text, r"([0-9]{2}(?:0[1-9]|1[0-2])\.[0-9]{4,5})(?:v[0-9]+)?", 1)
    return F.when(found != "", found)


#: Hosts of repositories.
REPO_HOSTS = ("github.com", "gitlab.com", "huggingface.co", "bitbucket.org", "codeberg.org")


def repo_key(url: Column) -> Column:
    """host/owner/name of a repository's address, lower case, without .git, and the folder in it that a tree or blob address names; null for any other address."""
    plain = F.regexp_replace(F.lower(F.trim(url)), r"^(https?://)?(www\.)?", "")
    parts = F.split(F.rtrim(F.regexp_replace(plain, r"[#?].*$|/+$", "")), "/")
    folder = F.slice(parts, 6, F.greatest(F.size(parts) - 5, F.lit(0)))
    last = F.try_element_at(folder, F.lit(-1))
    folder = F.when(last.rlike(r"^readme(\.\w+)?$") & (F.size(folder) > 1), F.slice(folder, F.lit(1), F.size(folder) - 1)).otherwise(folder)
    named = F.try_element_at(parts, F.lit(4)).isin("tree", "blob") & (F.size(folder) > 0)
    whole = F.concat(F.slice(parts, 1, 2), F.array(F.regexp_replace(F.try_element_at(parts, F.lit(3)), r"\.git$", "")), F.when(named, folder).otherwise(F.array().cast("array<string>")))
    known = F.try_element_at(parts, F.lit(1)).isin(*REPO_HOSTS) & (F.size(parts) >= 3) & ~F.exists(F.slice(parts, 1, 3), lambda x: x == "")
    return F.when(known, F.array_join(whole, "/"))


#: Where a version stands in a name, the first that fits; the number's first part is the major version.
VERSIONS = (
    r"(?:^|[\s_-])v\.?\s?(\d+)(?:\.\d+)*$",  # v2 at the end
    r"(?:^|[\s_-])v\.?\s?(\d+)(?:\.\d+)*(?=\s)",  # v2 before other words
    r"[\s_-](\d+)(?:\.\d+)*$",  # a number at the end
    r"(?<=[a-z])(\d+)(?:\.\d+)*$",  # a number that ends a word
)


def version_split(name: Column) -> tuple[Column, Column]:
    """A lower-case name without its version, and the version's first number; a name needs two letters or digits beside it."""
    low = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    base, major = low, F.lit(None).cast("long")
    for p in reversed(VERSIONS):
        at = F.regexp_instr(low, F.lit(p))
        found = F.regexp_extract(low, p, 0)
        rest = F.concat_ws(" ", F.substring(low, F.lit(1), at - 1), F.substring(low, at + F.length(found), F.length(low)))
        rest = F.regexp_replace(F.regexp_replace(rest, r"^[ _-]+|[ _-]+$", ""), r"\s+", " ")
        fits = (at > 0) & (F.length(squash(rest)) >= 2)
        base, major = F.when(fits, rest).otherwise(base), F.when(fits, F.regexp_extract(low, p, 1).cast("long")).otherwise(major)
    return base, major


#: What a paper puts around a number, and what then counts as one.
NUMBER = r"[+-]?\d+(?:\.\d+)?"
AROUND = (
    r"\([^)]*\)",  # an aside
    r"\s*(?:±|\+/-|\+-)\s*" + NUMBER + r"\s*%?",  # an error bar
    r"(?i)^\s*(?:~|≈|≃|about|approx\.?|approximately|ca\.?)\s*",
    r"[%$,]",
    r"(?i)\b(?:pp|points?|percent|percentage|usd|dollars?)\b",
)


def clean_number(text: Column) -> Column:
    """The number of a text that is nothing else, its decoration aside; null for ranges and words."""
    plain = F.regexp_replace(text, "[−–—]", "-")
    for p in AROUND:
        plain = F.trim(F.regexp_replace(plain, p, " " if p == AROUND[0] else ""))
    return F.when(plain.rlike(f"^{NUMBER}$"), plain.try_cast("double"))


def scaled_number(text: Column) -> Column:
    """A number with k, M or B after it; below zero is nothing."""
    x = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*([kKmMbB]?)\b", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*([kKmMbB]?)\b", 2)
    times = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in SCALES.items() for v in kv]), unit), F.lit(1.0))
    return F.when(x >= 0, x * times)


def numbers_in(text: Column) -> Column:
    """All numbers of a text; spaces around a decimal point and separators of thousands are mended."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?<=\d)\s*\.\s*(?=\d)", "."), r"(?<=\d),(?=\d{3}(?!\d))", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def traced(score: Column, text: Column) -> Column:
    """Whether a text has the number, or a hundred times it."""
    near = lambda x, y: F.abs(x - y) <= 1e-9 * F.greatest(F.abs(y), F.lit(1.0))
    return F.exists(numbers_in(text), lambda x: near(x, score) | near(x, score * 100))


def partial_date(text: Column) -> Column:
    """ISO text of a date at the precision that it has: year, month or day."""
    low = F.lower(F.trim(text))
    number = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(MONTHS, 1))):
        number = F.when(low.contains(m[:3]), f"{i:02d}").otherwise(number)
    year, day = F.regexp_extract(low, r"\b([0-9]{4})\b", 1), F.regexp_extract(low, r"\b([0-9]{1,2})\b", 1)
    iso = low.rlike(r"^[0-9]{4}([-/][0-9]{1,2}){0,2}$")
    parts = F.split(low, "[-/]")
    as_iso = F.array_join(F.transform(parts, lambda p: F.lpad(p, F.when(F.length(p) == 4, 4).otherwise(2), F.lit("0"))), "-")
    return F.when(iso, as_iso).when((year != "") & number.isNotNull(), F.concat_ws("-", year, number, F.when(day != "", F.lpad(day, 2, "0")))).when(year != "", year)


def signal_counts(text: Column, terms: dict[str, str]) -> dict[str, Column]:
    """How often each named pattern occurs."""
    return {name: F.regexp_count(text, F.lit(p)) for name, p in terms.items()}


def header(text: Column) -> tuple[Column, Column]:
    """The block of key: value lines before the first blank line, as a map, and the body; of a repeated key the last value. Without such a block the map is empty and the body all text."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.split(plain, "\n\n", 2)
    lines = F.filter(F.split(F.element_at(parts, 1), "\n"), lambda x: F.trim(x) != "")
    whole = (F.size(parts) == 2) & (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike("^[a-z_]+:"))
    keyed = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    last = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda y: y["key"] == x["key"]))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(whole, F.map_from_entries(last)).otherwise(none), F.when(whole, F.element_at(parts, -1)).otherwise(plain)


def sentences(text: Column, least: int, most: int) -> Column:
    """The first distinct sentences of at least that many characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim)
    return F.slice(F.array_distinct(F.filter(parts, lambda s: F.length(s) >= least)), 1, most)


def without_references(text: Column) -> Column:
    """A text up to its first heading of references beyond its first fifth; earlier ones stand in a table of contents."""
    from_ = F.ceil(F.length(text) * 0.2).cast("int")  # the character before stays, to see that a line begins
    at = F.regexp_instr(F.substring(text, from_, F.length(text)), F.lit(r"(?i)(?<=\n)[ \t]*(references|bibliography)[ \t]*(?=\n|\z)"))
    return F.when(at > 0, F.regexp_replace(F.substring(text, F.lit(1), from_ + at - 2), r"\s+\z", "")).otherwise(text)


def plain_text(text: Column) -> Column:
    """Words joined that a line end hyphenates, control characters gone, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"\s+", " "))


def tokens(text: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def letters(n: Column) -> Column:
    """a, b, ... z, aa, ab, ... for 0, 1, 2, ..., of any size."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("text"))
    step = lambda s, _: F.when(s["rest"] < 0, s).otherwise(F.struct((F.floor(s["rest"] / 26) - 1).cast("long").alias("rest"), F.concat(F.char(s["rest"] % 26 + 97), s["text"]).alias("text")))
    return F.when(n >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(11)), start, step, lambda s: s["text"]))


def from_code_point(n: Column) -> Column:
    """The character of a code point, of any size; char() wraps at 256."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, F.lit("0"))), "UTF-32")


def from_inverted(index: Column) -> Column:
    """The text of a map from words to positions."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")


def tag_stripped(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</(script|style|nav)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def leaks(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in patterns.items()]))


def evidence_split(text: Column) -> tuple[Column, Column]:
    """A quote and its locator: the balanced parentheses that end the text. Without them all is the quote."""
    plain = F.regexp_replace(text, r"\s+\z", "")
    signs = F.reverse(F.regexp_extract_all(plain, F.lit(r"([()])"), F.lit(1)))
    # From the right: the first sign after which as many have opened as closed is where the locator begins.
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("opened"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        depth, opened = s["depth"] + F.when(c == ")", 1).otherwise(-1), s["opened"] + F.when(c == "(", 1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), opened.alias("opened"), (depth == 0).alias("done")))

    state = F.aggregate(signs, start, step)
    found = F.endswith(plain, F.lit(")")) & state["done"]
    inner = F.array_join(F.slice(F.split(plain, r"\("), -F.greatest(state["opened"], F.lit(1)), F.greatest(state["opened"], F.lit(1))), "(")
    at = F.length(plain) - F.length(inner)
    quote = F.regexp_replace(F.substring(plain, F.lit(1), at - 1), r"\s+\z", "")
    return F.when(found, quote).otherwise(text), F.when(found, F.substring(plain, at + 1, F.length(plain) - at - 1))
