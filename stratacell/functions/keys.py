"""Canonical keys of models, benchmarks and metrics, and rules that read labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routes before a model's name, and words that don't tell models apart.
ROUTES = ("openai", "anthropic", "google", "meta", "mistral", "deepseek", "bedrock", "azure", "us")
IDLE_WORDS = ("latest", "api", "model", "snapshot", "exp")

#: Spellings of one model.
MODEL_NAMES = {"gpt4o": "gpt-4o", "gpt-4-o": "gpt-4o", "gpt4": "gpt-4", "gpt3.5-turbo": "gpt-3.5-turbo", "gemini-3.0-pro": "gemini-3-pro", "deepseek-chat": "deepseek-v3"}

#: Names that say which benchmark and, if qualified, which split.
BENCHMARKS = {
    "swebench": ("swe-bench", None),
    "swebenchverified": ("swe-bench", "verified"),
    "swebenchlite": ("swe-bench", "lite"),
    "gaia": ("gaia", None),
    "taubench": ("tau-bench", None),
    "webarena": ("webarena", None),
}
SPLITS = {"verified": "verified", "lite": "lite", "full": "full", "test": "full", "validation": "validation", "val": "validation"}

#: Words in a metric's name for which less is better, and for which more is, whatever else it says.
LESS = r"(?i)error|loss|\bcost|price|latency|\btime\b|seconds|duration|\bsteps\b|tokens|\brank\b|regret|violation|halluc|\bfail|perplex|overhead"
MORE = r"(?i)saving|speed ?-?up|bugs? (?:fixed|found)|success|accuracy|pass|score|\bf1\b|recall"

#: Marks of an arm that lacks a part; the first ones count in notes too.
LACKS = (("ablation", r"(?i)\bablat"), ("without", r"(?i)\bw/\s?o\b|\bwithout\b"), ("variant", r"(?i)\bvariant of\b"))
LACKS_IN_LABEL = (("only", r"(?i)\bonly\b"), ("minus", r"^\s*[-−]\s*\w"), ("no_part", r"(?i)^no[\s-]\w"), ("own", r"(?i)\bours\b"))

#: Wording of removals and additions.
REMOVAL = r"(?i)\bw/\s?o\b|\bwithout\b|^no\s|^\s*[-−]|\bminus\b|\bremov"
ADDITION = r"(?i)\bwith\b|\bw/(?!\s?o\b)|^\s*\+|\badd"

#: Families of model names.
MODEL_FAMILY = r"(?i)^(?:gpt|claude|gemini|llama|qwen|deepseek|mistral|o[134])(?:[-\s.]?[a-z0-9.]+)*$"


def fold(text: Column) -> Column:
    """Letters and digits only, the Greek tau spelled out."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "τ", "tau"), "[^a-z0-9]+", "")


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical_model(text: Column) -> Column:
    """A model's name without route, dates and idle words; bare numbers in a row are one version. Null if no letter is left or two models are named."""
    low = F.lower(F.trim(text))
    dated = F.regexp_replace(low, r"\(?\b20\d{2}-?\d{2}-?\d{2}\b\)?", " ")
    plain = F.regexp_replace(F.regexp_replace(dated, r"[()]", " "), r"^(?:\s*(?:" + "|".join(ROUTES) + r")[/.])+", "")
    parts = F.filter(F.split(plain, r"[^a-z0-9.+]+"), lambda t: (t != "") & ~t.isin(*IDLE_WORDS))
    last = lambda a: F.element_at(a, -1)

    def joined(a: Column, t: Column) -> Column:
        version = (F.size(a) > 0) & t.rlike(r"^\d+$") & F.coalesce(F.try_element_at(a, F.lit(-1)).rlike(r"^[0-9.]+$"), F.lit(False))
        return F.when(version, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last(F.concat(F.array(F.lit("")), a)), F.lit("."), t)))).otherwise(F.concat(a, F.array(t)))

    name = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), joined), "-")
    several = plain.rlike(r"/|,|\band\b|\+")
    return F.when(~several & name.rlike("[a-z]"), F.coalesce(looked_up(name, MODEL_NAMES), name))


def direction(metric: Column, unknown_else: bool = False) -> Column:
    """higher, lower or unknown. By one policy what no word decides is higher, by the other unknown and less wins over more."""
    blank = F.trim(F.coalesce(metric, F.lit(""))) == ""
    if unknown_else:
        return F.when(blank, "unknown").when(metric.rlike(LESS), "lower").when(metric.rlike(MORE), "higher").otherwise("unknown")
    return F.when(blank, "unknown").when(metric.rlike(MORE), "higher").when(metric.rlike(LESS), "lower").otherwise("higher")


def lacking(label: Column, note: Column) -> Column:
    """The first mark of an arm without a part; null for other arms."""
    both = F.concat_ws(" || ", label, F.coalesce(note, F.lit("")))
    return F.coalesce(*[F.when(both.rlike(p), n) for n, p in LACKS], *[F.when(label.rlike(p), n) for n, p in LACKS_IN_LABEL])


def signal(label: Column) -> Column:
    """removal, addition or both, by a label's wording; null for none."""
    out, into = label.rlike(REMOVAL), label.rlike(ADDITION)
    return F.when(out & into, "both").when(out, "removal").when(into, "addition")


def contradiction(label: Column, full: Column, turned: Column) -> Column:
    """Whether a label contradicts the direction that its row has (added or removed)."""
    own, other = signal(label), F.coalesce(signal(full), F.lit(""))
    reduced = other.isin("removal", "both")
    return F.coalesce((own == "removal") & (turned == "added") & ~reduced, F.lit(False)) | F.coalesce((own == "addition") & (turned == "removed") & (label.rlike(r"(?i)^\s*\+|^add") | reduced), F.lit(False))


def locator_fault(locator: Column) -> Column:
    """missing, without_line, malformed or null, for a place in a repository (path:line) or a paper (section, page, table)."""
    return F.when(F.coalesce(F.trim(locator), F.lit("")) == "", "missing").when(locator.rlike(r"^[\w./-]+\.\w+:\d+(?:-\d+)?$"), None).when(locator.rlike(r"^[\w./-]+/[\w.-]+$"), "without_line").when(locator.rlike(r"(?i)\b(?:sec(?:tion)?|p(?:age)?|table|fig(?:ure)?|app(?:endix)?)\.?\s*[A-Z0-9]"), None).otherwise("malformed")


def score_places(score: Column, text: Column, glued: bool = False) -> Column:
    """Positions (from 0) at which a text has a number with nothing numeric beside it; glued lets a decimal stand right after other digits."""
    core = F.regexp_replace(score, r"^[+-]", "")
    lead = F.when(core.contains("."), F.lit(r"(?<![.])")).otherwise(F.lit(r"(?<![\d.])")) if glued else F.lit(r"(?<![\d.])")
    pattern = F.concat(lead, F.lit(r"\Q"), core, F.lit(r"\E(?!\d|\.\d)"))
    cuts = F.split(text, pattern)
    ends = F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda x, i: F.aggregate(F.slice(cuts, F.lit(1), i + 1), F.lit(0), lambda a, c: a + F.length(c)) + i * F.length(core))
    return F.when(score.rlike(r"^[+-]?\d+(?:\.\d+)?$"), ends).otherwise(F.array().cast("array<int>"))


def is_model(text: Column) -> Column:
    return F.trim(text).rlike(MODEL_FAMILY)


def without_model(label: Column) -> tuple[Column, Column]:
    """A label without the model that it ends with, in parentheses or after a plus or with; and that model."""
    found = F.regexp_extract(label, r"(?i)^(.*?)\s*(?:\(([^()]+)\)|\s(?:\+|with)\s+(\S.*))$", 0)
    model = F.coalesce(*[F.when(F.regexp_extract(label, r"(?i)^(.*?)\s*(?:\(([^()]+)\)|\s(?:\+|with)\s+(\S.*))$", k) != "", F.regexp_extract(label, r"(?i)^(.*?)\s*(?:\(([^()]+)\)|\s(?:\+|with)\s+(\S.*))$", k)) for k in (2, 3)])
    split = (found != "") & is_model(model)
    return F.when(split, F.regexp_extract(label, r"(?i)^(.*?)\s*(?:\(([^()]+)\)|\s(?:\+|with)\s+(\S.*))$", 1)).otherwise(label), F.when(split, model)


def plain_code(code: Column) -> Column:
    """Code without comments, blank lines and space at the ends of lines."""
    lines = F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "#.*$", ""), r"\s+\z", ""))
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")


def decision(text: Column) -> Column:
    """include, exclude or unknown, from how a decision is worded."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low == "", "unknown").when(low.rlike("exclud|not included|fail|false") & ~low.contains("include"), "exclude").when(low.rlike("includ|pass|true|yes|eligible"), "include").when(low == "no", "exclude").otherwise("unknown")
